"""From admission days to episodes anchored on each subject's index event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recurra import config as c
from recurra.config import CohortConfig
from recurra.functions.columns import flag_codes, per_subject, subject_keys, yes_no

EPISODE_COLUMNS = [
    "patid", "sex", "district", "dob", "birthyear", "date_admit", "date_dis", "icd_m3", "outcome",
    "diagnosis_en", "time_at_lastfup", "time_dis_to_lastfup", "measles", "infection",
    "age_at_admit_d", "infection_type", "date_admit_index", "date_dis_index", "age_at_index_d",
    "hospitalization", "time_ad_index_to_ad", "period", "age",
]


def flag_admissions(days: DataFrame, cfg: CohortConfig) -> DataFrame:
    return days.withColumn("measles", flag_codes("icd_m3", [cfg.index_code])).withColumn(
        "infection", flag_codes("icd_m3", c.INFECTION_CODES))


def infections_only(days: DataFrame) -> DataFrame:
    return days.where(F.col("infection") == "yes").withColumn(
        "age_at_admit_d", F.datediff("date_admit", "dob"))


def index_cohort(days: DataFrame) -> DataFrame:
    """Subjects with an index event, as a window on the partitioning that is already there."""
    ever = F.max(F.col("measles") == "yes").over(per_subject(days))
    return days.withColumn("_ever", ever).where("_ever").drop("_ever")


def index_order(days: DataFrame) -> DataFrame:
    """`measles_order`: first or second (any repeat) among index rows, "no" for the others."""
    is_index = F.col("measles") == "yes"
    so_far = F.sum(is_index.cast("int")).over(
        per_subject(days, "date_admit").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return days.withColumn(
        "measles_order",
        F.when(~is_index, "no").when(so_far == 1, "first").otherwise("second"),
    )


def gap_days(days: DataFrame) -> DataFrame:
    """`tim_diff`: days from the previous row's discharge; the first row gets a large value."""
    previous = F.lag("date_dis").over(per_subject(days, "date_admit"))
    return days.withColumn(
        "tim_diff", F.coalesce(F.datediff("date_admit", previous), F.lit(c.FIRST_GAP_DAYS)))


def merge_close(days: DataFrame, cfg: CohortConfig) -> DataFrame:
    """Merge admissions at most cfg.gap_days after the previous discharge.

    "pairwise": a close admission takes the visit number of the row before it
    and joins that row only if that row kept its own number. "transitive":
    whole chains. Only the last row of a group stays, with the first admission,
    the latest discharge and the index code of the group; its other values,
    such as the age at admission, are its own.
    """
    if cfg.merge_mode not in ("pairwise", "transitive"):
        raise ValueError(f"unknown merge mode {cfg.merge_mode!r}")
    keys = subject_keys(days)
    ordered = per_subject(days, "date_admit")
    close = (F.col("tim_diff") <= cfg.gap_days).cast("int")
    if cfg.merge_mode == "pairwise":
        group = F.col("visit") - close
    else:
        group = F.sum(1 - close).over(
            ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")
    marked = (
        days.withColumn("visit", F.row_number().over(ordered))
        .withColumn("visit_select", group)
        # Repeats of the index event are complications, not index events.
        .withColumn("icd_m3", F.when(F.col("measles_order") == "second", cfg.repeat_code)
                    .otherwise(F.col("icd_m3")))
    )
    whole = Window.partitionBy(*keys, "visit_select")
    is_index = F.coalesce(F.col("icd_m3") == cfg.index_code, F.lit(False))
    merged = (
        marked.withColumn("measles_group", F.sum(is_index.cast("int")).over(whole).cast("int"))
        .withColumn("_first_admit", F.min("date_admit").over(whole))
        .withColumn("_last_dis", F.max("date_dis").over(whole))
        .withColumn("visit_max", F.max("visit").over(whole))
        .where(F.col("visit") == F.col("visit_max"))
    )
    return (
        merged.withColumn("date_admit", F.col("_first_admit"))
        .withColumn("date_dis", F.col("_last_dis"))
        .withColumn("icd_m3", F.when(F.col("measles_group") > 0, cfg.index_code)
                    .otherwise(F.col("icd_m3")))
        .withColumn("measles", yes_no(F.col("icd_m3") == cfg.index_code))
        .withColumn("measles_order", F.when(F.col("icd_m3") == cfg.index_code, "first")
                    .otherwise(F.col("measles_order")))
        .drop("_first_admit", "_last_dis", "visit", "visit_select")
    )


def infection_type(cfg: CohortConfig) -> Column:
    code = F.col("icd_m3")
    return (
        F.when(F.col("measles_order") == "second", c.LABEL_REPEAT)
        .when(code == cfg.index_code, c.LABEL_INDEX)
        .when(code.isin(c.DIARRHEA_CODES), c.LABEL_DIARRHEA)
        .when(code.isin(c.RESPIRATORY_CODES), c.LABEL_RESPIRATORY)
        .when(code.isin(c.CNS_CODES), c.LABEL_CNS)
        .otherwise(c.LABEL_OTHER)
    )


def classify_infection(episodes: DataFrame, cfg: CohortConfig) -> DataFrame:
    return episodes.withColumn("infection_type", infection_type(cfg))


def period_of(days: Column) -> Column:
    return (
        F.when(days > 0, c.PERIOD_AFTER).when(days < 0, c.PERIOD_BEFORE)
        .when(days == 0, c.PERIOD_INDEX)
    )


def anchor_index(episodes: DataFrame) -> DataFrame:
    """Attach the index event's dates and age to all of the subject's rows, and the period."""
    whole = per_subject(episodes)
    first = F.col("measles_order") == "first"

    def of_index(name: str) -> Column:
        return F.max(F.when(first, F.col(name))).over(whole)

    return (
        # One call, so that the planner needs one window pass.
        episodes.withColumns({
            "date_admit_index": of_index("date_admit"),
            "date_dis_index": of_index("date_dis"),
            "age_at_index_d": of_index("age_at_admit_d"),
        })
        .withColumn("hospitalization", F.datediff("date_dis", "date_admit"))
        .withColumn("time_ad_index_to_ad", F.datediff("date_admit", "date_admit_index"))
        .withColumn("period", period_of(F.col("time_ad_index_to_ad")))
        .withColumn("age", F.col("age_at_admit_d") / F.lit(float(c.DAYS_PER_YEAR)))
    )


def exclude_code(episodes: DataFrame, cfg: CohortConfig) -> DataFrame:
    """Drop subjects with the excluded code, as a window on the existing partitioning."""
    ever = F.max(F.coalesce(F.col("icd_m3") == cfg.exclusion_code, F.lit(False))).over(
        per_subject(episodes))
    return episodes.withColumn("_excluded", ever).where(~F.col("_excluded")).drop("_excluded")


def lookback(episodes: DataFrame, days: int) -> DataFrame:
    return episodes.where(F.col("time_ad_index_to_ad") >= -days)


def first_record(episodes: DataFrame) -> DataFrame:
    """First record of each subject and period."""
    window = Window.partitionBy(*subject_keys(episodes), "period").orderBy("date_admit")
    return episodes.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def last_seen(episodes: DataFrame) -> DataFrame:
    """Last visit year and last discharge over the index and later rows; NULL on earlier rows."""
    whole = per_subject(episodes)
    counted = F.col("period") != c.PERIOD_BEFORE
    return episodes.withColumn(
        "last_year", F.when(counted, F.max(F.when(counted, F.year("date_admit"))).over(whole))
    ).withColumn(
        "date_dis_last", F.when(counted, F.max(F.when(counted, F.col("date_dis"))).over(whole)))
