"""From raw admissions to one row per subject and admission day.

The two merges are aggregations, not windows: partial aggregation collapses
copies before the shuffle, and the shuffle key contains the date, so a subject
that owns a large share of the rows is spread over many tasks. Afterwards a
subject has at most one row per calendar day. That bounds every per-subject
window that follows by the number of days in the observation span.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recurra.config import (
    OUTCOME_DEAD, OUTCOME_DISCHARGED, OUTCOME_WORSE, CohortConfig,
)
from recurra.functions.columns import (
    birthday, both_or_null, fill_category, per_subject, poisoned, subject_keys,
)

# Ordinals per numbering cell; source ordinals are unique, so this bounds a cell's rows.
ORDINAL_CHUNK = 1 << 20


def index_subjects(admissions: DataFrame, cfg: CohortConfig) -> DataFrame:
    """Keep the subjects having an index event (semi join).

    Worth it where index events are rare. No hint: the size of the subject list
    decides at run time whether it is broadcast.
    """
    subjects = admissions.where(F.col("icd_m3") == cfg.index_code).select("patid").distinct()
    return admissions.join(subjects, "patid", "left_semi")


def number_admissions(admissions: DataFrame) -> DataFrame:
    """Visit number and last visit on raw admissions, for subjects of any size.

    A position is the sum of three offsets (earlier days, earlier discharges on
    the day, earlier ordinal chunks of that stay) and a rank inside one chunk,
    so no task holds more than a chunk of one subject's rows.
    """
    keys = subject_keys(admissions)
    day, stay, cell = [*keys, "date_admit"], [*keys, "date_admit", "date_dis"], \
        [*keys, "date_admit", "date_dis", "_chunk"]
    rows = admissions.withColumn("_chunk", F.floor(F.col("source_ordinal") / ORDINAL_CHUNK))

    def offsets(counts: DataFrame, group: list[str], order: str, name: str) -> DataFrame:
        window = Window.partitionBy(*group).orderBy(F.asc_nulls_last(order))
        return counts.withColumn(name, F.sum("_n").over(window) - F.col("_n"))

    def attach(left: DataFrame, right: DataFrame, on: list[str], values: list[str]) -> DataFrame:
        # Dates may be NULL, so the keys are compared null-safely.
        renamed = right.select([F.col(c).alias(f"_r_{c}") for c in on] + values)
        condition = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]
        return left.join(renamed, condition).drop(*(f"_r_{c}" for c in on))

    cells = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
    stays = cells.groupBy(*stay).agg(F.sum("_n").alias("_n"))
    days = stays.groupBy(*day).agg(F.sum("_n").alias("_n"))
    days = offsets(days, keys, "date_admit", "_day_offset").withColumn(
        "visit_last", F.sum("_n").over(Window.partitionBy(*keys)))
    stays = offsets(stays, day, "date_dis", "_stay_offset")
    cells = offsets(cells, stay, "_chunk", "_chunk_offset").drop("_n")
    cells = attach(cells, stays, stay, ["_stay_offset"])
    cells = attach(cells, days, day, ["_day_offset", "visit_last"])
    numbered = rows.withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*cell).orderBy("source_ordinal")))
    numbered = attach(numbered, cells, cell, ["_chunk_offset", "_stay_offset", "_day_offset", "visit_last"])
    return numbered.withColumn(
        "visit", F.col("_day_offset") + F.col("_stay_offset") + F.col("_chunk_offset") + F.col("_rank")
    ).select(*admissions.columns, "visit", "visit_last")


def dedupe_exact(admissions: DataFrame) -> DataFrame:
    """Same subject, admission and discharge: keep the last record."""
    keys = [*subject_keys(admissions), "date_admit", "date_dis"]
    rest = [c for c in admissions.columns if c not in keys and c != "source_ordinal"]
    last = F.max(F.struct("source_ordinal", *rest)).alias("_last")
    return admissions.groupBy(*keys).agg(last).select(*keys, "_last.*")


def merge_same_start(admissions: DataFrame, cfg: CohortConfig) -> DataFrame:
    """Same subject and admission day: keep the latest discharge, carry the index code over.

    A day with a missing discharge is lost when cfg.na_poison is set. A missing
    code counts as not the index code.
    """
    keys = [*subject_keys(admissions), "date_admit"]
    rest = [c for c in admissions.columns if c not in keys and c not in ("date_dis", "source_ordinal")]
    is_index = F.coalesce(F.col("icd_m3") == cfg.index_code, F.lit(False))
    merged = admissions.groupBy(*keys).agg(
        F.max(F.struct("date_dis", "source_ordinal", *rest)).alias("_latest"),
        F.max(is_index).alias("_any_index"),
        F.count(F.lit(1)).alias("_rows"),
        F.count("date_dis").alias("_dated"),
    )
    complete = F.col("_dated") == F.col("_rows") if cfg.na_poison else F.col("_dated") > 0
    return (
        merged.where(complete)
        .select(*keys, "_latest.*", "_any_index")
        .withColumn("icd_m3", F.when(F.col("_any_index"), cfg.index_code).otherwise(F.col("icd_m3")))
        .drop("_any_index")
    )


def visit_index(days: DataFrame) -> DataFrame:
    """Visit number and last visit per subject; expects one row per subject and day."""
    return days.withColumn("visit", F.row_number().over(per_subject(days, "date_admit"))).withColumn(
        "visit_last", F.count(F.lit(1)).over(per_subject(days)).cast("int"))


def resolve_outcome(days: DataFrame, worse_as_dead: bool) -> DataFrame:
    """A "worse" discharge followed by another visit was a discharge; the last one stays or is a death."""
    final = OUTCOME_DEAD if worse_as_dead else OUTCOME_WORSE
    known = days.withColumn("outcome", fill_category("outcome"))
    returns = F.lead(F.lit(True)).over(per_subject(known, "date_admit")).isNotNull()
    return known.withColumn(
        "outcome",
        F.when(F.col("outcome") != OUTCOME_WORSE, F.col("outcome"))
        .when(returns, OUTCOME_DISCHARGED)
        .otherwise(final),
    )


def impute_dob(admissions: DataFrame) -> DataFrame:
    """Missing birth date: 30 June of the birth year; rows with neither are dropped."""
    middle = F.make_date(F.col("birthyear"), F.lit(6), F.lit(30))
    return admissions.withColumn("dob", F.coalesce(F.col("dob"), middle)).where(F.col("dob").isNotNull())


def followup_end(days: DataFrame, cfg: CohortConfig) -> DataFrame:
    """End of follow-up: the subject's earliest of death, or else of age cap and data cutoff.

    A death replaces the age cap and the cutoff of its row and may lie after them.
    """
    cap = birthday(F.col("birthyear"), F.col("dob"), cfg.age_cap_years, cfg.birthday_mode)
    alive = both_or_null(F.least, cap, F.lit(cfg.followup_end)) if cfg.na_poison \
        else F.least(cap, F.lit(cfg.followup_end))
    row_end = F.when(F.col("outcome") == OUTCOME_DEAD, F.col("date_dis")).otherwise(alive)
    ended = days.withColumn("_row_end", row_end)
    return (
        ended.withColumn(
            "time_at_lastfup", poisoned(F.min, F.col("_row_end"), per_subject(ended), cfg.na_poison))
        .withColumn("time_dis_to_lastfup", F.datediff("time_at_lastfup", "date_dis"))
        .drop("_row_end")
    )


def valid_followup(days: DataFrame) -> DataFrame:
    return days.where(F.col("time_dis_to_lastfup") >= 0)
