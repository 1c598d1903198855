"""Report data products: tables and plot inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recurra import config as c
from recurra.functions.columns import recode, relabel
from recurra.operators import episodes as ep
from recurra.operators import persontime, summary

# Period labels of the descriptive tables.
TABLE_PERIODS = {
    c.PERIOD_INDEX: "Measles",
    c.PERIOD_BEFORE: "2 years before MeV",
    c.PERIOD_AFTER: "After MeV",
}
LATE_AFTER = ">1 year after MeV"
REASON_PERIODS = {
    c.PERIOD_BEFORE: "2 years before MeV",
    c.PERIOD_AFTER: "0-1 year after MeV",
    LATE_AFTER: LATE_AFTER,
}
REASON_COLUMNS = {
    "2 years before MeV&<5 years old": "two_years_before_MeV_below5_years_olds",
    "2 years before MeV&5-15 years old": "two_years_before_MeV_5to15_years_old",
    "0-1 year after MeV&<5 years old": "below1_year_after_MeV_below5_years_old",
    "0-1 year after MeV&5-15 years old": "below1_year_after_MeV_5to15_years_old",
    ">1 year after MeV&<5 years old": "above1_year_after_MeV_below5_year_old",
    ">1 year after MeV&5-15 years old": "above1_year_after_MeV_5to15_years_old",
}
MAJOR_MERGED = {
    "Dengue fever [classical dengue]": "Dengue",
    "Dengue hemorrhagic fever": "Dengue",
    "Respiratory tuberculosis": "Tuberculosis",
    "Tuberculosis of nervous system": "Tuberculosis",
}
MAJOR_LEVELS = [
    "Amebiasis", "Shigellosis", "Infectious gastroenteritis and colitis, unspecified",
    "Other bacterial intestinal infections", "Tuberculosis", "Whooping cough", "Other sepsis",
    "Viral meningitis", "Dengue", "Unspecified viral hemorrhagic fever", "Measles complicated",
    "Varicella [chickenpox]", "Zoster [herpes zoster]",
    "Oth viral infect with skin and mucous membrane lesions, NEC",
    "Unsp viral infection with skin and mucous membrane lesions", "Cytomegaloviral disease",
    "Mumps", "Viral conjunctivitis", "Viral infection of unspecified site", "Candidiasis",
    "Bacterial meningitis, not elsewhere classified",
    "Encephalitis, myelitis and encephalomyelitis",
    "Meningitis in oth infec/parastc diseases classd elswhr",
    "Sequelae of inflammatory diseases of central nervous system",
    "Acute laryngitis and tracheitis", "Acute nasopharyngitis [common cold]",
    "Acute pharyngitis", "Acute sinusitis", "Acute tonsillitis",
    "Acute upper resp infections of multiple and unsp sites",
    "Bacterial pneumonia, not elsewhere classified",
    "Influenza due to other identified influenza virus",
    "Pneumonia due to Streptococcus pneumoniae", "Pneumonia, unspecified organism",
    "Acute bronchiolitis", "Acute bronchitis", "Other and unspecified infectious diseases",
]
INCOME_LEVELS = ["High Income", "Upper Middle Income", "Lower Middle Income", "Low Income"]
INCOME_LABELS = ["HI", "UMI", "LMI", "LI"]
HIV_CAUSE = "HIV/AIDS and sexually transmitted infections"
CAUSE_LEVELS = ["Respiratory infections and tuberculosis", "Enteric infections",
                "Neglected tropical diseases and malaria", "Other infectious diseases"]
CAUSE_LABELS = ["Respiratory infections and TB", "Enteric infections", "NTD and malaria",
                "Other infectious diseases"]
SHARE_EXCLUDED = ["Chronic respiratory diseases", HIV_CAUSE]
YOUNG, OLD = "<5 years", "5-14 years"


def table_rows(episodes: DataFrame, lookback_days: int = 730) -> DataFrame:
    """Episodes of the look-back and later, with the table's period label and its rank."""
    label = recode("period", list(TABLE_PERIODS), list(TABLE_PERIODS.values()))
    return ep.lookback(episodes, lookback_days).withColumn("_p", label).select(
        *episodes.columns, F.col("_p.label").alias("period_label"), F.col("_p.sort_rank").alias("period_rank"))


def baseline_characteristics(episodes: DataFrame, compare: bool = False) -> DataFrame:
    """Table 1: subjects and sex from each subject's first record of a period, age and outcome from all.

    `compare` adds the p-values of `summary.baseline_table`.
    """
    rows = table_rows(episodes)
    groups = list(TABLE_PERIODS.values())
    first = ep.first_record(rows)
    subjects = summary.group_sizes(first, "period_label").select(
        F.lit(0).alias("position"), F.lit("Number of patients").alias("variable"),
        F.lit(None).cast("string").alias("level"), "period_label", "n",
        F.lit(None).cast("bigint").alias("denominator"), F.lit(None).cast("double").alias("percent"),
        *(F.lit(None).cast("double").alias(q) for q in summary.MODES["med.IQR"]))
    if compare:
        subjects = subjects.withColumn("p_value", F.lit(None).cast("double"))
    sex = summary.baseline_table(first, ["sex"], "period_label", groups, cont={"sex": False}, compare=compare)
    others = summary.baseline_table(
        rows, ["age", "outcome"], "period_label", groups, cont={"age": True, "outcome": False}, compare=compare,
    ).withColumn("position", F.col("position") + 1)
    return subjects.unionByName(sex).unionByName(others)


def age_period(episodes: DataFrame, lookback_days: int = 730, late_days: int = 365) -> DataFrame:
    """Rows other than the index event, with the combined period and age-group key."""
    late = F.when(F.col("time_ad_index_to_ad") > late_days, LATE_AFTER).otherwise(F.col("period"))
    label = recode(late, list(REASON_PERIODS), list(REASON_PERIODS.values()))
    return (
        ep.lookback(episodes, lookback_days).where(F.col("period") != c.PERIOD_INDEX)
        .withColumn("period_label", label["label"])
        .withColumn("age_group", summary.age_group(F.col("age")))
        .withColumn("age_period", F.concat_ws("&", "period_label", "age_group"))
    )


def reason_table(episodes: DataFrame, dim: DataFrame, strip_repeat_mark: bool = False) -> DataFrame:
    """Table S1: admissions by reason, period and age group.

    The code table has no entry for the repeat code, so those rows drop out of
    the inner join; strip_repeat_mark joins them to the index code instead. The
    code table has a few thousand rows at most, and its size is left to the
    planner to check.
    """
    code = F.rtrim("icd_m3", F.lit("*")) if strip_repeat_mark else F.col("icd_m3")
    rows = age_period(episodes).withColumn("three_digit", code).join(dim, "three_digit")
    counted = (
        rows.withColumn("major", relabel("major", MAJOR_MERGED))
        .groupBy("major", "sub_chapter", "type_id")
        .pivot("age_period", list(REASON_COLUMNS))
        .agg(F.count(F.lit(1)))
        .withColumnsRenamed(REASON_COLUMNS)
    )
    major = recode(relabel("major", {"Measles": c.LABEL_REPEAT}), MAJOR_LEVELS)
    return counted.withColumn("major", major["label"]).na.fill(0, list(REASON_COLUMNS.values())).orderBy(
        "sub_chapter",
        F.desc("two_years_before_MeV_below5_years_olds"),
        F.desc("two_years_before_MeV_5to15_years_old"),
        major["sort_rank"])


def figure_spans(weeks: DataFrame) -> DataFrame:
    return persontime.subject_span(weeks)


def relative_time() -> Column:
    """Years since the index event, negative before it."""
    return F.when(
        F.col("period") == c.PERIOD_BEFORE, F.col("age_at_infection") - F.col("age_at_index_y")
    ).otherwise(F.col("time_after_index"))


def figure_events(weeks: DataFrame) -> DataFrame:
    """Points of the events by age and by time relative to the index event."""
    return persontime.events(weeks).select(
        "patid", "period", "age_at_infection", relative_time().alias("relative_time"))


def figure_sample(weeks: DataFrame, n: int = 20, seed: int = 12321) -> DataFrame:
    return summary.sample_top(persontime.subject_span(weeks), "patid", n, seed)


def mortality_rows(rates: DataFrame, excluded: Sequence[str]) -> DataFrame:
    """Causes and income groups of interest, relabelled; a label outside the level sets gives NULL."""
    income = recode(F.substring("location", 12, 19), INCOME_LEVELS, INCOME_LABELS)
    cause = recode("cause_of_death", CAUSE_LEVELS, CAUSE_LABELS)
    return (
        rates.where(~F.col("cause_of_death").isin(list(excluded)))
        .withColumn("location", income["label"])
        .withColumn("cause_of_death", cause["label"])
    )


def paired_bounds(rates: DataFrame, young: str = YOUNG, old: str = OLD) -> DataFrame:
    """Give each young row the old row's lower bound, and each old row the young row's upper bound.

    One left join on the common columns replaces a chain of joins and a union:
    every row is offered as a partner to the other age group.
    """
    keys = ["location", "year", "cause_of_death", "age"]
    partner = rates.where(F.col("age").isin(young, old)).select(
        F.col("location").alias("_location"), F.col("year").alias("_year"),
        F.col("cause_of_death").alias("_cause_of_death"),
        F.when(F.col("age") == old, young).otherwise(old).alias("_age"),
        F.when(F.col("age") == old, F.col("lower_bound")).otherwise(F.col("upper_bound")).alias("val"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rates.join(partner, same, "left").drop(*(f"_{k}" for k in keys))


def mortality_rates(rates: DataFrame, year: int | None = 2015) -> DataFrame:
    """Figure S11: rates with paired bounds."""
    paired = paired_bounds(mortality_rows(rates, [HIV_CAUSE]))
    return paired if year is None else paired.where(F.col("year") == year)


def mortality_share(rates: DataFrame, year: int = 2015) -> DataFrame:
    """Figure S12: share of deaths by cause."""
    return mortality_rows(rates, SHARE_EXCLUDED).where(F.col("year") == year)


def monthly_index_series(admissions: DataFrame, index_code: str, first: int = 2005, last: int = 2015) -> DataFrame:
    """Figure S13: index admissions per month, gaps as zero."""
    return summary.monthly_series(summary.monthly_counts(admissions, index_code), first, last)
