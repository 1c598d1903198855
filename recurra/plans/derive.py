"""The derivation end to end: admissions, episodes, risk intervals, person-weeks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurra.config import CohortConfig, Emigration
from recurra.functions.columns import subject_keys
from recurra.operators import cleaning, episodes, persontime, scenarios, timeline
from recurra.session import materialize
from recurra.sources.tables import CORE_COLUMNS


def admission_days(admissions: DataFrame, cfg: CohortConfig) -> DataFrame:
    rows = admissions.select(CORE_COLUMNS)
    if cfg.prefilter_index_subjects:
        rows = cleaning.index_subjects(rows, cfg)
    return cleaning.merge_same_start(cleaning.dedupe_exact(rows), cfg)


def with_followup(days: DataFrame, cfg: CohortConfig) -> DataFrame:
    resolved = cleaning.resolve_outcome(days, cfg.worse_as_dead)
    return cleaning.followup_end(cleaning.impute_dob(resolved), cfg)


def cohort(days: DataFrame, cfg: CohortConfig) -> DataFrame:
    valid = episodes.flag_admissions(cleaning.valid_followup(with_followup(days, cfg)), cfg)
    return episodes.index_order(episodes.index_cohort(episodes.infections_only(valid)))


def merged(days: DataFrame, cfg: CohortConfig) -> DataFrame:
    return episodes.merge_close(episodes.gap_days(cohort(days, cfg)), cfg)


def anchored(days: DataFrame, cfg: CohortConfig) -> DataFrame:
    return episodes.anchor_index(episodes.classify_infection(merged(days, cfg), cfg))


def episodes_of_days(days: DataFrame, cfg: CohortConfig) -> DataFrame:
    return episodes.exclude_code(anchored(days, cfg), cfg).select(*episodes.EPISODE_COLUMNS)


def derive_episodes(admissions: DataFrame, cfg: CohortConfig) -> DataFrame:
    """Cleaned, merged, classified and anchored episodes; one shuffle by subject after the merges."""
    return episodes_of_days(admission_days(admissions, cfg), cfg)


def scenario_episodes(
    base: DataFrame, rows: Sequence[Emigration], years: tuple[int, int] = (2005, 2015)
) -> DataFrame:
    """Episodes of all scenarios at once, sharing the derivation up to here."""
    return scenarios.censor_followup(scenarios.fan_out(base, rows), years)


def person_time(episode_rows: DataFrame, cfg: CohortConfig) -> DataFrame:
    """Person-weeks before and after the index event."""
    return persontime.person_weeks(timeline.risk_intervals(episode_rows, cfg), cfg)


def stage_counts(admissions: DataFrame, cfg: CohortConfig) -> DataFrame:
    """Rows and distinct subjects left after each stage.

    The stages after the merges count from one written table of admission days.
    """
    rows = admissions.select(CORE_COLUMNS)
    exact = cleaning.dedupe_exact(rows)
    days = materialize(cleaning.merge_same_start(exact, cfg), "admission-days")
    stages = {
        "1 admissions": rows,
        "2 exact duplicates merged": exact,
        "3 same admission day merged": days,
        "4 birth date known": cleaning.impute_dob(days),
        "5 follow-up valid": cleaning.valid_followup(with_followup(days, cfg)),
        "6 infections of index subjects": cohort(days, cfg),
        "7 close admissions merged": merged(days, cfg),
        "8 excluded code removed": episodes_of_days(days, cfg),
    }

    def counted(name: str, stage: DataFrame) -> DataFrame:
        # Two steps, so that a subject's rows are counted before they are shuffled.
        subjects = stage.groupBy(*subject_keys(stage)).agg(F.count(F.lit(1)).alias("n"))
        return subjects.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_subjects")).select(
            F.lit(name).alias("stage"), "n_rows", "n_subjects")

    return reduce(DataFrame.unionByName, (counted(name, stage) for name, stage in stages.items()))
