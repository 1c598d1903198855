"""Sensitivity scenarios: random censoring after the last discharge.

As rows, each scenario has its own copy of the episodes. As cuts, all share one
table of weeks: nobody leaves before the last discharge, so a scenario only ends
the last interval earlier, and is one number per subject.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recurra.config import PERIOD_BEFORE, CohortConfig, Emigration
from recurra.functions.columns import exponential_days, exponential_of, uniform
from recurra.operators.episodes import last_seen
from recurra.operators.persontime import person_weeks
from recurra.operators.timeline import risk_intervals


def fan_out(episodes: DataFrame, scenarios: Sequence[Emigration]) -> DataFrame:
    """One copy of each row per scenario of the caller's list.

    The copies are spread anew by scenario and subject: split into weeks where
    they are, a partition would grow by the number of scenarios times some
    twenty. Episodes are the small side of that growth, so they are what moves.
    """
    rows = F.array(*(
        F.struct(
            F.lit(s.scenario_id).alias("scenario_id"),
            F.lit(float(s.rate)).alias("emigration_rate"),
            F.lit(int(s.seed)).alias("seed"),
        )
        for s in scenarios
    ))
    copies = episodes.withColumn("_scenario", F.explode(rows)).select(*episodes.columns, "_scenario.*")
    return copies.repartition("scenario_id", "patid")


def censoring_days(rows: DataFrame) -> DataFrame:
    """`emigration_days` from last discharge. One seed gives coupled draws: the rate only scales them."""
    return rows.withColumn(
        "emigration_days", exponential_days(F.col("emigration_rate"), F.col("patid"), F.col("seed")))


def censor_followup(rows: DataFrame, years: tuple[int, int] = (2005, 2015)) -> DataFrame:
    """Cut follow-up of the index and later rows at the drawn emigration date.

    Those rows are kept only if the subject's last visit lies in `years`; rows
    before the index event are not touched. As with the follow-up length,
    `time_dis_to_lastfup` then counts from the index discharge.
    """
    drawn = censoring_days(last_seen(rows))
    before = F.col("period") == PERIOD_BEFORE
    leaves = F.date_add("date_dis_last", F.col("emigration_days"))
    # least() skips the NULL of a scenario in which nobody leaves.
    ends = F.when(before, F.col("time_at_lastfup")).otherwise(F.least("time_at_lastfup", leaves))
    return (
        drawn.where(before | F.col("last_year").between(*years))
        .withColumn("time_at_lastfup", ends)
        .withColumn(
            "time_dis_to_lastfup",
            F.when(before, F.col("time_dis_to_lastfup"))
            .otherwise(F.datediff("time_at_lastfup", "date_dis_index")))
        .drop("last_year", "date_dis_last", "emigration_days")
    )


def cuttable_weeks(episodes: DataFrame, cfg: CohortConfig, years: tuple[int, int] = (2005, 2015)) -> DataFrame:
    """Person-weeks without censoring of the subjects and rows that scenarios keep.

    The weeks of a subject's last interval also carry where it stops (`tail_stop`) and
    the last discharge (`leave_from`), both in days after the index event.
    """
    seen = last_seen(episodes)
    before = F.col("period") == PERIOD_BEFORE
    kept = seen.where(before | F.col("last_year").between(*years)).drop("last_year")
    return person_weeks(risk_intervals(kept, cfg), cfg)


def cut_days(scenarios: Sequence[Emigration]) -> Column:
    """The day at which each scenario stops the last interval, from `patid`, `leave_from` and `tail_stop`."""
    # Scenarios of one seed share a draw, which the rate only scales.
    seeds = list(dict.fromkeys(int(s.seed) for s in scenarios))
    draws = F.transform(F.array(*(F.lit(s) for s in seeds)), lambda seed: uniform(F.col("patid"), seed))
    rows = F.array(*(F.struct(F.lit(float(s.rate)).alias("rate"), F.lit(seeds.index(int(s.seed))).alias("place")) for s in scenarios))

    def cut(drawn: Column) -> Column:
        def of(s: Column) -> Column:
            leaves = exponential_of(s["rate"], F.get(drawn, s["place"]))
            day = F.least("tail_stop", F.greatest(F.lit(0), F.col("leave_from") + leaves))
            return F.when(leaves.isNull(), F.col("tail_stop")).otherwise(day).cast("int")

        return F.transform(rows, of)

    # A lambda over the one array of draws, so that they are not made anew for each scenario.
    return F.element_at(F.transform(F.array(draws), cut), 1)
