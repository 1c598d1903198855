"""Risk intervals (time_start, time_stop] before and after the index event.

Each episode row takes the roles it plays ("before", "after"; the index row
plays both) and all windows run on (subject, side). Both sides come out of one
pass over one partitioning, without a union of two scans.

Before: an interval carries the values of the row that ends it. After: those
of the row that starts it, and status 1 refers to the next admission.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recurra import config as c
from recurra.config import CohortConfig
from recurra.functions.columns import per_subject, subject_keys

BEFORE, AFTER = c.PERIOD_BEFORE, c.PERIOD_AFTER


def sides(episodes: DataFrame, cfg: CohortConfig) -> DataFrame:
    """One row per episode and role, with the dob of the subject's first row."""
    index, later = F.col("period") == c.PERIOD_INDEX, F.col("period") == c.PERIOD_AFTER
    in_lookback = (F.col("period") == c.PERIOD_BEFORE) & (
        -F.col("time_ad_index_to_ad") <= cfg.lookback_days)
    roles = (
        F.when(index, F.array(F.lit(BEFORE), F.lit(AFTER)))
        .when(later, F.array(F.lit(AFTER)))
        .when(in_lookback, F.array(F.lit(BEFORE)))
    )
    # min_by needs no order within the subject, and so no sort.
    first_dob = F.min_by("dob", "date_admit").over(per_subject(episodes))
    return episodes.withColumn("dob_first", first_dob).withColumn("side", F.explode(roles))


def _side_window(rows: DataFrame):
    return Window.partitionBy(*subject_keys(rows), "side").orderBy("date_admit")


def _whole_side(rows: DataFrame):
    """All rows of a side, in the order that the other windows need: one sort serves both."""
    return _side_window(rows).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def fold_washout(rows: DataFrame, cfg: CohortConfig) -> DataFrame:
    """Fold all admissions up to the end of the washout into the index row.

    Its discharge becomes the latest of them and of the washout's last day, and
    follow-up lasts at least until then. Reads and returns rows with a side.
    """
    origin = {"admit": "date_admit_index", "discharge": "date_dis_index"}[cfg.washout_from]
    washout_end = F.date_add(origin, cfg.washout_days)
    index = F.col("period") == c.PERIOD_INDEX
    inside = (F.col("side") == AFTER) & (F.col("date_admit") <= washout_end)
    discharge = F.when(index, F.greatest(washout_end, F.col("date_dis"))).otherwise(F.col("date_dis"))
    folded = F.max(F.when(inside, discharge)).over(_whole_side(rows))
    after = F.col("side") == AFTER
    return (
        rows.withColumn("_folded", folded)
        .where(~after | index | ~inside)
        .withColumn("date_dis", F.when(after & index, F.col("_folded")).otherwise(F.col("date_dis")))
        .withColumn("date_dis_index", F.when(after, F.col("_folded")).otherwise(F.col("date_dis_index")))
        .withColumn("time_at_lastfup", F.when(after, F.greatest("time_at_lastfup", "_folded"))
                    .otherwise(F.col("time_at_lastfup")))
        .drop("_folded")
    )


def clocks(rows: DataFrame, cfg: CohortConfig) -> DataFrame:
    """`obs_time` of each row, in days.

    Before: since the start of the look-back, or since birth for subjects
    younger than that at the index event. After: since the index discharge.
    """
    span, age = cfg.lookback_days, F.col("age_at_index_d")
    old = age >= span
    of_index = F.when(old, F.lit(span)).otherwise(age)
    of_event = F.when(old, F.greatest(F.lit(span) - F.abs("time_ad_index_to_ad"), F.lit(0))).otherwise(
        F.col("age_at_admit_d"))
    before = (
        F.when((F.col("date_admit") == F.col("dob")) & ~old, F.lit(1))
        .when(F.col("period") == c.PERIOD_INDEX, of_index)
        .otherwise(of_event)
    )
    after = F.datediff("date_admit", "date_dis_index")
    return rows.withColumn("obs_time", F.when(F.col("side") == BEFORE, before).otherwise(after))


def neighbours(rows: DataFrame) -> DataFrame:
    """Previous and next row of the side, and `flag_index_impute` from whether they exist.

    Before: 1 index row with a prior event, 2 index row without, 3 prior event.
    After: 1 index row without a later event, 2 with, 3 later event, 4 the last one.
    """
    window = _side_window(rows)
    rows = rows.withColumns({
        "_prev_end": F.lag(F.col("obs_time") + F.col("hospitalization")).over(window),
        "_next_obs": F.lead("obs_time").over(window),
        "_next_period": F.lead("period").over(window),
        "_has_prev": F.lag(F.lit(True)).over(window).isNotNull(),
        "_has_next": F.lead(F.lit(True)).over(window).isNotNull(),
    })
    index, has_prev, has_next = F.col("period") == c.PERIOD_INDEX, F.col("_has_prev"), F.col("_has_next")
    before = F.when(index, F.when(has_prev, 1).otherwise(2)).otherwise(3)
    after = F.when(index, F.when(has_next, 2).otherwise(1)).otherwise(F.when(has_next, 3).otherwise(4))
    return rows.withColumn(
        "flag_index_impute", F.when(F.col("side") == BEFORE, before).otherwise(after))


def _interval(flag: Column, status: Column, obs: Column, start: Column, stop: Column) -> Column:
    return F.struct(
        flag.alias("flag_index_impute"), status.cast("int").alias("status"),
        obs.cast("int").alias("obs_time"),
        start.cast("int").alias("time_start"), stop.cast("int").alias("time_stop"))


def risk_intervals(episodes: DataFrame, cfg: CohortConfig) -> DataFrame:
    """All risk intervals of both sides; empty ones and those opened by a death are dropped."""
    rows = neighbours(clocks(fold_washout(sides(episodes, cfg), cfg), cfg))
    flag, obs, stay = F.col("flag_index_impute"), F.col("obs_time"), F.col("hospitalization")
    is_before = F.col("side") == BEFORE

    # Before: the event's own interval, and the tail from the last prior event to the index.
    start = F.coalesce(F.col("_prev_end"), F.lit(0))
    stop = F.when(obs == 0, start + 1).otherwise(obs)
    own = F.when(flag.isin(2, 3), _interval(flag, flag == 3, obs, start, stop))
    full = F.when(F.col("age_at_index_d") >= cfg.lookback_days, F.lit(cfg.lookback_days)).otherwise(
        F.col("age_at_index_d"))
    last_prior = (flag == 3) & (
        F.col("_next_period").isNull() | (F.col("_next_period") == c.PERIOD_INDEX))
    tail = F.when(last_prior, _interval(flag, F.lit(0), obs, stop + stay, full))

    # After: from this row's discharge to the next admission, or to the end of follow-up.
    censored = flag.isin(1, 4)
    after = F.when(
        F.col("outcome") != c.OUTCOME_DEAD,
        _interval(
            flag, ~censored, obs,
            F.when(flag.isin(3, 4), obs + stay).otherwise(F.lit(0)),
            F.when(censored, F.datediff("time_at_lastfup", "date_dis_index"))
            .otherwise(F.col("_next_obs"))),
    )
    pieces = F.when(is_before, F.array(own, tail)).otherwise(F.array(after))
    base = [k for k in subject_keys(rows)] + [
        "side", "period", "sex", "district", "dob", "dob_first", "date_admit", "date_dis", "date_dis_index",
        "age_at_admit_d", "age_at_index_d", "infection_type", "hospitalization",
        # Only on episodes whose follow-up scenarios will cut.
        *(name for name in ("date_dis_last",) if name in rows.columns)]
    return (
        rows.withColumn("hospitalization_index", F.datediff("date_dis_index", "date_admit_index"))
        .withColumn("_piece", F.explode(F.filter(pieces, lambda p: p.isNotNull())))
        .select(*base, "hospitalization_index", "_piece.*")
        .where(F.col("time_stop") > F.col("time_start"))
    )


def intervals_before(intervals: DataFrame) -> DataFrame:
    return intervals.where(F.col("side") == BEFORE).drop("period", "hospitalization_index", "date_dis_index")


def intervals_after(intervals: DataFrame) -> DataFrame:
    keys = subject_keys(intervals)
    return intervals.where(F.col("side") == AFTER).select(
        *keys, "period", "status", "time_start", "time_stop", "sex", "district", "age_at_index_d",
        "hospitalization_index", "date_dis_index", "infection_type", "hospitalization")
