"""Weekly person-time from risk intervals.

Days s+1 .. e of an interval (s, e] fall into 7-day bins, numbered by
ceil(day / 7). Each interval goes straight to its weeks: the days of a week
are consecutive, so their count and sum follow from the first and last day,
and the daily rows are never made.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recurra import config as c
from recurra.config import CohortConfig, ModelSpec
from recurra.functions.columns import clamp_year, cut, subject_keys
from recurra.functions.stats import z_value

WEEK = 7
PERSON_WEEK_COLUMNS = [
    "patid", "age_at_infection", "time_after_index", "offset_time", "status", "period",
    "age_at_index_y", "infection_type", "hospitalization", "sex", "district", "time_interval",
    "dob", "dai", "calendar_year", "week", "n_days", "sum_day",
]


def split_person_time(intervals: DataFrame, width: int = WEEK) -> DataFrame:
    """One row per interval and bin: bin number, days in it, their sum, and the events.

    A start below 0 leaves one piece up to day 0 that counts as one day and has
    no bin. The event belongs to the last piece.
    """
    stop, bin_no = F.col("time_stop"), F.col("week")
    first = F.greatest(F.col("time_start"), F.lit(0)) + 1
    # sequence() counts down when its end is the smaller one.
    bins = F.when(
        stop >= first,
        F.sequence(F.ceil(first / width).cast("int"), F.ceil(stop / width).cast("int")),
    ).otherwise(F.array().cast("array<int>"))
    unbinned = F.array(F.lit(None).cast("int"))
    bins = F.when(F.col("time_start") < 0, F.concat(unbinned, bins)).otherwise(bins)
    lo = F.greatest((bin_no - 1) * width + 1, first)
    hi = F.least(bin_no * width, stop)
    n = hi - lo + 1

    def piece(unbinned_value, binned_value):
        return F.when(bin_no.isNull(), unbinned_value).otherwise(binned_value)

    others = [name for name in intervals.columns if name != "status"]
    return intervals.withColumn("week", F.explode(bins)).select(
        *others, "week",
        piece(F.lit(1), n).alias("n_days"),
        # (lo + hi) * n is even: either n is, or lo and hi are both odd or both even.
        piece(F.lit(0), F.shiftright((lo + hi) * n, 1)).cast("long").alias("sum_day"),
        F.when(piece(stop <= 0, hi == stop), F.col("status")).otherwise(0).alias("status"))


def to_weeks(pieces: DataFrame) -> DataFrame:
    """Sum the pieces of a subject's week; infection type and stay are part of the week's key."""
    key = [*subject_keys(pieces), "side", "sex", "district", "age_at_index_d", "infection_type",
           "hospitalization", "week"]
    cuttable = []
    if "date_dis_last" in pieces.columns:
        # The interval that lasts to the end of follow-up: where it stops, and the last discharge, on its clock.
        tail = (F.col("side") == c.PERIOD_AFTER) & F.col("flag_index_impute").isin(1, 4)
        cuttable = [
            F.max(F.when(tail, F.col("time_stop"))).alias("tail_stop"),
            F.max(F.when(tail, F.datediff("date_dis_last", "date_dis_index"))).alias("leave_from"),
        ]
    return pieces.groupBy(*key).agg(
        *cuttable,
        F.sum("status").alias("status"),
        F.sum("n_days").alias("n_days"),
        F.sum("sum_day").alias("sum_day"),
        # The same on all of a subject's rows.
        F.max("hospitalization_index").alias("hospitalization_index"),
        F.max("dob_first").alias("dob"),
    )


def attach_clocks(weeks: DataFrame, cfg: CohortConfig) -> DataFrame:
    """Age, time since the index event, exposure and calendar date of each week.

    Days stay whole numbers until the last division, so that ties and calendar
    years do not depend on rounding.
    """
    after = F.col("side") == c.PERIOD_AFTER
    year = F.lit(float(c.DAYS_PER_YEAR))
    age_at_zero = F.when(after, F.col("age_at_index_d") + F.col("hospitalization_index")).otherwise(
        F.greatest(F.col("age_at_index_d") - cfg.lookback_days, F.lit(0)))
    mean_day = F.col("sum_day") / F.col("n_days")
    age_days = mean_day + age_at_zero
    whole_age = F.floor(F.expr("sum_day div n_days")).cast("int")
    return (
        weeks.withColumn("period", F.col("side"))
        .withColumn("age_at_infection", age_days / year)
        .withColumn(
            "time_after_index",
            F.when(after, (mean_day + F.col("hospitalization_index")) / year).otherwise(F.lit(-1.0)))
        .withColumn("time_interval", F.col("n_days") / year)
        .withColumn("offset_time", F.ln("time_interval"))
        .withColumn("age_at_index_y", F.col("age_at_index_d") / year)
        .withColumn("dai", F.date_add("dob", whole_age + age_at_zero))
        .withColumn("calendar_year", F.year("dai"))
    )


def person_weeks(intervals: DataFrame, cfg: CohortConfig) -> DataFrame:
    weeks = attach_clocks(to_weeks(split_person_time(intervals)), cfg)
    keys = [k for k in subject_keys(weeks) if k != "patid"]
    extra = [k for k in ("tail_stop", "leave_from") if k in weeks.columns]
    return weeks.select(*keys, *PERSON_WEEK_COLUMNS, *extra)


def wave(weeks: DataFrame, mode: str = "skip") -> DataFrame:
    """Running number of a subject's weeks by age; "skip" leaves one out at the washout."""
    if mode not in ("skip", "plain"):
        raise ValueError(f"unknown wave mode {mode!r}")
    window = Window.partitionBy(*subject_keys(weeks)).orderBy(
        "age_at_infection", "time_after_index", F.asc_nulls_first("week"), "infection_type",
        "hospitalization", "sex", "district")
    number = F.row_number().over(window)
    if mode == "skip":
        number = number + F.when(F.col("period") == c.PERIOD_AFTER, 1).otherwise(0)
    return weeks.withColumn("wave", number)


def subpopulation(weeks: DataFrame, max_age: float | None = None, max_time: float | None = None) -> DataFrame:
    if max_age is not None:
        weeks = weeks.where(F.col("age_at_infection") <= max_age)
    if max_time is not None:
        weeks = weeks.where(F.col("time_after_index") <= max_time)
    return weeks


def model_rows(weeks: DataFrame, spec: ModelSpec) -> DataFrame:
    """Rows of one specification: waves are numbered on all weeks, then the rows are chosen."""
    return subpopulation(wave(weeks, spec.wave_mode), spec.max_age, spec.max_time)


def events(weeks: DataFrame) -> DataFrame:
    return weeks.where(F.col("status") == 1)


def subject_span(weeks: DataFrame) -> DataFrame:
    """Start and end of each subject's follow-up, by time and by age.

    Time is relative to the index event: before it, the difference of the ages.
    """
    relative = F.when(
        F.col("period") == c.PERIOD_BEFORE, F.col("age_at_infection") - F.col("age_at_index_y")
    ).otherwise(F.col("time_after_index"))
    return weeks.withColumn("_t", relative).groupBy(*subject_keys(weeks), "age_at_index_y").agg(
        F.min("_t").alias("tstart"), F.min("age_at_infection").alias("age_start"),
        F.max("_t").alias("tstop"), F.max("age_at_infection").alias("age_stop"))


def followup_by_year(weeks: DataFrame, first: int = 2005, last: int = 2015) -> DataFrame:
    """Person-years by calendar year, before and after the index event."""
    band = cut("time_after_index", [-1, 0, 10], include_lowest=True)
    label = F.when(band == 1, "pre-MeV").when(band == 2, "post-MeV")
    return weeks.groupBy(
        clamp_year("calendar_year", first, last).alias("calendar_year"), label.alias("time_band"),
    ).agg((F.sum("n_days") / F.lit(float(c.DAYS_PER_YEAR))).alias("person_years"))


def max_event_time(weeks: DataFrame) -> DataFrame:
    return events(weeks).agg(F.max("time_after_index").alias("max_time"))


def retention_ratio(weeks: DataFrame) -> DataFrame:
    """Weeks of follow-up past one and two years after the index event, and their ratio."""
    past = weeks.agg(
        F.count_if(F.col("time_after_index") >= 1).alias("n_past_1y"),
        F.count_if(F.col("time_after_index") >= 2).alias("n_past_2y"))
    return past.withColumn("ratio", F.try_divide("n_past_2y", "n_past_1y"))


def _rates(grouped: DataFrame) -> DataFrame:
    years = F.col("days") / F.lit(float(c.DAYS_PER_YEAR))
    return grouped.withColumn("person_years", years).withColumn("rate", F.col("events") / F.col("person_years"))


def crude_rates(weeks: DataFrame) -> DataFrame:
    """Events, person-years and their ratio before and after the index event."""
    summed = weeks.groupBy("period").agg(F.sum("status").alias("events"), F.sum("n_days").alias("days"))
    return _rates(summed).drop("days")


def piecewise_rates(weeks: DataFrame, bands: Sequence[float]) -> DataFrame:
    """Crude rate per band of time since the index event, and its log ratio to the first band (NULL if that has no events)."""
    band = cut("time_after_index", bands, include_lowest=True)
    rates = _rates(
        weeks.groupBy(band.alias("band")).agg(F.sum("status").alias("events"), F.sum("n_days").alias("days"))
        .where(F.col("band").isNotNull()))
    # One row per band here, so the window over all of them is small.
    base = F.max(F.when(F.col("band") == 1, F.col("rate"))).over(Window.partitionBy(F.lit(0)))
    ratio = F.when(F.col("events") > 0, F.ln(F.try_divide("rate", base)))
    return rates.withColumn("log_rate_ratio", ratio).drop("days")


def crude_irr(weeks: DataFrame, z: float | None = None) -> DataFrame:
    """Crude rate ratio after versus before with its cluster-robust error, in closed form.

    Per subject the residual of a side is u = events - rate * years. With totals
    Y the variances of the log rates are sum(u**2) / Y**2, so one pass of
    per-subject sums and their second moments is enough. NULL where a side has
    no time or no events.
    """
    z = z_value() if z is None else z
    before, after = F.col("period") == c.PERIOD_BEFORE, F.col("period") == c.PERIOD_AFTER

    def years(side):
        return F.sum(F.when(side, F.col("n_days")).otherwise(0)) / F.lit(float(c.DAYS_PER_YEAR))

    def count(side):
        return F.sum(F.when(side, F.col("status")).otherwise(0)).cast("double")

    subjects = weeks.groupBy(*subject_keys(weeks)).agg(
        count(before).alias("y0"), years(before).alias("t0"),
        count(after).alias("y1"), years(after).alias("t1"))
    names = ("y0", "t0", "y1", "t1")
    sums = [F.sum(n).alias(n) for n in names]
    products = [
        F.sum(F.col(a) * F.col(b)).alias(a + b)
        for i, a in enumerate(names) for b in names[i:]]
    groups = [k for k in subject_keys(weeks) if k != "patid"]
    m = subjects.groupBy(*groups).agg(*sums, *products)
    r0, r1 = F.try_divide("y0", "t0"), F.try_divide("y1", "t1")
    u00 = F.col("y0y0") - 2 * r0 * F.col("y0t0") + r0 * r0 * F.col("t0t0")
    u11 = F.col("y1y1") - 2 * r1 * F.col("y1t1") + r1 * r1 * F.col("t1t1")
    u01 = F.col("y0y1") - r1 * F.col("y0t1") - r0 * F.col("t0y1") + r0 * r1 * F.col("t0t1")
    y0, y1 = F.col("y0"), F.col("y1")
    variance = F.try_divide(u00, y0 * y0) + F.try_divide(u11, y1 * y1) - 2 * F.try_divide(u01, y0 * y1)
    return (
        m.select(*groups, F.ln(F.try_divide(r1, r0)).alias("estimate"), F.sqrt(variance).alias("std_err"))
        .withColumn("irr", F.exp("estimate"))
        .withColumn("irr_lower", F.exp(F.col("estimate") - F.lit(z) * F.col("std_err")))
        .withColumn("irr_upper", F.exp(F.col("estimate") + F.lit(z) * F.col("std_err")))
    )
