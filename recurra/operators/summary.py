"""Descriptive tables: continuous and categorical summaries, tests, counts and series."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recurra.functions.stats import chi2_p
from recurra.operators.ranking import _join_by, counted_quantiles, ranked_values

POOLED = "All patients"
MODES = {
    "med.IQR": {"q_low": 0.25, "median": 0.5, "q_high": 0.75},
    "med.90": {"q_low": 0.05, "median": 0.5, "q_high": 0.95},
    "med.range": {"q_low": 0.0, "median": 0.5, "q_high": 1.0},
    "MIC": {"median": 0.5, "q90": 0.9, "min": 0.0, "max": 1.0},
}


def with_pooled(df: DataFrame, group: str) -> DataFrame:
    """Each row in its own group and in the pooled one."""
    return df.withColumn(group, F.explode(F.array(F.col(group), F.lit(POOLED))))


def group_sizes(df: DataFrame, group: str, pooled: bool = False) -> DataFrame:
    df = df.where(F.col(group).isNotNull())
    if pooled:
        df = with_pooled(df, group)
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))


def summarize_continuous(
    df: DataFrame, var: str, group: str, mode: str = "med.IQR", pooled: bool = False
) -> DataFrame:
    """Non-missing count and exact quantiles per group."""
    if mode not in MODES:
        raise ValueError(f"unknown summary mode {mode!r}")
    rows = df.where(F.col(group).isNotNull()).select(group, var)
    if pooled:
        rows = with_pooled(rows, group)
    return counted_quantiles(rows, var, [group], MODES[mode])


def summarize_categorical(
    df: DataFrame, var: str, group: str, groups: Sequence[str], pooled: bool = False
) -> DataFrame:
    """Count, denominator and rounded percent for every level in every listed group."""
    groups = [POOLED, *groups] if pooled else list(groups)
    rows = df.where(F.col(group).isin(groups) & F.col(var).isNotNull())
    member = {g: F.lit(True) if pooled and g == POOLED else F.col(group) == g for g in groups}
    counts = rows.groupBy(F.col(var).cast("string").alias("level")).agg(
        *(F.count_if(member[g]).alias(f"_{i}") for i, g in enumerate(groups)))
    cells = F.array(*(
        F.struct(F.lit(g).alias(group), F.col(f"_{i}").alias("n")) for i, g in enumerate(groups)))
    long = counts.select("level", F.explode(cells).alias("_c")).select(f"_c.{group}", "level", "_c.n")
    # One row per level here, so the window holds the levels of a group, not its rows.
    denominator = F.sum("n").over(Window.partitionBy(group))
    return long.withColumn("denominator", denominator).withColumn(
        "percent", F.bround(100 * F.try_divide("n", "denominator")))


def is_categorical(df: DataFrame, var: str) -> bool:
    """Text columns, and numbers with at most five distinct values."""
    if isinstance(df.schema[var].dataType, (T.StringType, T.BooleanType)):
        return True
    return df.where(F.col(var).isNotNull()).select(var).distinct().limit(6).count() <= 5


def baseline_table(
    df: DataFrame, variables: Sequence[str], group: str, groups: Sequence[str],
    mode: str = "med.IQR", pooled: bool = False, cont: dict[str, bool] | None = None, compare: bool = False,
) -> DataFrame:
    """Summaries of several variables, stacked: one row per variable, level and group.

    `compare` adds `p_value`, the same on all rows of a variable: does it differ between
    the groups (without the pooled one)? By Kruskal-Wallis for continuous variables, by Pearson's
    chi-square for others; NULL with fewer than two groups or levels.
    `cont` states which variables are continuous; for others a job counts the distinct values.
    """
    cont = cont or {}
    rows = df.where(F.col(group).isin(list(groups)))
    quantile_names = list(MODES[mode])
    parts = []
    for position, var in enumerate(variables, start=1):
        categorical = not cont[var] if var in cont else is_categorical(rows, var)
        if categorical:
            part = summarize_categorical(rows, var, group, groups, pooled).select(
                "level", group, "n", "denominator", "percent",
                *(F.lit(None).cast("double").alias(q) for q in quantile_names))
        else:
            part = summarize_continuous(rows, var, group, mode, pooled).select(
                F.lit(None).cast("string").alias("level"), group, "n",
                F.lit(None).cast("bigint").alias("denominator"),
                F.lit(None).cast("double").alias("percent"), *quantile_names)
        if compare:
            tested = chi_square(part, group) if categorical else kruskal_h(rows, var, group)
            part = part.withColumn("p_value", tested.select("p_value").scalar())
        parts.append(part.select(F.lit(position).alias("position"), F.lit(var).alias("variable"), "*"))
    return reduce(DataFrame.unionByName, parts)


def chi_square(counts: DataFrame, group: str) -> DataFrame:
    """Pearson's chi-square of `summarize_categorical`'s rows: statistic, degrees of freedom and p-value."""
    own = counts.where(F.col(group) != POOLED)
    # A row per level and group here.
    whole = Window.partitionBy(F.lit(0))
    sums = own.select(
        "level", group, F.col("n").cast("double").alias("n"),
        F.sum("n").over(Window.partitionBy("level")).alias("_row"),
        F.sum("n").over(Window.partitionBy(group)).alias("_column"), F.sum("n").over(whole).alias("_total"))
    expected = F.try_divide(F.col("_row") * F.col("_column").cast("double"), F.col("_total"))
    total = sums.agg(
        F.sum(F.try_divide((F.col("n") - expected) * (F.col("n") - expected), expected)).alias("chi2"),
        F.count_distinct(F.when(F.col("_row") > 0, F.col("level"))).alias("_levels"),
        F.count_distinct(F.when(F.col("_column") > 0, F.col(group))).alias("_groups"))
    df = (F.col("_levels") - 1) * (F.col("_groups") - 1)
    return total.select(F.when(df > 0, F.col("chi2")).alias("chi2"), df.alias("df")).withColumn(
        "p_value", F.when(F.col("df") > 0, chi2_p(F.col("chi2"), F.greatest(F.col("df"), F.lit(1)))))


def kruskal_h(df: DataFrame, var: str, group: str) -> DataFrame:
    """Kruskal-Wallis H with tie correction, degrees of freedom and p-value; H is NULL where all values tie."""
    rows = df.where(F.col(group).isNotNull() & F.col(var).isNotNull())
    counts = rows.groupBy(group, var).agg(F.count(F.lit(1)).alias("_members"))
    cells = _join_by(counts, ranked_values(counts, var, weight="_members"), [var], ["n", "below", "total"])
    average_rank = F.col("below") + (F.col("n") + 1) / F.lit(2.0)
    per_group = cells.groupBy(group).agg(
        F.sum(F.col("_members") * average_rank).alias("rank_sum"),
        F.sum("_members").alias("n_group"),
        # A tied value's n**3 - n, shared among its cells so that it counts once.
        F.sum(F.col("_members") * (F.col("n").cast("double") * F.col("n") - 1)).alias("_ties"),
        F.max("total").alias("n_total"),
    )
    n = F.col("n_total").cast("double")
    total = per_group.agg(
        F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n_group")).alias("_squares"),
        F.sum("_ties").alias("_ties"), F.max("n_total").alias("n_total"),
        F.count(F.lit(1)).alias("n_groups"),
    )
    spread = 1 - F.try_divide("_ties", n * n * n - n)
    h = F.try_divide(12 / (n * (n + 1)) * F.col("_squares") - 3 * (n + 1), spread)
    return total.withColumn("h", h).withColumn("df", F.col("n_groups") - 1).withColumn(
        "p_value", chi2_p(F.col("h"), F.col("df"))).select("n_total", "n_groups", "h", "df", "p_value")


def histogram(df: DataFrame, col: str, lo: float, width: float, by: Sequence[str] = ()) -> DataFrame:
    """Counts in equal left-closed bins from `lo`."""
    number = F.floor((F.col(col) - F.lit(float(lo))) / F.lit(float(width)))
    return (
        df.where(F.col(col).isNotNull())
        .groupBy(*by, number.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bin_start", F.lit(float(lo)) + F.col("bin") * F.lit(float(width)))
    )


def crosstab(df: DataFrame, row: str, column: str, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(row).agg(*(F.count_if(F.col(column) == v).alias(v) for v in columns))


def monthly_counts(admissions: DataFrame, index_code: str) -> DataFrame:
    """Index admissions per calendar month."""
    return admissions.where(F.col("icd_m3") == index_code).groupBy(
        F.year("date_admit").alias("year"), F.month("date_admit").alias("month"),
    ).agg(F.count(F.lit(1)).alias("cases"))


def month_spine(df: DataFrame, first: int, last: int) -> DataFrame:
    return (
        df.sparkSession.range(first, last + 1)
        .select(F.col("id").cast("int").alias("year"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    )


def monthly_series(counts: DataFrame, first: int, last: int) -> DataFrame:
    """Every month of the years, 0 where nothing happened, with the time as a decimal year."""
    return (
        month_spine(counts, first, last).join(counts, ["year", "month"], "left")
        .na.fill(0, ["cases"])
        .withColumn("time", F.col("year") + (F.col("month") - 1) / F.lit(12.0))
    )


def sample_top(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """A reproducible random sample: the n rows whose hashed key is smallest."""
    return df.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def age_group(age: Column) -> Column:
    return F.when(age >= 5, "5-15 years old").when(age < 5, "<5 years old")
