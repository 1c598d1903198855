"""Exact ranks and quantiles without bringing a group into one task.

Equal values collapse to counts first. Approximate quantiles of the distinct
values cut each group into cells of about the same size; the few cell totals
per group give the rank offset of each cell, and ranks are counted inside a
cell. The approximation decides only how even the cells are, never the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELLS = 256


def ranked_values(
    df: DataFrame, value: str, by: Sequence[str] = (), cells: int = CELLS, weight: str | None = None
) -> DataFrame:
    """Per group and distinct value: `n` rows, `below` rows with a smaller value, `total` rows.

    A missing value weighs nothing, but keeps its group in the result. `weight`
    names a column of row counts if the rows are counts already.
    """
    by = list(by)
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.groupBy(*by, value).agg(rows.alias("n")).withColumn(
        "n", F.when(F.col(value).isNull(), 0).otherwise(F.col("n")))
    fractions = [i / cells for i in range(1, cells)]
    # Reading n keeps this use of the counts the same as the next, so they are computed once.
    cuts = F.percentile_approx(F.when(F.col("n") > 0, F.col(value)), fractions, 20 * cells).alias("_cuts")
    if by:
        splits = counts.groupBy(*by).agg(cuts)
        placed = _join_by(counts, splits, by, ["_cuts"])
    else:
        placed = counts.withColumn("_cuts", counts.agg(cuts).scalar())
    cell = F.size(F.filter("_cuts", lambda cut: cut < F.col(value)))
    placed = placed.withColumn("_cell", cell).drop("_cuts")

    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    totals = placed.groupBy(*by, "_cell").agg(F.sum("n").alias("_cell_n"))
    totals = totals.withColumn(
        "_offset", F.sum("_cell_n").over(whole.orderBy("_cell")) - F.col("_cell_n")
    ).withColumn("total", F.sum("_cell_n").over(whole))
    ranked = _join_by(placed, totals, [*by, "_cell"], ["_offset", "total"])
    inside = Window.partitionBy(*by, "_cell").orderBy(value)
    below = F.col("_offset") + F.sum("n").over(inside) - F.col("n")
    return ranked.withColumn("below", below).select(*by, value, "n", "below", "total")


def _join_by(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    renamed = right.select([F.col(k).alias(f"_r_{k}") for k in keys] + values)
    condition = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, condition).drop(*(f"_r_{k}" for k in keys))


def exact_quantiles(
    df: DataFrame, value: str, by: Sequence[str], probs: dict[str, float], cells: int = CELLS
) -> DataFrame:
    """Quantiles of the groups that have a value; one column per entry of `probs`."""
    return counted_quantiles(df, value, by, probs, cells).where("n > 0").drop("n")


def counted_quantiles(
    df: DataFrame, value: str, by: Sequence[str], probs: dict[str, float], cells: int = CELLS
) -> DataFrame:
    """Of every group, non-missing count `n` and linearly interpolated quantiles (type 7)."""
    ranked = ranked_values(df, value, by, cells)

    def at(position):
        here = (F.col("below") <= position) & (position < F.col("below") + F.col("n"))
        return F.max(F.when(here, F.col(value).cast("double")))

    spans = []
    for name, p in probs.items():
        h = (F.col("total") - 1) * F.lit(float(p))
        spans += [at(F.floor(h)).alias(f"_{name}_lo"), at(F.ceil(h)).alias(f"_{name}_hi")]
    grouped = ranked.groupBy(*by).agg(*spans, F.max("total").alias("_total"))
    result = [F.col("_total").alias("n")]
    for name, p in probs.items():
        h = (F.col("_total") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        result.append((lo + (h - F.floor(h)) * (hi - lo)).alias(name))
    return grouped.select(*by, *result)
