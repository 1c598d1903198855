"""Connected components of link tables, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurra.llm.common import release, written


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node that has a link to another; component is the smallest node it can reach.

    Each round maps a node to its smallest neighbour, follows that one step
    further, and rewrites the links. The smallest node of a component always stays,
    and a component of links to one node is done in one round. Nulls link nothing.
    """
    spark = edges.sparkSession
    left = written(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") < F.col("b"))).distinct(), "links")
    found = None
    while not left.isEmpty():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(left.select("b", "a"))
        low = written(both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("up")), "parents")
        further = low.select(F.col("node").alias("up"), F.col("up").alias("top"))
        step = low.join(further, "up").select("node", F.col("top").alias("component"))
        ends = [step.select(F.col("node").alias(x), F.col("component").alias(f"to_{x}")) for x in "ab"]
        moved = left.join(ends[0], "a").join(ends[1], "b")
        rest = written(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).where("a < b").distinct(), "links")
        if found is None:
            now = step
        else:
            later = step.select(F.col("node").alias("component"), F.col("component").alias("top"))
            now = found.join(later, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
        now = written(now, "components")
        release(low)
        release(left)
        if found is not None:
            release(found)
        found, left = now, rest
    if found is None:
        return spark.createDataFrame([], f"node {edges.schema[a].dataType.simpleString()}, component {edges.schema[a].dataType.simpleString()}")
    return found
