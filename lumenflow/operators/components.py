"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenflow.plans.tables import drop


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def connected_components(edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (columns u, v); a component is named by its least node.

    Each round hooks every node's neighbours to the least one it knows, first
    the larger and then the smaller ones, so paths halve and stars stay stars;
    no task needs a node's neighbours together. Rounds go on until nothing
    changes; their number grows with the logarithm of the nodes. ``keep(df, label)`` makes a
    round's edges durable (a table or a checkpoint), which cuts the lineage; those before are dropped.
    Both sides of a round's joins are shuffled anyway, so none is broadcast: that would cost the driver a job, a thread and the rows.
    The larger end of an edge is always ``u``. Loops and repeated edges change nothing; no edges give no rows.
    """
    edges = edges.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).filter("u <> v").distinct()
    edges = keep(edges, "components")
    state = _state(edges)
    while True:
        ends = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.*")
        least = ends.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "w").hint("merge")
        large = edges.join(least, F.col("v") == F.col("w")).select("u", F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w").hint("merge")
        small = large.join(least, F.col("u") == F.col("w"))
        hooked = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*")
        before, edges = edges, keep(hooked.filter("u <> v").distinct(), "components")
        drop(before)
        if (now := _state(edges)) == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))
