"""Exact quantiles of groups of any size by histogram refinement, without a buffer of a group's values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenflow.plans.tables import durable

#: Cells of one refinement; each keeps its count and its least and greatest value.
CELLS = 1024
#: Values of one cell that a task may sort at once; a cell of more is refined again.
GATHERED = 65_536
#: Groups whose open cells may be broadcast; of more, the join is shuffled.
BROADCAST_GROUPS = 10_000


def _picked(values: DataFrame, open_cells: DataFrame, by: list[str]) -> DataFrame:
    """Each value in one of its group's open cells, with that cell; cells of a group don't overlap."""
    lists = open_cells.groupBy(*by).agg(F.collect_list(F.struct("lo", "hi", "below", "n")).alias("_cells"))
    if lists.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        lists = F.broadcast(lists)
    cell = F.get(F.filter("_cells", lambda c: (F.col("_x") >= c["lo"]) & (F.col("_x") <= c["hi"])), F.lit(0))
    return values.join(lists, by).select(*by, "_x", cell.alias("_c")).filter("_c is not null").select(*by, "_x", "_c.*")


def order_statistics(values: DataFrame, targets: DataFrame, by: list[str], cells: int = CELLS, gathered: int = GATHERED) -> DataFrame:
    """(by, rank, value): of each group of ``values`` (by, _x) the values at the ranks (from 0) of ``targets`` (by, rank, lo, hi, below, n).

    A target lies in a cell [lo, hi] of n values with ``below`` smaller ones. A
    round counts the open cells' values in ``cells`` equal parts, with map-side
    counts, and takes each target to its part. Ends of a part are values that
    occur, so the least and the greatest never share one again: parts always get
    smaller, however values tie. A part of one value is solved, however many rows
    have it; parts of at most ``gathered`` rows are sorted in the end. A round
    divides a cell's width by ``cells``, so values bunched into a tiny share of
    their group's width take as many rounds as that share has digits to this base.
    """
    solved = F.when((F.col("lo") == F.col("hi")) | (F.col("rank") == F.col("below")), F.col("lo")).when(F.col("rank") == F.col("below") + F.col("n") - 1, F.col("hi"))
    found, targets = None, durable(targets.select(*by, "rank", "lo", "hi", "below", "n").withColumn("value", solved), "quantile-targets")
    while True:
        done = targets.filter("value is not null").select(*by, "rank", "value")
        found = done if found is None else found.unionByName(done)
        wide = targets.filter((F.col("value").isNull()) & (F.col("n") > gathered))
        few = targets.filter((F.col("value").isNull()) & (F.col("n") <= gathered))
        cell = [*by, "lo", "hi", "below", "n"]
        if not few.isEmpty():
            lists = _picked(values, few.select(*cell).distinct(), by).groupBy(*cell).agg(F.array_sort(F.collect_list("_x")).alias("_all"))
            at = F.get("_all", (F.col("rank") - F.col("below")).cast("int"))
            found = found.unionByName(few.select(*cell, "rank").join(lists, cell).select(*by, "rank", at.alias("value")))
        if wide.isEmpty():
            return found
        part = F.least(F.floor((F.col("_x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * cells), F.lit(cells - 1)).alias("_part")
        parts = _picked(values, wide.select(*cell).distinct(), by).groupBy(*cell, part).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        before = F.col("below") + F.sum("_n").over(Window.partitionBy(*cell).orderBy("_part")) - F.col("_n")  # a row for each part
        parts = parts.withColumn("_before", before)
        own = wide.select(*cell, "rank").join(parts, cell).filter((F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("_n")))
        own = own.select(*by, "rank", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.col("_before").alias("below"), F.col("_n").alias("n"))
        targets = durable(own.withColumn("value", solved), "quantile-targets")


def exact_quantiles(df: DataFrame, by: list[str], column: str | Column, points: tuple[float, ...], cells: int = CELLS, gathered: int = GATHERED) -> DataFrame:
    """(by, n, quantiles): the interpolated quantiles of each group, as ``percentile`` gives them, and how many values it has.

    Nulls, NaN and infinities are no values; a group without any has no row. A
    null in ``by`` has no row either. Values are written once, as ``column`` may be
    costly, then read in two or three rounds; no task holds more than ``gathered``
    values, or the ``cells`` counts, of a cell.
    """
    x = (F.col(column) if isinstance(column, str) else column).cast("double")
    values = df.select(*by, x.alias("_x")).filter("_x is not null and not isnan(_x) and abs(_x) < double('infinity')").dropna(subset=by)
    values = durable(values, "quantile-values")
    ends = durable(values.groupBy(*by).agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.count(F.lit(1)).alias("n")), "quantile-ends")
    places = [F.lit(p) * (F.col("n") - 1) for p in points]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(k), F.ceil(k)) for k in places])))
    targets = ends.select(*by, "lo", "hi", F.lit(0).cast("long").alias("below"), "n", F.explode(ranks).alias("rank"))
    found = order_statistics(values, targets, by, cells, gathered)
    held = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_at"))
    at = lambda k: F.element_at("_at", k)
    one = lambda k: F.when(F.floor(k) == F.ceil(k), at(F.floor(k))).otherwise((F.ceil(k) - k) * at(F.floor(k)) + (k - F.floor(k)) * at(F.ceil(k)))
    return ends.join(held, by).select(*by, "n", F.array(*[one(k) for k in places]).alias("quantiles"))
