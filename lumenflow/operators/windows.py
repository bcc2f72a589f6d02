"""Ranking and windows within a gallery. ``display_order, photo_id`` break all ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BY = "gallery_id"
ORDER = ["display_order", "photo_id"]


def percentile(score: str, by: str = BY) -> Column:
    """100 * ordinal rank / (valid - 1); 50 for a missing score and for a lone valid one. NaN counts as missing."""
    v = F.when(~F.isnan(score), F.col(score))
    w = Window.partitionBy(by).orderBy(v.isNull(), v, *ORDER)
    n = F.count(v).over(Window.partitionBy(by))
    return F.when(v.isNull() | (n <= 1), F.lit(50.0)).otherwise(100.0 * (F.row_number().over(w) - 1) / (n - 1))


def set_percentiles(df: DataFrame, scores: dict[str, str], by: str = BY) -> DataFrame:
    """All percentiles after one shuffle by gallery."""
    return df.withColumns({name: percentile(score, by) for score, name in scores.items()})


def _burst_order() -> list[Column]:
    return [F.desc("technical_pct"), F.coalesce("sharpness", F.lit(0.0)).desc(), F.desc("aesthetic_pct"), F.col("photo_id").cast("string")]


def burst_ranks(df: DataFrame, by: str = BY) -> DataFrame:
    """burst_rank from 0, and rank_reason of the first: why it beats the others of its burst."""
    keys = [by, "burst_id"]
    w = Window.partitionBy(*keys).orderBy(*_burst_order())
    rest = w.rowsBetween(1, Window.unboundedFollowing)
    sharp = F.coalesce("sharpness", F.lit(0.0))
    best = {"t": F.max("technical_pct").over(rest), "s": F.max(sharp).over(rest), "a": F.max("aesthetic_pct").over(rest)}
    df = df.withColumns({"burst_rank": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys)), **{f"_{k}": v for k, v in best.items()}})
    reason = F.when(F.col("_n") == 1, "single").when(F.col("technical_pct") - F.col("_t") > 5, "technical").when(sharp > 1.25 * F.col("_s"), "sharpness").when(F.col("aesthetic_pct") - F.col("_a") > 5, "aesthetic").otherwise("tie")
    return df.withColumn("rank_reason", F.when(F.col("burst_rank") == 0, reason)).drop("_n", "_t", "_s", "_a")


def clear_unranked(df: DataFrame, scored: str, columns: list[str], by: str = BY) -> DataFrame:
    """Clears ranks in galleries with any row that isn't scored."""
    all_scored = F.bool_and(F.coalesce(scored, F.lit(False))).over(Window.partitionBy(by))
    return df.withColumns({c: F.when(all_scored, F.col(c)) for c in columns})


def partition_order(df: DataFrame, time: str = "taken_at", by: str = BY) -> DataFrame:
    """part (cameras by first appearance) and pos: by time if the camera's photos all have one, else as they come."""
    camera = F.coalesce("camera", F.lit(""))
    idx = F.row_number().over(Window.partitionBy(by).orderBy(*ORDER)) - 1
    df = df.withColumns({"idx": idx, "_cam": camera})
    cam = Window.partitionBy(by, "_cam")
    df = df.withColumns({"_first": F.min("idx").over(cam), "_gap": F.max(F.col(time).isNull()).over(cam)})
    df = df.withColumn("part", F.dense_rank().over(Window.partitionBy(by).orderBy("_first")) - 1)
    pos = F.row_number().over(cam.orderBy(F.when(~F.col("_gap"), F.col(time)).asc_nulls_first(), "idx")) - 1
    return df.withColumn("pos", pos).drop("_cam", "_first", "_gap")



def time_segments(df: DataFrame, gap_seconds: float = 300, time: str = "taken_at", by: str = BY) -> DataFrame:
    """segment from 0 in time order; a gap over ``gap_seconds`` begins one. gap_s: seconds since the photo before."""
    w = Window.partitionBy(by).orderBy(time, *ORDER)
    df = df.withColumn("_before", F.lag(time).over(w)).withColumn("gap_s", F.expr(f"timestampdiff(MICROSECOND, _before, {time})") / F.lit(1e6))
    return df.withColumn("segment", F.sum(F.when(F.col("gap_s") > gap_seconds, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_before")


def timeline(by: str = BY) -> Column:
    w = Window.partitionBy(by)
    return (F.row_number().over(w.orderBy(*ORDER)) - 1) / F.greatest(F.count(F.lit(1)).over(w) - 1, F.lit(1))


def renumbered(df: DataFrame, label: str, name: str, by: str = BY, first: str = "display_order") -> DataFrame:
    """Ids from 0 by first appearance."""
    df = df.withColumn("_first", F.min(F.struct(first, "photo_id")).over(Window.partitionBy(by, label)))
    return df.withColumn(name, F.dense_rank().over(Window.partitionBy(by).orderBy("_first")) - 1).drop("_first")


def coverage_prefix(groups: DataFrame, share: float = 0.85, images: int = 15, by: str = BY) -> DataFrame:
    """Groups (size, reps) by size that cover ``share`` with at most ``images`` pictures; the first is always taken, under two groups none."""
    w = Window.partitionBy(by)
    before = w.orderBy(F.desc("size"), "group_id").rowsBetween(Window.unboundedPreceding, -1)
    covered, shown = F.coalesce(F.sum("size").over(before), F.lit(0)), F.coalesce(F.sum("reps").over(before), F.lit(0))
    df = groups.withColumns({"_n": F.count(F.lit(1)).over(w), "_total": F.sum("size").over(w), "_covered": covered, "_shown": shown})
    # both sums only grow, so the first group that fails ends the prefix
    return df.withColumn("taken", (F.col("_n") >= 2) & ((F.col("_covered") == 0) | ((F.col("_covered") < share * F.col("_total")) & (F.col("_shown") + F.col("reps") <= images)))).drop("_n", "_total", "_covered", "_shown")


def dedup_order(df: DataFrame, score: str, by: str = BY) -> DataFrame:
    """dedup_rank (from 1) of each burst's best photo by score; null for the others. A negative burst is its own."""
    own = F.when(F.col("burst_id") >= 0, F.struct(F.lit(0).alias("k"), F.col("burst_id").alias("b"))).otherwise(F.struct(F.lit(1).alias("k"), F.col("photo_id").alias("b")))
    order = [F.desc(score), *ORDER]
    df = df.withColumn("_top", F.row_number().over(Window.partitionBy(by, own).orderBy(*order)) == 1)
    return df.withColumn("dedup_rank", F.when(F.col("_top"), F.row_number().over(Window.partitionBy(by, "_top").orderBy(*order)))).drop("_top")


def zscore(value, by: str = BY) -> Column:
    """(x - mean) / population deviation; a deviation up to 1e-12 counts as 1."""
    value = F.col(value) if isinstance(value, str) else value
    w = Window.partitionBy(by)
    std = F.stddev_pop(value).over(w)
    return (value - F.avg(value).over(w)) / F.when(std <= 1e-12, 1.0).otherwise(std)


def quantile_picks(df: DataFrame, group: list[str], order: list, quantiles: tuple[float, ...] = (0.1, 0.37, 0.63, 0.9)) -> DataFrame:
    """The member at round-half-even(q * (n - 1)) for each q, in ``pick`` order; one may come twice."""
    w = Window.partitionBy(*group)
    df = df.withColumns({"_pos": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count(F.lit(1)).over(w)})
    picks = F.array(*[F.struct(F.lit(i).alias("pick"), F.bround(F.lit(q) * (F.col("_n") - 1), 0).cast("long").alias("at")) for i, q in enumerate(quantiles)])
    return df.withColumn("_p", F.explode(picks)).filter(F.col("_p.at") == F.col("_pos")).withColumn("pick", F.col("_p.pick")).drop("_p", "_pos", "_n")


def unique_names(df: DataFrame, name: str, order: str, by: str = BY, default: str = "컨셉") -> DataFrame:
    """Names stripped, empty ones replaced, and the k-th of equals with its number after it."""
    df = df.withColumn("_name", F.coalesce(F.when(F.trim(name) != "", F.trim(name)), F.lit(default)))
    k = F.row_number().over(Window.partitionBy(by, "_name").orderBy(order))
    return df.withColumn("unique_name", F.when(k == 1, F.col("_name")).otherwise(F.concat_ws(" ", "_name", k.cast("string")))).drop("_name")


def chunks(n: int, by: str = BY) -> Column:
    return F.floor((F.row_number().over(Window.partitionBy(by).orderBy(*ORDER)) - 1) / n)
