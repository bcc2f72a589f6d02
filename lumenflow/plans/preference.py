"""The preference ranker: features, training sample, weighted logistic regression, evaluation and gate.

Rows are photos (gallery_id, photo_id, display_order, burst_id, burst_rank,
embed_group_id, technical_pct, aesthetic_pct, sharpness_pct, subject, embedding,
clip, selected). Everything that grows with photos is a DataFrame; the driver
holds one model and one line for each gallery and score.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import comb

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenflow.functions.vectors import centroids, dot, minus, normalised
from lumenflow.operators.aggregate import sizes
from lumenflow.operators.windows import BY, ORDER, dedup_order, timeline, zscore

#: The labels that become columns; any other is all zeros.
SUBJECTS = ["bride", "groom", "couple", "group"]
SCALARS = 3 + len(SUBJECTS) + 4


def scalars(df: DataFrame, by: str = BY) -> DataFrame:
    """Adds scalar (array of 11); needs no vectors, so they can be added after it and none are sorted."""
    w = Window.partitionBy(by)
    n = F.count(F.lit(1)).over(w)
    df = df.withColumns({"_burst": sizes("burst_id", by), "_group": sizes("embed_group_id", by), "_line": timeline(by), "_all": n})
    scalar = F.array(
        F.col("technical_pct") / 100,
        F.col("aesthetic_pct") / 100,
        F.col("sharpness_pct") / 100,
        *[(F.coalesce("subject", F.lit("")) == s).cast("double") for s in SUBJECTS],
        F.log(F.col("_group") / F.col("_all")),
        F.col("_line"),
        F.col("_burst") / F.max("_burst").over(w),
        (F.col("_burst") > 1).cast("double"),
    )
    return df.withColumn("scalar", scalar).drop("_burst", "_group", "_line", "_all")


def _joint(df: DataFrame) -> DataFrame:
    return df.withColumn("emb", F.concat(normalised("embedding", 1e-12), normalised("clip", 1e-12)))


def gallery_means(df: DataFrame, by: str = BY) -> DataFrame:
    """(gallery, emb_mean) over all photos of ``df`` (embedding, clip)."""
    return centroids(_joint(df), [by], "emb", "emb_mean")


def centred(df: DataFrame, means: DataFrame, by: str = BY) -> DataFrame:
    """Adds emb: both vectors normalised, joined, less the gallery's mean."""
    return _joint(df).join(F.broadcast(means), by).withColumn("emb", minus("emb", "emb_mean"))  # means: a row for each gallery


def features(df: DataFrame, by: str = BY) -> DataFrame:
    """Adds scalar (array of 11) and emb (both vectors normalised, joined, less the gallery's mean)."""
    df = scalars(df, by)
    return centred(df, gallery_means(df, by), by)


def sample(df: DataFrame, by: str = BY) -> DataFrame:
    """Training rows with y and weight.

    A positive weighs 1 over the positives of its burst; negatives are the best
    ranked rows of bursts without a positive; a positive's siblings are left out.
    Each class of a gallery sums to 0.5; galleries without one class give no rows.
    """
    own = F.when(F.col("burst_id") >= 0, F.struct(F.lit(0).alias("k"), F.col("burst_id").alias("b"))).otherwise(F.struct(F.lit(1).alias("k"), F.col("photo_id").alias("b")))
    df = df.withColumn("_own", own)
    w = Window.partitionBy(by, "_own")
    hits = F.sum(F.col("selected").cast("int")).over(w)
    first = F.row_number().over(w.orderBy(F.coalesce("burst_rank", F.lit(0)), *ORDER))
    df = df.withColumns({"_hits": hits, "_first": first}).filter(F.col("selected") | ((F.col("_hits") == 0) & (F.col("_first") == 1)))
    df = df.withColumns({"y": F.col("selected").cast("double"), "_raw": F.when(F.col("selected"), 1 / F.col("_hits")).otherwise(F.lit(1.0))})
    g = Window.partitionBy(by)
    both = (F.max("y").over(g) == 1) & (F.min("y").over(g) == 0)
    df = df.withColumns({"weight": 0.5 * F.col("_raw") / F.sum("_raw").over(Window.partitionBy(by, "y")), "_both": both})
    return df.filter("_both").drop("_own", "_hits", "_first", "_raw", "_both")


@dataclass
class Preference:
    w_scalar: list[float]
    w_emb: list[float]
    bias: float
    n_galleries: int

    def raw(self) -> Column:
        return dot("scalar", F.array(*map(F.lit, self.w_scalar))) + dot("emb", F.array(*map(F.lit, self.w_emb))) + F.lit(self.bias)

    def row(self) -> dict:
        return {"w_scalar": self.w_scalar, "w_emb": self.w_emb, "bias": self.bias, "n_galleries": self.n_galleries, "lambda": strength(self.n_galleries)}


def strength(n: int, n0: float = 5.0) -> float:
    """n / (n + n0); 1 without an n0."""
    return 1.0 if n0 <= 0 else n / (n + n0)


def prior() -> Column:
    return 0.5 * F.col("technical_pct") + 0.5 * F.col("aesthetic_pct")


def fused(model: Preference, lam: float | None = None, by: str = BY) -> Column:
    return zscore(prior(), by) + F.lit(strength(model.n_galleries) if lam is None else lam) * zscore(model.raw(), by)


def block_scale(rows: DataFrame, column: str) -> float:
    """Mean variance of a block's columns; 1 for a constant block."""
    parts = rows.select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.var_pop("x").alias("v"))
    v = parts.agg(F.avg("v")).first()[0]
    return 1.0 if v is None or v <= 1e-12 else float(v)


def fit(rows: DataFrame, l2_scalar: float = 0.02, l2_emb: float = 0.02, by: str = BY) -> Preference:
    """Weighted logistic loss plus reg * theta^2 with one strength for each block and a free bias.

    Columns are scaled by 1 / sqrt(2 * reg), so one common strength serves both blocks.
    """
    reg = (l2_scalar * block_scale(rows, "scalar"), l2_emb * block_scale(rows, "emb"))
    scale = [1 / np.sqrt(2 * r) for r in reg]
    x = F.concat(F.transform("scalar", lambda v: v * F.lit(float(scale[0]))), F.transform("emb", lambda v: v * F.lit(float(scale[1]))))
    data = rows.select(array_to_vector(x).alias("features"), F.col("y").alias("label"), "weight")  # the fit keeps blocks of rows itself
    model = LogisticRegression(maxIter=500, tol=1e-9, regParam=1.0, elasticNetParam=0.0, standardization=False, weightCol="weight").fit(data)
    c = model.coefficients.toArray()
    n = rows.select(by).distinct().count()
    return Preference((c[:SCALARS] * scale[0]).tolist(), (c[SCALARS:] * scale[1]).tolist(), float(model.intercept), n)


def recalls(df: DataFrame, score: str, k_times: int = 3, by: str = BY) -> DataFrame:
    """recall_strict and recall_burst of the selected photos among the first 3 * positives after burst dedup."""
    w = Window.partitionBy(by)
    d = dedup_order(df, score, by).withColumn("_k", k_times * F.greatest(F.sum(F.col("selected").cast("int")).over(w), F.lit(1)))
    d = d.withColumn("_top", F.coalesce(F.col("dedup_rank") <= F.col("_k"), F.lit(False)))
    burst_top = F.max(F.when(F.col("burst_id") >= 0, F.col("_top")).otherwise(False)).over(Window.partitionBy(by, "burst_id"))
    d = d.withColumn("_hit", F.col("_top") | ((F.col("burst_id") >= 0) & burst_top))
    pos = d.filter("selected")
    return pos.groupBy(by).agg(F.count(F.lit(1)).alias("positives"), F.first("_k").alias("k"), F.avg(F.col("_top").cast("int")).alias("recall_strict"), F.avg(F.col("_hit").cast("int")).alias("recall_burst"))


def auc(rows: DataFrame, score: str, by: str = BY) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties half: by the rank sum, without pairs."""
    w = Window.partitionBy(by)
    rank = F.rank().over(w.orderBy(score)) + (F.count(F.lit(1)).over(Window.partitionBy(by, score)) - 1) / 2.0
    r = rows.withColumn("_r", rank)
    p, n = F.sum("y"), F.sum(1 - F.col("y"))
    return r.groupBy(by).agg(F.when((p > 0) & (n > 0), (F.sum(F.when(F.col("y") == 1, F.col("_r"))) - p * (p + 1) / 2) / (p * n)).alias("auc"))


def evaluate(df: DataFrame, rows: DataFrame, scores: list[str], by: str = BY) -> DataFrame:
    """(gallery, score, positives, k, recall_strict, recall_burst, auc) of score columns; auc over the sample's rows."""
    out = None
    for s in scores:
        one = recalls(df, s, by=by).join(auc(rows, s, by), by, "left").withColumn("score", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out


def sign_test(better: int, worse: int) -> float:
    """One-sided exact binomial tail; 1 without any difference."""
    n = better + worse
    return 1.0 if not n else sum(comb(n, k) for k in range(better, n + 1)) / 2**n


def scored(df: DataFrame, model: Preference, by: str = BY) -> DataFrame:
    df = df.withColumn("_raw", model.raw())  # a number for each row, before windows need it
    raw = zscore("_raw", by)
    return df.withColumns({"prior": zscore(prior(), by), "pref": raw, "fused": zscore(prior(), by) + F.lit(strength(model.n_galleries)) * raw}).drop("_raw")


def leave_one_out(df: DataFrame, rows: DataFrame, galleries: list, by: str = BY) -> pd.DataFrame:
    """Each gallery judged by a model of the others; a fit is a Spark job over one cached sample. Under two galleries nothing."""
    found = []
    if len(galleries) < 2:
        return pd.DataFrame(columns=[by, "score", "recall_strict", "recall_burst", "auc"])
    sample = rows.filter(F.col(by).isin(galleries)).cache()
    for g in galleries:
        own = scored(df.filter(F.col(by) == g), fit(sample.filter(F.col(by) != g), by=by), by)
        kept = sample.filter(F.col(by) == g).select(by, "photo_id", "y")
        found.append(evaluate(own, own.join(kept, [by, "photo_id"]), ["prior", "pref", "fused"], by).toPandas())
    sample.unpersist()
    return pd.concat(found, ignore_index=True)


def gains(results: dict[int, pd.DataFrame], metric: str, by: str = BY) -> pd.DataFrame:
    """(galleries, gallery, gain of fused over prior) of all leave-one-out results."""
    rows = pd.concat([t.assign(galleries=n) for n, t in results.items()], ignore_index=True)
    wide = rows.pivot(index=["galleries", by], columns="score", values=metric)
    return (wide["fused"] - wide["prior"]).rename("gain").reset_index()


def gate(results: dict[int, pd.DataFrame], metric: str = "recall_burst", p_max: float = 0.05, worse_max: float = 0.3, window: int = 3, tolerance: float = 0.05, by: str = BY) -> dict:
    """Whether fused beats prior: significant, rarely worse, and not shrinking over the last galleries.

    ``results`` has leave-one-out results by number of galleries: of all n, and
    of the prefixes n - window … n. The verdict is a table of criteria, each with
    its value and limit; ``reasons`` are those that don't hold.
    """
    n = max(results, default=0)
    if n < 2:
        return {"galleries": n, "passed": False, "reasons": ["fewer than 2 galleries"]}
    table = gains(results, metric, by)
    last = table.loc[table["galleries"] == n, "gain"]
    curve = table[table["galleries"] >= n - window].groupby("galleries")["gain"].mean()
    p_value, worse = sign_test(int((last > 0).sum()), int((last < 0).sum())), float((last < 0).mean())
    criteria = pd.DataFrame(
        [
            ("not significant", p_value, p_max, p_value < p_max),
            ("worse too often", worse, worse_max, worse <= worse_max),
            ("too few galleries to judge stability", n, window + 2, n >= window + 2),
            ("the mean difference fell", -curve.diff().min(), tolerance, n < window + 2 or not (curve.diff() < -tolerance).any()),
        ],
        columns=["reason", "value", "limit", "ok"],
    )
    reasons = criteria.loc[~criteria["ok"].astype(bool), "reason"].tolist()
    out = {"galleries": n, "passed": not reasons, "reasons": reasons, "p_value": p_value, "worse_ratio": worse, "mean_diff": float(last.mean())}
    return out | ({"curve": curve.tolist()} if n >= window + 2 else {})


def sign_tail(better: Column, worse: Column) -> Column:
    """``sign_test`` as an expression over two counts of any size: terms go by logarithms."""
    n = better + worse
    start = F.struct(F.lit(0.0).alias("log"), F.when(better == 0, F.exp(-n * F.lit(float(np.log(2))))).otherwise(0.0).alias("tail"))

    def step(s: Column, i: Column) -> Column:
        log = s["log"] + F.log((n - i + 1) / i)
        return F.struct(log.alias("log"), (s["tail"] + F.when(i >= better, F.exp(log - n * F.lit(float(np.log(2))))).otherwise(0.0)).alias("tail"))

    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), start, step)["tail"]))


def compared(results: DataFrame, base: str, other: str, metric: str = "recall_burst", p_max: float = 0.05, worse_max: float = 0.3, by: str = BY) -> DataFrame:
    """One row that judges score ``other`` against ``base`` over the galleries that have both (gallery, score, metric).

    galleries, better, worse, mean_diff, worse_ratio, p_value and passed: significantly
    better and rarely worse. A missing metric counts for nothing; without any
    gallery the means are null, p_value is 1 and passed is false.
    """
    kept = results.filter(F.col("score").isin(base, other) & F.col(metric).isNotNull())
    value = lambda name: F.max(F.when(F.col("score") == name, F.col(metric)))
    gain = kept.groupBy(by).agg((value(other) - value(base)).alias("gain")).filter("gain is not null")
    total = gain.agg(F.count(F.lit(1)).alias("galleries"), F.count_if(F.col("gain") > 0).alias("better"), F.count_if(F.col("gain") < 0).alias("worse"), F.avg("gain").alias("mean_diff"))
    total = total.withColumns({"worse_ratio": F.try_divide("worse", "galleries"), "p_value": sign_tail(F.col("better"), F.col("worse"))})
    return total.withColumn("passed", F.coalesce((F.col("p_value") < p_max) & (F.col("worse_ratio") <= worse_max), F.lit(False)))
