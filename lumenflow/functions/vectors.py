"""Vector expressions over array<double> columns, inside the JVM."""

from __future__ import annotations

import base64
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bound(value, use) -> Column:
    """``use(value)`` with the value worked out once: inside a lambda Spark works out an outer expression anew for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalised(v, eps: float = 1e-8) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return bound(v, lambda u: bound(F.greatest(norm(u), F.lit(eps)), lambda n: F.transform(u, lambda x: x / n)))


def cosine(a, b, eps: float = 1e-8) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


def concat_space(e, c) -> Column:
    """Both parts normalised, joined, and normalised: its cosine is the mean of the parts' cosines, or the other part's where one is zero."""
    return normalised(F.concat(normalised(e), normalised(c)))


def minus(a, b) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def centroids(df: DataFrame, keys: list[str], vector: str, name: str = "centroid") -> DataFrame:
    """Mean vector by group: components are averaged in a partial aggregation, so no group meets in one task."""
    parts = df.select(*keys, F.posexplode(vector).alias("_i", "_x")).groupBy(*keys, "_i").agg(F.avg("_x").alias("_x"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias(name))


def best_label(image, prototypes: dict[str, list[float]], min_margin: float = 0.01, unknown: str = "unknown") -> Column:
    """struct<label, score, margin> of the prototype with the highest cosine; ``unknown`` under the margin."""
    scored = F.array(*[F.struct(dot(normalised(image), normalised(F.array(*map(F.lit, p)))).alias("score"), F.lit(k).alias("label")) for k, p in sorted(prototypes.items())])
    ranked = F.reverse(F.array_sort(scored))
    margin = F.get(ranked, 0)["score"] - F.get(ranked, 1)["score"]
    return F.struct(F.when(margin < min_margin, unknown).otherwise(F.get(ranked, 0)["label"]).alias("label"), F.get(ranked, 0)["score"].alias("score"), margin.alias("margin"))


def affine(weights: list[np.ndarray], biases: list[np.ndarray]) -> tuple[list[float], float]:
    """Folds linear layers without activations into one dot product and a bias."""
    w, b = weights[0], biases[0]
    for nw, nb in zip(weights[1:], biases[1:], strict=True):
        w, b = nw @ w, nw @ b + nb
    return w.reshape(-1).tolist(), float(b.reshape(-1)[0])


def affine_score(v, w: list[float], b: float) -> Column:
    return dot(v, F.array(*map(F.lit, w))) + F.lit(b)


def _decoded(text: pd.Series) -> pd.Series:
    def one(x):
        try:
            v = np.frombuffer(base64.b64decode(x, validate=True), "<f4")
        except (TypeError, ValueError):
            return None
        return v.tolist() if np.isfinite(v).all() else None

    return text.map(one)


def _encoded(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else base64.b64encode(struct.pack(f"<{len(v)}f", *v)).decode())


def _text(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else "[" + ",".join(f"{x:.9g}" for x in v) + "]")


def decode_f32(text) -> Column:
    """Little-endian float32 values of a base64 string; null where it isn't one or holds NaN or infinity."""
    return F.pandas_udf(_decoded, "array<float>")(text)


def encode_f32(vector) -> Column:
    return F.pandas_udf(_encoded, "string")(vector)


def vector_text(vector) -> Column:
    """[a,b,…] with nine significant digits, which float32 round-trips through."""
    return F.pandas_udf(_text, "string")(vector)
