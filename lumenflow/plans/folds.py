"""Leave-one-gallery-out fits of the preference ranker, all folds in one pass for each step.

A fold leaves one gallery out. Every training row belongs to all folds but its
own gallery's, so one pass over the rows works out losses and gradients of all
folds: a task multiplies its rows with the matrix of the folds' weights, and sends
one sum for each fold. The steps are those of limited-memory BFGS, taken for all
folds alike on the driver, which holds a few vectors for each fold. So the number
of jobs is that of the steps, however many galleries there are.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenflow.functions.vectors import dot
from lumenflow.operators.windows import BY, zscore
from lumenflow.plans.preference import SCALARS, Preference, evaluate, prior, strength
from lumenflow.plans.tables import durable

#: Steps at most; pairs of steps that BFGS remembers; the gradient at which a fold is done.
STEPS, MEMORY, DONE = 500, 12, 1e-8
#: Differences of losses that are rounding.
NOISE = 1e-13


def column_sums(rows: DataFrame, by: str = BY) -> dict:
    """Of each gallery: rows, weight, and the sums and square sums of all columns (scalar, then emb)."""
    own = rows.select(by, "weight", F.posexplode(F.concat("scalar", "emb")).alias("i", "x"))
    sums = own.groupBy(by, "i").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    lists = sums.groupBy(by).agg(F.first("n").alias("n"), F.first("w").alias("w"), F.array_sort(F.collect_list(F.struct("i", "s", "q"))).alias("c"))
    return {r[by]: (r["n"], r["w"], np.array([x["s"] for x in r["c"]]), np.array([x["q"] for x in r["c"]])) for r in lists.collect()}


def fold_scales(sums: dict, galleries: list, reg: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Of each fold: the factors of its columns (1 / sqrt(2 * reg * mean variance of the block)), and its weight."""
    total = [sum(s[k] for s in sums.values()) for k in range(4)]
    scales, weights = [], []
    for g in galleries:
        n, w, s, q = (t - o for t, o in zip(total, sums[g], strict=True))
        variance = np.maximum(q / n - (s / n) ** 2, 0)
        blocks = [float(v.mean()) for v in (variance[:SCALARS], variance[SCALARS:])]
        factors = [1 / np.sqrt(2 * r * (1.0 if b <= 1e-12 else b)) for r, b in zip(reg, blocks, strict=True)]
        scales.append(np.repeat(factors, [SCALARS, len(variance) - SCALARS]))
        weights.append(w)
    return np.array(scales), np.array(weights)


def losses(data: DataFrame, folds: np.ndarray, theta: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted logistic losses of some folds and their gradients (columns, then bias), in one pass over the rows (fold, y, weight, x).

    ``fold`` is the fold that leaves the row out.
    """
    shared = data.sparkSession.sparkContext.broadcast((folds, theta, bias))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folds, theta, bias = shared.value
        loss, grad = np.zeros(len(folds)), np.zeros((len(folds), theta.shape[1] + 1))
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["x"].to_numpy())
            y = pdf["y"].to_numpy()[:, None]
            w = pdf["weight"].to_numpy()[:, None] * (pdf["fold"].to_numpy()[:, None] != folds[None, :])
            m = x @ theta.T + bias[None, :]
            loss += (w * (np.logaddexp(0, m) - y * m)).sum(axis=0)
            r = w * (1 / (1 + np.exp(-np.clip(m, -700, 700))) - y)
            grad[:, :-1] += r.T @ x
            grad[:, -1] += r.sum(axis=0)
        yield pd.DataFrame({"fold": folds, "loss": loss, "grad": list(grad)})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fold": pdf["fold"].iloc[:1], "loss": [pdf["loss"].sum()], "grad": [np.stack(pdf["grad"].to_numpy()).sum(axis=0)]})

    schema = "fold int, loss double, grad array<double>"
    rows = data.mapInPandas(partial, schema).groupBy("fold").applyInPandas(whole, schema).toPandas().set_index("fold").loc[folds]  # a row for each task and fold is shuffled
    shared.unpersist()
    return rows["loss"].to_numpy(), np.stack(rows["grad"].to_numpy())


class _Bfgs:
    """One fold's state: where it is, its gradient there, and its last steps."""

    def __init__(self, size: int):
        self.at, self.value, self.grad, self.past = np.zeros(size), None, None, deque(maxlen=MEMORY)
        self.step, self.way, self.done = 1.0, None, False

    def propose(self) -> np.ndarray:
        if self.grad is None:
            return self.at
        if self.way is None:
            q, used = self.grad.copy(), []
            for s, y in reversed(self.past):
                a = (s @ q) / (y @ s)
                q -= a * y
                used.append(a)
            if self.past:
                s, y = self.past[-1]
                q *= (s @ y) / (y @ y)
            for (s, y), a in zip(self.past, reversed(used), strict=True):
                q += (a - (y @ q) / (y @ s)) * s
            self.way, self.step = -q, 1.0 if self.past else min(1.0, 1 / max(np.linalg.norm(q), 1e-12))
        return self.at + self.step * self.way

    def tell(self, at: np.ndarray, value: float, grad: np.ndarray) -> None:
        if self.grad is not None:
            slope = self.grad @ self.way
            if value > self.value + 1e-4 * self.step * slope + NOISE:
                self.step /= 2
                self.done = self.step < 1e-10  # no lower loss can be told from here
                return
            s, y = at - self.at, grad - self.grad
            if s @ y > 1e-16:
                self.past.append((s, y))
            self.done = np.abs(s).max() < 1e-13
        self.at, self.value, self.grad, self.way = at, value, grad, None
        self.done = self.done or float(np.abs(grad).max()) < DONE


def fit_folds(rows: DataFrame, galleries: list, l2_scalar: float = 0.02, l2_emb: float = 0.02, by: str = BY, keep=durable) -> dict:
    """A model for each gallery, fitted on all the others: the minimum that ``fit`` finds for each fold.

    ``rows`` are training rows (gallery, scalar, emb, y, weight) of ``galleries``.
    Under two galleries there is nothing to fit.
    """
    if len(galleries) < 2:
        return {}
    place = F.create_map(*[F.lit(v) for k, g in enumerate(galleries) for v in (g, k)])
    data = keep(rows.select(place[F.col(by)].cast("int").alias("fold"), F.col("y").cast("double").alias("y"), F.col("weight").cast("double").alias("weight"), F.concat("scalar", "emb").alias("x")), "folds")
    scales, weights = fold_scales(column_sums(rows, by), galleries, (l2_scalar, l2_emb))
    states = [_Bfgs(scales.shape[1] + 1) for _ in galleries]
    for _ in range(STEPS):
        open_ = np.array([k for k, s in enumerate(states) if not s.done], dtype=np.int32)
        if not len(open_):
            break
        at = np.stack([states[k].propose() for k in open_])
        loss, grad = losses(data, open_, at[:, :-1] * scales[open_], at[:, -1])
        for j, k in enumerate(open_):
            u = at[j, :-1]
            g = grad[j] / weights[k]
            states[k].tell(at[j], loss[j] / weights[k] + 0.5 * float(u @ u), np.append(g[:-1] * scales[k] + u, g[-1]))
    out = {}
    for g, s, scale in zip(galleries, states, scales, strict=True):
        theta = s.at[:-1] * scale
        out[g] = Preference(theta[:SCALARS].tolist(), theta[SCALARS:].tolist(), float(s.at[-1]), len(galleries) - 1)
    return out


def leave_one_out(df: DataFrame, rows: DataFrame, galleries: list, by: str = BY, keep=durable) -> pd.DataFrame:
    """Each gallery judged by a model of the others, as ``preference.leave_one_out``, in jobs that don't grow with the galleries."""
    columns = [by, "score", "recall_strict", "recall_burst", "auc"]
    if len(galleries) < 2:
        return pd.DataFrame(columns=columns)
    sample = keep(rows.filter(F.col(by).isin(galleries)), "sample")
    models = fit_folds(sample, galleries, by=by, keep=keep)
    kind = dict(rows.dtypes)[by]
    table = df.sparkSession.createDataFrame([(g, m.w_scalar, m.w_emb, m.bias) for g, m in models.items()], f"`{by}` {kind}, _ws array<double>, _we array<double>, _b double")
    own = df.join(F.broadcast(table), by)  # one model for each gallery
    raw = dot("scalar", "_ws") + dot("emb", "_we") + F.col("_b")
    own = own.withColumn("_raw", raw).withColumns({"prior": zscore(prior(), by), "pref": zscore(F.col("_raw"), by)})
    own = own.withColumn("fused", F.col("prior") + F.lit(strength(len(galleries) - 1)) * F.col("pref")).drop("_ws", "_we", "_b", "_raw")
    own = keep(own, "scored")
    return evaluate(own, own.join(sample.select(by, "photo_id", "y"), [by, "photo_id"]), ["prior", "pref", "fused"], by).toPandas()


def train(df: DataFrame, rows: DataFrame, galleries: list, by: str = BY, keep=durable, window: int = 3) -> dict:
    """The training job: the gate over leave-one-out results of all galleries and of the last prefixes, and the model row of all.

    ``galleries`` are in the order in which they were closed. The row is active
    only if the gate passes; under two galleries there is neither.
    """
    from lumenflow.plans.preference import fit, gate

    n = len(galleries)
    results = {m: leave_one_out(df, rows, galleries[:m], by, keep) for m in range(max(2, n - window), n + 1)} if n >= 2 else {}
    verdict = gate(results, by=by)
    model = fit(rows.filter(F.col(by).isin(galleries)), by=by) if n else None
    return {"gate": verdict, "model": None if model is None else model.row() | {"active": bool(verdict["passed"])}}


def sanity(df: DataFrame, model: Preference, by: str = BY) -> DataFrame:
    """(gallery, photos, mean, deviation, missing) of a model's scores: what a run looks at before a model is used."""
    own = df.withColumn("_raw", model.raw())
    bad = F.col("_raw").isNull() | F.isnan("_raw")
    return own.groupBy(by).agg(F.count(F.lit(1)).alias("photos"), F.avg(F.when(~bad, F.col("_raw"))).alias("mean"), F.stddev_pop(F.when(~bad, F.col("_raw"))).alias("deviation"), F.count_if(bad).alias("missing"))
