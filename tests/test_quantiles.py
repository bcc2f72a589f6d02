"""Quantiles by refinement give what sorting a group gives."""

import numpy as np
import pytest

from lumenflow.operators import quantiles as Q
from lumenflow.operators.aggregate import similarity_profile

POINTS = (0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0)


def groups():
    r = np.random.default_rng(5)
    return {
        1: r.normal(size=3000),
        2: np.repeat([0.25, 0.5, 0.75], [1000, 5, 700]),  # ties hold whole parts
        3: np.array([7.0]),
        4: np.exp(r.uniform(-10, 10, size=800)),  # nearly all values in the first part
        5: np.concatenate([np.full(2000, 0.1), [0.1 + 1e-9 * k for k in range(40)], [-1, 1]]),
        6: np.array([-0.5, 0.5]),
    }


@pytest.mark.parametrize("cells,gathered", [(64, 10), (1024, 4096)])
def test_quantiles_are_exact(spark, cells, gathered):
    rows = [(g, float(x)) for g, xs in groups().items() for x in xs]
    rows += [(1, None), (1, float("nan")), (1, float("inf")), (8, None), (None, 1.0)]
    df = spark.createDataFrame(rows, "gallery_id long, x double").repartition(3)
    got = {r.gallery_id: r for r in Q.exact_quantiles(df, ["gallery_id"], "x", POINTS, cells, gathered).collect()}
    assert sorted(got) == sorted(groups())
    for g, xs in groups().items():
        assert got[g].n == len(xs)
        np.testing.assert_allclose(got[g].quantiles, np.quantile(xs, POINTS), rtol=1e-12, atol=1e-12)


def test_profile_without_pairs(spark):
    none = spark.createDataFrame([], "gallery_id long, a long, b long, cosine double")
    assert similarity_profile(none).count() == 0


def test_no_task_sorts_a_group(spark):
    df = spark.range(20_000).selectExpr("id % 2 as g", "cast(hash(id) as double) as x")
    plans = []
    kept, Q._picked = Q._picked, lambda v, c, by: plans.append(c.agg({"n": "max"}).first()[0]) or kept(v, c, by)
    try:
        got = Q.exact_quantiles(df, ["g"], "x", (0.5,), cells=32, gathered=500).collect()
    finally:
        Q._picked = kept
    assert len(got) == 2 and plans[0] == 10_000 and plans[-1] <= 500
