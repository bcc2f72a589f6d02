"""Fits of all folds in one pass against one fit after another, and the training job."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenflow.plans import folds
from lumenflow.plans import preference as P


@pytest.fixture(scope="module")
def world(spark):
    """Four small galleries with a hidden taste: (features, sample)."""
    rng = np.random.default_rng(11)
    taste, rows = rng.normal(size=5), []
    for g in range(4):
        e = np.repeat(rng.normal(size=(25, 5)), 3, axis=0) + 0.01 * rng.normal(size=(75, 5))
        top = set((np.argsort(-(e[::3] @ taste))[:6] * 3).tolist())
        for i in range(75):
            rows.append((g, g * 1000 + i, i, i // 3, i % 3, i // 15, *map(float, rng.uniform(0, 100, 3)), "couple", e[i].tolist(), e[i].tolist(), i in top))
    df = spark.createDataFrame(rows, "gallery_id long, photo_id long, display_order long, burst_id long, burst_rank long, embed_group_id long, technical_pct double, aesthetic_pct double, sharpness_pct double, subject string, embedding array<double>, clip array<double>, selected boolean")
    f = P.features(df).cache()
    return f, P.sample(f).cache()


def test_folds_are_the_single_fits_in_passes_for_all(world, monkeypatch):
    _, sample = world
    passes = []
    real = folds.losses
    monkeypatch.setattr(folds, "losses", lambda data, which, *a: passes.append(len(which)) or real(data, which, *a))
    models = folds.fit_folds(sample, [0, 1, 2, 3])
    assert passes[0] == 4 and sum(passes) > 2 * len(passes)
    want, got = P.fit(sample.filter("gallery_id <> 3")), models[3]
    assert got.n_galleries == want.n_galleries == 3
    assert np.allclose(got.w_scalar + got.w_emb + [got.bias], want.w_scalar + want.w_emb + [want.bias], atol=2e-6)
    assert folds.fit_folds(sample, [0]) == {}


def test_leave_one_out_as_one_fit_after_another(world, monkeypatch):
    monkeypatch.setattr(folds, "DONE", 1e-6)
    f, sample = world
    key = ["gallery_id", "score"]
    got = folds.leave_one_out(f, sample, [0, 1, 2]).sort_values(key).reset_index(drop=True)
    want = P.leave_one_out(f, sample, [0, 1, 2]).sort_values(key).reset_index(drop=True)
    pd.testing.assert_frame_equal(got[[*key, "recall_strict", "recall_burst", "auc"]], want[[*key, "recall_strict", "recall_burst", "auc"]], atol=1e-6)
    assert folds.leave_one_out(f, sample, [0]).empty


def test_training_job(world, monkeypatch):
    monkeypatch.setattr(folds, "DONE", 1e-3)
    f, sample = world
    out = folds.train(f, sample, [0, 1, 2], window=1)
    assert out["gate"]["galleries"] == 3 and out["model"]["n_galleries"] == 3 and out["model"]["active"] == out["gate"]["passed"]
    assert folds.train(f, sample, [0])["gate"]["reasons"] == ["fewer than 2 galleries"]
    model = P.Preference(out["model"]["w_scalar"], out["model"]["w_emb"], out["model"]["bias"], 3)
    checked = folds.sanity(f, model).orderBy("gallery_id").collect()
    assert [(r.photos, r.missing) for r in checked] == [(75, 0)] * 4 and all(r.deviation > 0 for r in checked)
