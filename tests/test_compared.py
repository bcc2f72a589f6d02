"""The sign test as an expression, and the judgement of one score against another."""

import pytest
from pyspark.sql import functions as F

from lumenflow.plans.preference import compared, sign_tail, sign_test


def test_sign_tail_is_the_exact_test(spark):
    pairs = [(a, b) for a in range(0, 40, 3) for b in range(0, 40, 5)] + [(700, 650), (1500, 1500)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", sign_tail(F.col("a"), F.col("b")).alias("p")).collect()
    assert len(got) == len(pairs)
    assert all(r.p == pytest.approx(sign_test(r.a, r.b), rel=1e-8) for r in got)


def results(spark, rows):
    return spark.createDataFrame(rows, "gallery_id long, score string, recall_burst double")


def test_better_everywhere_passes(spark):
    rows = [(g, s, 0.5 + 0.1 * (s == "fused")) for g in range(6) for s in ("prior", "fused", "pref")]
    r = compared(results(spark, rows), "prior", "fused").first()
    assert (r.galleries, r.better, r.worse, r.worse_ratio, r.passed) == (6, 6, 0, 0.0, True)
    assert r.p_value == pytest.approx(1 / 64) and r.mean_diff == pytest.approx(0.1)


def test_ties_missing_values_and_lone_scores(spark):
    rows = [(1, "prior", 0.5), (1, "fused", 0.5), (2, "prior", 0.4), (3, "fused", 0.9), (4, "prior", None), (4, "fused", 0.3), (None, "prior", 0.1), (None, "fused", 0.2)]
    r = compared(results(spark, rows), "prior", "fused").first()
    assert (r.galleries, r.better, r.worse, r.passed) == (2, 1, 0, False)
    r = compared(results(spark, []), "prior", "fused").first()
    assert (r.galleries, r.mean_diff, r.worse_ratio, r.p_value, r.passed) == (0, None, None, 1.0, False)
