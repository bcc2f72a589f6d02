"""The old file cache, faults, single encoding after a failed batch, and galleries by folder."""

import json

import numpy as np
import pytest

from lumenflow.functions.images import encoded
from lumenflow.operators.scan import with_faults
from lumenflow.sources.cache import cached_analysis, cached_assignments, cached_vectors
from lumenflow.sources.files import image_files


@pytest.fixture
def root(tmp_path):
    for slug, lines in {
        "a__b c+d": [{"photo_id": "1", "cluster_id": 4, "model_version": "v1"}, {"photo_id": "2", "burst_id": 5, "cluster_id": 9, "more": 1}],
        "z": [{"photo_id": "1", "burst_id": None}],
    }.items():
        (tmp_path / "v3" / slug).mkdir(parents=True)
        (tmp_path / "v3" / slug / "analysis.jsonl").write_text("\n\n".join(map(json.dumps, lines)) + "\n")
    first = tmp_path / "v3" / "a__b c+d"
    (first / "assignments.jsonl").write_text('{"photo_id": "1", "parent_name": "Up", "concept_name": "Low", "job_id": 3}\n{"photo_id": "2", "concept_name": "Up", "detail_name": "Low"}')
    for name, n in (("embeddings", 2500), ("clip_embeddings", 3)):
        np.save(first / f"{name}.npy", np.arange(2 * n, dtype=np.float32).reshape(n, 2))
        (first / f"{name}_ids.json").write_text(json.dumps([str(k) for k in range(n - 1)]))
    np.save(tmp_path / "v3" / "z" / "embeddings.npy", np.zeros((2, 2)))  # no ids
    return tmp_path


def test_old_tables(spark, root):
    got = cached_analysis(spark, str(root), "photo_id string, burst_id long, pipeline_version string").collect()
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == [("a/b c+d", "1", 4, "v1"), ("a/b c+d", "2", 5, None), ("z", "1", None, None)]
    got = cached_assignments(spark, str(root), "photo_id string, concept_name string, detail_name string").collect()
    assert sorted(map(tuple, got)) == [("a/b c+d", "1", "Up", "Low"), ("a/b c+d", "2", "Up", "Low")]
    (root / "v3" / "z" / "analysis.jsonl").write_text("{no json")
    with pytest.raises(Exception, match="(?i)malformed"):
        cached_analysis(spark, str(root), "photo_id string").collect()


def test_old_vectors(spark, root):
    rows = {r.photo_id: (r.gallery, r.vector) for r in cached_vectors(spark, str(root)).collect()}
    assert len(rows) == 2499 and rows["2000"] == ("a/b c+d", [4000.0, 4001.0])
    assert cached_vectors(spark, str(root), "clip_embeddings").count() == 2


def test_faults_drop_rows_at_their_rate(spark):
    df = spark.range(20_000)
    assert with_faults(df, 0.0).count() == 20_000 and with_faults(df, 1.0).count() == 0
    assert 13_500 < with_faults(df, 0.3, seed=1).count() < 14_500


def test_a_failed_batch_is_encoded_one_by_one(spark):
    def make():
        def encode(contents):
            if b"bad" in contents:
                raise ValueError("bad")
            return np.array([[len(c), len(contents)] for c in contents])

        return encode

    rows = [(str(k), bytearray(b"bad" if k == 2 else b"x" * k)) for k in range(6)]
    df = spark.createDataFrame(rows, "path string, content binary").coalesce(1)
    got = {r.path: (r.status, r.embedding) for r in encoded(df, make, batch=4).collect()}
    assert got["2"] == ("ValueError", None)
    assert got["1"] == ("ok", [1.0, 1.0]) and got["5"] == ("ok", [5.0, 2.0])  # single, and in a whole batch


def test_galleries_below_a_root_with_odd_names(spark, tmp_path):
    root = tmp_path / "a.b" / "aXb" / "a.b"
    for f in ("x/y/1.jpg", "a.b/2.jpg"):
        (root / f).parent.mkdir(parents=True, exist_ok=True)
        (root / f).write_bytes(b"0")
    assert {(r.gallery, r.name) for r in image_files(spark, str(root)).collect()} == {("x/y", "1.jpg"), ("a.b", "2.jpg")}
