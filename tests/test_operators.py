"""Operators on small hand-made cases."""

import base64
import json
import struct
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenflow.functions import documents as D
from lumenflow.functions import images as I
from lumenflow.functions import vectors as V
from lumenflow.operators import cluster, merge, scan, windows
from lumenflow.operators.aggregate import window_pairs
from lumenflow.operators.components import connected_components
from lumenflow.plans import preference as P
from lumenflow.plans.tables import durable

T0 = datetime(2026, 4, 15, 12)


def at(seconds):
    return None if seconds is None else datetime.fromtimestamp(T0.timestamp() + seconds)


def gallery(spark, rows, schema):
    return spark.createDataFrame([(1, i, i, *r) for i, r in enumerate(rows)], "gallery_id long, photo_id long, display_order long, " + schema)


def test_partition_order(spark):
    df = gallery(spark, [("A", at(3)), ("B", at(1)), ("A", at(1)), ("B", at(2)), (None, None)], "camera string, taken_at timestamp_ntz")
    got = windows.partition_order(df).orderBy("part", "pos").collect()
    parts = {}
    for r in got:
        parts.setdefault(r.part, []).append(r.photo_id)
    assert list(parts.values()) == [[2, 0], [1, 3], [4]]


def test_partition_order_with_a_missing_time_keeps_the_order(spark):
    df = gallery(spark, [("A", at(5)), ("A", None), ("A", at(1))], "camera string, taken_at timestamp_ntz")
    assert [r.photo_id for r in windows.partition_order(df).orderBy("pos").collect()] == [0, 1, 2]


def units(spark, blocks, gaps, share, cap=40):
    """Sizes of the units after cutting, absorbing and capping."""
    rows = [(1, k, n, None if not k else float(gaps[k - 1]), sum(blocks)) for k, n in enumerate(blocks)]
    table = spark.createDataFrame(rows, "gallery_id long, segment long, size long, gap_s double, n long")
    out = cluster.absorbed_segments(table, share, cap).join(table, ["gallery_id", "segment"]).groupBy("unit").agg(F.sum("size").alias("s")).orderBy("unit")
    return [r.s for r in out.collect()]


def test_absorption_and_cap(spark):
    assert units(spark, [10, 8, 12], [600, 400], 0.005) == [10, 8, 12]
    assert units(spark, [20, 3, 20], [3000, 400], 0.1) == [20, 23]
    assert units(spark, [4, 4, 4, 4], [900, 400, 1200], 0.0, 3) == [4, 8, 4]


def step_by_step(size, gap, least):
    """The same absorption, one neighbour at a time over a list of units."""
    left, cut = [[x] for x in size], list(gap)
    while len(left) > 1:
        k = min(range(len(left)), key=lambda i: (sum(left[i]), i))
        if sum(left[k]) >= least:
            break
        before, after = (cut[k - 1] if k else np.inf), (cut[k] if k < len(cut) else np.inf)
        a = k - 1 if before <= after else k
        left = left[:a] + [left[a] + left[a + 1]] + left[a + 2 :]
        cut = cut[:a] + cut[a + 1 :]
    return [sum(x) for x in left]


def test_absorption_against_single_steps():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 25))
        size, gap = rng.integers(1, 9, n), rng.integers(300, 320, n - 1).astype(float)
        stays = cluster._kept_boundaries(size, np.append(np.nan, gap), least := int(rng.integers(0, 20)))
        begins = np.flatnonzero(stays | (np.arange(n) == 0))
        assert np.add.reduceat(size, begins).tolist() == step_by_step(size.tolist(), gap.tolist(), least)


def test_linkages_from_means_alone_make_the_same_merges():
    x = np.random.default_rng(6).normal(size=(60, 768))
    for linkage in (cluster.average_linkage, cluster.ward_linkage):
        by_matrix, by_means = linkage(x), linkage(x, matrix_bytes=0)
        assert [m[:2] for m in by_matrix] == [m[:2] for m in by_means]
        np.testing.assert_allclose([m[2] for m in by_matrix], [m[2] for m in by_means], atol=1e-9)


def test_segmentation_by_time_and_by_images(spark):
    e, f = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, i, i, at(i) if i < 6 else at(600 + i), i, e if i < 6 else f) for i in range(12)]  # two stretches
    rows += [(1, 12, 12, None, 12, f)]  # no time: like the second
    rows += [(2, 20 + i, i, None, i, e if i % 3 else f) for i in range(9)]  # no times at all
    rows += [(3, 40 + i, i, at(0), i, e if i < 4 else f) for i in range(6)]  # all the same time
    df = spark.createDataFrame(rows, "gallery_id long, photo_id long, display_order long, taken_at timestamp_ntz, burst_id long, embedding array<double>")
    got = {r.photo_id: (r.mode, r.unit) for r in cluster.segmented(df, 300, k=2).collect()}
    assert [got[i] for i in range(13)] == [("time", 0)] * 6 + [("time", 1)] * 7
    assert {got[20 + i] for i in range(9) if i % 3} == {("visual", 0)} and {got[20 + i] for i in (0, 3, 6)} == {("visual", 1)}
    assert {got[40 + i] for i in range(4)} == {("visual", 0)} and len(got) == 28


def test_joint_space_of_wide_vectors(spark):
    x = np.random.default_rng(7).normal(size=(20, 768))
    df = spark.createDataFrame([(x[i].tolist(), x[-i - 1].tolist()) for i in range(20)], "a array<double>, b array<double>")
    got = df.select(V.dot(V.normalised("a"), V.normalised("b")).alias("c")).toPandas()["c"]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    np.testing.assert_allclose(got, (u * u[::-1]).sum(axis=1), atol=1e-12)


def test_exposures(spark):
    given = {0.005: "1/200", 1.0: "1", 2.5: "2.5", 30.123456: "30.1235", 9.999999: "10", 120.0: "120", 1234567.0: "1.23457e+06", 999999.7: "1e+06", 0.0: None}
    df = spark.createDataFrame([(k,) for k in given], "s double")
    assert {r.s: r.x for r in df.select("s", I.exposure_text("s").alias("x")).collect()} == given
    assert all(v == f"{k:g}" for k, v in given.items() if k >= 1)


def test_bursts_interleave(spark):
    e = [[1.0, 0.0], [0.0, 1.0]]
    df = gallery(spark, [("A", at(i), e[i % 2]) for i in range(6)], "camera string, taken_at timestamp_ntz, embedding array<double>")
    got = cluster.bursts(df, 0.96, durable).orderBy("photo_id").collect()
    assert [r.burst_id for r in got] == [0, 1, 0, 1, 0, 1]


def test_components_against_union_find(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(120)] + [(7, 7)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(edges, "u long, v long"), durable).collect()
    assert {r.node: r.component for r in got} == {x: root(x) for x in parent}


def test_rounds_of_components_have_no_union_and_no_broadcast(spark):
    plans = []

    def keep(df, label):
        plans.append(df._jdf.queryExecution().toString())
        return durable(df, label)

    edges = spark.createDataFrame([(i, i + 1) for i in range(20)], "u long, v long")
    assert {r.component for r in connected_components(edges, keep).collect()} == {0}
    assert len(plans) > 2 and not any("Union" in p or "BroadcastExchange" in p for p in plans)


def test_components_of_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long"), durable).count() == 0


def test_rank_reason(spark):
    rows = [(0, 90.0, 10.0, 1.0), (0, 10.0, 10.0, 1.0), (1, 50.0, 50.0, 1.0), (2, 50.0, 50.0, 2.0), (2, 50.0, 50.0, 1.0)]
    df = gallery(spark, rows, "burst_id long, technical_pct double, aesthetic_pct double, sharpness double")
    got = windows.burst_ranks(df).filter("burst_rank = 0").orderBy("burst_id").collect()
    assert [r.rank_reason for r in got] == ["technical", "single", "sharpness"]


def test_percentiles_of_missing_and_lone_values(spark):
    df = gallery(spark, [(None,), (float("nan"),), (3.0,)], "s double")
    assert [r.p for r in df.withColumn("p", windows.percentile("s")).collect()] == [50.0] * 3


def brute_average(x, distance):
    """Average linkage by definition, a pair of clusters at a time."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - x @ x.T
    groups = [[i] for i in range(len(x))]
    while len(groups) > 1:
        best = min(((d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j))
        if best[0] > distance:
            break
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(g) for g in groups}


def test_average_linkage_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(5):
        x = rng.normal(size=(8, 1, 6)) + 0.25 * rng.normal(size=(8, 5, 6))
        x = x.reshape(40, 6)
        labels = cluster.cut_groups(x, 0.2, share=1.0)
        assert {frozenset(np.flatnonzero(labels == k).tolist()) for k in set(labels)} == brute_average(x, 0.2)


def test_one_background_is_one_group_and_the_guard_raises_the_distance():
    rng = np.random.default_rng(2)
    one = rng.normal(size=16) + 0.02 * rng.normal(size=(20, 16))
    assert cluster.cut_groups(one).max() == 0
    two = np.concatenate([np.eye(16)[0] + 0.03 * rng.normal(size=(10, 16)), np.eye(16)[1] + 0.03 * rng.normal(size=(10, 16))])
    assert cluster.cut_groups(two, 0.01).max() + 1 == 2


def test_ward_finds_three_blocks():
    rng = np.random.default_rng(3)
    x = np.repeat(np.eye(8)[:3], 10, axis=0) + 0.02 * rng.normal(size=(30, 8))
    merges = cluster.ward_linkage(x)
    labels = cluster._labels(30, merges[:27])
    assert labels.tolist() == [0] * 10 + [1] * 10 + [2] * 10


def message(**change):
    photo = {"photoId": 1, "storageKey": "k", "previewKey": "p", "vector": base64.b64encode(struct.pack("<4f", 1, 2, 3, 4)).decode(), "metadata": {"takenAt": "2026-10-01T03:04:05+09:00", "cameraMake": "Canon", "iso": 400}}
    photo |= change.pop("photo", {})
    return json.dumps({"v": 1, "galleryId": 7, "embeddingModel": "m", "photos": [photo]} | change)


BAD = {
    "not JSON": "{",
    "array": "[]",
    "v2": message(v=2),
    "no v": json.dumps({"galleryId": 7, "embeddingModel": "m", "photos": []}),
    "photos": message(photos={}),
    "no model": message(embeddingModel=""),
    "string id": message(photo={"photoId": "1"}),
    "bool id": message(photo={"photoId": True}),
    "null key": message(photo={"storageKey": None}),
    "bad base64": message(photo={"vector": "%%%"}),
    "wrong dim": message(photo={"vector": base64.b64encode(struct.pack("<3f", 1, 2, 3)).decode()}),
    "NaN": message(photo={"vector": base64.b64encode(struct.pack("<4f", 1, 2, float("nan"), 4)).decode()}),
    "infinity": message(photo={"vector": base64.b64encode(struct.pack("<4f", 1, 2, float("-inf"), 4)).decode()}),
    "bad time": message(photo={"metadata": {"takenAt": "yesterday"}}),
    "long make": message(photo={"metadata": {"cameraMake": "x" * 101}}),
    "metadata list": message(photo={"metadata": []}),
    "null body": None,
}


@pytest.mark.parametrize("name", sorted(BAD))
def test_bad_messages(spark, name):
    df = spark.createDataFrame([(BAD[name],)], "body string")
    assert df.select(scan.message_error("body", 4).alias("e")).first().e is not None


def test_good_messages(spark):
    good = [message(), message(photos=[]), message(photo={"metadata": None})]
    df = spark.createDataFrame([(b,) for b in good], "body string").withColumn("e", scan.message_error("body", 4))
    assert [r.e for r in df.collect()] == [None] * 3
    row = scan.message_rows(df.limit(1)).first()
    assert (row.photo_id, row.taken_at, row.camera_make) == (1, datetime(2026, 10, 1, 3, 4, 5), "Canon")


def test_admin_events(spark):
    ok = {"jobType": "EMBEDDING", "storageKey": "k", "jobId": 1, "attemptCount": "2", "photoId": 3, "galleryId": 4, "revisionId": 5}
    cases = [(ok, None), (ok | {"jobType": "X"}, "UNSUPPORTED_JOB_TYPE"), (ok | {"storageKey": " "}, "INVALID_STORAGE_KEY"), (ok | {"jobId": True}, "INVALID_JOBID"), (ok | {"photoId": 0}, "INVALID_PHOTOID"), (ok | {"revisionId": "-1"}, "INVALID_REVISIONID"), ([], "INVALID_EVENT")]
    df = spark.createDataFrame([(json.dumps(c),) for c, _ in cases], "b string").select(scan.admin_event_error("b").alias("e"))
    assert [r.e for r in df.collect()] == [e for _, e in cases]


def test_bulk_write_golden(spark):
    """Live, updated, replaced, trashed and unknown photos: two of six results are written."""
    galleries = spark.createDataFrame([(7, None), (8, T0)], "gallery_id long, deleted_at timestamp")
    photos = spark.createDataFrame([(1, 7, "k1", "Old", 100, None, 0), (2, 7, "k2", "Old", 100, None, 0), (3, 7, "new3", "Old", 100, None, 0), (4, 8, "k4", "Old", 100, None, 0), (5, 7, "k5", "Old", 100, T0, 0)], "photo_id long, gallery_id long, storage_key string, camera_make string, iso int, deleted_at timestamp, version long")
    analysis = spark.createDataFrame([(2, [1.0], "m", [1.0, 1.0], 3)], "photo_id long, embedding array<double>, embedding_model string, clip array<double>, version long")
    new = spark.createDataFrame([(1, "k1", [1.0, 2.0], "m2", "Canon", 400), (2, "k2", [0.1, 0.2], "m2", None, None), (3, "k3", [9.0], "m2", "X", 1), (4, "k4", [9.0], "m2", "X", 1), (5, "k5", [9.0], "m2", "X", 1), (999, "k", [9.0], "m2", "X", 1)], "photo_id long, storage_key string, embedding array<double>, embedding_model string, camera_make string, iso int")
    ok = merge.accepted(new, photos, galleries)
    assert sorted(r.photo_id for r in ok.collect()) == [1, 2]
    a = {r.photo_id: r for r in merge.vector_upsert(analysis, ok).collect()}
    assert (a[1].embedding, a[1].version, a[1].clip) == ([1.0, 2.0], 0, None)
    assert (a[2].embedding, a[2].version, a[2].clip) == ([0.1, 0.2], 4, [1.0, 1.0])
    p = {r.photo_id: r for r in merge.photo_update(photos, ok, ["camera_make", "iso"], []).collect()}
    assert (p[1].camera_make, p[1].iso, p[2].camera_make, p[2].iso, p[3].camera_make) == ("Canon", 400, "Old", 100, "Old")


def test_markdown(spark):
    rows = [
        ("d", "a", None, 0, "heading_1", "T", False, None, None, None, None),
        ("d", "b", None, 1, "numbered_list_item", "x", False, None, None, None, None),
        ("d", "c", None, 2, "numbered_list_item", "y", False, None, None, None, None),
        ("d", "c1", "c", 0, "to_do", "z", True, None, None, None, None),
        ("d", "e", None, 3, "table", "", False, None, None, None, None),
        ("d", "e1", "e", 0, "table_row", "", False, None, None, None, ["h", "i"]),
        ("d", "e2", "e", 1, "table_row", "", False, None, None, None, ["1", "2"]),
        ("d", "f", None, 4, "image", "", False, None, None, "u", None),
        ("d", "g", None, 5, "paragraph", "", False, None, None, None, None),
        ("d", "h", None, 6, "numbered_list_item", "n", False, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id string, block_id string, parent_id string, pos int, type string, text string, checked boolean, language string, title string, url string, cells array<string>")
    assert D.markdown(df).first().markdown == "# T\n1. x\n2. y\n  - [x] z\n| h | i |\n|---|---|\n| 1 | 2 |\n[image] u\n1. n"
    assert '"c")' in D.markdown(df, 0).first().markdown


def test_rich_text(spark):
    df = spark.createDataFrame([([("a", None), ("b", "u")],)], "x array<struct<plain_text:string,href:string>>")
    assert df.select(D.rich_text(F.col("x")).alias("t")).first().t == "a[b](u)"


def test_upcoming_events(spark):
    rows = [("over", "2026-11-14T14:00", None), ("open", "2026-11-14T15:00", None), ("today", "2026-11-14", None), ("span", "2026-11-13", "2026-11-15"), ("next", "2026-11-15T10:00", "2026-11-15T11:00"), ("zone", "2026-11-16T10:00:00+00:00", None)]
    df = spark.createDataFrame([(*r, "", "") for r in rows], "title string, start string, end string, detail string, url string")
    got = D.upcoming(df, "2026-11-14 06:25:00").collect()
    assert [r.title for r in got] == ["span", "today", "open", "next", "zone"]
    assert [r.relative for r in got] == ["진행 중", "오늘", "진행 중", "내일", "모레"]
    assert got[3].when_text == "2026-11-15(일) 10:00~11:00" and got[4].when_text == "2026-11-16(월) 19:00"


def test_exposure_and_pgm(spark):
    df = spark.createDataFrame([(0.005,), (2.5,), (0.0,), (1.0,)], "s double").select(I.exposure_text("s").alias("t"))
    assert [r.t for r in df.collect()] == ["1/200", "2.5", None, "1"]
    gray = I.pgm(b"P5\n2 2\n255\n" + bytes([0, 255, 255, 0]))
    sharp, high, low, mean = I.classical(gray)
    assert (high, low, mean) == (0.5, 0.5, 127.5) and sharp > 0


def test_affine_fold():
    rng = np.random.default_rng(4)
    ws, bs = [rng.normal(size=(5, 7)), rng.normal(size=(3, 5)), rng.normal(size=(1, 3))], [rng.normal(size=n) for n in (5, 3, 1)]
    x = rng.normal(size=7)
    want = ws[2] @ (ws[1] @ (ws[0] @ x + bs[0]) + bs[1]) + bs[2]
    w, b = V.affine(ws, bs)
    assert np.isclose(np.dot(w, x) + b, want[0])


def test_sign_test_and_strength():
    assert P.sign_test(0, 0) == 1.0 and P.sign_test(5, 0) == 1 / 32 and np.isclose(P.sign_test(3, 1), 5 / 16)
    assert np.isclose(P.strength(1), 1 / 6) and P.strength(3, 0) == 1.0


def test_taste_is_learned(spark):
    """A hidden taste over three galleries: the fitted ranking finds it, the prior doesn't."""
    rng = np.random.default_rng(6)
    taste, rows = rng.normal(size=8), []
    for g in range(3):
        e = np.repeat(rng.normal(size=(80, 8)), 3, axis=0) + 0.01 * rng.normal(size=(240, 8))
        top = set(np.argsort(-(e[::3] @ taste))[:10] * 3)
        for i in range(240):
            rows.append((g, g * 1000 + i, i, i // 3, i % 3, i // 20, *map(float, rng.uniform(0, 100, 3)), "couple", e[i].tolist(), e[i].tolist(), i in top))
    df = spark.createDataFrame(rows, "gallery_id long, photo_id long, display_order long, burst_id long, burst_rank long, embed_group_id long, technical_pct double, aesthetic_pct double, sharpness_pct double, subject string, embedding array<double>, clip array<double>, selected boolean")
    f = P.features(df).cache()
    s = P.sample(f).cache()
    assert s.groupBy("gallery_id", "y").agg(F.round(F.sum("weight"), 9).alias("w")).select("w").distinct().collect() == [(0.5,)]
    model = P.fit(s)
    own = P.scored(f, model)
    ev = P.evaluate(own, own.join(s.select("gallery_id", "photo_id", "y"), ["gallery_id", "photo_id"]), ["prior", "pref"]).groupBy("score").agg(F.avg("auc").alias("auc"), F.avg("recall_burst").alias("r")).collect()
    by = {r.score: r for r in ev}
    assert by["pref"].auc > 0.9 and by["pref"].r > 0.9 and by["prior"].auc < 0.75


def test_merged_maps_and_keys(spark):
    df = spark.createDataFrame([([1, 2], ["a", "b"]), ([1], ["a", "b"]), ([1], [""])], "ids array<long>, keys array<string>")
    assert [r.p is not None for r in df.select(scan.paired_keys(F.col("ids"), F.col("keys")).alias("p")).collect()] == [True, False, False]


def test_mixed_models_fail(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "gallery_id long, embedding_model string")
    with pytest.raises(Exception, match="mixed embedding models"):
        scan.assert_single_model(df).collect()


def jpeg_with_exif():
    """A JPEG's head: EXIF with two directories, and a frame of 40 x 30."""
    texts = [(0x010F, b"Canon\0"), (0x0110, b"R5 \0")]
    head = 8 + 2 + 12 * 4 + 4
    data, first = b"", []
    for tag, raw in texts:
        first.append(struct.pack("<HHII", tag, 2, len(raw), head + len(data)) if len(raw) > 4 else struct.pack("<HHI4s", tag, 2, len(raw), raw))
        data += raw if len(raw) > 4 else b""
    first.append(struct.pack("<HHIHH", 0x0112, 3, 1, 6, 0))
    more = head + len(data)
    first.append(struct.pack("<HHII", 0x8769, 4, 1, more))
    tail = more + 2 + 12 * 3 + 4
    stamp = b"2026:10:01 03:04:05\0"
    second = [struct.pack("<HHII", 0x829A, 5, 1, tail), struct.pack("<HHIHH", 0x8827, 3, 1, 400, 0), struct.pack("<HHII", 0x9003, 2, len(stamp), tail + 8)]
    tiff = struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", 4) + b"".join(first) + b"\0" * 4 + data + struct.pack("<H", 3) + b"".join(second) + b"\0" * 4 + struct.pack("<II", 1, 200) + stamp
    app = b"Exif\0\0" + tiff
    frame = struct.pack(">BHH", 8, 30, 40) + b"\1"
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app) + 2) + app + b"\xff\xc0" + struct.pack(">H", len(frame) + 2) + frame + b"\xff\xd9"


def test_exif(spark):
    df = spark.createDataFrame([("a", bytearray(jpeg_with_exif())), ("b", bytearray(b"junk")), ("c", bytearray(b"\xff\xd8\xff\xe1\x00\x10Exif\0\0II"))], "path string, content binary")
    a, b, c = I.exif_rows(df).orderBy("path").collect()
    assert (a.taken_at, a.camera_make, a.camera_model, a.exposure_time, a.iso, a.width, a.height) == (datetime(2026, 10, 1, 3, 4, 5), "Canon", "R5", "1/200", 400, 30, 40)
    assert b.camera_make is None and b.byte_size == 4 and c.taken_at is None


def test_images_of_several_sizes_are_measured_as_one_by_one(spark):
    rng = np.random.default_rng(3)
    images = {f"{k}": rng.integers(0, 256, size) for k, size in enumerate([(2, 2), (5, 3), (2, 2), (1, 7), (5, 3)])}
    content = {k: b"P5\n%d %d\n255\n" % g.shape[::-1] + g.astype(np.uint8).tobytes() for k, g in images.items()} | {"bad": b"P6\n", "empty": b"P5\n0 0\n255\n"}
    got = {r.path: r for r in I.measured(spark.createDataFrame([(k, bytearray(c)) for k, c in content.items()], "path string, content binary").coalesce(1), I.pgm).collect()}
    assert {k for k, r in got.items() if r.status != "ok" and r.luma is None} == {"bad", "empty"}
    for k, g in images.items():
        assert np.allclose(got[k][1:5], I.classical(g.astype(np.uint8)))
    assert np.allclose([x[1] for x in I._classical(np.stack([images["0"], images["2"]]))], I.classical(images["2"]))


def test_pairs_in_blocks_are_those_of_one_window(spark):
    rows = [(k % 2, k, k // 2, [float(k % 5), 1.0]) for k in range(60)]
    df = spark.createDataFrame(rows, "gallery_id long, photo_id long, pos long, v array<double>")
    got = [sorted(map(tuple, window_pairs(df, ["pos"], "v", 3, place=place, block=block).collect())) for place, block in (("pos", 1024), ("pos", 4), (None, 7))]
    assert got[0] == got[1] == got[2] and {(a, b) for _, a, b, _ in got[0]} == {(a, a + 2 * d) for a in range(60) for d in (1, 2, 3) if a + 2 * d < 60}
