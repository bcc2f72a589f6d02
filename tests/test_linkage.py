"""Clustering in rounds over tables gives the groups of the chain in one task."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenflow.functions.vectors import concat_space, norm
from lumenflow.operators import cluster, linkage
from lumenflow.plans.tables import durable, made


def blobs(rng, groups, dims=6, centers=8):
    """(grp, item, vector): groups around random centres, some items repeated."""
    rows, item = [], 0
    for g, n in enumerate(groups):
        c = rng.normal(size=(centers, dims))
        x = c[rng.integers(0, centers, n)] + 0.3 * rng.normal(size=(n, dims))
        x[: n // 5] = x[n // 5 : 2 * (n // 5)]
        for v in x:
            rows.append((f"g{g}", item, v.tolist()))
            item += 1
    return rows


def partition(rows, labels):
    out = {}
    for r, k in zip(rows, labels):
        out.setdefault((r[0], int(k)), set()).add(r[1])
    return {frozenset(s) for s in out.values()}


def by_group(rows):
    names = dict.fromkeys(r[0] for r in rows)
    return [(g, [r for r in rows if r[0] == g]) for g in names]


@pytest.mark.parametrize("kind", ["average", "ward"])
def test_rounds_merge_as_the_chain_does(spark, kind):
    rows = blobs(np.random.default_rng(7), [1, 2, 30, 50])
    items = spark.createDataFrame(rows, "grp string, item long, vector array<double>")
    got = {}
    for r in linkage.linkage_merges(items, durable, kind, local=12, tile=16).collect():
        assert r.a < r.b
        got.setdefault(r.grp, []).append(r.height)
    for g, own in by_group(rows):
        x = np.array([r[2] for r in own])
        want = [h for *_, h in (linkage.average_linkage(x) if kind == "average" else linkage.ward_linkage(x))]
        assert np.allclose(sorted(got.get(g, [])), want, atol=1e-6)


def test_average_parts_against_one_task(spark):
    rows = blobs(np.random.default_rng(8), [60, 1, 45])
    items = spark.createDataFrame(rows, "grp string, item long, vector array<double>")
    for distance in (0.05, 0.2):
        got = {r.item: r.part for r in linkage.average_parts(items, durable, distance, local=12, tile=8).collect()}
        want = set().union(*[partition(own, linkage.cut_groups(np.array([r[2] for r in own]), distance)) for _, own in by_group(rows)])
        assert partition(rows, [got[r[1]] for r in rows]) == want


def test_ward_parts_against_one_task(spark):
    rows = blobs(np.random.default_rng(9), [50, 3])
    items = spark.createDataFrame(rows, "grp string, item long, vector array<double>")
    got = {r.item: r.part for r in linkage.ward_parts(items, durable, 7, local=12, tile=8).collect()}
    want = set()
    for _, own in by_group(rows):
        x = np.array([r[2] for r in own])
        want |= partition(own, linkage._labels(len(x), linkage.ward_linkage(x)[: max(0, len(x) - 7)]))
    assert partition(rows, [got[r[1]] for r in rows]) == want


def test_equal_vectors_need_no_rounds(spark):
    rows = [("g", i, [1.0, 0.0]) for i in range(200)] + [("g", 200 + i, [0.0, 1.0]) for i in range(200)] + [("z", 500 + i, [0.0, 0.0]) for i in range(20)]
    items = spark.createDataFrame(rows, "grp string, item long, vector array<double>")
    merges = linkage.linkage_merges(items, durable, "average", local=2, tile=16).collect()
    assert len(merges) == 399 + 19 and sorted(m.height for m in merges if m.grp == "g")[-2:] == [0.0, 1.0]
    assert linkage.linkage_merges(items.limit(0), durable).count() == 0


def test_equal_distances(spark):
    """A square grid has many ties; all items merge, heights never fall below the least distance."""
    rows = [("g", 10 * i + j, [float(i), float(j)]) for i in range(6) for j in range(6)]
    items = spark.createDataFrame(rows, "grp string, item long, vector array<double>")
    merges = linkage.linkage_merges(items, durable, "ward", local=2, tile=8).collect()
    assert len(merges) == 35 and len({m.b for m in merges}) == 35 and math.isclose(min(m.height for m in merges), 1.0)


def test_groups_and_units_at_any_bound(spark):
    """detail_groups and visual_units give the same rows whether or not a group is over the bound."""
    rng = np.random.default_rng(10)
    c = rng.normal(size=(6, 8))
    rows = [(g, k % 2, i, 1000 * g + i, (c[rng.integers(0, 6)] + 0.25 * rng.normal(size=8)).tolist()) for g, n in ((1, 60), (2, 6)) for i, k in enumerate(range(n))]
    df = spark.createDataFrame(rows, "gallery_id long, concept long, display_order long, photo_id long, x array<double>")
    plain = lambda d: sorted(map(tuple, d.collect()))
    cols = ["gallery_id", "concept", "photo_id", "embed_group_id"]
    assert plain(cluster.detail_groups(df, local=8).select(cols)) == plain(cluster.detail_groups(df).select(cols))
    cols = ["gallery_id", "photo_id", "unit"]
    assert plain(cluster.visual_units(df, 5, "x", local=8).select(cols)) == plain(cluster.visual_units(df, 5, "x").select(cols))


def test_joint_vector_of_a_zero_part(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [0.0, 0.0])], "e array<double>, c array<double>")
    got = [r.n for r in df.select(norm(concat_space("e", "c")).alias("n")).collect()]
    assert np.allclose(got, [1, 1, 0])
    assert df.select(concat_space(F.col("e"), F.col("c")).alias("x")).first().x == [0.6, 0.8, 0.0, 0.0]


def test_shared_vectors_and_vectors_without_a_length(spark):
    """Groups that share vectors give each its own parts; photos with a zero vector stay apart, as in one task."""
    rng = np.random.default_rng(11)
    c = rng.normal(size=(12, 6))
    base = [(c[k % 12] + 0.2 * rng.normal(size=6)).tolist() for k in range(40)] + [[0.0] * 6] * 3
    rows = [(f"g{g}", 100 * g + i, v) for g in range(4) for i, v in enumerate(base[g:])]
    items = spark.createDataFrame(rows, "grp string, item long, vector array<double>")
    got = {r.item: r.part for r in linkage.average_parts(items, durable, 0.2, local=4, tile=8).collect()}
    want = set().union(*[partition(own, linkage.cut_groups(np.array([r[2] for r in own]), 0.2)) for _, own in by_group(rows)])
    assert partition(rows, [got[r[1]] for r in rows]) == want


def test_cells_send_a_row_once_for_each_tile(spark):
    rows = [("g", i, 1, i % 3 > 0, [float(i)]) for i in range(300)]
    cells = linkage._cells(spark.createDataFrame(rows, "grp string, cluster long, size long, open boolean, mean array<double>"), 50)
    n = cells.groupBy("cluster").count().collect()
    assert {r["count"] for r in n if r.cluster % 3 == 0} == {4} and {r["count"] for r in n if r.cluster % 3} == {6}


def test_rounds_leave_no_tables_of_clusters(spark):
    """A round's tables go when the next one has its own: only narrow results are left on disk."""
    rows = blobs(np.random.default_rng(12), [40, 5])
    items = spark.createDataFrame(rows, "grp string, item long, vector array<double>")
    mark = len(made)
    merges = linkage.linkage_merges(items, durable, "ward", local=12, tile=16)
    left = {os.path.basename(p).split("-")[0] for p in made[mark:] if os.path.isdir(p)}
    assert left == {"first", "merges"} and merges.count() == 43


def test_passes_send_a_row_a_few_times(spark):
    """Whatever the number of tiles, a pass sends an open row four times at most; all passes make up all cells."""
    rows = [("g", i, 1, i % 3 > 0, [float(i)]) for i in range(300)] + [("z", 500 + i, 1, True, [0.0]) for i in range(30)]
    clusters = spark.createDataFrame(rows, "grp string, cluster long, size long, open boolean, mean array<double>")
    plain = lambda d: sorted(map(tuple, d.drop("mean").collect()))
    passes = [plain(linkage._cells(clusters, 20, k)) for k in range(linkage._passes(linkage._tiles(clusters, 20)))]
    assert len(passes) == 6 and sorted(sum(passes, [])) == plain(linkage._cells(clusters, 20))
    sent = [np.unique([r[5] for r in p], return_counts=True) for p in passes]
    assert all(n <= (4 if c % 3 or c >= 500 else 5) for p in sent for c, n in zip(*p))


def test_nearest_over_blocks_and_passes(spark):
    """Tiles of more than a block, and more tiles than a pass takes, give the nearest by brute force."""
    rng = np.random.default_rng(13)
    x = rng.normal(size=(1200, 5)).astype("float32").astype(float)
    x[::2] += 1e-12  # not exact in 32 bits
    size, numbers = rng.integers(1, 5, 1200).astype(float), np.arange(1200)
    d = linkage._ward_distance(x, x, size, size)
    np.fill_diagonal(d, np.inf)
    rows = [("g", int(i), int(size[i]), x[i].tolist()) for i in numbers]
    clusters = linkage._kept(spark.createDataFrame(rows, "grp string, cluster long, size long, vector array<double>"), F.col("vector"), durable)
    assert clusters.filter("short is null").count() == 600
    for tile, open_, n in ((2000, F.lit(True), 1200), (150, F.lit(True), 1200), (150, F.col("cluster") % 3 == 0, 400)):
        got = linkage._nearest(clusters.withColumn("open", open_), "ward", tile, durable).collect()
        assert len(got) == n
        assert all(r.nearest == d[r.cluster].argmin() and math.isclose(r.height, d[r.cluster].min(), rel_tol=1e-6) for r in got)


@pytest.mark.parametrize("linkage_", ["average", "ward"])
def test_means_end_sized_clusters_as_the_matrix_does(linkage_):
    rng = np.random.default_rng(14)
    x, size = rng.normal(size=(150, 6)), rng.integers(1, 6, 150).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    distance, update = linkage.RULES[linkage_]
    matrix = linkage._Matrix(distance(x, x, size, size), update)
    matrix.size = size.copy()
    want, got = linkage._merges(matrix, 150), linkage._merges(linkage._Means(x, linkage_, size), 150)
    assert [m[:2] for m in got] == [m[:2] for m in want] and np.allclose([m[2] for m in got], [m[2] for m in want])
