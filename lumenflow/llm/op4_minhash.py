"""Near duplicates by fast similarity sketching, banding and exact verification.

1. A pass over the texts makes each document's set of 5-word shingles and its
   sketch. In round i < t every shingle is thrown into one of t bins with value
   i + hash; in round t + k all go into bin k; rounds end once all bins hold a
   value. So every coordinate fills after at most 2t rounds, most texts need one
   or two, and a bin's minimum agrees between two sets with their similarity,
   concentrated as for t independent hashes.
2. Equal sets fall together first: one class each, so exact copies cost nothing.
3. Bands of coordinates are bucket keys. In each bucket a pivot, the member that
   shares most buckets, is compared with all others on the full sets. What is
   linked to it is in its component; the others go on with a pivot of their own,
   for a few rounds. So a large group of near copies never makes all its pairs.
4. Documents of buckets that still hold several components may have links that
   no pivot met. Among them all pairs of different components that can reach the
   threshold are found by an exact prefix, length and position filter over the
   shingles, rarest first, and are verified too. Shingles are counted by an
   ordinary aggregation; the filter's only shared data are the counts of the
   ``FREQUENT`` commonest, as the others may come in any order.
5. Components of the verified links.

Verification reads full sets. Pairs are dealt out by their first document, in
portions, so a hub's text goes along once for ``PORTION`` pairs and not with each.

Defined results: see ``near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenflow.llm.common import Scratch, map_arrow, map_batches, table
from lumenflow.llm.textops import blocks, mix, seeds, shingle_sets
from lumenflow.operators.components import connected_components

WORDS = 5
#: 40 bands of 4 coordinates: a pair at 0.75 misses all with probability 2.5e-7.
BANDS, ROWS = 40, 4
#: Rounds of pivots.
ROUNDS = 2
#: Shingles whose counts order the filter; all others come before them.
FREQUENT = 1 << 17
#: Pairs that one copy of a hub's text serves, about.
PORTION = 64
#: Rows of a shingle beyond which they are split by bands of sizes.
HOT = 500
#: Width of the bands of set sizes, in logarithms: four make the ratio 4 / 3, the most that sets at 0.75 differ by.
_BAND = float(np.log(4 / 3) / 4)
_U = np.uint64
_EMPTY = _U(0xFFFFFFFFFFFFFFFF)


def sketch(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """Fast similarity sketches (rows) of sets of 64-bit hashes; an empty set's row keeps the largest value."""
    out = np.full((len(sets), bins), _EMPTY, dtype=_U)
    rows = [i for i, s in enumerate(sets) if len(s)]
    if not rows:
        return out
    values = np.concatenate([sets[i] for i in rows])
    owner = np.repeat(np.array(rows), [len(sets[i]) for i in rows])
    flat, salt = out.reshape(-1), seeds(2 * bins, 4)
    for i in range(bins):
        h = mix(values ^ salt[i])
        bin_ = ((h >> _U(32)) * _U(bins)) >> _U(32)
        np.minimum.at(flat, owner * bins + bin_.astype(np.int64), (_U(i) << _U(55)) | (mix(h) >> _U(9)))
        open_ = (out == _EMPTY).any(axis=1)
        more = open_[owner]
        if not more.all():
            values, owner = values[more], owner[more]
        if not len(values):
            return out
    begins = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    for k in range(bins):
        least = np.minimum.reduceat(mix(values ^ salt[bins + k]), begins)
        docs = owner[begins]
        out[docs, k] = np.minimum(out[docs, k], (_U(bins + k) << _U(55)) | (least >> _U(9)))
    return out


def band_keys(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts, salt = sketches.reshape(len(sketches), bands, rows), seeds(rows, 5)
    keys = np.zeros((len(sketches), bands), dtype=_U)
    for r in range(rows):
        keys = mix(keys ^ (parts[:, :, r] * (salt[r] | _U(1))))
    return mix(keys ^ seeds(bands, 6)[None, :])


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key, text: rows of one doc_id with different texts have different keys."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("key"), "text")


def sketched(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, key (a hash of doc_id and text), n_shingles, h1 and h2 (128 bits that name the set), bands (bucket keys)."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, b, data, offsets in blocks(batch.column(2)):
            sets = shingle_sets(data, offsets, WORDS)
            n = np.array([len(s) for s in sets], dtype=np.int64)
            keys = band_keys(sketch(sets, bands * rows), bands, rows).view(np.int64)
            h1 = np.array([mix(s).sum(dtype=_U) for s in sets], dtype=_U).view(np.int64)
            h2 = np.array([mix(s ^ seeds(1, 7)[0]).sum(dtype=_U) for s in sets], dtype=_U).view(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n), pa.array(h1), pa.array(h2), lists], names=["doc_id", "key", "n_shingles", "h1", "h2", "bands"])

    return map_batches(keyed(docs), work, "doc_id long, key long, n_shingles long, h1 long, h2 long, bands array<long>")


def measured(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """u, v, linked: whether 100 * intersection >= 75 * union of the full sets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_sets = None, []
        for batch in batches:
            us, portions, vs = (batch.column(k).to_pylist() for k in range(3))
            out = []
            for a, _, data, offsets in blocks(batch.column(3)):
                for k, s in enumerate(shingle_sets(data, offsets, WORDS), a):
                    if hub != (us[k], portions[k]):
                        hub, hub_sets = (us[k], portions[k]), []
                    if vs[k] is None:  # the hub's own text comes first
                        hub_sets.append(s)
                        continue
                    linked = False
                    for x in hub_sets:
                        at = np.minimum(np.searchsorted(x, s), max(len(x) - 1, 0))
                        common = int((x[at] == s).sum()) if len(x) else 0
                        linked |= len(x) > 0 and 100 * common >= 75 * (len(x) + len(s) - common)
                    out.append((us[k], vs[k], linked))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["u", "v", "linked"])

    degrees = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    dealt = pairs.select("u", "v").join(degrees.hint("merge"), "u").select("u", F.pmod(F.xxhash64("v"), F.ceil(F.col("n") / PORTION)).alias("portion"), "v")
    hubs = dealt.select("u", "portion").distinct().select("u", "portion", F.lit(None).cast("long").alias("v"))
    rows = hubs.unionByName(dealt).withColumn("class_id", F.coalesce("v", "u")).join(texts.hint("merge"), "class_id")
    rows = rows.select("u", "portion", "v", "text").repartition("u", "portion").sortWithinPartitions("u", "portion", F.asc_nulls_first("v"))
    return map_arrow(rows, work, "u long, v long, linked boolean").groupBy("u", "v").agg(F.max("linked").alias("linked"))


def frequent_shingles(texts: DataFrame, scratch: Scratch, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles (sorted hashes) and how many sets hold each: at most ``most`` come to the driver.

    Counts are put into steps of a sixteenth of a power of two; as many of the
    upper steps are taken as hold no more than ``most`` shingles.
    """

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for _, _, data, offsets in blocks(batch.column(0)):
            token, n = np.unique(np.concatenate(shingle_sets(data, offsets, WORDS)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], names=["token", "n"])

    counts = map_batches(texts.select("text"), work, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter("n > 1")
    counts = scratch.stored(counts.withColumn("step", F.floor(16 * F.log2("n"))), "counts")
    sizes = counts.groupBy("step").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("step", ascending=False)  # at most a thousand rows
    taken = sizes["step"][sizes["n"].cumsum() <= most]
    top = counts.filter(F.col("step") >= int(taken.min()) if len(taken) else F.lit(False)).select("token", "n").toPandas()
    token = top["token"].to_numpy(dtype=np.int64).view(_U)
    order = np.argsort(token)
    return token[order], top["n"].to_numpy(dtype=np.int64)[order]


def rare_prefixes(texts: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """token, class_id, n, pos: of each set, in order of count, the shingles of which two sets at 0.75 share one."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        (known, n), names = shared.value, batch.column(0).to_numpy()
        for a, _, data, offsets in blocks(batch.column(1)):
            out = []
            for k, s in enumerate(shingle_sets(data, offsets, WORDS)):
                if len(s):
                    often = np.zeros(len(s), dtype=np.int64)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        often = np.where(known[at] == s, n[at], 0)
                    first = np.argsort(often, kind="stable")[: len(s) - (3 * len(s) + 3) // 4 + 1]  # equals by hash
                    out.append((s[first].view(np.int64), np.full(len(first), names[a + k]), np.full(len(first), len(s)), np.arange(len(first))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["token", "class_id", "n", "pos"])

    return map_batches(texts.select("class_id", "text"), work, "token long, class_id long, n long, pos long")


def banded(rows: DataFrame) -> DataFrame:
    """Each row once for every band of sizes in which a partner can still reach 0.75 from its position.

    What follows a row's position bounds the intersection, and the smallest size
    of a band bounds the union. Bounds are a little loose; ``reach`` is exact.
    Rows of shingles that aren't ``hot`` all stay in one band.
    """
    own = F.floor(F.log("n") / _BAND)
    least = lambda b: F.floor(F.exp(b * _BAND) * (1 - 1e-9))
    bands = F.filter(F.transform(F.sequence(own - 5, own + 5), lambda b: b), lambda b: 7 * (F.col("n") - F.col("pos")) >= 3 * (F.col("n") + least(b)))
    one = F.lit(0).cast("long")
    return rows.select("token", "class_id", "n", "pos", "part", "main", F.when(F.col("hot"), own).otherwise(one).alias("band"), F.explode(F.when(F.col("hot"), bands).otherwise(F.array(one))).alias("partner"))


def unresolved_pairs(texts: DataFrame, parts: DataFrame, scratch: Scratch) -> DataFrame:
    """All pairs (u, v) of different parts that can reach 0.75, by an exact prefix, length and position filter.

    In one order of all shingles, the rarest first, the first common shingle of a
    pair bounds its intersection by what follows it in either set. So copies of
    one passage or distant variants of one text, which share their common
    shingles only, make no pair. Nor do the rows of a common shingle all meet:
    they are joined by bands of sizes, and are only in bands where their position
    allows it. Of the part that most rows of a shingle seem to be in (``main``,
    drawn by hash; any choice is exact) none meets another of it.
    """
    rows = rare_prefixes(texts, frequent_shingles(texts, scratch)).join(parts, "class_id")
    drawn = [F.min_by("part", F.xxhash64("class_id", F.lit(k))).alias(f"d{k}") for k in range(3)]
    tokens = rows.groupBy("token").agg(F.min("part").alias("a"), F.max("part").alias("b"), *drawn, (F.count(F.lit(1)) > HOT).alias("hot")).filter("a <> b")
    tokens = tokens.select("token", "hot", F.when(F.col("d1") == F.col("d2"), F.col("d1")).otherwise(F.col("d0")).alias("main"))
    rows = scratch.stored(banded(rows.join(tokens.hint("merge"), "token")), "prefixes")
    one = rows.filter("part <> main").select("token", "band", "partner", *[F.col(c).alias(f"{c}_u") for c in ("class_id", "n", "pos", "part")])
    other = rows.select("token", F.col("partner").alias("band"), F.col("band").alias("partner"), "main", *[F.col(c).alias(f"{c}_v") for c in ("class_id", "n", "pos", "part")])
    reach = F.expr("7 * (1 + least(n_u - 1 - pos_u, n_v - 1 - pos_v)) >= 3 * (n_u + n_v)")
    met = (F.col("part_u") != F.col("part_v")) & reach & ((F.col("part_v") == F.col("main")) | (F.col("class_id_u") < F.col("class_id_v")))
    pairs = one.join(other, ["token", "band", "partner"]).filter(met)
    return pairs.select(F.least("class_id_u", "class_id_v").alias("u"), F.greatest("class_id_u", "class_id_v").alias("v")).distinct()


def linked_classes(classes: DataFrame, docs: DataFrame, scratch: Scratch, rounds: int = ROUNDS) -> DataFrame:
    """class_id, component of the classes (class_id, doc_id and key of one of its rows, bands) that verified links join to others.

    Sides of a join that come from an aggregation are merged, as both are
    shuffled by then: a broadcast would cost the driver a job, a thread and their rows.
    """
    rows = classes.select("class_id", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = scratch.stored(rows.join(shared.hint("merge"), "key"), "members")
    weights = scratch.stored(members.groupBy("class_id").agg(F.sum("size").alias("weight")), "weights")
    named = classes.select("class_id", "doc_id", "key").join(weights.select("class_id"), "class_id", "left_semi")
    texts = scratch.stored(keyed(docs).join(named, ["doc_id", "key"]).select("class_id", "text"), "texts")
    active = members.select("key", "class_id").join(weights, "class_id")
    tested = []
    for _ in range(rounds):
        pivots = active.groupBy("key").agg(F.max_by("class_id", F.struct("weight", -F.col("class_id"))).alias("center"))
        pairs = scratch.stored(active.join(pivots.hint("merge"), "key").filter("class_id <> center"), "pairs")
        found = scratch.stored(measured(pairs.select(F.col("center").alias("u"), F.col("class_id").alias("v")).distinct(), texts), "tested")
        tested.append(found)
        active = scratch.stored(pairs.join(found.filter("linked").select(F.col("u").alias("center"), F.col("v").alias("class_id")), ["center", "class_id"], "left_anti").select("key", "class_id", "weight"), "active")
        if active.isEmpty():
            break
    links = scratch.stored(reduce(DataFrame.unionByName, tested).filter("linked").select("u", "v"), "links")
    named = scratch.stored(connected_components(links, scratch.stored).withColumnRenamed("node", "class_id"), "named")
    parted = members.select("key", "class_id").join(named, "class_id", "left").select("key", "class_id", F.coalesce("component", "class_id").alias("part"))
    mixed = parted.groupBy("key").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a <> b").select("key")
    open_ = scratch.stored(parted.join(mixed.hint("merge"), "key").select("class_id", "part").distinct(), "open")
    pairs = unresolved_pairs(texts.join(open_.select("class_id"), "class_id", "left_semi"), open_, scratch)
    done = reduce(DataFrame.unionByName, tested).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    rest = scratch.stored(pairs.join(done.hint("merge"), ["u", "v"], "left_anti"), "rest")
    more = scratch.stored(measured(rest, texts).filter("linked").select("u", "v"), "more")
    if more.isEmpty():
        return named
    known = named.select(F.col("class_id").alias("u"), F.col("component").alias("v"))  # these links' components needn't be found again
    return connected_components(known.unionByName(more), scratch.stored).withColumnRenamed("node", "class_id")


def classified(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, key, n_shingles, component (a number), component_id, first: one row for each row of ``docs``.

    A class is a set of shingles, and has a number of its own; so rows that share
    a doc_id but not a set are of different classes, and only links bring them
    together. ``component_id`` is the least doc_id of a component, and ``first``
    is true for one doc_id and text of it (rows that repeat are all first).
    Rows without shingles or doc_id are their own component (``component`` null).
    """
    kept, scratch = Scratch(docs.sparkSession, "op4"), Scratch(docs.sparkSession, "op4-work")
    every = kept.stored(sketched(docs, bands, rows), "sketches")
    full = every.filter("n_shingles > 0 and doc_id is not null")
    # equal sets have equal sizes and buckets
    classes = full.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "key")).alias("least"), F.first("bands").alias("bands"))
    classes = kept.stored(classes.select(F.monotonically_increasing_id().alias("class_id"), "least.doc_id", "least.key", "bands", "h1", "h2"), "classes")
    found = kept.stored(linked_classes(classes, docs, scratch), "components")
    scratch.drop()
    placed = classes.select("h1", "h2", "class_id", "doc_id", "key").join(found, "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    least = placed.groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("least"))
    components = placed.join(least.hint("merge"), "component").select("h1", "h2", "component", "least")
    linked = full.select("doc_id", "key", "n_shingles", "h1", "h2").join(components, ["h1", "h2"])
    linked = linked.select("doc_id", "key", "n_shingles", "component", F.col("least.doc_id").alias("component_id"), (F.struct("doc_id", "key") == F.col("least")).alias("first"))
    alone = every.filter("n_shingles = 0 or doc_id is null")
    return linked.unionByName(alone.select("doc_id", "key", "n_shingles", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"), F.lit(True).alias("first")))


def near_duplicates(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; fewer
    than five make one shingle. A null, empty or blank text has no shingle and is
    its own component. Rows that repeat fall into one component and are named by
    their doc_id alike; rows of one doc_id with different texts each have the
    component of their text (whose least doc_id may be the same). A null doc_id is
    linked with nothing. Other columns are ignored; an empty table gives no rows.
    """
    out = classified(docs, bands, rows)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node),
m AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d JOIN m ON m.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
