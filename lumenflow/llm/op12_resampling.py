"""Importance resampling of documents towards a target distribution of hashed word runs.

1. One pass over the texts counts hashed features: all runs of one and two words,
   each in bucket crc32 modulo ``BUCKETS``. A batch of documents becomes one CSR
   block (row pointers, bucket indices, counts), and the sparse document-by-bucket
   matrix is written as a table of such blocks. The target texts give a second,
   small matrix in the same way.
2. Column sums of both matrices are the two distributions: each task adds up its
   blocks in one dense vector of ``BUCKETS`` counts, and the vectors are summed by
   bucket. Gains are one number for each bucket, so what is shared has a fixed size.
3. The matrix times the vector of gains is each document's log weight.
4. Hashed Gumbel noise is added, and the highest scores are drawn: sampling
   without replacement in proportion to the weights, the same at every run. Ranks
   come from ranges of scores, whose sizes are added up before rows are numbered
   within them, so no task orders all.

Defined results: a null or empty text has no feature and weight 0. Texts are taken
whole, in slices that end between words. A null doc_id counts as an empty string
in the noise and comes last among ties; rows that repeat are scored, counted and
drawn each, and tie in no particular order as they are equal. Other columns are
ignored. An empty table gives no rows; an empty target makes all gains follow the
documents' counts alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenflow.llm.common import Scratch, map_arrow, map_batches, table

BUCKETS = 10_000
SEED = 7
#: Documents with fewer words are never drawn.
LEAST_WORDS = 20
PERCENT = 25
#: Bytes of a text that are worked on at a time, up to the end of a word.
SLICE = 1 << 20
#: Bytes of texts that make one CSR block, about.
BLOCK = 1 << 20
#: Blocks of a row group: Parquet looks at the bytes it holds after 100 rows only, and reads a group's arrays at once.
GROUP = 4
_CSR = "doc_ids array<long>, words array<long>, indptr array<int>, indices array<int>, counts array<int>"
#: To lower case (A-Z only), and what is no word byte to a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def feature_hashes(text: memoryview) -> Iterator[tuple[int, list[int]]]:
    """(words, crc32 of the features) of the slices of a text; a run of two words belongs to the slice of the second."""
    at, n, last = 0, len(text), None
    while at < n:
        to = min(n, at + SLICE)
        piece = bytes(text[at:to]).translate(_TABLE)
        if to < n and (cut := piece.rfind(b" ")) >= 0:
            to, piece = at + cut + 1, piece[: cut + 1]
        while to < n and piece[-1] != 32:  # one word fills the slice: go on to its end
            more = bytes(text[to : to + SLICE]).translate(_TABLE)
            cut = more.find(b" ")
            more = more if cut < 0 else more[: cut + 1]
            to, piece = to + len(more), piece + more
        words = piece.split()
        single = list(map(crc32, words))
        if single:
            second, before = (words, [last, *single[:-1]]) if last is not None else (words[1:], single[:-1])
            yield len(words), single + list(map(crc32, map(b" ".__add__, second), before))
            last = single[-1]
        at = to


def _counted(texts: list[memoryview], buckets: int) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, and the block's row pointers, bucket indices and counts."""
    words, sizes, indices, counts = [], [0], [], []
    for text in texts:
        n, own, total = 0, None, []
        for k, hashes in feature_hashes(text):
            n += k
            h = np.array(hashes, dtype=np.int64) % buckets
            if len(text) <= SLICE:
                total.append(h)
            else:  # a long text keeps one dense row
                own = np.bincount(h, minlength=buckets) if own is None else own + np.bincount(h, minlength=buckets)
        if own is not None:
            at = np.flatnonzero(own)
            c = own[at]
        else:
            at, c = np.unique(np.concatenate(total) if total else np.zeros(0, dtype=np.int64), return_counts=True)
        words.append(n)
        sizes.append(sizes[-1] + len(at))
        indices.append(at)
        counts.append(c)
    return words, np.array(sizes), np.concatenate(indices), np.concatenate(counts)


def count_matrix(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """CSR blocks of the documents (doc_id long, text): doc_ids, words, indptr, indices, counts."""

    def block(ids: list, texts: list[memoryview]) -> pa.RecordBatch:
        words, indptr, indices, counts = _counted(texts, buckets)
        one = lambda x, kind: pa.array([x], pa.list_(kind))
        flat = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x.astype(np.int32)))
        return pa.RecordBatch.from_arrays([one(ids, pa.int64()), one(words, pa.int64()), flat(indptr), flat(indices), flat(counts)], names=["doc_ids", "words", "indptr", "indices", "counts"])

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        column = batch.column(1).cast(pa.large_binary())
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        view, ids, at = memoryview(data) if data else memoryview(b""), batch.column(0).to_pylist(), 0
        while at < len(ids):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, side="right")) - 1)
            yield block(ids[at:to], [view[offsets[k] : offsets[k + 1]] for k in range(at, min(to, len(ids)))])
            at = to

    return map_batches(texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), work, _CSR)


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: no more than one row of each bucket from each task is shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            at = batch.column(0).flatten().to_numpy()
            np.add.at(total, at, batch.column(1).flatten().to_numpy().astype(np.int64))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    return map_arrow(matrix.select("indices", "counts"), work, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(own: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 * ln(smoothed target share / smoothed own share)) of each bucket; the driver gets two numbers for each bucket."""

    def dense(sums: DataFrame) -> np.ndarray:
        out = np.zeros(buckets, dtype=np.int64)
        rows = sums.toPandas()
        out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
        return out

    s, t = dense(own), dense(target)
    ratio = (t + 1).astype(np.float64) * float(s.sum() + buckets) / ((s + 1).astype(np.float64) * float(t.sum() + buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], dtype=np.int64)


def weighed(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the matrix times the gains, as a floored mean for each document."""
    shared = matrix.sparkSession.sparkContext.broadcast(gain)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for k in range(batch.num_rows):
            ids, words, indptr, indices, counts = (batch.column(c)[k].values for c in range(5))
            at, counts = indptr.to_numpy(), counts.to_numpy().astype(np.int64)
            up_to = lambda x: np.concatenate(([0], np.cumsum(x)))
            n = np.diff(up_to(counts)[at])
            total = np.diff(up_to(counts * shared.value[indices.to_numpy()])[at])
            yield pa.RecordBatch.from_arrays([ids, words, pa.array(n), pa.array(np.where(n > 0, total // np.maximum(n, 1), 0))], names=["doc_id", "n_words", "n_features", "weight"])

    return map_batches(matrix, work, "doc_id long, n_words long, n_features long, weight long")


def drawn(rows: DataFrame, scratch: Scratch, percent: int, least_words: int) -> DataFrame:
    """The rows with rank: 1, 2, 3 ... for the highest scores of ``percent`` of the rows with ``least_words``, else null.

    Rows are dealt out by ranges of score and id; the sizes of the ranges (one
    row each) say with which rank each begins.
    """
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fit = rows.filter(F.col("n_words") >= least_words)
    dealt = scratch.stored(fit.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = {r["range"]: r["n"] for r in dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()}
    take, before, starts = percent * sum(sizes.values()) // 100, 0, []
    for k in sorted(sizes):
        starts.append((k, before))
        before += sizes[k]
    starts = F.broadcast(rows.sparkSession.createDataFrame(starts, "range int, before long"))  # a row for each range
    number = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    ranked = dealt.join(starts, "range").withColumn("rank", F.col("before") + number).withColumn("rank", F.when(F.col("rank") <= take, F.col("rank")))
    return ranked.drop("range", "before").unionByName(rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, least_words: int = LEAST_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of all ``docs`` (doc_id, text), drawn towards the texts of ``target``."""
    kept, scratch = Scratch(docs.sparkSession, "op12"), Scratch(docs.sparkSession, "op12-work")
    matrix = scratch.stored(count_matrix(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), buckets), "matrix", GROUP)
    wanted = scratch.stored(count_matrix(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets), "target", GROUP)
    rows = weighed(matrix, gains(column_sums(matrix, buckets), column_sums(wanted, buckets), buckets))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = kept.stored(rows.withColumn("score", F.col("weight") + noise), "scores")
    out = drawn(scored, kept, percent, least_words)
    scratch.drop()
    return out


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 over the bytes of a string, eight bits at a time by a table made from the polynomial.
CRC32 = """
crc_bit AS (SELECT i, (CASE WHEN i % 2 = 1 THEN xor(i >> 1, 3988292384) ELSE i >> 1 END)::BIGINT AS c, 1 AS k FROM (SELECT unnest(range(256))::BIGINT AS i)
  UNION ALL SELECT i, (CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)::BIGINT, k + 1 FROM crc_bit WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_bit WHERE k = 8)"""


def crc32_sql(text: str) -> str:
    """SQL of the CRC-32 of a string; reads column t of crc_table."""
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]), 4294967295::BIGINT), 4294967295)"


ORACLE = rf"""
WITH RECURSIVE {CRC32},
w AS (SELECT doc_id, own, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM (SELECT doc_id, text, true AS own FROM documents UNION ALL SELECT item_id, text, false FROM benchmark)),
f AS (SELECT doc_id, own, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM w),
k AS (SELECT doc_id, own, f, count(*) AS n FROM f GROUP BY ALL),
b AS (SELECT f, {crc32_sql("f")} % {BUCKETS} AS bucket FROM (SELECT DISTINCT f FROM k), crc_table),
m AS (SELECT doc_id, own, bucket, sum(n)::BIGINT AS n FROM k JOIN b USING (f) GROUP BY ALL),
s AS (SELECT bucket, coalesce(sum(n) FILTER (own), 0)::BIGINT AS s, coalesce(sum(n) FILTER (NOT own), 0)::BIGINT AS t FROM m GROUP BY 1),
a AS (SELECT coalesce(sum(s), 0)::DOUBLE AS ss, coalesce(sum(t), 0)::DOUBLE AS tt FROM s),
g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (ss + {BUCKETS}) / ((s + 1)::DOUBLE * (tt + {BUCKETS}))))::BIGINT AS gain FROM s, a),
d AS (SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM m JOIN g USING (bucket) WHERE own GROUP BY doc_id),
x AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || w.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM w LEFT JOIN d ON d.doc_id = w.doc_id WHERE own),
r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= {LEAST_WORDS}) OVER () AS fit FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {LEAST_WORDS} AND place <= {PERCENT} * fit // 100 THEN place END AS rank FROM r
"""
