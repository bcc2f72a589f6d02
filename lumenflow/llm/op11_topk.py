"""Exact top-k inner products over a bit-sliced index.

1. Vectors are quantised to integers (``floor(64 * x)``). A block of rows, in the
   order of their ids, is one row of the index table: for each attribute and bit
   a bitmap over the block's rows (a slice), taken from the attribute's least
   value in the block.
2. Queries go in chunks. A (block, portion of chunks) pair is one key of a join,
   so a block's slices serve many queries and every query meets every block.
3. A query's score is a sum of slices: slice b of attribute d counts 2^(b + j) for
   each bit j of the query's weight; weights below zero take the slice's
   complement. All slices of one power are added by carry-save adders, whose
   carries go to the next power: bitmaps of the score's own bits come out.
4. From the score's most significant bitmap downward, rows fall into surely in,
   surely out and still equal, until k rows are fixed. Rows that are equal to the
   last bit are the boundary: they tie, and as many as are still open are taken in
   the order of ids. Only the rows taken get their scores as numbers.
5. The best k of each block meet by query.

Defined results: a vector that is null, or holds a null or non-finite component,
takes no part, neither as query nor as candidate. An empty vector takes part and
scores 0. Components beyond the shorter of two vectors count as 0. Quantised
components saturate at ``LIMIT``, so a score is a long. A null id is no query; as a
candidate it comes last among ties. A row is a query's own if it has its id. Rows
that repeat are candidates each, and one query; rows of one id with different
vectors are queries each, under the same query_id. Other columns are ignored. No
query or no candidate: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenflow.llm.common import Scratch, map_arrow, table

SCALE = 64
K = 20
#: Every so many ids is a query.
QUERY_STEP = 20
#: Rows of a block at most, and cells (rows * attributes) about.
BLOCK_ROWS, BLOCK_CELLS = 1 << 15, 1 << 21
#: Queries of a chunk; chunks that one copy of a block serves.
CHUNK, PORTION = 32, 4
#: Greatest quantised component, either way.
LIMIT = 1 << 26
_U = np.uint64


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and the quantised components, without vectors that take no part."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)) & ~F.isnan(c))
    step = lambda c: F.greatest(F.lit(float(-LIMIT)), F.least(F.lit(float(LIMIT)), F.floor(c * scale).cast("double"))).cast("int")
    return vectors.filter(x.isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, step).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of integers, the shorter ones filled up with 0."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), int(sizes.max(initial=0))), dtype=np.int64)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy()
    return out


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    parts = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(parts).combine_chunks() if parts else None


def sliced(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least values of the attributes, and the slices (attribute, bit, word of 64 rows)."""
    rows, dims = x.shape
    least = x.min(axis=0, initial=0) if not rows else x.min(axis=0)
    above = np.ascontiguousarray((x - least).T)
    bits = max(1, int(above.max(initial=0)).bit_length())
    planes = np.zeros((dims, bits, -(-rows // 64) * 8), dtype=np.uint8)
    for b in range(bits):
        packed = np.packbits((above >> b & 1).astype(np.uint8), axis=1, bitorder="little")
        planes[:, b, : packed.shape[1]] = packed
    return least, planes.view(_U)


def _split(df: DataFrame, rows: int, most: int, work, schema: str) -> DataFrame:
    """``work`` on evenly dealt parts of at most about ``most`` of the rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (whole := _whole(batches)) is not None:
            yield from work(TaskContext.get().partitionId(), whole)

    return map_arrow(df.repartition(max(1, math.ceil(rows / most))), each, schema)


def bit_sliced_index(vectors: DataFrame, rows: int, most: int) -> DataFrame:
    """A row for each block: block, n, ids (longs, ascending), n_null (the last ids are null), dims, least, planes."""

    def work(block: int, whole: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = whole.column("vec_id").combine_chunks()
        null = ids.is_null().to_numpy(zero_copy_only=False)
        known = ids.fill_null(0).to_numpy()
        order = np.lexsort((known, null))
        x = _matrix(whole.column("x").combine_chunks())[order]
        least, planes = sliced(x)
        yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "n": pa.array([len(order)], pa.int32()), "ids": [known[order].tobytes()], "n_null": pa.array([int(null.sum())], pa.int32()), "dims": pa.array([x.shape[1]], pa.int32()), "least": [least.tobytes()], "planes": [planes.tobytes()]})

    return _split(vectors, rows, most, work, "block int, n int, ids binary, n_null int, dims int, least binary, planes binary")


def query_chunks(queries: DataFrame, rows: int, most: int) -> DataFrame:
    """A row for each chunk: chunk, queries (ids), q_dims, weights."""

    def work(chunk: int, whole: pa.Table) -> Iterator[pa.RecordBatch]:
        x = _matrix(whole.column("x").combine_chunks())
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "queries": [whole.column("vec_id").to_numpy().tobytes()], "q_dims": pa.array([x.shape[1]], pa.int32()), "weights": [x.tobytes()]})

    return _split(queries, rows, most, work, "chunk int, queries binary, q_dims int, weights binary")


def _added(planes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The bitmap of the lowest bit of a sum of bitmaps, and the carries, by carry-save adders."""
    carries = []
    while len(planes) > 2:
        k = len(planes) // 3
        a, b, c = planes[:k], planes[k : 2 * k], planes[2 * k : 3 * k]
        half = a ^ b
        carry = a & b
        carry |= half & c
        half ^= c
        carries.append(carry)
        planes = np.concatenate((half, planes[3 * k :])) if len(planes) > 3 * k else half
    if len(planes) == 2:
        carries.append(planes[:1] & planes[1:])
        return planes[0] ^ planes[1], carries
    return planes[0], carries


def _rows(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


class Block:
    """The slices of one block, ready for queries."""

    def __init__(self, n: int, ids: np.ndarray, n_null: int, least: np.ndarray, planes: np.ndarray):
        self.n, self.ids, self.n_null, self.least = n, ids, n_null, least
        self.dims, self.bits, self.words = planes.shape
        # complements follow the slices; bits of rows that don't exist are masked by ``every``
        self.planes = np.concatenate((planes, ~planes)).reshape(-1, self.words)
        every = np.zeros(self.words * 64, dtype=np.uint8)
        every[:n] = 1
        self.every = np.packbits(every, bitorder="little").view(_U)

    def others(self, query: int) -> np.ndarray:
        """The bitmap of the rows that don't have the query's id."""
        known = self.ids[: self.n - self.n_null]
        a, b = np.searchsorted(known, query, "left"), np.searchsorted(known, query, "right")
        if a == b:
            return self.every
        own = np.zeros(self.words * 64, dtype=np.uint8)
        own[a:b] = 1
        return self.every & ~np.packbits(own, bitorder="little").view(_U)

    def sums(self, q: np.ndarray) -> list[np.ndarray]:
        """Bitmaps of the score's bits, the lowest first: the sum of the slices by the query's weights, less a constant."""
        size, side = np.abs(q), np.where(q < 0, self.dims, 0) + np.arange(len(q))
        used = [np.flatnonzero(size >> j & 1) for j in range(int(size.max(initial=0)).bit_length())]
        out, carries = [], []
        w = 0
        while w < self.bits + len(used) or carries:
            own = [side[used[w - b]] * self.bits + b for b in range(self.bits) if 0 <= w - b < len(used)]
            stacked = ([self.planes[np.concatenate(own)]] if sum(map(len, own)) else []) + carries
            bit, carries = _added(np.concatenate(stacked)) if stacked else (np.zeros(self.words, dtype=_U), [])
            out.append(bit)
            w += 1
        return out

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact scores of some rows, from all their slices."""
        own = self.planes[: self.dims * self.bits, rows >> 6] >> (rows & 63).astype(_U) & _U(1)
        own = own.reshape(self.dims, self.bits, len(rows)).astype(np.int64)
        above = np.zeros((self.dims, len(rows)), dtype=np.int64)
        for b in range(self.bits):
            above += own[:, b] << b
        return q @ above[: len(q)] + int(q @ self.least[: len(q)])

    def top_k(self, q: np.ndarray, live: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best live rows; ties go to the earlier row."""
        q = q[: self.dims]
        sure, equal = np.zeros_like(live), live
        if int(np.bitwise_count(live).sum()) > k:
            for bit in reversed(self.sums(q)):
                with_bit = equal & bit
                n = int(np.bitwise_count(sure | with_bit).sum())
                if n >= k:
                    equal = with_bit
                else:
                    sure, equal = sure | with_bit, equal & ~bit
                if n == k:
                    break
        rows = _rows(sure)
        rows = np.concatenate((rows, _rows(equal)[: k - len(rows)]))
        score = self.scores(rows, q)
        order = np.lexsort((rows, -score))
        return rows[order], score[order]


def searched(pairs: DataFrame, k: int) -> DataFrame:
    """chunk, q (the query's place in it), query_id, vec_id, score: each block's best k for each query of the chunk."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, block = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if name != row["block"]:
                    planes = np.frombuffer(row["planes"], dtype=_U)
                    words = -(-row["n"] // 64)
                    planes = planes.reshape(row["dims"], -1, words) if row["dims"] else np.zeros((0, 1, words), dtype=_U)
                    name, block = row["block"], Block(row["n"], np.frombuffer(row["ids"], dtype=np.int64), row["n_null"], np.frombuffer(row["least"], dtype=np.int64), planes)
                ids = np.frombuffer(row["queries"], dtype=np.int64)
                weights = np.frombuffer(row["weights"], dtype=np.int64).reshape(len(ids), row["q_dims"])
                found = [block.top_k(q, block.others(int(i)), k) for i, q in zip(ids, weights, strict=True)]
                n = [len(r) for r, _ in found]
                rows = np.concatenate([r for r, _ in found])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(rows), row["chunk"], dtype=np.int32)),
                        pa.array(np.repeat(np.arange(len(ids), dtype=np.int32), n)),
                        pa.array(np.repeat(ids, n)),
                        pa.array(block.ids[rows], mask=rows >= block.n - block.n_null),
                        pa.array(np.concatenate([s for _, s in found])),
                    ],
                    names=["chunk", "q", "query_id", "vec_id", "score"],
                )

    return map_arrow(pairs, work, "chunk int, q int, query_id long, vec_id long, score long")


def top_products(vectors: DataFrame, k: int = K, step: int = QUERY_STEP, scale: int = SCALE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of each vector whose id is divisible by ``step``."""
    kept, scratch = Scratch(vectors.sparkSession, "op11"), Scratch(vectors.sparkSession, "op11-work")
    rows = scratch.stored(usable(vectors, scale), "vectors")
    asked = scratch.stored(rows.filter(F.col("vec_id") % step == 0).dropDuplicates(["vec_id", "x"]), "queries")
    n, dims = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    n_asked = asked.count()
    most = max(64, min(block_rows, BLOCK_CELLS // max(1, dims)))
    index = kept.stored(bit_sliced_index(rows, n, most), "index")
    chunks = kept.stored(query_chunks(asked, n_asked, CHUNK), "queries")
    scratch.drop()
    blocks, portions = max(1, math.ceil(n / most)), max(1, math.ceil(n_asked / (CHUNK * PORTION)))
    dealt = index.withColumn("portion", F.explode(F.sequence(F.lit(0), F.lit(portions - 1))))
    met = chunks.withColumn("portion", F.col("chunk") % portions).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = searched(dealt.join(met.hint("merge"), ["block", "portion"]), k)
    best = Window.partitionBy("chunk", "q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda c: floor({SCALE} * c)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.x, v.x) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % {QUERY_STEP} = 0 AND q.vec_id IS DISTINCT FROM v.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
