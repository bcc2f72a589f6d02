"""Token ids in a succinct binary format: one wavelet matrix per shard.

A shard is a row of the file table: the ids of consecutive documents as packed
bit planes (most significant bit first, each plane stably sorted by the plane
above), with a count of ones at every ``SAMPLE`` bits for rank and select. From
the bytes alone a reader gets any token, counts a token in any range, and finds
its k-th occurrence, or reads all ids back.

Documents are range-partitioned by doc_id, so shards are in ascending order; a
shard knows where it begins within its partition, and only one number for each
partition is summed up over partitions. The table is written by Spark into the
shared folder, so any store that Spark reaches will do, and a lost task writes
its part again.

Defined results: a null or empty text is the end id alone; repeated doc_ids are
kept, ordered by text; a null doc_id comes first; an empty table gives an empty
file table and no rows; other columns are ignored. A shard ends at a document's
end, so a very long document makes a long shard.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenflow.llm.common import scratch_path, table

END_ID = 2
SHARD_TOKENS = 1 << 18
SAMPLE = 512
_MAGIC = b"WVM1"
_HEAD = struct.Struct("<4sBxxxQ")
FILE_SCHEMA = "part long, shard long, part_start long, n_tokens long, n_docs long, doc_ids array<long>, doc_sizes array<long>, matrix binary"
_FILE = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("part_start", pa.int64()), ("n_tokens", pa.int64()), ("n_docs", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_sizes", pa.list_(pa.int64())), ("matrix", pa.binary())])


class WaveletMatrix:
    """Bit planes with rank and select support; ``to_bytes`` and ``from_bytes`` are the file format."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], samples: list[np.ndarray]):
        self.n, self.planes, self.zeros, self.samples = n, planes, zeros, samples

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max(initial=0)).bit_length())
        x = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros, samples = [], [], []
        for k in range(bits - 1, -1, -1):
            b = ((x >> k) & 1).astype(bool)
            packed = np.packbits(b, bitorder="little")
            ones = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), SAMPLE // 8), dtype=np.int64) if len(packed) else np.zeros(0, dtype=np.int64)
            sample = np.zeros(len(ones) + 1, dtype=np.uint32)
            np.cumsum(ones, out=sample[1:])
            low, high = np.flatnonzero(~b), np.flatnonzero(b)
            x = np.concatenate((x[low], x[high]))
            planes.append(packed)
            zeros.append(len(low))
            samples.append(sample)
        return cls(len(ids), planes, zeros, samples)

    def to_bytes(self) -> bytes:
        parts = [_HEAD.pack(_MAGIC, len(self.planes), self.n), np.array(self.zeros, dtype="<u8").tobytes()]
        for plane, sample in zip(self.planes, self.samples, strict=True):
            parts += [plane.tobytes(), sample.astype("<u4").tobytes()]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        magic, bits, n = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a wavelet matrix")
        at = _HEAD.size
        zeros = np.frombuffer(data, "<u8", bits, at).tolist()
        at += 8 * bits
        size = (n + 7) // 8
        n_samples = -(-size // (SAMPLE // 8)) + 1
        planes, samples = [], []
        for _ in range(bits):
            planes.append(np.frombuffer(data, np.uint8, size, at))
            samples.append(np.frombuffer(data, "<u4", n_samples, at + size))
            at += size + 4 * n_samples
        return cls(n, planes, zeros, samples)

    def _bit(self, k: int, i: int) -> int:
        return int(self.planes[k][i >> 3] >> (i & 7)) & 1

    def _ones(self, k: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, plane = i // SAMPLE, self.planes[k]
        found = int(self.samples[k][block]) + int(np.bitwise_count(plane[block * SAMPLE // 8 : i >> 3]).sum())
        return found + ((int(plane[i >> 3]) & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else 0)

    def access(self, i: int) -> int:
        """The token at i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(len(self.planes)):
            bit = self._bit(k, i)
            value = value << 1 | bit
            i = self.zeros[k] + self._ones(k, i) if bit else i - self._ones(k, i)
        return value

    def _narrowed(self, token: int, a: int, b: int) -> tuple[int, int]:
        bits = len(self.planes)
        if token < 0 or token >> bits:
            return 0, 0
        for k in range(bits):
            if token >> (bits - 1 - k) & 1:
                a, b = self.zeros[k] + self._ones(k, a), self.zeros[k] + self._ones(k, b)
            else:
                a, b = a - self._ones(k, a), b - self._ones(k, b)
        return a, b

    def count(self, token: int, a: int = 0, b: int | None = None) -> int:
        """How often a token occurs in [a, b)."""
        a, b = self._narrowed(token, a, self.n if b is None else b)
        return b - a

    def _select(self, k: int, bit: int, j: int) -> int:
        """Where the j-th (from 0) such bit of a plane is."""
        sample = self.samples[k].astype(np.int64)
        if not bit:
            sample = np.minimum(np.arange(len(sample)) * SAMPLE, self.n) - sample
        block = int(np.searchsorted(sample, j, side="right")) - 1
        part = np.unpackbits(self.planes[k][block * SAMPLE // 8 : (block + 1) * SAMPLE // 8], bitorder="little")[: self.n - block * SAMPLE]
        return block * SAMPLE + int(np.flatnonzero(part == bit)[j - int(sample[block])])

    def select(self, token: int, j: int) -> int:
        """Where the j-th (from 0) occurrence of a token is; -1 if there is none."""
        a, b = self._narrowed(token, 0, self.n)
        if not 0 <= j < b - a:
            return -1
        i = a + j
        for k in range(len(self.planes) - 1, -1, -1):
            bit = token >> (len(self.planes) - 1 - k) & 1
            i = self._select(k, bit, i - self.zeros[k] if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All tokens in order, from the lowest plane up."""
        bits = len(self.planes)
        values = np.zeros(self.n, dtype=np.uint16 if bits <= 16 else np.uint32)
        for k in range(bits - 1, -1, -1):
            b = np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)
            above = np.empty_like(values)
            above[np.flatnonzero(~b)] = values[: self.zeros[k]]
            above[np.flatnonzero(b)] = values[self.zeros[k] :] | values.dtype.type(1 << (bits - 1 - k))
            values = above
        return values.astype(np.uint32)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, added: bool = False) -> None:
    """Encodes all documents in ascending doc_id order and writes the shards as a table at ``path``; ``added`` as in bpe."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lumenflow.llm.bpe import encoder

        codec, part = encoder(tokenizer_path, added), TaskContext.get().partitionId()
        state = {"shard": 0, "start": 0}
        names, sizes, held, n = [], [], [], 0
        end = np.array([end_id], dtype=np.uint32)

        def flush() -> pa.RecordBatch:
            row = [part, state["shard"], state["start"], n, len(names), names, sizes, WaveletMatrix.build(np.concatenate(held)).to_bytes()]
            state["shard"] += 1
            state["start"] += n
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, _FILE, strict=True)], schema=_FILE)

        for batch in batches:
            own = batch.column(0).to_pylist()
            for a, b, ids, offsets in codec.encode(batch.column(1)):
                for k in range(a, b):
                    names.append(own[k])
                    held += [ids[offsets[k - a] : offsets[k - a + 1]], end]
                    sizes.append(len(held[-2]) + 1)
                    n += sizes[-1]
                    if n >= shard_tokens:
                        yield flush()
                        names, sizes, held, n = [], [], [], 0
        if names:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(shards, FILE_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document in the files: doc_id, start over all files, n_tokens, ids (little-endian unsigned 32-bit)."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, start = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                ids = WaveletMatrix.from_bytes(batch.column(4)[i].as_buffer()).decode()
                sizes = np.array(batch.column(3)[i].as_py(), dtype=np.int64)
                at = np.cumsum(sizes) - sizes
                data = ids.astype("<u4")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sizes), part)), pa.array(batch.column(2)[i].as_py(), type=pa.int64()), pa.array(start + at), pa.array(sizes), pa.array([data[x : x + y].tobytes() for x, y in zip(at.tolist(), sizes.tolist(), strict=True)], type=pa.binary())], names=["part", "doc_id", "start", "n_tokens", "ids"])

    rows = files.select("part", "part_start", "doc_ids", "doc_sizes", "matrix").mapInArrow(documents, "part long, doc_id long, start long, n_tokens long, ids binary")
    # one row for each partition that was written
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = totals.select(F.col("part").alias("of"), (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("before"))
    return rows.join(before, F.col("part") == F.col("of")).select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids")


def op3_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "op3-files")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), added=True)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
