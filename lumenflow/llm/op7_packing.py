"""Packing of documents into training windows by the sum-of-squares rule.

Each task reads its documents as a stream. A document is cut into full windows
and one rest; the rest is placed at once into the fill level that minimises the
sum over levels of the squared count of partly filled windows there. The counts
are one array by level, so a placement costs one pass over at most ``window``
levels, whatever has been packed before.

What a task leaves open (few per cent of its tokens, where it has some ten
thousand documents) goes on to a second packing by the same rule, in so few tasks
that each gets ``CARRY`` pieces at least. Only what is still open then is poured
into full windows and a last one of sizes that are powers of two, so nothing is
padded; ``poured`` marks those pieces.

Windows that a task closes are never shuffled, and the driver holds a count only.
A lost task is simply run again: its input is in a fixed order. A task keeps its
open windows only, at most ``max_open``, never its documents.

Defined results: a null or empty text is a document of the end id alone; rows
that repeat are packed each; an empty table gives no rows; a null doc_id stays
null; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenflow.llm.common import map_arrow, stored, table

END_ID = 1
WINDOW = 2048
#: Open windows of a task; with so many the next document is cut to fill up the fullest.
MAX_OPEN = 512
#: Pieces that a task of the second packing gets at least.
CARRY = 20_000
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, open boolean, poured boolean"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_()), ("poured", pa.bool_())])
#: Sequences of the second packing are numbered from here, and by 2**40 for each task.
_SECOND = 1 << 62


class SumOfSquares:
    """Online packing of pieces (doc, start, ids, doc_tokens) into windows; closed ones go to ``out``.

    Where ``max_open`` windows are open, the next document fills up the fullest
    one. At the end, open windows are poured, or written as they are (``open``)
    where they are to be handed on.
    """

    def __init__(self, window: int, first_id: int, max_open: int = MAX_OPEN, hand_on: bool = False):
        self.window, self.next_id, self.max_open, self.hand_on = window, first_id, max_open, hand_on
        self.count = np.zeros(window + 1, dtype=np.int64)  # the level array: open windows by fill level
        self.open: dict[int, list[list[tuple]]] = {}
        self.n_open = 0
        self.out: list[tuple] = []

    def level_for(self, size: int) -> int:
        """The level (0: a new window) that keeps the sum of squared counts least; of equals the fullest."""
        room = self.window - size
        take = np.where(self.count[: room + 1] > 0, 1 - 2 * self.count[: room + 1], np.iinfo(np.int64).max // 4)
        take[0] = 0
        put = 2 * self.count[size:] + 1
        put[room] = 0  # a window that gets full is no longer counted
        change = take + put
        return room - int(np.argmin(change[::-1]))

    def add(self, doc, start: int, ids: np.ndarray, doc_tokens: int) -> None:
        if len(ids) == self.window:
            self._close([(doc, start, ids, doc_tokens)])
            return
        while len(ids):
            level = int(np.flatnonzero(self.count)[-1]) if self.n_open >= self.max_open else self.level_for(len(ids))
            part = ids[: self.window - level]  # less than the whole only where too many are open
            held = []
            if level:
                held = self.open[level].pop()
                self.count[level] -= 1
                self.n_open -= 1
            held.append((doc, start, part, doc_tokens))
            start, ids, level = start + len(part), ids[len(part) :], level + len(part)
            if level == self.window:
                self._close(held)
            else:
                held[-1] = (doc, held[-1][1], part.copy(), doc_tokens)  # not a view of a whole document
                self.open.setdefault(level, []).append(held)
                self.count[level] += 1
                self.n_open += 1

    def end(self) -> None:
        if not self.hand_on:
            self.pour()
            return
        for level in sorted(self.open, reverse=True):
            for held in self.open[level]:
                self._close(held, open_=True)
        self.open.clear()
        self.count[:] = 0
        self.n_open = 0

    def pour(self) -> None:
        """Cuts what is in open windows into full ones, and the last into windows of sizes that are powers of two."""
        left = [p for level in sorted(self.open, reverse=True) for held in self.open[level] for p in held]
        total = sum(len(p[2]) for p in left)
        sizes = [self.window] * (total // self.window) + [1 << k for k in range(self.window.bit_length() - 1, -1, -1) if total % self.window >> k & 1]
        self.open.clear()
        self.count[:] = 0
        self.n_open = 0
        held, room = [], 0
        sizes.reverse()
        for doc, start, ids, doc_tokens in left:
            while len(ids):
                if not room:
                    room = sizes.pop()
                part = ids[:room]
                held.append((doc, start, part, doc_tokens))
                start, ids, room = start + len(part), ids[len(part) :], room - len(part)
                if not room:
                    self._close(held, poured=True)
                    held = []

    def _close(self, held: list[tuple], open_: bool = False, poured: bool = False) -> None:
        at = 0
        for doc, start, ids, doc_tokens in held:
            self.out.append((doc, start, len(ids), ids.astype("<u4").tobytes(), doc_tokens, self.next_id, at, open_, poured))
            at += len(ids)
        self.next_id += 1

    def taken(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, max_open: int = MAX_OPEN, added: bool = False, carry: int = CARRY) -> DataFrame:
    """One row for each piece: its ids (little-endian unsigned 32-bit), its document, its sequence, its offset there, and whether it was poured; ``added`` as in bpe."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lumenflow.llm.bpe import encoder

        codec = encoder(tokenizer_path, added)
        packer = SumOfSquares(window, TaskContext.get().partitionId() << 40, max_open, hand_on=True)
        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for a, b, ids, offsets in codec.encode(batch.column(1)):
                for k in range(a, b):
                    own = np.concatenate((ids[offsets[k - a] : offsets[k - a + 1]], end))
                    for start in range(0, len(own), window):
                        packer.add(names[k], start, own[start : start + window], len(own))
                    if len(packer.out) >= 512:
                        yield packer.taken()
        packer.end()
        if packer.out:
            yield packer.taken()

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = SumOfSquares(window, _SECOND + (TaskContext.get().partitionId() << 40), max_open)
        for batch in batches:
            names, starts, _, ids, sizes = (batch.column(k).to_pylist() for k in range(5))
            for k in range(batch.num_rows):
                packer.add(names[k], starts[k], np.frombuffer(ids[k], dtype="<u4"), sizes[k])
            if packer.out:
                yield packer.taken()
        packer.end()
        if packer.out:
            yield packer.taken()

    pieces = stored(map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), first, SCHEMA), "op7-pieces")
    left = pieces.filter("open")
    tasks = max(1, left.count() // carry)
    left = left.repartition(tasks, "sequence_id").sortWithinPartitions("sequence_id", "offset", "poured")
    return pieces.filter("not open").unionByName(map_arrow(left, second, SCHEMA)).drop("open")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), added=True)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "poured")
