"""Benchmark decontamination: an exact prefix of rare n-gram seeds, then Smith-Waterman alignment.

1. The test items' word pairs go into a bitmap of 16 bits for each pair, at most
   2**``BITMAP_BITS`` bits (the only thing that is broadcast unchecked), and one
   pass over the texts counts those that the bitmap lets through.
2. An alignment of m matches and e errors (score m - e) has at most e + 1 runs of
   matches, so it holds at least score - 1 of the item's pairs. An item of n words
   that needs the score t therefore shares at least one of any n - t + 1 of its
   n - 1 pairs: the n - t + 1 rarest are its seeds, and no alignment is lost
   however often a passage is copied. Counts only save work.
3. A second pass writes where seeds occur. Seeds that share a diagonal range
   (position in the text minus position in the item) make one window to align.
   It reaches n / 2 words beyond the range, as far as the errors of a score of
   half the words can shift an alignment.
4. A third pass reads each text with windows once and cuts their word hashes out.
5. Windows with fewer than t - 1 of the item's pairs go. The others are aligned
   with their item (match 1, mismatch and gap -1), which finds edited and
   paraphrased copies; the score is divided by the item's words.

Words are runs of letters, digits and non-ASCII bytes, A-Z lower-cased. An item
of one or two words holds no pair that an edited copy must share, and half of it
is no evidence; with ``short`` it is found where all its words stand in a row, by
one more pass that runs if there are such items. An item without words is never found.

Defined results: null and empty texts and items match nothing; rows that repeat,
and items that repeat, are reported once; a null doc_id or item_id is never
reported; other columns are ignored; an empty table on either side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenflow.llm import textops
from lumenflow.llm.common import Scratch, map_batches, small, table
from lumenflow.llm.textops import blocks, shingle_hashes, span_hashes

SEED_WORDS = 2
#: Items of fewer words are found as whole word sequences only.
LEAST_WORDS = 3
BITMAP_BITS = 28
#: Windows of a document that one row carries.
WINDOWS = 4096
#: Least score for contamination, as a share of the item's words.
THRESHOLD = 0.5
#: Diagonals that fall into one window.
DIAGONALS = 32
_U = np.uint64
_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_VALUE = textops._LOWER


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each row's begin; long blocks are hashed in pieces between words."""
    padded = np.zeros(len(data) + 2, dtype=bool)
    padded[1:-1] = _INSIDE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    starts = np.flatnonzero(padded[1:] & (~padded[:-1] | cut))
    ends = np.flatnonzero(padded[:-1] & (~padded[1:] | cut))
    out, a = [], 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + 2 * textops.BLOCK, side="right")))
        lo, hi = starts[a], ends[b - 1]
        out.append(span_hashes(_VALUE[data[lo:hi]], starts[a:b] - lo, ends[a:b] - lo))
        a = b
    return np.concatenate(out) if out else np.zeros(0, dtype=_U), np.searchsorted(starts, offsets)


def seed_rows(hashes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, hash) of all word pairs."""
    every = shingle_hashes(hashes, SEED_WORDS)
    row = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    whole = np.flatnonzero(row[: len(every)] == row[SEED_WORDS - 1 :]) if len(every) else np.zeros(0, dtype=np.int64)
    return row[whole], whole - begins[row[whole]], every[whole]


def item_grams(items: DataFrame) -> DataFrame:
    """item_id, item_key (one for each of its texts), item_at, gram, item_words."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, _, data, offsets in blocks(batch.column(2)):
            hashes, begins = word_hashes(data, offsets)
            row, at, gram = seed_rows(hashes, begins)
            size = np.diff(begins)[row]
            own = size >= LEAST_WORDS
            rows = pa.array(row[own] + a)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at[own]), pa.array(gram[own].view(np.int64)), pa.array(size[own])], names=["item_id", "item_key", "item_at", "gram", "item_words"])

    return map_batches(items.select("item_id", F.xxhash64("text").alias("item_key"), "text"), work, "item_id long, item_key long, item_at long, gram long, item_words long")


def bitmap_bits(n_grams: int) -> int:
    return min(BITMAP_BITS, max(16, (16 * n_grams).bit_length()))


def bitmap(grams: DataFrame, bits: int) -> np.ndarray:
    """A packed bitmap of the grams' upper bits; what comes to the driver is at most 2**bits bits, whatever the items."""
    slot = F.shiftrightunsigned("gram", 64 - bits)
    cells = grams.select(F.shiftright(slot, 6).alias("cell"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(gram, {64 - bits}) & 63 as int))").alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << (bits - 6), dtype="<i8")
    out[cells["cell"].to_numpy(dtype=np.int64)] = cells["bits"].to_numpy(dtype=np.int64)
    return out.view(np.uint8)


def word_rows(hashes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position of the last word, hash) of all words and word pairs."""
    row, at, pair = seed_rows(hashes, begins)
    one = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    return np.concatenate([one, row]), np.concatenate([np.arange(len(one)) - begins[one], at + SEED_WORDS - 1]), np.concatenate([hashes, pair])


def short_items(items: DataFrame) -> DataFrame:
    """item_id, gram (of all its words), item_words of the items under LEAST_WORDS."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, _, data, offsets in blocks(batch.column(1)):
            hashes, begins = word_hashes(data, offsets)
            size = np.diff(begins)
            row, at, gram = word_rows(hashes, begins)
            whole = (size[row] < LEAST_WORDS) & (at == size[row] - 1)
            single = np.arange(len(row)) < len(hashes)
            whole &= single == (size[row] == 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[whole] + a)), pa.array(gram[whole].view(np.int64)), pa.array(size[row[whole]])], names=["item_id", "gram", "item_words"])

    return map_batches(items.select("item_id", "text"), work, "item_id long, gram long, item_words long")


def _passed(docs: DataFrame, grams: DataFrame, emit, schema: str, rows=seed_rows) -> DataFrame:
    """What ``emit`` makes of (batch, row, position, gram) of the places (``rows``) whose gram the bitmap of ``grams`` holds, block by block."""
    bits = bitmap_bits(grams.count())
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(grams, bits))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for a, _, data, offsets in blocks(batch.column(1)):
            hashes, begins = word_hashes(data, offsets)
            row, at, gram = rows(hashes, begins)
            slot = gram >> _U(64 - bits)
            hit = np.flatnonzero(held[(slot >> _U(3)).astype(np.int64)] >> (slot & _U(7)).astype(np.uint8) & 1)
            yield emit(batch, row[hit] + a, at[hit], gram[hit].view(np.int64))

    return map_batches(docs, work, schema)


def gram_counts(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """gram, n: occurrences over all texts, added up within a block first."""

    def emit(batch, row, at, gram):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(gram, return_counts=True)], names=["gram", "n"])

    return _passed(docs, grams, emit, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def occurrences(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """doc_id, doc_at, gram of all places whose gram the bitmap of ``grams`` holds."""

    def emit(batch, row, at, gram):
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(at), pa.array(gram)], names=["doc_id", "doc_at", "gram"])

    return _passed(docs, grams, emit, "doc_id long, doc_at long, gram long")


def whole_sequences(docs: DataFrame, short: DataFrame) -> DataFrame:
    """doc_id, item_id, score (1), item_words, ends_at (the last place) of short items that occur whole; a text gives each sequence once."""

    def emit(batch, row, at, gram):
        order = np.lexsort((at, gram, row))
        row, at, gram = row[order], at[order], gram[order]
        last = np.ones(len(row), dtype=bool)
        last[:-1] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[last])), pa.array(at[last]), pa.array(gram[last])], names=["doc_id", "ends_at", "gram"])

    found = _passed(docs, short.select("gram"), emit, "doc_id long, ends_at long, gram long", word_rows)
    return found.join(small(short), "gram").select("doc_id", "item_id", F.lit(1.0).alias("score"), "item_words", "ends_at")


def best_scores(texts: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair the best local alignment score and where in the text it ends."""
    width, height = max(map(len, texts)), max(map(len, items))
    t = np.zeros((len(texts), width), dtype=_U)
    q = np.zeros((len(items), height), dtype=_U)
    in_text, in_item = np.zeros(t.shape, dtype=bool), np.zeros(q.shape, dtype=bool)
    for k, (x, y) in enumerate(zip(texts, items, strict=True)):
        t[k, : len(x)], q[k, : len(y)] = x, y
        in_text[k, : len(x)], in_item[k, : len(y)] = True, True
    slope = np.arange(width, dtype=np.int32)
    above = np.zeros((len(texts), width + 1), dtype=np.int32)
    best, end = np.zeros(len(texts), dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
    for i in range(height):
        alike = (t == q[:, i : i + 1]) & in_text & in_item[:, i : i + 1]
        row = np.maximum(above[:, :-1] + np.where(alike, 1, -1), above[:, 1:] - 1)
        row = np.maximum(np.maximum.accumulate(np.maximum(row, 0) + slope, axis=1) - slope, 0)  # gaps in the item
        above[:, 1:] = row
        at = row.argmax(axis=1)
        most = row[np.arange(len(texts)), at]
        better = most > best
        best[better], end[better] = most[better], at[better]
    return best, end


def needed(size, threshold: float):
    """Least whole score of items of ``size`` words that reaches the threshold."""
    return np.ceil(np.asarray(size) * threshold - 1e-9).astype(np.int64)


_WINDOW = "item_id long, item_key long, window long, item_words long"


def cut_windows(windows: DataFrame, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, item_key, begin, hashes (of the window's words): each text is read once for up to WINDOWS windows."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, b, data, offsets in blocks(batch.column(1)):
            hashes, begins = word_hashes(data, offsets)
            rows = batch.column(2).slice(a, b - a)
            own = rows.flatten()
            item, key, window, size = (own.field(k).to_numpy() for k in range(4))
            doc = np.repeat(np.arange(b - a), pc.list_value_length(rows).to_numpy())
            slack = (size * (1 - threshold)).astype(np.int64) + 1
            length = np.diff(begins)[doc]
            lo = np.minimum(np.maximum(0, window * DIAGONALS - slack), length)
            hi = np.minimum(np.maximum(lo, (window + 1) * DIAGONALS + size + slack), length)
            raw = hashes.tobytes()
            at = begins[:-1][doc]
            for k in range(0, len(doc), 1024):
                part = slice(k, k + 1024)
                cut = [raw[8 * x : 8 * y] for x, y in zip((at + lo)[part].tolist(), (at + hi)[part].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc[part] + a)), pa.array(item[part]), pa.array(key[part]), pa.array(lo[part]), pa.array(cut, type=pa.binary())], names=["doc_id", "item_id", "item_key", "begin", "hashes"])

    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    part = F.pmod(F.xxhash64("item_key", "window"), F.ceil(n / WINDOWS))
    lists = windows.withColumn("part", part).groupBy("doc_id", "part").agg(F.collect_list(F.struct("item_id", "item_key", "window", "item_words")).alias("windows"))
    rows = lists.join(docs, "doc_id").select("doc_id", "text", F.col("windows").cast(f"array<struct<{_WINDOW.replace(' ', ':').replace(',:', ',')}>>").alias("windows"))
    return map_batches(rows, work, "doc_id long, item_id long, item_key long, begin long, hashes binary")


def hashed_items(items: DataFrame) -> DataFrame:
    """item_id, item_key, item_hashes (of the words)."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, b, data, offsets in blocks(batch.column(2)):
            hashes, begins = word_hashes(data, offsets)
            own = pa.array([hashes[x:y].tobytes() for x, y in zip(begins[:-1], begins[1:], strict=True)], type=pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), own], names=["item_id", "item_key", "item_hashes"])

    return map_batches(items.select("item_id", F.xxhash64("text").alias("item_key"), "text"), work, "item_id long, item_key long, item_hashes binary")


def aligned(windows: DataFrame, pairs: int = 256, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, item_words, ends_at (word of the text) of the windows (with hashes and item_hashes) that can reach the threshold."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        begin = batch.column(2).to_numpy()
        cut, item = ([np.frombuffer(x.as_buffer(), dtype=_U) for x in batch.column(k)] for k in (3, 4))
        size = np.array([len(x) for x in item], dtype=np.int64)
        shared = [np.isin(shingle_hashes(x, SEED_WORDS), shingle_hashes(y, SEED_WORDS)).sum() for x, y in zip(item, cut, strict=True)]
        can = (np.array(shared, dtype=np.int64) >= needed(size, threshold) - 1) & (size > 0)
        order = sorted(np.flatnonzero(can).tolist(), key=lambda k: (size[k], len(cut[k])))
        score, end = np.zeros(len(cut), dtype=np.int32), np.zeros(len(cut), dtype=np.int64)
        for k in range(0, len(order), pairs):
            own = order[k : k + pairs]
            score[own], end[own] = best_scores([cut[i] for i in own], [item[i] for i in own])
        out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score / np.maximum(size, 1)), pa.array(size), pa.array(end + begin)], names=["doc_id", "item_id", "score", "item_words", "ends_at"])
        yield out.filter(pa.array(can))

    return map_batches(windows.select("doc_id", "item_id", "begin", "hashes", "item_hashes"), work, "doc_id long, item_id long, score double, item_words long, ends_at long")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, short: bool = False) -> DataFrame:
    """doc_id, item_id, score, item_words, ends_at of every pair whose best alignment reaches the threshold.

    ``short`` looks for items of one or two words too, as whole sequences. It is
    off where documents are dropped by the result, as such an item is a common
    word or name in most documents that hold it.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null").distinct()
    kept, scratch = Scratch(docs.sparkSession, "op10"), Scratch(docs.sparkSession, "op10-work")
    grams = scratch.stored(item_grams(items), "items")
    counted = scratch.stored(grams.join(gram_counts(docs, grams), "gram", "left").na.fill(0, ["n"]), "counted")
    rank = F.row_number().over(Window.partitionBy("item_id", "item_key").orderBy("n", "gram", "item_at"))
    seeds = F.col("item_words") - F.ceil(F.col("item_words") * F.lit(threshold) - F.lit(1e-9)) + 1
    rare = counted.withColumn("rank", rank).filter((F.col("rank") <= seeds) & (F.col("n") > 0)).select("gram", "item_id", "item_key", "item_at", "item_words")
    rare = scratch.stored(rare, "seeds")
    hits = scratch.stored(occurrences(docs, rare), "hits")
    window = F.floor((F.col("doc_at") - F.col("item_at")) / DIAGONALS).alias("window")
    windows = scratch.stored(hits.join(small(rare), "gram").select("doc_id", "item_id", "item_key", window, "item_words").distinct(), "windows")
    cut = cut_windows(windows, docs, threshold).join(small(scratch.stored(hashed_items(items), "hashed")), ["item_id", "item_key"])
    best = kept.stored(aligned(cut, threshold=threshold).filter(F.col("score") >= threshold), "aligned")
    words = scratch.stored(short_items(items), "short") if short else None
    if words is not None and not words.isEmpty():
        best = best.unionByName(kept.stored(whole_sequences(docs, words), "short"))
    scratch.drop()
    return best.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "item_words", "ends_at")).alias("x")).select("doc_id", "item_id", "x.*")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short=True)
