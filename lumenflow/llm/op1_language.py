"""Language identification by prediction by partial matching.

Per language a variable-order context tree over bytes (orders 3 to 0) is counted
from a bounded sample and then frozen. A byte costs -log2 of its count in the
longest context that has seen it, and an escape (method C: distinct over total
plus distinct) for each longer one; a byte that no context has seen costs 8 bits
after the last escape. A text gets the language with the shortest exact code.

As statistics are frozen, the cost of each byte after the commonest three-byte
contexts of the sample is worked out once for all languages (a table of at most
``TABLE_BYTES``); the others are worked out from the trees when they turn up.
Before coding, A-Z are lower-cased and all other ASCII but letters counts as a
space.

The sample: about ``DOCS_PER_LANGUAGE`` documents of each language, at most the
``MAX_LANGUAGES`` commonest; of a text over ``DOC_BYTES`` bytes a stretch of so
many from its middle. Of a language's four-byte strings the commonest are kept, at
most ``GRAMS`` over all languages. Predictions code every whole text.

Defined results: null or letterless texts are ``und`` with score 0; a tie goes to
the language first in alphabetical order; without any learned language all are
``und``. Rows that repeat are predicted each; a null doc_id is predicted, and is
never learned from; an empty table gives no rows. ``predict`` replaces input
columns named lang_pred, score or bits_per_byte and carries all others;
``predicted`` carries every row whole, as a struct.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenflow.llm.common import map_batches, quoted, row_struct, table
from lumenflow.llm.textops import blocks

ORDER = 3
#: The bounds of the sample: documents of a language (expected), bytes of one document, languages, and four-byte strings of all languages.
DOCS_PER_LANGUAGE = 400
DOC_BYTES = 1 << 16
MAX_LANGUAGES = 1024
GRAMS = 1 << 22
#: Bytes of the table of costs.
TABLE_BYTES = 1 << 25
_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_SLOTS = 20
_PIECE = 1 << 18


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte itself and the three before it in its text, as one 32-bit number; before the text there are spaces."""
    b = _FOLD[data].astype(np.uint32)
    out = b.copy()
    for k in range(1, ORDER + 1):
        before = np.full(len(b), 32, dtype=np.uint32)
        before[k:] = b[:-k] if len(b) > k else 0
        for j in range(k):
            at = offsets[:-1] + j
            before[at[at < offsets[1:]]] = 32
        out |= before << np.uint32(8 * k)
    return out


class ContextTree:
    """Frozen counts of one language."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.orders = []
        for order in range(ORDER, -1, -1):
            part = keys & np.uint32((1 << 8 * (order + 1)) - 1)
            known, where = np.unique(part, return_inverse=True)
            count = np.bincount(where, weights=counts, minlength=len(known))
            context, begins = np.unique(known >> np.uint32(8), return_index=True)
            total = np.add.reduceat(count, begins)
            distinct = np.diff(np.append(begins, len(known)))
            self.orders.append((known, count, context, total, distinct))

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Code length of each byte after its context."""
        out, left = np.zeros(len(keys)), np.arange(len(keys))
        for order, (known, count, context, total, distinct) in zip(range(ORDER, -1, -1), self.orders, strict=True):
            part = keys[left] & np.uint32((1 << 8 * (order + 1)) - 1)
            c = np.minimum(np.searchsorted(context, part >> np.uint32(8)), len(context) - 1)
            seen = context[c] == part >> np.uint32(8)
            k = np.minimum(np.searchsorted(known, part), len(known) - 1)
            hit = seen & (known[k] == part)
            size = total[c] + distinct[c]
            out[left[hit]] += np.log2(size[hit] / count[k[hit]])
            escaped = seen & ~hit
            out[left[escaped]] += np.log2(size[escaped] / distinct[c[escaped]])
            left = left[~hit]
        out[left] += 8
        return out


class Model:
    """All languages' trees, and the costs of the sample's grams laid out for quick lookup."""

    def __init__(self, languages: list[str], trees: list[ContextTree]):
        self.languages, self.trees = languages, trees
        self.keys, where = np.unique(np.concatenate([t.orders[0][0] for t in trees]), return_inverse=True)
        if len(self.keys) > (most := TABLE_BYTES // (8 * len(trees))):
            often = np.bincount(where, weights=np.concatenate([t.orders[0][1] for t in trees]))
            self.keys = np.sort(self.keys[np.argsort(-often, kind="stable")[:most]])
        self.costs = np.stack([t.bits(self.keys) for t in trees], axis=1)
        self.slots = np.zeros(1 << _SLOTS, dtype=np.int32)
        self.slots[self._slot(self.keys)] = np.arange(len(self.keys))

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435761)) >> np.uint32(32 - _SLOTS)).astype(np.int64)

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text (rows) under each language."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        all_keys = grams(data, offsets)
        for a in range(0, len(all_keys), _PIECE):
            keys = all_keys[a : a + _PIECE]
            row = self.slots[self._slot(keys)]
            cost = self.costs[row]
            missed = np.flatnonzero(self.keys[row] != keys)
            if len(missed):
                new, back = np.unique(keys[missed], return_inverse=True)
                near = np.minimum(np.searchsorted(self.keys, new), len(self.keys) - 1)
                known = self.keys[near] == new
                fresh = self.costs[near]
                if not known.all():
                    fresh[~known] = np.stack([t.bits(new[~known]) for t in self.trees], axis=1)
                cost[missed] = fresh[back]
            first = int(np.searchsorted(offsets, a, side="right")) - 1
            last = int(np.searchsorted(offsets, a + len(keys), side="left"))
            begins = np.maximum(offsets[first:last], a) - a
            owners = np.arange(first, last)
            full = offsets[first + 1 : last + 1] > np.maximum(offsets[first:last], a)
            out[owners[full]] += np.add.reduceat(cost, begins[full], axis=0, dtype=np.float64)
        return out


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def learn(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> Model | None:
    """Trees from about ``docs_per_language`` documents of each language, chosen by a hash of doc_id; None without any.

    What comes to the driver are at most GRAMS counts, whatever the size of the corpus.
    """
    known = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    if not sizes:
        return None
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    shares = docs.sparkSession.createDataFrame([(r["lang"], int(min(1.0, docs_per_language / r["n"]) * (1 << 30))) for r in sizes], "lang string, share long")
    sample = known.join(F.broadcast(shares), "lang").filter(draw < F.col("share")).select("text", "lang")
    each = max(256, min(1 << 17, GRAMS // len(sizes)))

    def stretches(column: pa.Array) -> pa.Array:
        """The texts as bytes, of long ones a stretch from the middle."""
        if pc.max(pc.binary_length(column)).as_py() <= DOC_BYTES:
            return column.cast(pa.binary())
        raw = [x.as_buffer() for x in column.cast(pa.binary())]
        return pa.array([x[(x.size - DOC_BYTES) // 2 :][:DOC_BYTES].to_pybytes() if x.size > DOC_BYTES else x.to_pybytes() for x in raw], type=pa.binary())

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        langs = batch.column(1).to_pylist()
        for a, b, data, offsets in blocks(stretches(batch.column(0))):
            keys = grams(data, offsets)
            for lang in sorted(set(langs[a:b])):
                own = [keys[offsets[i - a] : offsets[i - a + 1]] for i in range(a, b) if langs[i] == lang]
                known, n = np.unique(np.concatenate(own), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(known)), pa.array(known.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counts = map_batches(sample, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    counts = counts.withColumn("rank", rank).filter(F.col("rank") <= each).select("lang", "gram", "n").toPandas()
    languages = sorted(counts["lang"].unique())
    if not languages:
        return None
    return Model(languages, [ContextTree(c["gram"].to_numpy().astype(np.uint32), c["n"].to_numpy()) for _, c in counts.sort_values(["lang", "gram"]).groupby("lang", sort=True)])


_FOUND = ["lang_pred", "score", "bits_per_byte"]


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """row (the row of ``docs``, a struct), lang_pred, score and bits_per_byte of the whole texts."""
    lettered = F.coalesce(quoted("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(row_struct(docs).alias("row"), lettered.alias("lettered"))
    if model is None:
        return rows.select("row", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
    names = np.array([*model.languages, "und"], dtype=object)
    text = docs.columns.index("text")

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lettered = batch.column(1).to_numpy(zero_copy_only=False)
        for a, b, data, offsets in blocks(batch.column(0).field(text)):
            bits = model.code_lengths(data, offsets)
            best = bits.argmin(axis=1)
            least = bits[np.arange(b - a), best]
            score = 1 / np.exp2(np.clip(least[:, None] - bits, -1000, 0)).sum(axis=1)
            ok = lettered[a:b]
            per = least / np.maximum(np.diff(offsets), 1)
            found = [pa.array(names[np.where(ok, best, len(names) - 1)], type=pa.string()), pa.array(np.where(ok, score, 0.0)), pa.array(per)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *found], names=["row", *_FOUND])

    return map_batches(rows, work, T.StructType([rows.schema["row"], *T.StructType.fromDDL("lang_pred string, score double, bits_per_byte double").fields]))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` with lang_pred, score and bits_per_byte of their whole texts."""
    return predicted(docs, model).select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in _FOUND], *_FOUND)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict(docs.select("doc_id", "text"), learn(docs)).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_byte")
