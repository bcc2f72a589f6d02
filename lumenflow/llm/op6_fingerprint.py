"""Document fingerprints by one-permutation MinHash with optimal densification, in DataFrame functions only.

The 5-word shingles of a text (words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased;
fewer words are one shingle) are hashed once. A hash's upper part is its bin and
its lower part its value; a mark for every bin is sorted in behind the bin's
hashes, so the first of each bin's run, its least value or its mark, fills a slot.
An empty bin takes the value of the first filled bin in a pseudo-random order of
its own, which is the same for all documents. Of every
value the low ``BITS`` bits are packed into a hexadecimal string. Equal share m of two
fingerprints is corrected for chance agreement: (m - 2^-BITS) / (1 - 2^-BITS).

Defined results: a null text counts as empty; texts without a word have the
fingerprint of all zero bins; equal texts have equal fingerprints. Documents are
in descending order of doc_id, then text, so repeated rows follow each other; a
null doc_id comes last; an empty table gives no rows, and a single document is
its own next one; other columns are ignored. Rows of one doc_id are in one range,
so one task orders them.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenflow.llm.common import lower_ascii, table

BINS = 128
BITS = 8
_VALUE_BITS = 48
_SEED = 29
#: Bins that an empty one asks before all filled ones are looked at.
_ASKED = 2


def words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _literal(rows: list[list[int]]) -> Column:
    return F.from_json(F.lit(json.dumps(rows)), "array<array<int>>")


def probe_orders() -> list[list[int]]:
    """For each bin the order in which it asks the others for a value, from a rule."""
    return [sorted(range(BINS), key=lambda j, i=i: crc32(f"{_SEED}:{i}:{j}".encode())) for i in range(BINS)]


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the fingerprint of a text column.

    A slot is twice a hash, or the odd mark of an empty bin. Such a bin asks the
    first bins of its order; if they are empty too, the filled bins are asked for
    their places in that order, and the least place wins.
    """
    orders = probe_orders()
    places = [[0] * BINS for _ in range(BINS)]  # place * BINS + bin, so the least one names its bin
    for i, order in enumerate(orders):
        for place, j in enumerate(order):
            places[i][j] = place * BINS + j
    df = df.withColumn("_w", F.transform(words(F.coalesce(F.col(text), F.lit(""))), lambda w: F.xxhash64(w)))
    # each shingle once; one shingle of all words where there are fewer than five
    sets = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_w") - 5, F.lit(0))), lambda i: F.xxhash64(*[F.get(F.col("_w"), i + k) for k in range(5)]).bitwiseAND(F.lit((1 << 55) - 1)) * 2)
    marks = F.transform(F.sequence(F.lit(1), F.lit(BINS)), lambda b: F.shiftleft(b.cast("long"), _VALUE_BITS + 1) - 1)
    df = df.withColumn("_h", F.when(F.size("_w") > 0, F.sort_array(F.concat(sets, marks))))
    bin_of = lambda x: F.shiftright(x, _VALUE_BITS + 1)
    df = df.withColumn("_s", F.filter("_h", lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(F.col("_h"), i - 1)))))
    df = df.withColumn("_f", F.transform(F.filter("_s", lambda x: x % 2 == 0), lambda x: bin_of(x).cast("int")))
    df = df.withColumn("_p", _literal([order[:_ASKED] for order in orders])).withColumn("_o", _literal(places))
    found = lambda b: F.when(F.get(F.col("_s"), b) % 2 == 0, F.get(F.col("_s"), b))
    least = lambda b: F.array_min(F.transform("_f", lambda j: F.get(F.get(F.col("_o"), b), j))) % BINS
    filled = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.coalesce(found(b), *[found(F.get(F.get(F.col("_p"), b), F.lit(k))) for k in range(_ASKED)], F.get(F.col("_s"), least(b))))
    low = lambda v: F.shiftright(v, 1).bitwiseAND(F.lit((1 << BITS) - 1))
    packed = F.array_join(F.transform(filled, lambda v: F.lpad(F.lower(F.hex(low(v))), BITS // 4, "0")), "")
    return df.withColumn(name, F.when(F.size("_w") > 0, packed).otherwise(F.lit("0" * (BINS * BITS // 4)))).drop("_w", "_h", "_s", "_f", "_p", "_o")


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity of two fingerprints, 0 to 1."""
    width = BITS // 4
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.substring(a, i * width + 1, F.lit(width)) == F.substring(b, i * width + 1, F.lit(width))))
    return F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - F.lit(2.0**-BITS)) / F.lit(1 - 2.0**-BITS))


def range_of(doc_id: Column, cuts: Column, step: int) -> Column:
    """How many of the sorted cuts lie below, by every step-th cut first, so a row looks at few of them."""
    below = lambda a: F.size(F.filter(a, lambda c: c < doc_id))
    whole = F.greatest(below(F.filter(cuts, lambda _, i: i % step == 0)) - 1, F.lit(0)) * step
    return whole + below(F.slice(cuts, whole + 1, step))


def with_next(df: DataFrame, complete: Callable[[DataFrame], DataFrame], columns: list[str], ranges: int) -> DataFrame:
    """``complete(df)`` with next_<column> of the row after each in descending doc_id order; after the last comes the first.

    Rows are dealt out to ``ranges`` ranges of doc_id; within one the next row is
    a window's, and a range's last row gets the first of the range below. Ranges
    are put in order by their numbers alone; a head's text goes only where that
    last row is. ``complete`` runs once for each document and each head.
    """
    order = [F.desc_nulls_last("doc_id"), F.desc_nulls_last("text")]
    cuts = df.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 100_000).alias("cuts"))
    cuts = cuts.select(F.array_sort(F.array_distinct(F.coalesce("cuts", F.array().cast("array<long>")))).alias("cuts")).first()["cuts"]
    ranged = df.withColumn("_r", range_of(F.col("doc_id"), F.from_json(F.lit(json.dumps(cuts)), "array<long>"), max(1, int(len(cuts) ** 0.5))))
    following = F.struct(*[F.col(c) for c in columns])
    # texts are dealt out first, so ``complete`` works in as many tasks as there are, whatever the files
    rows = complete(ranged.repartition("_r")).withColumn("_next", F.lead(following).over(Window.partitionBy("_r").orderBy(*order)))
    heads = complete(ranged.groupBy("_r").agg(F.max_by("text", F.struct("doc_id", "text")).alias("text"))).withColumn("_head", following)
    # a head follows the last row of the range above it; the top one follows the lowest range's
    every = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = ranged.select("_r").distinct().select("_r", F.coalesce(F.lead("_r").over(Window.orderBy("_r")), F.first("_r").over(every)).alias("_of"))
    heads = heads.join(F.broadcast(follows), "_r").select("_head", "_of")  # a row for each range, of two numbers
    rows = rows.join(heads, (F.col("_r") == F.col("_of")) & F.col("_next").isNull(), "left").withColumn("_next", F.coalesce("_next", "_head"))
    return rows.select("*", *[F.col(f"_next.{c}").alias(f"next_{c}") for c in columns]).drop("_r", "_of", "_next", "_head")


def fingerprint_edits(docs: DataFrame, ranges: int) -> DataFrame:
    """Fingerprints of the documents and of their edited texts, with both likenesses."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(texts, lambda df: with_fingerprint(df, "text", "fingerprint"), ["text", "fingerprint"], ranges).withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - third), F.substring(F.col("next_text"), F.lit(1), third)))
    rows = rows.select("doc_id", "n_chars", "edited", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "next_fingerprint")
    rows = with_fingerprint(rows, "edited", "edited_fingerprint")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return fingerprint_edits(table(spark, sf_dir, "documents"), ranges)
