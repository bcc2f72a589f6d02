"""Removal of cross-site boilerplate lines.

A line (without surrounding white space) is boilerplate if at least ``min_sites``
distinct sources carry it. One aggregation by line hash merges HyperLogLog
sketches of the sources; tasks sketch their own lines first, so a line that is
everywhere is one row for each task. Lines whose estimate is near the threshold
get an exact distinct count, which needs their rows only. Then every carrier of a
boilerplate line is cleaned of it; a text of nothing else stays whole.

Defined results: blank lines are never removed; a null source is no site; a null
text stays null with no lines; an empty text is one blank line. Rows that repeat
are cleaned each; a null doc_id is treated as any other value. Other columns are
carried along, whatever their names (``clean_lines`` replaces n_lines and
n_removed, ``cleaned`` carries the whole row as a struct); an empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenflow.llm.common import Scratch, row_struct, small, table

MIN_SITES = 10
LOG_SIZE = 12
#: Five standard errors of the sketch, relative; and two sites at least.
NEAR = 5 * 1.04 / 2 ** (LOG_SIZE / 2)
#: The white space around a line that doesn't count.
BLANK = " \t\x0b\x0c\r"


def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK))


def spread_lines(docs: DataFrame, scratch: Scratch, min_sites: int = MIN_SITES, counted: DataFrame | None = None) -> DataFrame:
    """Hashes of the lines that at least ``min_sites`` sources carry, in the rows that are ``counted`` (key: a hash of doc_id and text), or have no doc_id."""
    ids = [] if counted is None else ["doc_id", F.xxhash64(F.col("doc_id").cast("long"), "text").alias("key")]
    lines = docs.filter("source is not null").select(*ids, "source", F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.filter(stripped(F.col("line")) != "").select(*(["doc_id", "key"] if ids else []), F.xxhash64(stripped(F.col("line"))).alias("h"), F.xxhash64("source").alias("site"))
    if counted is not None:  # hashes are shuffled by key, never texts
        own = lines.join(counted.hint("merge"), "key", "left_semi").filter("doc_id is not null").drop("key", "doc_id")
        lines = scratch.stored(own.unionByName(lines.filter("doc_id is null").select("h", "site")), "lines")
    margin = max(2.0, NEAR * min_sites)
    sketches = lines.groupBy("h").agg(F.hll_sketch_agg("site", F.lit(LOG_SIZE)).alias("sketch"))
    rough = sketches.select("h", F.hll_sketch_estimate("sketch").alias("sites")).filter(F.col("sites") >= min_sites - margin)
    rough = scratch.stored(rough, "rough")
    near = scratch.stored(rough.filter(F.col("sites") <= min_sites + margin).select("h"), "near")
    exact = lines.join(small(near), "h", "left_semi").groupBy("h").agg(F.count_distinct("site").alias("sites")).filter(F.col("sites") >= min_sites)
    return rough.filter(F.col("sites") > min_sites + margin).select("h").unionByName(exact.select("h"))


def cleaned(docs: DataFrame, min_sites: int = MIN_SITES, counted: DataFrame | None = None) -> DataFrame:
    """row (the row of ``docs``, a struct), text without the lines, n_lines, n_removed.

    Sites are counted over the rows in ``counted`` (key, a hash of doc_id and
    text; all of ``docs`` where None): one of each class of near copies makes a
    copied page one site.
    """
    kept, scratch = Scratch(docs.sparkSession, "op8"), Scratch(docs.sparkSession, "op8-work")
    spread = kept.stored(spread_lines(docs, scratch, min_sites, counted), "spread")
    scratch.drop()
    # rows are known by a hash of doc_id and text; should two meet, each sees the other's lines, which changes nothing
    key = F.xxhash64("doc_id", "text").alias("key")
    own = docs.select(key, F.explode(F.transform(F.split("text", "\n"), lambda x: F.xxhash64(stripped(x)))).alias("h"))
    found = own.join(small(spread), "h").groupBy("key").agg(F.collect_set("h").alias("spread"))
    rows = docs.select(row_struct(docs).alias("row"), key).join(found.hint("merge"), "key", "left").withColumn("lines", F.split("row.text", "\n"))
    left = F.when(F.col("spread").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: (stripped(x) == "") | ~F.array_contains(F.col("spread"), F.xxhash64(stripped(x)))))
    rows = rows.withColumn("left", left)
    taken = F.col("spread").isNotNull() & F.exists("left", lambda x: stripped(x) != "")
    return rows.select(
        "row",
        F.when(taken, F.array_join("left", "\n")).otherwise(F.col("row.text")).alias("text"),
        F.when(F.col("row.text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(taken, F.size("lines") - F.size("left")).otherwise(0).cast("long").alias("n_removed"),
    )


def clean_lines(docs: DataFrame, min_sites: int = MIN_SITES, counted: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` with the lines taken out of ``text``, and n_lines, n_removed."""
    out = cleaned(docs, min_sites, counted)
    return out.select(*[(F.col("text") if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed")


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clean_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


ORACLE = f"""
WITH l AS (SELECT doc_id, source, text, line, pos, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS bare
  FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL)),
s AS (SELECT bare AS line FROM l WHERE bare <> '' AND source IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source) >= {MIN_SITES}),
c AS (SELECT l.doc_id, count(*) AS n_lines, count(s.line) AS hits, coalesce(string_agg(CASE WHEN s.line IS NULL THEN l.line END, chr(10) ORDER BY pos), '') AS cleaned,
    bool_or(s.line IS NULL AND bare <> '') AS more, any_value(text) AS text
  FROM l LEFT JOIN s ON l.bare = s.line GROUP BY l.doc_id),
d AS (SELECT *, hits > 0 AND more AS taken FROM c)
SELECT doc_id, n_lines, CASE WHEN taken THEN hits ELSE 0 END AS n_removed, length(CASE WHEN taken THEN cleaned ELSE text END) AS n_chars, sha256(CASE WHEN taken THEN cleaned ELSE text END) AS text_sha256 FROM d
"""
