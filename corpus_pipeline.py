"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and reread as the next one's docs. All but the last return the columns
of ``docs``. A stage gives the results of its operator for null, empty, very long
and repeated rows and for empty tables; see there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenflow.llm.common import made, quoted, remove, stored, table
from lumenflow.llm.op1_language import learn, predicted
from lumenflow.llm.op4_minhash import classified
from lumenflow.llm.op7_packing import pack_documents
from lumenflow.llm.op8_lines import cleaned
from lumenflow.llm.op10_decontamination import contaminated

ORACLE_SQL = None
#: A name for a hash of doc_id and text that no table has.
_KEY = "\x00key"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (``und``: null or letterless); a missing lang is filled in.

    A prediction that contradicts lang has no effect. Where nothing can be learned
    from, lettered documents stay and a missing lang stays missing.
    """
    model = learn(docs)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    kept = predicted(docs, model).filter("lang_pred <> 'und'")
    return kept.select(*[(F.coalesce("row.lang", "lang_pred") if c == "lang" else F.col("row")[c]).alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes cross-site boilerplate lines out of the texts; n_chars follows.

    Of a class of near copies one document counts, so lines of a copied page are
    no boilerplate and a carrier is cleaned whatever the share of such lines. A
    text of nothing else stays whole.
    """
    kept = classified(docs).filter("first and doc_id is not null").select("key").distinct()
    out = cleaned(docs, counted=stored(kept, "line-classes"))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {"text": F.col("text")}
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least doc_id; of repeated rows one.

    Rows of one doc_id with different texts are different documents.
    """
    kept = classified(docs).filter("first and doc_id is not null").select("key").distinct()
    own = docs.withColumn(_KEY, F.xxhash64(F.col("doc_id").cast("long"), "text"))
    stays = own.join(kept.withColumnRenamed("key", _KEY), _KEY, "left_semi").filter("doc_id is not null").dropDuplicates([_KEY, "doc_id"])
    return stays.select(*map(quoted, docs.columns)).unionByName(docs.filter("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test item or an edited copy of one."""
    leaks = contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*map(quoted, docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), added=True)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again; what a stage worked with goes once it is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        mark = len(made)
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        out = made.pop()
        for path in [*made[mark:], *([before] if before else [])]:
            remove(spark, path)
        del made[mark:]
        before = out
    return docs
