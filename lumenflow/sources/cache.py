"""Reads the old file cache: a folder ``v3/<gallery>/`` with JSON-lines tables and vectors as NPY with a list of ids."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keys of older files and the fields that they are now.
OLD_ANALYSIS_KEYS = {"cluster_id": "burst_id", "cluster_rank": "burst_rank", "model_version": "pipeline_version"}
OLD_ASSIGNMENT_KEYS = {"parent_name": "concept_name", "concept_name": "detail_name"}

#: Vectors that go from a worker to Spark at once.
VECTORS = 1024


def _gallery() -> Column:
    """The gallery of a file's folder; its slash was written as two underscores."""
    return F.replace(F.element_at(F.split(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "/"), -2), F.lit("__"), F.lit("/"))


def _lines(spark: SparkSession, root: str, file: str, fields: T.StructType, old: dict[str, str]) -> DataFrame:
    """gallery and the line as ``now`` and ``before`` (under the old keys), of all galleries that have the file."""
    types = {f.name: f.dataType for f in fields}
    earlier = T.StructType([T.StructField(k, types[v]) for k, v in old.items() if v in types])
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", file).text(f"{root.rstrip('/')}/v3").select(_gallery().alias("gallery"), F.trim("value").alias("_line")).filter("_line <> ''")
    strict = {"mode": "FAILFAST"}
    return raw.select("gallery", F.from_json("_line", fields, strict).alias("now"), F.from_json("_line", earlier, strict).alias("before"))


def cached_analysis(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """(gallery, *schema) of every ``analysis.jsonl``; a field that the line lacks is read by its old key.

    Empty lines are skipped, keys outside the schema too, and a line that is no
    JSON fails. Rows without a pipeline_version aren't scored: filter them out for
    a gallery as it is grouped.
    """
    fields = T.StructType.fromDDL(schema)
    lines, back = _lines(spark, root, "analysis.jsonl", fields, OLD_ANALYSIS_KEYS), {v: k for k, v in OLD_ANALYSIS_KEYS.items()}
    one = lambda c: F.coalesce(F.col("now")[c], F.col("before")[back[c]]) if c in back else F.col("now")[c]
    return lines.select("gallery", *[one(c).alias(c) for c in fields.names])


def cached_assignments(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """(gallery, *schema) of every ``assignments.jsonl``.

    A line with the old key of the upper name is old, and its other name then is
    the lower one; in a newer line the same key is the upper one.
    """
    fields = T.StructType.fromDDL(schema)
    lines, back = _lines(spark, root, "assignments.jsonl", fields, OLD_ASSIGNMENT_KEYS), {v: k for k, v in OLD_ASSIGNMENT_KEYS.items()}
    old = F.col("before.parent_name").isNotNull()
    one = lambda c: F.when(old, F.col("before")[back[c]]).otherwise(F.col("now")[c]) if c in back else F.col("now")[c]
    return lines.select("gallery", *[one(c).alias(c) for c in fields.names])


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """gallery, pos, vector of NPY files; a matrix is read from its bytes without a copy and given on in parts."""
    for pdf in batches:
        for gallery, content in zip(pdf["gallery"], pdf["content"], strict=True):
            matrix = np.load(io.BytesIO(content), allow_pickle=False)
            for a in range(0, len(matrix), VECTORS):
                part = matrix[a : a + VECTORS].astype(np.float64)
                yield pd.DataFrame({"gallery": gallery, "pos": np.arange(a, a + len(part)), "vector": list(part)})


def cached_vectors(spark: SparkSession, root: str, name: str = "embeddings") -> DataFrame:
    """(gallery, photo_id, vector) of every ``<name>.npy`` with its ``<name>_ids.json``.

    A gallery with only one of the two files has no vectors, and of two lengths
    the shorter counts. One task reads one gallery's file, which Spark bounds at
    2 GB; larger ones fail.
    """
    folder = f"{root.rstrip('/')}/v3"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"{name}.npy").load(folder)
    vectors = files.select(_gallery().alias("gallery"), "content").mapInPandas(_rows, "gallery string, pos long, vector array<double>")
    ids = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"{name}_ids.json").text(folder, wholetext=True)
    ids = ids.select(_gallery().alias("gallery"), F.posexplode(F.from_json("value", "array<string>")).alias("pos", "photo_id"))
    return vectors.join(ids.withColumn("pos", F.col("pos").cast("long")), ["gallery", "pos"]).select("gallery", "photo_id", "vector")
