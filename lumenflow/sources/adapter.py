"""The photo tables as views of the driver's tables, in Spark and in DuckDB SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The labels of the subject classifier, the last one for an unclear photo.
SUBJECTS = ["bride", "groom", "couple", "group", "unknown"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One photo for each event."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("photo_id"),
        F.col("event_id").alias("display_order"),
        F.dayofmonth("ts").cast("long").alias("gallery_id"),
        F.concat(F.lit("cam"), (F.col("user_id") % 3).cast("string")).alias("camera"),
        F.col("ts").alias("taken_at"),
        F.when(F.col("event_id") % 37 != 0, F.col("ts")).alias("taken_at_gaps"),
        F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("technical_score"),
        (((F.col("event_id") * 7919) % 1000) / F.lit(10.0)).alias("aesthetic_score"),
        F.get_json_object("props", "$.k").cast("double").alias("sharpness"),
        (F.col("event_type") == "purchase").alias("selected"),
        F.element_at(F.array(*map(F.lit, SUBJECTS)), (F.col("user_id") % 5 + 1).cast("int")).alias("subject"),
        "user_id",
        "event_type",
        F.floor(F.col("event_id") / 4).alias("burst_id"),
        F.col("props"),
    )


def with_vectors(photos_df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds embedding and clip (array<double>), picked by photo_id from the vector table.

    Both follow from photo_id modulo the table's size, so they are paired there first: one join, and rows with vectors aren't moved.
    """
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    n = e.agg(F.count(F.lit(1)).alias("n_vectors"))  # one row
    both = e.select(F.col("vec_id").alias("_e"), F.col("v").alias("embedding")).crossJoin(F.broadcast(n)).withColumn("_c", (F.col("_e") * 7 + 3) % F.col("n_vectors"))
    both = both.join(e.select(F.col("vec_id").alias("_c"), F.col("v").alias("clip")), "_c").select("_e", "embedding", "clip")
    p = photos_df.crossJoin(F.broadcast(n)).withColumn("_e", F.col("photo_id") % F.col("n_vectors"))
    return p.join(both, "_e").drop("_e", "n_vectors")


PHOTOS_SQL = """photos AS (
  SELECT event_id AS photo_id, event_id AS display_order, CAST(day(ts) AS BIGINT) AS gallery_id, 'cam' || CAST(user_id % 3 AS VARCHAR) AS camera,
    ts AS taken_at, CASE WHEN event_id % 37 <> 0 THEN ts END AS taken_at_gaps, CASE WHEN event_id % 11 <> 0 THEN value END AS technical_score,
    CAST((event_id * 7919) % 1000 AS DOUBLE) / 10 AS aesthetic_score, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS sharpness,
    event_type = 'purchase' AS selected, CASE user_id % 5 WHEN 0 THEN 'bride' WHEN 1 THEN 'groom' WHEN 2 THEN 'couple' WHEN 3 THEN 'group' ELSE 'unknown' END AS subject,
    user_id, event_type, CAST(floor(event_id / 4) AS BIGINT) AS burst_id, props
  FROM events)"""
VECTORS_SQL = """vn AS (SELECT count(*) AS n FROM embeddings),
ev AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pv AS (SELECT p.*, a.v AS embedding, b.v AS clip FROM photos p CROSS JOIN vn JOIN ev a ON a.vec_id = p.photo_id % vn.n JOIN ev b ON b.vec_id = (p.photo_id * 7 + 3) % vn.n)"""
