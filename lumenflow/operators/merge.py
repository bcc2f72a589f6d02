"""Upserts and compare-and-set updates as joins: each returns the new table (or what would be written)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, key: str, seq: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))).filter("_n = 1").drop("_n")


def vector_upsert(table: DataFrame, new: DataFrame, key: str = "photo_id", columns: tuple[str, ...] = ("embedding", "embedding_model")) -> DataFrame:
    """Inserts (version 0) or replaces ``columns`` (version + 1); all others are kept."""
    n = new.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    out = table.join(n, F.col(key) == F.col("_k"), "full_outer")
    hit, fresh = F.col("_k").isNotNull(), F.col(key).isNull()
    cols = {c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in columns} | {"version": F.when(fresh, F.lit(0).cast("long")).when(hit, F.col("version") + 1).otherwise(F.col("version")), key: F.coalesce(key, "_k")}
    return out.withColumns(cols).select(*table.columns)


def accepted(new: DataFrame, photos: DataFrame, galleries: DataFrame) -> DataFrame:
    """Results whose photo and gallery are live and whose storage key is still the photo's."""
    ok = photos.filter("deleted_at is null").join(galleries.filter("deleted_at is null").select("gallery_id"), "gallery_id", "left_semi")
    return new.join(ok.select("photo_id", "storage_key"), ["photo_id", "storage_key"], "left_semi")


def photo_update(photos: DataFrame, new: DataFrame, keep_old: list[str], overwrite: list[str]) -> DataFrame:
    """Compare-and-set on (photo_id, storage_key): new values win where there are any, ``overwrite`` always; version + 1."""
    n = new.select("photo_id", "storage_key", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in keep_old + overwrite])
    out = photos.join(n, ["photo_id", "storage_key"], "left")
    cols = {c: F.coalesce(f"_{c}", c) for c in keep_old} | {c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in overwrite}
    return out.withColumns(cols | {"version": F.col("version") + F.coalesce(F.col("_hit").cast("int"), F.lit(0))}).select(*photos.columns)


def merged_maps(old, new) -> Column:
    """Key-wise merge, new values win."""
    empty = F.create_map().cast("map<string,double>")
    return F.map_zip_with(F.coalesce(old, empty), F.coalesce(new, empty), lambda _, a, b: F.coalesce(b, a))


def score_upsert(table: DataFrame, new: DataFrame) -> DataFrame:
    """sub_scores merge key-wise, quality_scored_at is kept where the new one is null."""
    n = new.select(F.col("photo_id").alias("_k"), F.col("sub_scores").alias("_s"), F.col("quality_scored_at").alias("_q"), F.col("pipeline_version").alias("_v"))
    out = table.join(n, F.col("photo_id") == F.col("_k"), "full_outer")
    hit = F.col("_k").isNotNull()
    return out.withColumns({"sub_scores": F.when(hit, merged_maps(F.col("sub_scores"), F.col("_s"))).otherwise(F.col("sub_scores")), "quality_scored_at": F.coalesce("_q", "quality_scored_at"), "pipeline_version": F.coalesce("_v", "pipeline_version"), "photo_id": F.coalesce("photo_id", "_k")}).select(*table.columns)


def group_patch(old, patch, owned: tuple[str, ...] = ("sharpness_pct", "rank_reason")) -> Column:
    """The owned keys are taken out and the patch put in."""
    kept = F.map_filter(old, lambda k, _: ~k.isin(*owned))
    return F.map_concat(kept, F.coalesce(F.map_filter(patch, lambda k, v: k.isin(*owned) & v.isNotNull()), F.create_map().cast("map<string,double>")))


def rank_update(table: DataFrame, new: DataFrame) -> DataFrame:
    """Only rows that have a group get the new ranks."""
    n = new.select("photo_id", F.col("burst_rank").alias("_r"), F.lit(True).alias("_hit"))
    return table.join(n, "photo_id", "left").withColumn("burst_rank", F.when(F.col("_hit") & F.col("embed_group_id").isNotNull(), F.col("_r")).otherwise(F.col("burst_rank"))).select(*table.columns)


def keyed_upsert(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key; rows without a full key are skipped."""
    for k in keys:
        new = new.filter(F.col(k).isNotNull())
    return table.join(new.select(*keys), keys, "left_anti").unionByName(new)


def error_rows(errors: DataFrame) -> DataFrame:
    """Numeric ids only; the code is cut at 80 signs."""
    return errors.filter(F.col("photo_id").cast("string").rlike(r"^[0-9]+$")).select(F.col("photo_id").cast("long").alias("photo_id"), F.substring("error", 1, 80).alias("error"))


def admin_outcome(events: DataFrame, photos: DataFrame, jobs: DataFrame) -> DataFrame:
    """ok where both the photo's key and the job's attempt still match, else which one doesn't."""
    p = photos.filter("deleted_at is null").select("photo_id", "storage_key", F.lit(True).alias("_p"))
    j = jobs.select("job_id", "attempt_count", F.lit(True).alias("_j"))
    out = events.join(p, ["photo_id", "storage_key"], "left").join(j, ["job_id", "attempt_count"], "left")
    return out.withColumn("outcome", F.when(F.col("_p").isNull(), "PHOTO_REVISION_MISMATCH").when(F.col("_j").isNull(), "JOB_ATTEMPT_MISMATCH").otherwise("ok")).drop("_p", "_j")


def one_active(models: DataFrame, by: str = "id") -> DataFrame:
    """Only the newest model is active."""
    newest = models.agg(F.max(by).alias("_newest"))
    return models.crossJoin(F.broadcast(newest)).withColumn("active", F.col(by) == F.col("_newest")).drop("_newest")


def quality_patches(table: DataFrame, patches: DataFrame, locked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table with patches (photo_id, sub_scores) merged key-wise, and the ids that could not be written (unknown or locked)."""
    free = patches.join(locked.select("photo_id"), "photo_id", "left_anti")
    p = free.select("photo_id", F.col("sub_scores").alias("_s"))
    out = table.join(p, "photo_id", "left").withColumn("sub_scores", F.when(F.col("_s").isNotNull(), merged_maps(F.col("sub_scores"), F.col("_s"))).otherwise(F.col("sub_scores"))).select(*table.columns)
    return out, patches.select("photo_id").join(free.join(table.select("photo_id"), "photo_id", "left_semi").select("photo_id"), "photo_id", "left_anti")


def failed_jobs(jobs: DataFrame, failures: DataFrame) -> DataFrame:
    """Failures (job_id, attempt_count, error) mark a job's current attempt only; the error is cut at 4000 signs."""
    f = failures.groupBy("job_id", "attempt_count").agg(F.max(F.substring("error", 1, 4000)).alias("_e"))
    return jobs.join(f, ["job_id", "attempt_count"], "left").withColumns({"status": F.when(F.col("_e").isNotNull(), "FAILED").otherwise(F.col("status")), "error": F.coalesce("_e", "error")}).select(*jobs.columns)
