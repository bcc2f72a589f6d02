"""Scans, selection predicates and validation over photo, gallery and analysis tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Kinds of admin jobs.
JOB_TYPES = ["DERIVATIVE", "EMBEDDING"]


def live(photos: DataFrame, galleries: DataFrame, preview: bool = False) -> DataFrame:
    """Photos that are not deleted, of galleries that are not deleted (and with a preview)."""
    df = photos.filter("deleted_at is null").join(galleries.filter("deleted_at is null").select("gallery_id"), "gallery_id", "left_semi")
    return df.filter("preview_key is not null") if preview else df


def gallery_scan(photos: DataFrame, analysis: DataFrame) -> DataFrame:
    """Analysis rows with their photos' order; deleted photos are out."""
    return analysis.join(photos.filter("deleted_at is null").select("photo_id", "gallery_id", "display_order", "camera", "taken_at"), "photo_id")


def mixed_models(df: DataFrame, model: str = "embedding_model", by: str = "gallery_id") -> DataFrame:
    """Galleries whose vectors come from more than one model."""
    return df.filter(F.col(model).isNotNull()).groupBy(by).agg(F.sort_array(F.collect_set(model)).alias("models")).filter(F.size("models") > 1)


def assert_single_model(df: DataFrame, model: str = "embedding_model", by: str = "gallery_id") -> DataFrame:
    """The rows, or a failure of the job where a gallery mixes models."""
    w = Window.partitionBy(by)
    ok = F.min(model).over(w).eqNullSafe(F.max(model).over(w))
    return df.withColumn("_ok", ok).filter(F.when(F.col("_ok"), True).otherwise(F.raise_error(F.concat(F.lit("mixed embedding models in gallery "), F.col(by).cast("string"))).cast("boolean"))).drop("_ok")


def camera_name(make, model) -> Column:
    name = F.trim(F.concat_ws(" ", F.trim(make), F.trim(model)))
    return F.when(name != "", name)


def photo_listing(photos: DataFrame, gallery_id, limit: int | None = None) -> DataFrame:
    """Live photos of a gallery that have a preview, in display order."""
    df = photos.filter((F.col("gallery_id") == gallery_id) & F.col("deleted_at").isNull() & F.col("preview_key").isNotNull())
    df = df.withColumn("camera", camera_name("camera_make", "camera_model")).orderBy("display_order", "photo_id")
    return df if limit is None else df.limit(limit)


def by_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the requested ids (pos, photo_id) with their place in the request; unknown ids are dropped."""
    return df.join(ids, "photo_id")


def request(spark: SparkSession, ids: list[int]) -> DataFrame:
    return spark.createDataFrame([(ids,)], "ids array<long>").select(F.posexplode("ids").alias("pos", "photo_id"))


def pending_targets(photos: DataFrame, galleries: DataFrame, done: DataFrame) -> DataFrame:
    """Uploaded live photos of live galleries without a result yet."""
    return live(photos.filter("status <> 'PENDING'"), galleries).join(done.select("photo_id"), "photo_id", "left_anti")


def resume_todo(refs: DataFrame, analysis: DataFrame, clip: DataFrame, version: str, since=None) -> DataFrame:
    """Refs without a fresh analysis and a clip vector; fresh: this version, and analysed at ``since`` or later."""
    fresh = analysis.filter(F.col("pipeline_version") == version)
    if since is not None:
        fresh = fresh.filter(F.col("analyzed_at") >= F.lit(since))
    return refs.join(fresh.select("photo_id").join(clip.select("photo_id"), "photo_id", "left_semi"), "photo_id", "left_anti")


def claim_batch(analysis: DataFrame, live_photos: DataFrame, exclude: DataFrame, n: int) -> DataFrame:
    """The next n live photos with an embedding, no clip vector and no error, by photo_id."""
    open_ = analysis.filter("has_embedding and not has_clip and error is null")
    return open_.join(live_photos.select("photo_id"), "photo_id", "left_semi").join(exclude.select("photo_id"), "photo_id", "left_anti").orderBy("photo_id").limit(n)


def lease_claims(analysis: DataFrame, exclude: DataFrame, now, lease_seconds: int, n: int) -> DataFrame:
    """The next n photos with a clip vector whose quality isn't scored and whose lease is free or run out, stamped with ``now``."""
    free = F.col("claimed_at").isNull() | (F.col("claimed_at") < F.lit(now) - F.make_dt_interval(secs=F.lit(float(lease_seconds))))
    return analysis.filter(F.col("has_clip") & F.col("quality_scored_at").isNull() & F.col("error").isNull() & free).join(exclude.select("photo_id"), "photo_id", "left_anti").orderBy("photo_id").limit(n).withColumn("claimed_at", F.lit(now))


def quality_scored(scored_at, sub_scores: str) -> Column:
    return F.col(scored_at).isNotNull() | F.get_json_object(sub_scores, "$.technical_score").isNotNull()


def eligible(refs: DataFrame, analysis: DataFrame, vectors: DataFrame, by: str = "gallery_id") -> DataFrame:
    """Refs with an analysis and both vectors. A gallery without any E vector uses C for E (source: clip)."""
    df = refs.join(analysis, "photo_id").join(vectors, "photo_id")
    has_e = F.max(F.col("e").isNotNull()).over(Window.partitionBy(by))
    return df.withColumns({"source": F.when(has_e, "embedding").otherwise("clip"), "e": F.when(has_e, F.col("e")).otherwise(F.col("c"))}).filter("e is not null and c is not null")


def preview_key(storage_key) -> Column:
    return F.concat(F.lit("previews/"), F.regexp_replace(storage_key, r"\.[^./]*$", ""), F.lit(".jpg"))


def failure_code(text) -> Column:
    return F.substring(F.upper(F.regexp_replace(text, r"[^A-Za-z0-9_.-]", "_")), 1, 80)


def clean_map(scores) -> Column:
    """NaN and infinities to null, before JSON is written."""
    bad = lambda v: F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    return F.transform_values(scores, lambda _, v: F.when(~bad(v), v))


def paired_keys(ids, keys) -> Column:
    """Pairs of photo ids and storage keys, null unless there are as many and none is blank."""
    ok = (F.size(ids) == F.size(keys)) & F.forall(keys, lambda k: k.isNotNull() & (k != ""))
    return F.when(ok, F.arrays_zip(ids, keys))


def clamp(x, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(x) if isinstance(x, str) else x))


def renamed_keys(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Old column names are read as the new ones where the new one is missing."""
    for old, new in names.items():
        if old in df.columns:
            df = df.withColumn(new, F.coalesce(new, old) if new in df.columns else F.col(old)).drop(old)
    return df


def _json_kind(raw, path: str) -> Column:
    """The JSON type at a path: a variant's, so 1, true and "1" are told apart."""
    return F.schema_of_variant(F.try_variant_get(raw, path, "variant"))


def _whole(kind: Column) -> Column:
    return kind.isin("BIGINT")


def admin_event_error(payload: str) -> Column:
    """Null for a valid admin photo event, else the first error's code."""
    raw = F.try_parse_json(payload)
    kind = F.schema_of_variant(raw)
    key = F.try_variant_get(raw, "$.storageKey", "string")
    steps = [
        (raw.isNull() | ~F.startswith(kind, F.lit("OBJECT")), "INVALID_EVENT"),
        (~F.coalesce(F.try_variant_get(raw, "$.jobType", "string").isin(*JOB_TYPES), F.lit(False)), "UNSUPPORTED_JOB_TYPE"),
        (~F.coalesce(_json_kind(raw, "$.storageKey").eqNullSafe("STRING") & (F.trim(key) != "") & (F.length(key) <= 500), F.lit(False)), "INVALID_STORAGE_KEY"),
    ]
    for name in ("jobId", "attemptCount", "photoId", "galleryId", "revisionId"):
        k = _json_kind(raw, f"$.{name}")
        text = F.try_variant_get(raw, f"$.{name}", "string")
        ok = (_whole(k) | (k == "STRING")) & text.rlike(r"^[0-9]+$") & (F.expr("try_cast(0 as decimal(38,0))") < text.try_cast("decimal(38,0)"))
        steps.append((~F.coalesce(ok, F.lit(False)), f"INVALID_{name.upper()}"))
    out = F.when(*[steps[0][0], F.lit(steps[0][1])])
    for bad, code in steps[1:]:
        out = out.when(bad, code)
    return out


def route(payload: str) -> Column:
    """admin, rank, full, or an error, by the payload's keys."""
    mode = F.get_json_object(payload, "$.mode")
    return (
        F.when(F.get_json_object(payload, "$.jobId").isNotNull() & F.get_json_object(payload, "$.jobType").isNotNull(), "admin")
        .when(F.get_json_object(payload, "$.galleryId").isNull(), "error: no gallery")
        .when(mode.isNull() | (mode == "full"), "full")
        .when(mode == "rank", "rank")
        .otherwise("error: unknown mode")
    )


MESSAGE = (
    "v int, galleryId long, embeddingModel string, photos array<struct<photoId long, storageKey string, previewKey string, vector string, metadata struct<takenAt string, cameraMake string, cameraModel string, exposureTime string, fNumber double, iso int, width int, height int, byteSize long>>>"
)
_LIMITS = {"storageKey": 500, "previewKey": 500}
_META = {"cameraMake": 100, "cameraModel": 100, "exposureTime": 30}


def message_error(body: str, dim: int) -> Column:
    """Null for a valid ingest message, else why the whole message is rejected."""
    raw = F.try_parse_json(body)
    at = lambda p: _json_kind(raw, p)
    photos = F.try_variant_get(raw, "$.photos", "array<variant>")
    model = F.try_variant_get(raw, "$.embeddingModel", "string")

    def text_bad(photo, path, limit, required):
        k = _json_kind(photo, path)
        s = F.try_variant_get(photo, path, "string")
        missing = k.isNull() | (k == "VOID")
        if required:
            return missing | (k != "STRING") | (s == "") | (F.length(s) > limit)
        return ~missing & ((k != "STRING") | (F.length(s) > limit))

    def int_bad(photo, path, required):
        k = _json_kind(photo, path)
        missing = k.isNull() | (k == "VOID")
        return (missing if required else F.lit(False)) | (~missing & ~_whole(k))

    def photo_bad(p):
        meta = _json_kind(p, "$.metadata")
        vec = F.try_variant_get(p, "$.vector", "string")
        taken = F.try_variant_get(p, "$.metadata.takenAt", "string")
        bad = ~F.startswith(F.schema_of_variant(p), F.lit("OBJECT")) | (~(meta.isNull() | (meta == "VOID")) & ~F.startswith(meta, F.lit("OBJECT")))
        bad = bad | int_bad(p, "$.photoId", True)
        for name, limit in _LIMITS.items():
            bad = bad | text_bad(p, f"$.{name}", limit, True)
        for name, limit in _META.items():
            bad = bad | text_bad(p, f"$.metadata.{name}", limit, False)
        for name in ("iso", "width", "height", "byteSize"):
            bad = bad | int_bad(p, f"$.metadata.{name}", False)
        f_kind = _json_kind(p, "$.metadata.fNumber")
        bad = bad | ~(f_kind.isNull() | f_kind.isin("VOID", "BIGINT", "DOUBLE") | F.startswith(f_kind, F.lit("DECIMAL")))
        size = F.octet_length(F.try_to_binary(vec, F.lit("base64")))
        bad = bad | ~_json_kind(p, "$.vector").eqNullSafe("STRING") | size.isNull() | (size != 4 * dim)
        hexes = F.hex(F.try_to_binary(vec, F.lit("base64")))
        # little-endian float32 is NaN or infinite when its exponent is all ones
        special = F.exists(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.conv(F.substring(hexes, i * 8 + 7, F.lit(2)), 16, 10).cast("int") % 128 == 127) & (F.conv(F.substring(hexes, i * 8 + 5, F.lit(2)), 16, 10).cast("int") >= 128))
        t_kind = _json_kind(p, "$.metadata.takenAt")
        t_bad = ~(t_kind.isNull() | (t_kind == "VOID")) & ((t_kind != "STRING") | F.try_to_timestamp(taken).isNull())
        return F.coalesce(bad | special | t_bad, F.lit(True))

    return (
        F.when(raw.isNull(), "not JSON")
        .when(~F.startswith(F.schema_of_variant(raw), F.lit("OBJECT")), "not an object")
        .when(~(_whole(at("$.v")) & (F.try_variant_get(raw, "$.v", "long") == 1)).eqNullSafe(True), "unknown version")
        .when(~_whole(at("$.galleryId")).eqNullSafe(True), "galleryId")
        .when(~((at("$.embeddingModel") == "STRING") & (model != "") & (F.length(model) <= 60)).eqNullSafe(True), "embeddingModel")
        .when(~F.startswith(at("$.photos"), F.lit("ARRAY")).eqNullSafe(True) | photos.isNull(), "photos")
        .when(F.exists(photos, photo_bad), "photo")
    )


def message_rows(messages: DataFrame, body: str = "body") -> DataFrame:
    """One row for each photo of valid messages; an offset of takenAt is dropped, not converted."""
    m = messages.withColumn("_m", F.from_json(body, MESSAGE)).select("*", F.explode("_m.photos").alias("_p"))
    wall = F.regexp_replace("_p.metadata.takenAt", r"(Z|[+-]\d{2}:?\d{2})$", "")
    return m.select(
        *messages.columns,
        F.col("_p.photoId").alias("photo_id"),
        F.col("_p.storageKey").alias("storage_key"),
        F.col("_p.previewKey").alias("preview_key"),
        F.col("_p.vector").alias("vector"),
        F.col("_m.embeddingModel").alias("embedding_model"),
        wall.try_cast("timestamp_ntz").alias("taken_at"),
        F.col("_p.metadata.cameraMake").alias("camera_make"),
        F.col("_p.metadata.cameraModel").alias("camera_model"),
        F.col("_p.metadata.exposureTime").alias("exposure_time"),
        F.col("_p.metadata.fNumber").alias("f_number"),
        F.col("_p.metadata.iso").alias("iso"),
        F.col("_p.metadata.width").alias("width"),
        F.col("_p.metadata.height").alias("height"),
        F.col("_p.metadata.byteSize").alias("byte_size"),
    )


def verified_events(events: DataFrame, jobs: DataFrame, photos: DataFrame, galleries: DataFrame, revisions: DataFrame) -> DataFrame:
    """Admin events whose job, live photo, live gallery and revision all agree, the job's payload included."""
    j = jobs.select("job_id", "attempt_count", "job_type", F.col("target_id").alias("photo_id"), "revision_id", "payload")
    ok = events.join(j, ["job_id", "attempt_count", "job_type", "photo_id", "revision_id"])
    ok = ok.filter((F.get_json_object("payload", "$.storageKey") == F.col("storage_key")) & (F.get_json_object("payload", "$.galleryId").try_cast("long") == F.col("gallery_id")))
    ok = ok.join(photos.filter("deleted_at is null").select("photo_id", "gallery_id", "storage_key"), ["photo_id", "gallery_id", "storage_key"], "left_semi")
    ok = ok.join(galleries.filter("deleted_at is null").select("gallery_id"), "gallery_id", "left_semi")
    return ok.join(revisions.select("revision_id", "photo_id", "storage_key"), ["revision_id", "photo_id", "storage_key"], "left_semi").select(events.columns)


def staged(fast: DataFrame, quality: DataFrame, n: int) -> DataFrame:
    """The next n photos over two stages, the fast one first."""
    both = fast.withColumn("stage", F.lit(0)).unionByName(quality.withColumn("stage", F.lit(1)))
    return both.orderBy("stage", "photo_id").limit(n)


def with_faults(df: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    """For tests: the rows that survive a fault at this rate."""
    return df.filter(F.rand(seed) >= rate)
