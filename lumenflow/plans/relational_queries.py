"""Scans, joins, merges, set operations and aggregates over the adapter tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenflow.operators import aggregate, merge, scan
from lumenflow.operators.windows import set_percentiles
from lumenflow.plans.catalog import query
from lumenflow.sources.adapter import PHOTOS_SQL, VECTORS_SQL, photos, read, with_vectors


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Photo, gallery and analysis tables in the shape of the operators, derived from the adapter view."""
    p = photos(spark, sf_dir)
    return {
        "photos": p.select(
            "photo_id", "gallery_id", "display_order", "camera", "taken_at", "user_id",
            F.when(F.col("photo_id") % 13 == 0, F.col("taken_at")).alias("deleted_at"),
            F.when(F.col("photo_id") % 17 != 0, F.concat(F.lit("previews/p"), F.col("photo_id").cast("string"), F.lit(".jpg"))).alias("preview_key"),
            F.concat(F.lit("originals/p"), F.col("photo_id").cast("string"), F.lit(".raw.jpg")).alias("storage_key"),
            F.when(F.col("photo_id") % 19 == 0, "PENDING").otherwise("UPLOADED").alias("status"),
            F.when(F.col("user_id") % 4 != 0, F.concat(F.lit(" Make"), (F.col("user_id") % 3).cast("string"))).alias("camera_make"),
            F.when(F.col("user_id") % 7 != 0, F.concat(F.lit("M"), (F.col("user_id") % 5).cast("string"), F.lit(" "))).alias("camera_model"),
            (F.col("photo_id") % 5).alias("version"),
        ),
        "galleries": p.select("gallery_id").distinct().withColumn("deleted_at", F.when(F.col("gallery_id") % 10 == 0, F.lit("2024-02-01").cast("timestamp_ntz"))),
        "analysis": p.filter("photo_id % 4 <> 0").select(
            "photo_id",
            (F.col("photo_id") % 3 != 0).alias("has_embedding"),
            (F.col("photo_id") % 9 == 1).alias("has_clip"),
            F.when(F.col("photo_id") % 23 == 0, "DECODE_FAILED").alias("error"),
            F.when(F.col("gallery_id") % 6 == 0, F.concat(F.lit("m"), (F.col("photo_id") % 2).cast("string"))).otherwise("m0").alias("embedding_model"),
            F.concat(F.lit("v"), (F.col("photo_id") % 2).cast("string")).alias("pipeline_version"),
            F.when(F.col("photo_id") % 5 == 1, F.col("taken_at")).alias("quality_scored_at"),
            F.when(F.col("photo_id") % 10 == 7, F.col("taken_at")).alias("claimed_at"),
            F.col("props").alias("sub_scores"),
        ),
    }


TABLES_SQL = f"""WITH {PHOTOS_SQL},
ph AS (SELECT photo_id, gallery_id, display_order, camera, taken_at, user_id, CASE WHEN photo_id % 13 = 0 THEN taken_at END AS deleted_at,
  CASE WHEN photo_id % 17 <> 0 THEN 'previews/p' || photo_id || '.jpg' END AS preview_key, 'originals/p' || photo_id || '.raw.jpg' AS storage_key,
  CASE WHEN photo_id % 19 = 0 THEN 'PENDING' ELSE 'UPLOADED' END AS status, CASE WHEN user_id % 4 <> 0 THEN ' Make' || (user_id % 3) END AS camera_make,
  CASE WHEN user_id % 7 <> 0 THEN 'M' || (user_id % 5) || ' ' END AS camera_model, photo_id % 5 AS version FROM photos),
ga AS (SELECT DISTINCT gallery_id, CASE WHEN gallery_id % 10 = 0 THEN TIMESTAMP '2024-02-01' END AS deleted_at FROM photos),
an AS (SELECT photo_id, photo_id % 3 <> 0 AS has_embedding, photo_id % 9 = 1 AS has_clip, CASE WHEN photo_id % 23 = 0 THEN 'DECODE_FAILED' END AS error,
  CASE WHEN gallery_id % 6 = 0 THEN 'm' || (photo_id % 2) ELSE 'm0' END AS embedding_model, 'v' || (photo_id % 2) AS pipeline_version,
  CASE WHEN photo_id % 5 = 1 THEN taken_at END AS quality_scored_at, CASE WHEN photo_id % 10 = 7 THEN taken_at END AS claimed_at, props AS sub_scores FROM photos WHERE photo_id % 4 <> 0),
live AS (SELECT ph.* FROM ph JOIN ga USING (gallery_id) WHERE ph.deleted_at IS NULL AND ga.deleted_at IS NULL)
"""


@query("a1_gallery_scan", TABLES_SQL + "SELECT an.photo_id, gallery_id, display_order, camera, embedding_model FROM an JOIN ph USING (photo_id) WHERE deleted_at IS NULL")
def a1(spark, sf):
    t = tables(spark, sf)
    return scan.gallery_scan(t["photos"], t["analysis"]).select("photo_id", "gallery_id", "display_order", "camera", "embedding_model")


@query("a2_mixed_models", TABLES_SQL + "SELECT gallery_id, string_agg(DISTINCT embedding_model, ',' ORDER BY embedding_model) AS models FROM an JOIN ph USING (photo_id) GROUP BY 1 HAVING count(DISTINCT embedding_model) > 1")
def a2(spark, sf):
    t = tables(spark, sf)
    return scan.mixed_models(t["analysis"].join(t["photos"], "photo_id")).withColumn("models", F.array_join("models", ","))


@query("a3_photo_listing", TABLES_SQL + "SELECT photo_id, nullif(trim(trim(coalesce(camera_make, '')) || ' ' || trim(coalesce(camera_model, ''))), '') AS camera FROM ph WHERE gallery_id = 3 AND deleted_at IS NULL AND preview_key IS NOT NULL ORDER BY display_order, photo_id LIMIT 100")
def a3(spark, sf):
    return scan.photo_listing(tables(spark, sf)["photos"], 3, 100).select("photo_id", "camera")


@query("a4_fetch_by_ids", TABLES_SQL + ", ids AS (SELECT unnest([90, 3, 77, 99999999, 12]) AS photo_id, generate_subscripts([90, 3, 77, 99999999, 12], 1) - 1 AS pos) SELECT CAST(pos AS INTEGER) AS pos, photo_id, storage_key FROM ids JOIN live USING (photo_id)")
def a4(spark, sf):
    t = tables(spark, sf)
    return scan.by_ids(scan.live(t["photos"], t["galleries"]), scan.request(spark, [90, 3, 77, 99999999, 12])).select("pos", "photo_id", "storage_key")


@query("a5_pending_targets", TABLES_SQL + "SELECT photo_id, gallery_id, storage_key FROM live WHERE status <> 'PENDING' AND NOT EXISTS (SELECT 1 FROM an WHERE an.photo_id = live.photo_id AND has_embedding)")
def a5(spark, sf):
    t = tables(spark, sf)
    return scan.pending_targets(t["photos"], t["galleries"], t["analysis"].filter("has_embedding")).select("photo_id", "gallery_id", "storage_key")


@query("a6_resume_todo", TABLES_SQL + "SELECT photo_id FROM live WHERE photo_id NOT IN (SELECT photo_id FROM an WHERE pipeline_version = 'v1' AND has_clip)")
def a6(spark, sf):
    t = tables(spark, sf)
    return scan.resume_todo(scan.live(t["photos"], t["galleries"]).select("photo_id"), t["analysis"], t["analysis"].filter("has_clip"), "v1")


@query("a7_claim_batch", TABLES_SQL + "SELECT photo_id FROM an WHERE has_embedding AND NOT has_clip AND error IS NULL AND photo_id IN (SELECT photo_id FROM live) AND photo_id % 50 <> 2 ORDER BY photo_id LIMIT 64")
def a7(spark, sf):
    t = tables(spark, sf)
    poison = t["photos"].filter("photo_id % 50 = 2")
    return scan.claim_batch(t["analysis"], scan.live(t["photos"], t["galleries"]), poison, 64).select("photo_id")


@query("a8_lease_claim", TABLES_SQL + "SELECT photo_id, TIMESTAMP '2024-01-10 00:00:00' AS claimed_at FROM an WHERE has_clip AND quality_scored_at IS NULL AND error IS NULL AND (claimed_at IS NULL OR claimed_at < TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 600 SECOND) AND photo_id % 50 <> 2 ORDER BY photo_id LIMIT 64")
def a8(spark, sf):
    t = tables(spark, sf)
    now = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    return scan.lease_claims(t["analysis"], t["photos"].filter("photo_id % 50 = 2"), now, 600, 64).select("photo_id", "claimed_at")


@query("n6_staged_claims", TABLES_SQL + "SELECT photo_id, stage FROM (SELECT photo_id, 0 AS stage FROM an WHERE photo_id % 100 = 1 UNION ALL SELECT photo_id, 1 FROM an WHERE photo_id % 9 = 2) ORDER BY stage, photo_id LIMIT 40")
def n6(spark, sf):
    a = tables(spark, sf)["analysis"].select("photo_id")
    return scan.staged(a.filter("photo_id % 100 = 1"), a.filter("photo_id % 9 = 2"), 40)


@query("a20_document_search", "SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'license') AND (lang = 'en' OR n_chars > 3000)")
def a20(spark, sf):
    from lumenflow.sources.files import predicate, search

    d = search(read(spark, sf, "documents"), "text", "License")
    return d.filter(predicate({"or": [{"property": "lang", "select": {"equals": "en"}}, {"property": "n_chars", "number": {"greater_than": 3000}}]})).select("doc_id", "lang")


@query("a22_inventory", "SELECT CASE WHEN page_id % 3 = 0 THEN 'database' ELSE 'page' END AS kind, page_id AS id FROM pages WHERE page_id % 3 = 0 OR page_id % 4 <> 1")
def a22(spark, sf):
    from lumenflow.sources.files import inventory

    p = read(spark, sf, "pages").select(F.when(F.col("page_id") % 3 == 0, "database").otherwise("page").alias("object"), F.when(F.col("page_id") % 4 == 1, "database_id").alias("parent_type"), F.col("page_id").alias("id"), F.col("url").alias("title"))
    return inventory(p).select("kind", "id")


@query("b1_live_photos", TABLES_SQL + "SELECT photo_id, gallery_id FROM live WHERE preview_key IS NOT NULL")
def b1(spark, sf):
    t = tables(spark, sf)
    return scan.live(t["photos"], t["galleries"], preview=True).select("photo_id", "gallery_id")


@query("b2_quality_scored", TABLES_SQL + "SELECT photo_id, quality_scored_at IS NOT NULL OR json_extract_string(sub_scores, '$.technical_score') IS NOT NULL AS scored FROM an")
def b2(spark, sf):
    return tables(spark, sf)["analysis"].select("photo_id", scan.quality_scored("quality_scored_at", "sub_scores").alias("scored"))


@query("b4_b5_eligible", f"WITH {PHOTOS_SQL}, v AS (SELECT photo_id, gallery_id, CASE WHEN gallery_id % 3 <> 0 AND photo_id % 7 <> 0 THEN 1 END AS e, CASE WHEN photo_id % 11 <> 0 THEN 2 END AS c FROM photos), w AS (SELECT *, max(e) OVER (PARTITION BY gallery_id) IS NOT NULL AS has_e FROM v) SELECT photo_id, CASE WHEN has_e THEN 'embedding' ELSE 'clip' END AS source, CASE WHEN has_e THEN e ELSE c END AS e FROM w WHERE c IS NOT NULL AND (CASE WHEN has_e THEN e ELSE c END) IS NOT NULL")
def b45(spark, sf):
    p = photos(spark, sf)
    v = p.select("photo_id", F.when((F.col("gallery_id") % 3 != 0) & (F.col("photo_id") % 7 != 0), 1).alias("e"), F.when(F.col("photo_id") % 11 != 0, 2).alias("c"))
    return scan.eligible(p.select("photo_id", "gallery_id"), p.select("photo_id"), v).select("photo_id", "source", "e")


@query("b6_b7_keys", TABLES_SQL + r"SELECT photo_id, nullif(trim(trim(coalesce(camera_make, '')) || ' ' || trim(coalesce(camera_model, ''))), '') AS camera, 'previews/' || regexp_replace(storage_key, '\.[^./]*$', '') || '.jpg' AS preview FROM ph")
def b67(spark, sf):
    return tables(spark, sf)["photos"].select("photo_id", scan.camera_name("camera_make", "camera_model").alias("camera"), scan.preview_key("storage_key").alias("preview"))


@query("b10_routes", f"""WITH {PHOTOS_SQL}, m AS (SELECT photo_id, photo_id % 6 AS k FROM photos)
SELECT photo_id, CASE k WHEN 0 THEN 'admin' WHEN 1 THEN 'full' WHEN 2 THEN 'rank' WHEN 3 THEN 'error: unknown mode' WHEN 4 THEN 'error: no gallery' ELSE 'full' END AS route FROM m""")
def b10(spark, sf):
    bodies = ['{"jobId":1,"jobType":"EMBEDDING"}', '{"galleryId":5}', '{"galleryId":5,"mode":"rank"}', '{"galleryId":5,"mode":"x"}', "{}", '{"galleryId":5,"mode":"full"}']
    p = photos(spark, sf).withColumn("body", F.element_at(F.array(*map(F.lit, bodies)), (F.col("photo_id") % 6 + 1).cast("int")))
    return p.select("photo_id", scan.route("body").alias("route"))


@query("b12_failure_code", f"WITH {PHOTOS_SQL} SELECT photo_id, substr(upper(regexp_replace(props || camera || ' #', '[^A-Za-z0-9_.-]', '_', 'g')), 1, 80) AS code FROM photos")
def b12(spark, sf):
    return photos(spark, sf).select("photo_id", scan.failure_code(F.concat("props", "camera", F.lit(" #"))).alias("code"))


@query("b13_b15_clean_values", f"WITH {PHOTOS_SQL} SELECT photo_id, CASE WHEN photo_id % 5 > 1 THEN technical_score END AS clean, greatest(0.0, least(1.0, coalesce(technical_score, 0) / 100)) AS confidence FROM photos")
def b1315(spark, sf):
    nan = F.when(F.col("photo_id") % 5 == 0, F.lit(float("nan"))).when(F.col("photo_id") % 5 == 1, F.lit(float("inf"))).otherwise(F.col("technical_score"))
    m = scan.clean_map(F.create_map(F.lit("t"), nan))
    return photos(spark, sf).select("photo_id", F.element_at(m, "t").alias("clean"), scan.clamp(F.coalesce("technical_score", F.lit(0.0)) / 100).alias("confidence"))


@query("b14_renamed_keys", f"WITH {PHOTOS_SQL} SELECT photo_id, coalesce(CASE WHEN photo_id % 3 = 0 THEN camera END, subject) AS label FROM photos")
def b14(spark, sf):
    p = photos(spark, sf).select("photo_id", F.when(F.col("photo_id") % 3 == 0, F.col("camera")).alias("label"), F.col("subject").alias("old_label"))
    return scan.renamed_keys(p, {"old_label": "label"}).select("photo_id", "label")


@query("c3_c6_semi_anti", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) AND EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey <> 2)")
def c36(spark, sf):
    r = lambda n: read(spark, sf, n)
    nations = r("nation").filter("n_regionkey <> 2").select(F.col("n_nationkey").alias("c_nationkey"))
    return r("customer").join(r("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").join(nations, "c_nationkey", "left_semi").select("c_custkey", "c_mktsegment")


NEW_SQL = TABLES_SQL + ", nw AS (SELECT photo_id, CASE WHEN photo_id % 10 = 0 THEN 'stale' ELSE storage_key END AS storage_key, CASE WHEN photo_id % 4 = 0 THEN NULL ELSE 'Canon' END AS camera_make, 'new/' || photo_id AS preview_key FROM ph WHERE photo_id % 3 = 0)\n"


def _new(t):
    return t["photos"].filter("photo_id % 3 = 0").select("photo_id", F.when(F.col("photo_id") % 10 == 0, "stale").otherwise(F.col("storage_key")).alias("storage_key"), F.when(F.col("photo_id") % 4 != 0, "Canon").alias("camera_make"), F.concat(F.lit("new/"), F.col("photo_id").cast("string")).alias("preview_key"))


@query("c7_accepted_results", NEW_SQL + "SELECT nw.photo_id, nw.storage_key FROM nw JOIN live USING (photo_id, storage_key)")
def c7(spark, sf):
    t = tables(spark, sf)
    return merge.accepted(_new(t), t["photos"], t["galleries"]).select("photo_id", "storage_key")


@query("c8_verified_events", TABLES_SQL + "SELECT photo_id AS job_id, photo_id FROM live WHERE photo_id % 4 <> 0 AND photo_id % 6 <> 0 AND photo_id % 5 <> 0")
def c8(spark, sf):
    t = tables(spark, sf)
    p = t["photos"]
    base = p.select(F.col("photo_id").alias("job_id"), "photo_id", "gallery_id", "storage_key", (F.col("photo_id") % 3).alias("attempt_count"), F.lit("EMBEDDING").alias("job_type"), (F.col("photo_id") + 1).alias("revision_id"))
    payload = F.to_json(F.struct(F.col("storage_key").alias("storageKey"), F.when(F.col("photo_id") % 5 == 0, -1).otherwise(F.col("gallery_id")).alias("galleryId")))
    jobs = base.select("job_id", F.when(F.col("photo_id") % 4 == 0, 9).otherwise(F.col("attempt_count")).alias("attempt_count"), "job_type", F.col("photo_id").alias("target_id"), "revision_id", payload.alias("payload"))
    revisions = base.filter("photo_id % 6 <> 0").select("revision_id", "photo_id", "storage_key")
    return scan.verified_events(base, jobs, p, t["galleries"], revisions).select("job_id", "photo_id")


@query("c9_selected_items", f"WITH {PHOTOS_SQL}, i AS (SELECT user_id AS selection_id, photo_id, CASE WHEN photo_id % 2 = 0 THEN 'MANUAL' ELSE 'AUTO' END AS source FROM photos WHERE selected), s AS (SELECT DISTINCT user_id AS selection_id FROM photos WHERE user_id % 5 <> 0) SELECT selection_id, photo_id FROM i JOIN s USING (selection_id) WHERE source = 'MANUAL'")
def c9(spark, sf):
    p = photos(spark, sf)
    items = p.filter("selected").select(F.col("user_id").alias("selection_id"), "photo_id", F.when(F.col("photo_id") % 2 == 0, "MANUAL").otherwise("AUTO").alias("source"))
    selections = p.filter("user_id % 5 <> 0").select(F.col("user_id").alias("selection_id")).distinct()
    joined = items.join(selections, "selection_id")
    return (joined.filter("source = 'MANUAL'") if "source" in items.columns else joined).select("selection_id", "photo_id")


@query("c10_golden_ids", f"WITH {PHOTOS_SQL}, f AS (SELECT 'IMG_' || (photo_id % 500) AS file, max(photo_id) AS photo_id FROM photos GROUP BY 1), g AS (SELECT unnest(['IMG_3', 'IMG_499', 'IMG_x']) AS file) SELECT file, photo_id FROM g LEFT JOIN f USING (file)")
def c10(spark, sf):
    from lumenflow.sources.files import golden_ids

    p = photos(spark, sf).withColumn("original_file_name", F.concat(F.lit("IMG_"), (F.col("photo_id") % 500).cast("string")))
    hit, missing = golden_ids(p, spark.range(1).select(F.explode(F.array(F.lit("IMG_3"), F.lit("IMG_499"), F.lit("IMG_x"))).alias("file")))
    return hit.unionByName(missing.withColumn("photo_id", F.lit(None).cast("long")))


@query("d1_vector_upsert", TABLES_SQL + ", t AS (SELECT photo_id, 'e' || photo_id AS embedding, 'm0' AS embedding_model, version, camera FROM ph WHERE photo_id % 2 = 0), n AS (SELECT photo_id, 'n' || photo_id AS embedding, 'm1' AS embedding_model FROM ph WHERE photo_id % 3 = 0) SELECT coalesce(t.photo_id, n.photo_id) AS photo_id, coalesce(n.embedding, t.embedding) AS embedding, coalesce(n.embedding_model, t.embedding_model) AS embedding_model, CASE WHEN t.photo_id IS NULL THEN 0 WHEN n.photo_id IS NOT NULL THEN t.version + 1 ELSE t.version END AS version, camera FROM t FULL JOIN n ON t.photo_id = n.photo_id")
def d1(spark, sf):
    p = tables(spark, sf)["photos"]
    s = F.col("photo_id").cast("string")
    t = p.filter("photo_id % 2 = 0").select("photo_id", F.concat(F.lit("e"), s).alias("embedding"), F.lit("m0").alias("embedding_model"), "version", "camera")
    n = p.filter("photo_id % 3 = 0").select("photo_id", F.concat(F.lit("n"), s).alias("embedding"), F.lit("m1").alias("embedding_model"))
    return merge.vector_upsert(t, n)


@query("d2_photo_update", NEW_SQL + "SELECT ph.photo_id, coalesce(nw.camera_make, ph.camera_make) AS camera_make, CASE WHEN nw.photo_id IS NOT NULL THEN nw.preview_key ELSE ph.preview_key END AS preview_key, ph.version + CASE WHEN nw.photo_id IS NOT NULL THEN 1 ELSE 0 END AS version FROM ph LEFT JOIN nw ON nw.photo_id = ph.photo_id AND nw.storage_key = ph.storage_key")
def d2(spark, sf):
    t = tables(spark, sf)
    return merge.photo_update(t["photos"], _new(t), ["camera_make"], ["preview_key"]).select("photo_id", "camera_make", "preview_key", "version")


@query("d3_last_wins", f"WITH {PHOTOS_SQL} SELECT user_id, max(photo_id) AS photo_id, arg_max(camera, photo_id) AS camera FROM photos GROUP BY 1")
def d3(spark, sf):
    return merge.last_wins(photos(spark, sf).select("user_id", "photo_id", "camera"), "user_id", "photo_id")


@query("d4_score_merge", f"WITH {PHOTOS_SQL} SELECT photo_id, CASE WHEN photo_id % 2 = 0 THEN 2.0 ELSE 1.0 END AS a, CASE WHEN photo_id % 2 = 0 THEN 5.0 END AS b, 3.0 AS c FROM photos")
def d4(spark, sf):
    old = F.create_map(F.lit("a"), F.lit(1.0), F.lit("c"), F.lit(3.0))
    new = F.when(F.col("photo_id") % 2 == 0, F.create_map(F.lit("a"), F.lit(2.0), F.lit("b"), F.lit(5.0)))
    m = photos(spark, sf).withColumn("m", merge.merged_maps(old, new))
    return m.select("photo_id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in "abc"])


@query("d5_quality_patches", f"WITH {PHOTOS_SQL} SELECT photo_id, CASE WHEN photo_id % 3 = 0 AND photo_id % 5 <> 0 THEN 9.0 ELSE 1.0 END AS a FROM photos WHERE photo_id % 7 <> 0")
def d5(spark, sf):
    p = photos(spark, sf)
    table = p.filter("photo_id % 7 <> 0").select("photo_id", F.create_map(F.lit("a"), F.lit(1.0)).alias("sub_scores"))
    patches = p.filter("photo_id % 3 = 0").select("photo_id", F.create_map(F.lit("a"), F.lit(9.0)).alias("sub_scores"))
    out, _ = merge.quality_patches(table, patches, p.filter("photo_id % 5 = 0"))
    return out.select("photo_id", F.element_at("sub_scores", "a").alias("a"))


@query("d5_unwritten", f"WITH {PHOTOS_SQL} SELECT photo_id FROM photos WHERE photo_id % 3 = 0 AND (photo_id % 5 = 0 OR photo_id % 7 = 0)")
def d5_unwritten(spark, sf):
    p = photos(spark, sf)
    table = p.filter("photo_id % 7 <> 0").select("photo_id", F.create_map(F.lit("a"), F.lit(1.0)).alias("sub_scores"))
    patches = p.filter("photo_id % 3 = 0").select("photo_id", F.create_map(F.lit("a"), F.lit(9.0)).alias("sub_scores"))
    return merge.quality_patches(table, patches, p.filter("photo_id % 5 = 0"))[1]


@query("d10_d12_failed_jobs", f"WITH {PHOTOS_SQL} SELECT photo_id AS job_id, CASE WHEN photo_id % 2 = 0 AND photo_id % 3 <> 0 THEN 'FAILED' ELSE 'RUNNING' END AS status, CASE WHEN photo_id % 2 = 0 AND photo_id % 3 <> 0 THEN 'boom' END AS error FROM photos")
def d1012(spark, sf):
    p = photos(spark, sf)
    jobs = p.select(F.col("photo_id").alias("job_id"), F.lit(2).alias("attempt_count"), F.lit("RUNNING").alias("status"), F.lit(None).cast("string").alias("error"))
    failures = p.filter("photo_id % 2 = 0").select(F.col("photo_id").alias("job_id"), F.when(F.col("photo_id") % 3 == 0, 1).otherwise(2).alias("attempt_count"), F.lit("boom").alias("error"))
    return merge.failed_jobs(jobs, failures).select("job_id", "status", "error")


@query("d6_group_patch", f"WITH {PHOTOS_SQL} SELECT photo_id, CASE WHEN photo_id % 2 = 0 THEN 7.0 END AS sharpness_pct, 1.0 AS technical_score FROM photos")
def d6(spark, sf):
    old = F.create_map(F.lit("technical_score"), F.lit(1.0), F.lit("sharpness_pct"), F.lit(2.0))
    patch = F.when(F.col("photo_id") % 2 == 0, F.create_map(F.lit("sharpness_pct"), F.lit(7.0)))
    m = photos(spark, sf).withColumn("m", merge.group_patch(old, patch))
    return m.select("photo_id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("sharpness_pct", "technical_score")])


@query("d7_rank_update", f"WITH {PHOTOS_SQL} SELECT photo_id, CASE WHEN photo_id % 3 = 0 AND photo_id % 4 <> 0 THEN photo_id % 7 ELSE -1 END AS burst_rank FROM photos")
def d7(spark, sf):
    p = photos(spark, sf)
    t = p.select("photo_id", F.when(F.col("photo_id") % 4 != 0, F.lit(1)).alias("embed_group_id"), F.lit(-1).cast("long").alias("burst_rank"))
    return merge.rank_update(t, p.filter("photo_id % 3 = 0").select("photo_id", (F.col("photo_id") % 7).alias("burst_rank"))).select("photo_id", "burst_rank")


@query("d8_assignment_upsert", f"WITH {PHOTOS_SQL}, t AS (SELECT DISTINCT gallery_id AS job_id, burst_id % 9 AS embed_group_id, 'old' AS concept FROM photos), n AS (SELECT DISTINCT gallery_id AS job_id, burst_id % 20 AS embed_group_id, 'new' AS concept FROM photos WHERE gallery_id % 2 = 0) SELECT * FROM n UNION ALL SELECT t.* FROM t WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.job_id = t.job_id AND n.embed_group_id = t.embed_group_id)")
def d8(spark, sf):
    p = photos(spark, sf)
    t = p.select(F.col("gallery_id").alias("job_id"), (F.col("burst_id") % 9).alias("embed_group_id"), F.lit("old").alias("concept")).distinct()
    n = p.select(F.when(F.col("gallery_id") % 2 == 0, F.col("gallery_id")).alias("job_id"), (F.col("burst_id") % 20).alias("embed_group_id"), F.lit("new").alias("concept")).distinct()
    return merge.keyed_upsert(t, n, ["job_id", "embed_group_id"])


@query("d9_error_rows", f"WITH {PHOTOS_SQL} SELECT photo_id, substr(repeat(camera || '-', 30), 1, 80) AS error FROM photos WHERE photo_id % 5 <> 0")
def d9(spark, sf):
    p = photos(spark, sf)
    bad = F.when(F.col("photo_id") % 5 == 0, F.concat(F.lit("x"), F.col("photo_id").cast("string"))).otherwise(F.col("photo_id").cast("string"))
    return merge.error_rows(p.select(bad.alias("photo_id"), F.repeat(F.concat("camera", F.lit("-")), 30).alias("error")))


@query("d11_admin_outcome", TABLES_SQL + ", ev AS (SELECT photo_id AS job_id, photo_id, CASE WHEN photo_id % 6 = 0 THEN 'old' ELSE storage_key END AS storage_key, photo_id % 4 AS attempt_count FROM ph) SELECT ev.job_id, CASE WHEN p.photo_id IS NULL THEN 'PHOTO_REVISION_MISMATCH' WHEN ev.attempt_count = 3 THEN 'JOB_ATTEMPT_MISMATCH' ELSE 'ok' END AS outcome FROM ev LEFT JOIN ph p ON p.photo_id = ev.photo_id AND p.storage_key = ev.storage_key AND p.deleted_at IS NULL")
def d11(spark, sf):
    t = tables(spark, sf)
    p = t["photos"]
    events = p.select(F.col("photo_id").alias("job_id"), "photo_id", F.when(F.col("photo_id") % 6 == 0, "old").otherwise(F.col("storage_key")).alias("storage_key"), (F.col("photo_id") % 4).alias("attempt_count"))
    jobs = p.select(F.col("photo_id").alias("job_id"), F.when(F.col("photo_id") % 4 == 3, 9).otherwise(F.col("photo_id") % 4).alias("attempt_count"))
    return merge.admin_outcome(events, p, jobs).select("job_id", "outcome")


@query("d13_one_active", "SELECT s_suppkey AS id, s_suppkey = (SELECT max(s_suppkey) FROM supplier) AS active FROM supplier")
def d13(spark, sf):
    return merge.one_active(read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")))


@query("e1_gallery_sizes", f"WITH {PHOTOS_SQL} SELECT gallery_id, count(*) AS n FROM photos GROUP BY 1")
def e1(spark, sf):
    return aggregate.gallery_sizes(photos(spark, sf))


@query("e2_burst_sizes", f"WITH {PHOTOS_SQL}, b AS (SELECT photo_id, gallery_id, CASE WHEN photo_id % 29 = 0 THEN -1 ELSE burst_id END AS b FROM photos) SELECT photo_id, CASE WHEN b >= 0 THEN count(*) OVER (PARTITION BY gallery_id, b) ELSE 1 END AS size FROM b")
def e2(spark, sf):
    p = photos(spark, sf).withColumn("b", F.when(F.col("photo_id") % 29 == 0, -1).otherwise(F.col("burst_id")))
    return p.select("photo_id", aggregate.sizes("b").cast("long").alias("size"))


@query("e3_group_profile", f"WITH {PHOTOS_SQL}, g AS (SELECT gallery_id, user_id % 40 AS l, count(*) AS n FROM photos GROUP BY 1, 2) SELECT gallery_id, count(*) AS groups, max(n) AS max_size, max(n) / sum(n) AS max_share, count(*) FILTER (n = 1) AS singletons FROM g GROUP BY 1")
def e3(spark, sf):
    return aggregate.group_profile(photos(spark, sf).withColumn("l", F.col("user_id") % 40), "l")


@query("e4_similarity_profile", f"WITH {PHOTOS_SQL}, {VECTORS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY gallery_id ORDER BY display_order, photo_id) AS rn FROM pv), c AS (SELECT a.gallery_id, list_dot_product(a.embedding, b.embedding) / sqrt(list_dot_product(a.embedding, a.embedding)) / sqrt(list_dot_product(b.embedding, b.embedding)) AS cosine FROM o a JOIN o b ON a.gallery_id = b.gallery_id AND b.rn > a.rn AND b.rn - a.rn <= 8) SELECT gallery_id, count(*) AS n, round(quantile_cont(cosine, 0.1), 6) AS p10, round(quantile_cont(cosine, 0.5), 6) AS p50, round(quantile_cont(cosine, 0.99), 6) AS p99 FROM c GROUP BY 1")
def e4(spark, sf):
    pairs = aggregate.window_pairs(with_vectors(photos(spark, sf), spark, sf), ["display_order"], "embedding")
    return aggregate.similarity_profile(pairs).select("gallery_id", "n", *[F.round(c, 6).alias(c) for c in ("p10", "p50", "p99")])


@query("e5_e7_centroids", f"WITH {PHOTOS_SQL}, {VECTORS_SQL}, u AS (SELECT gallery_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM pv), m AS (SELECT gallery_id, i, avg(x) AS x FROM u GROUP BY 1, 2) SELECT gallery_id, count(*) AS dims, round(sqrt(sum(x * x)), 6) AS length, round(sum(x * i), 6) AS checksum FROM m GROUP BY 1")
def e57(spark, sf):
    from lumenflow.functions.vectors import centroids, norm

    c = centroids(with_vectors(photos(spark, sf), spark, sf), ["gallery_id"], "embedding")
    check = F.aggregate(F.transform("centroid", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return c.select("gallery_id", F.size("centroid").cast("long").alias("dims"), F.round(norm("centroid"), 6).alias("length"), F.round(check, 6).alias("checksum"))


@query("e6_representatives", f"""WITH {PHOTOS_SQL}, {VECTORS_SQL}, u AS (SELECT gallery_id, user_id % 6 AS g, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM pv), m AS (SELECT gallery_id, g, i, avg(x) AS x FROM u GROUP BY ALL),
c AS (SELECT gallery_id, g, list(x ORDER BY i) AS v FROM m GROUP BY ALL), s AS (SELECT c.gallery_id, c.g, photo_id, round(list_dot_product(embedding, v) / sqrt(list_dot_product(v, v)), 9) AS sim FROM pv JOIN c ON c.gallery_id = pv.gallery_id AND c.g = pv.user_id % 6),
r AS (SELECT *, row_number() OVER (PARTITION BY gallery_id, g ORDER BY sim DESC, photo_id) AS hi, row_number() OVER (PARTITION BY gallery_id, g ORDER BY sim, photo_id) AS lo FROM s)
SELECT gallery_id, g, max(CASE WHEN hi = 1 THEN photo_id END) AS nearest, max(CASE WHEN lo = 1 THEN photo_id END) AS farthest, round(avg(1 - sim), 6) AS spread FROM r GROUP BY ALL""")
def e6(spark, sf):
    p = with_vectors(photos(spark, sf), spark, sf).withColumn("g", F.col("user_id") % 6)
    return aggregate.representatives(p, ["gallery_id", "g"], "embedding").withColumn("spread", F.round("spread", 6))


@query("e8_major_version", f"WITH {PHOTOS_SQL}, n AS (SELECT gallery_id, event_type AS version, count(*) AS n FROM photos GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY gallery_id ORDER BY n DESC, version) AS r, count(*) OVER (PARTITION BY gallery_id) AS versions FROM n) SELECT gallery_id, version, versions FROM r WHERE r = 1")
def e8(spark, sf):
    return aggregate.version_of(photos(spark, sf), "event_type")


@query("e9_folder_summary", f"WITH {PHOTOS_SQL}, d AS (SELECT gallery_id, camera AS folder, subject AS detail, min(display_order) AS f, count(*) FILTER (photo_id % 3 = 0) AS vlm, count(*) FILTER (photo_id % 3 <> 0) AS nearest FROM photos GROUP BY ALL) SELECT gallery_id, folder, string_agg(detail, ',' ORDER BY f, detail) AS details, CAST(sum(vlm) AS BIGINT) AS vlm, CAST(sum(nearest) AS BIGINT) AS nearest FROM d GROUP BY 1, 2")
def e9(spark, sf):
    p = photos(spark, sf).withColumn("assigned_by", F.when(F.col("photo_id") % 3 == 0, "vlm").otherwise("nearest")).withColumnsRenamed({"camera": "folder", "subject": "detail"})
    return aggregate.folder_summary(p, "folder", "detail")


@query("e10_gallery_flags", f"WITH {PHOTOS_SQL} SELECT gallery_id, bool_and(technical_score IS NOT NULL) AS ranked, count(*) FILTER (technical_score IS NULL) AS pending, max(display_order) AS last FROM photos GROUP BY 1")
def e10(spark, sf):
    return photos(spark, sf).groupBy("gallery_id").agg(F.bool_and(F.col("technical_score").isNotNull()).alias("ranked"), F.count_if(F.col("technical_score").isNull()).alias("pending"), F.max("display_order").alias("last"))


@query("e12_snapshot_metrics", """WITH a AS (SELECT p_partkey AS k, p_retailprice AS x, p_brand AS l FROM part), b AS (SELECT p_partkey AS k, p_retailprice + (p_partkey % 7) * 10 AS x, CASE WHEN p_partkey % 10 = 0 THEN 'other' ELSE p_brand END AS l FROM part),
j AS (SELECT a.x, b.x AS y, a.l = b.l AS same, rank() OVER (ORDER BY a.x) + (count(*) OVER (PARTITION BY a.x) - 1) / 2 AS rx, rank() OVER (ORDER BY b.x) + (count(*) OVER (PARTITION BY b.x) - 1) / 2 AS ry FROM a JOIN b USING (k)),
o AS (SELECT count(*) AS n FROM (SELECT k FROM (SELECT * FROM a ORDER BY x DESC, k LIMIT 50) INTERSECT SELECT k FROM (SELECT * FROM b ORDER BY x DESC, k LIMIT 50)))
SELECT round(corr(rx, ry), 6) AS spearman, round(max(abs(x - y)), 6) AS max_diff, round(avg(abs(x - y)), 6) AS mean_diff, round(avg(CAST(same AS INT)), 6) AS agreement, (SELECT n FROM o) AS top_overlap FROM j""")
def e12(spark, sf):
    a = read(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("x0"), F.col("p_brand").alias("l"))
    b = a.select("k", (F.col("x0") + (F.col("k") % 7) * 10).alias("x0"), F.when(F.col("k") % 10 == 0, "other").otherwise(F.col("l")).alias("l"))
    m = aggregate.snapshot_metrics(a, b, "k", "x0", "l")
    return m.select(*[F.round(c, 6).alias(c) for c in ("spearman", "max_diff", "mean_diff", "agreement")], "top_overlap")


@query("e13_run_differences", f"WITH {PHOTOS_SQL}, a AS (SELECT photo_id, aesthetic_score AS x FROM photos WHERE photo_id % 5 <> 0), b AS (SELECT photo_id, aesthetic_score + CASE WHEN photo_id % 7 = 0 THEN 0.5 ELSE 0 END AS y FROM photos WHERE photo_id % 6 <> 0) SELECT count(*) FILTER (b.photo_id IS NULL) AS only_a, count(*) FILTER (a.photo_id IS NULL) AS only_b, count(*) FILTER (abs(x - y) > 0.1) AS mismatches, max(abs(x - y)) AS max_diff FROM a FULL JOIN b ON a.photo_id = b.photo_id")
def e13(spark, sf):
    p = photos(spark, sf)
    a = p.filter("photo_id % 5 <> 0").select("photo_id", F.col("aesthetic_score").alias("x0"))
    b = p.filter("photo_id % 6 <> 0").select("photo_id", (F.col("aesthetic_score") + F.when(F.col("photo_id") % 7 == 0, 0.5).otherwise(0.0)).alias("x0"))
    return aggregate.run_differences(a, b, "photo_id", "x0", 0.1)


@query("e14_e15_run_totals", "SELECT role, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY 1")
def e1415(spark, sf):
    return read(spark, sf, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).cast("long").alias("chars"), F.count_distinct("conv_id").alias("conversations"))


@query("e16_usage_summary", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, round(avg(value), 6) AS avg, max(CASE WHEN i = n // 2 THEN value END) AS p50, max(value) AS max, round(avg(CAST(value >= 80 AS INT)), 6) AS busy_share FROM r GROUP BY 1")
def e16(spark, sf):
    u = aggregate.usage_summary(read(spark, sf, "events"), "value", "event_type")
    return u.select("event_type", F.round("avg", 6).alias("avg"), "p50", "max", F.round("busy_share", 6).alias("busy_share"))


@query("e17_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, CAST(grouping(l_returnflag) + grouping(l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def e17(spark, sf):
    return read(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), (F.grouping("l_returnflag") + F.grouping("l_linestatus")).cast("long").alias("level"))


@query("g4_top_overlap", "SELECT k FROM (SELECT s_suppkey AS k FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 50) INTERSECT SELECT k FROM (SELECT s_suppkey AS k FROM supplier ORDER BY s_name DESC, s_suppkey LIMIT 50)")
def g4(spark, sf):
    s = read(spark, sf, "supplier").withColumn("k", F.col("s_suppkey"))
    top = lambda c: s.orderBy(F.desc(c), "k").limit(50).select("k")
    return top("s_acctbal").intersect(top("s_name"))


@query("g7_chunks", f"WITH {PHOTOS_SQL} SELECT photo_id, CAST((row_number() OVER (PARTITION BY gallery_id ORDER BY display_order, photo_id) - 1) // 32 AS BIGINT) AS chunk FROM photos")
def g7(spark, sf):
    from lumenflow.operators.windows import chunks

    return photos(spark, sf).select("photo_id", chunks(32).alias("chunk"))


@query("h3_h4_set_differences", "SELECT 'only_customers' AS side, c_nationkey AS nation FROM customer WHERE c_acctbal > 9000 EXCEPT SELECT 'only_customers', s_nationkey FROM supplier WHERE s_acctbal > 5000 UNION ALL SELECT 'all' AS side, n_nationkey FROM nation")
def h34(spark, sf):
    c = read(spark, sf, "customer").filter("c_acctbal > 9000").select(F.lit("only_customers").alias("side"), F.col("c_nationkey").alias("nation"))
    s = read(spark, sf, "supplier").filter("s_acctbal > 5000").select(F.lit("only_customers").alias("side"), F.col("s_nationkey").alias("nation"))
    return c.exceptAll(s.distinct()).distinct().join(s, ["side", "nation"], "left_anti").unionByName(read(spark, sf, "nation").select(F.lit("all").alias("side"), F.col("n_nationkey").alias("nation")))


@query("f2_set_percentiles", f"""WITH {PHOTOS_SQL} SELECT photo_id, gallery_id,
  {', '.join(f"round(CASE WHEN {s} IS NULL OR count({s}) OVER (PARTITION BY gallery_id) <= 1 THEN 50.0 ELSE 100.0 * (row_number() OVER (PARTITION BY gallery_id ORDER BY {s} IS NULL, {s}, display_order, photo_id) - 1) / (count({s}) OVER (PARTITION BY gallery_id) - 1) END, 6) AS {s.split('_')[0]}_pct" for s in ("technical_score", "aesthetic_score", "sharpness"))} FROM photos""")
def f2(spark, sf):
    names = {"technical_score": "technical_pct", "aesthetic_score": "aesthetic_pct", "sharpness": "sharpness_pct"}
    return set_percentiles(photos(spark, sf), names).select("photo_id", "gallery_id", *[F.round(c, 6).alias(c) for c in names.values()])




@query("c3_c6_without_recent_orders", "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 4 = 0) AND EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey <> 2)")
def c36_recent(spark, sf):
    nations = read(spark, sf, "nation").filter("n_regionkey <> 2").select(F.col("n_nationkey").alias("c_nationkey"))
    recent = read(spark, sf, "orders").filter("o_orderkey % 4 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf, "customer").join(recent, "c_custkey", "left_anti").join(nations, "c_nationkey", "left_semi").select("c_custkey", "c_mktsegment")


@query("c4_closed_galleries", TABLES_SQL + "SELECT gallery_id FROM ga WHERE deleted_at IS NULL AND EXISTS (SELECT 1 FROM photos WHERE photos.gallery_id = ga.gallery_id AND selected AND photo_id % 5 = 0) AND EXISTS (SELECT 1 FROM an JOIN ph USING (photo_id) WHERE ph.gallery_id = ga.gallery_id AND has_embedding AND pipeline_version = 'v1')")
def c4(spark, sf):
    t = tables(spark, sf)
    chosen = photos(spark, sf).filter("selected and photo_id % 5 = 0").select("gallery_id")
    analysed = t["analysis"].filter("has_embedding and pipeline_version = 'v1'").join(t["photos"].select("photo_id", "gallery_id"), "photo_id").select("gallery_id")
    return t["galleries"].filter("deleted_at is null").join(chosen, "gallery_id", "left_semi").join(analysed, "gallery_id", "left_semi").select("gallery_id")
