"""Documents, preference evaluation and streaming over the adapter tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenflow.functions import documents as D
from lumenflow.functions import images as I
from lumenflow.plans import preference as P
from lumenflow.operators import scan
from lumenflow.plans.catalog import query
from lumenflow.plans.gallery_queries import DEDUP_SQL, NAMES, RANK_SQL
from lumenflow.operators.windows import ORDER, burst_ranks, set_percentiles
from lumenflow.plans.tables import durable
from lumenflow.sources.adapter import PHOTOS_SQL, photos, read, with_vectors
from lumenflow.sources.files import result_messages

NOW = "2026-11-14 06:25:00"


@query("k2_k4_exif_values", "SELECT event_id, strftime(ts, '%Y:%m:%d %H:%M:%S') AS stamp, CAST(event_id % 10 AS DOUBLE) AS number, CASE WHEN event_id % 8 >= 5 THEN 30 ELSE 20 END AS width FROM events")
def k24(spark, sf):
    e = read(spark, sf, "events").withColumn("exif", F.date_format("ts", "yyyy:MM:dd HH:mm:ss"))
    e = e.withColumns({"pair": F.concat(F.lit("("), (F.col("event_id") % 10).cast("string"), F.lit(", 1)")), "w": F.lit(20), "h": F.lit(30), "o": (F.col("event_id") % 8).cast("int")})
    return e.select("event_id", F.date_format(I.exif_time("exif"), "yyyy:MM:dd HH:mm:ss").alias("stamp"), I.number("pair").alias("number"), I.oriented("w", "h", "o")[0].alias("width"))


@query("k3_exposure", "SELECT event_id, CASE WHEN value <= 0 OR value IS NULL THEN NULL WHEN value >= 1 THEN regexp_replace(regexp_replace(printf('%.*f', CASE WHEN value < 9.999995 THEN 5 WHEN value < 99.99995 THEN 4 WHEN value < 999.9995 THEN 3 WHEN value < 9999.995 THEN 2 ELSE 1 END, value), '0+$', ''), '\\.$', '') ELSE '1/' || CAST(CAST(round_even(1 / value, 0) AS BIGINT) AS VARCHAR) END AS exposure FROM events")
def k3(spark, sf):
    return read(spark, sf, "events").select("event_id", I.exposure_text("value").alias("exposure"))


@query("l7_week_bounds", "SELECT event_id, strftime(m, '%Y-%m-%d') AS monday, strftime(m + INTERVAL 5 DAY, '%Y-%m-%d') AS saturday, strftime(m + INTERVAL 6 DAY, '%Y-%m-%d') AS sunday FROM (SELECT event_id, date_trunc('week', ts + INTERVAL 9 HOUR) AS m FROM events)")
def l7w(spark, sf):
    days = zip(("monday", "saturday", "sunday"), D.week_bounds(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), strict=True)
    return read(spark, sf, "events").select("event_id", *[F.date_format(d, "yyyy-MM-dd").alias(n) for n, d in days])


@query("l1_l4_markdown", """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM d),
t AS (SELECT *, CASE pos % 5 WHEN 0 THEN 'heading_2' WHEN 3 THEN 'quote' WHEN 4 THEN 'bulleted_list_item' ELSE 'numbered_list_item' END AS type FROM l)
SELECT doc_id, string_agg(CASE type WHEN 'heading_2' THEN '## ' || line WHEN 'quote' THEN '> ' || line WHEN 'bulleted_list_item' THEN '- ' || line ELSE (pos % 5) || '. ' || line END, chr(10) ORDER BY pos) AS markdown FROM t GROUP BY 1""")
def l1(spark, sf):
    lines = read(spark, sf, "documents").select(F.col("doc_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    kind = F.when(F.col("pos") % 5 == 0, "heading_2").when(F.col("pos") % 5 == 3, "quote").when(F.col("pos") % 5 == 4, "bulleted_list_item").otherwise("numbered_list_item")
    none = F.lit(None).cast("string")
    blocks = lines.select("doc_id", F.concat_ws("-", "doc_id", "pos").alias("block_id"), none.alias("parent_id"), "pos", kind.alias("type"), "text", F.lit(False).alias("checked"), none.alias("language"), none.alias("title"), none.alias("url"), F.lit(None).cast("array<string>").alias("cells"))
    return D.markdown(blocks)


@query("l3_properties_text", "SELECT p_partkey, 'name: ' || p_name || ' / brand: ' || p_brand || ' / size: ' || p_size || ' / links: 2건 연결' AS text FROM part")
def l3(spark, sf):
    schema = "struct<name:string,type:string,value:string,names:array<string>,rich_text:array<struct<plain_text:string,href:string>>,start:string,end:string>"

    def prop(name, kind, **k):
        return F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"), k.get("value", F.lit(None)).cast("string").alias("value"), k.get("names", F.lit(None)).cast("array<string>").alias("names"), k.get("rich", F.lit(None)).cast("array<struct<plain_text:string,href:string>>").alias("rich_text"), F.lit(None).cast("string").alias("start"), F.lit(None).cast("string").alias("end")).cast(schema)

    props = F.array(prop("name", "title", rich=F.array(F.struct(F.col("p_name").alias("plain_text"), F.lit(None).cast("string").alias("href")))), prop("brand", "select", names=F.array("p_brand")), prop("size", "number", value=F.col("p_size")), prop("empty", "url"), prop("links", "relation", names=F.array(F.lit("a"), F.lit("b"))))
    return read(spark, sf, "part").select("p_partkey", D.properties_text(props).alias("text"))


@query("l5_l6_upcoming", f"""WITH o AS (SELECT o_orderkey, o_orderpriority AS title, o_orderkey % 3 = 0 AS timed, o_orderdate + INTERVAL 10300 DAY + INTERVAL (o_orderkey % 24) HOUR AS local FROM orders)
SELECT o_orderkey FROM o WHERE contains(lower(title), 'urgent') AND CASE WHEN timed THEN local + INTERVAL 1 HOUR >= TIMESTAMP '{NOW}' + INTERVAL 9 HOUR ELSE CAST(local AS DATE) >= CAST(TIMESTAMP '{NOW}' + INTERVAL 9 HOUR AS DATE) END
ORDER BY CASE WHEN timed THEN local ELSE date_trunc('day', local) END, o_orderkey LIMIT 30""")
def l56(spark, sf):
    o = read(spark, sf, "orders")
    local = F.col("o_orderdate") + F.expr("make_dt_interval(10300 + 0 * o_orderkey, cast(o_orderkey % 24 as int))")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(local, "yyyy-MM-dd"))
    events = o.select("o_orderkey", F.format_string("%s %012d", "o_orderpriority", "o_orderkey").alias("title"), text.alias("start"), F.lit(None).cast("string").alias("end"), F.lit("").alias("detail"), F.lit("").alias("url"))
    return D.upcoming(events, NOW, "urgent").select("o_orderkey")


ONE_SQL = "strftime(X, '%Y-%m-%d') || '(' || substr('월화수목금토일', isodow(X), 1) || ')' || CASE WHEN timed THEN ' ' || strftime(X, '%H:%M') ELSE '" + D.ALL_DAY + "' END"


@query("l7_relative_days", f"""WITH o AS (SELECT o_orderkey, o_orderpriority || o_orderkey AS title, o_orderkey % 3 = 0 AS timed, o_orderdate + INTERVAL 10300 DAY + INTERVAL (o_orderkey % 24) HOUR AS b, CASE WHEN o_orderkey % 5 = 0 THEN b + INTERVAL 2 DAY WHEN o_orderkey % 15 = 3 THEN b + INTERVAL 30 MINUTE END AS e, TIMESTAMP '{NOW}' + INTERVAL 9 HOUR AS now FROM orders),
k AS (SELECT *, CASE WHEN timed THEN b < now ELSE CAST(b AS DATE) < CAST(now AS DATE) END AS begun, datediff('day', now, b) AS days FROM o
  WHERE CASE WHEN timed THEN coalesce(e, b + INTERVAL 1 HOUR) >= now ELSE CAST(coalesce(e, b) AS DATE) >= CAST(now AS DATE) END)
SELECT o_orderkey, CASE WHEN begun THEN '{D.ONGOING}' WHEN days = 0 THEN '{D.TODAY}' WHEN days = 1 THEN '{D.TOMORROW}' WHEN days = 2 THEN '{D.AFTER}' ELSE days || '{D.DAYS}' END AS relative,
  {ONE_SQL.replace("X", "b")} || CASE WHEN e IS NULL THEN '' WHEN timed AND CAST(e AS DATE) = CAST(b AS DATE) THEN '~' || strftime(e, '%H:%M') ELSE ' ~ ' || {ONE_SQL.replace("X", "e")} END AS when_text
FROM k ORDER BY CASE WHEN timed THEN b ELSE date_trunc('day', b) END, title LIMIT 30""")
def l7r(spark, sf):
    day = F.make_dt_interval(days=F.lit(10300), hours=(F.col("o_orderkey") % 24).cast("int"))
    o = read(spark, sf, "orders").withColumn("b", F.col("o_orderdate").cast("timestamp") + day)
    end = F.when(F.col("o_orderkey") % 5 == 0, F.col("b") + F.make_dt_interval(days=F.lit(2))).when(F.col("o_orderkey") % 15 == 3, F.col("b") + F.make_dt_interval(mins=F.lit(30)))
    text = lambda c: F.when(F.col("o_orderkey") % 3 == 0, F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(c, "yyyy-MM-dd"))
    events = o.select("o_orderkey", F.concat("o_orderpriority", F.col("o_orderkey").cast("string")).alias("title"), text(F.col("b")).alias("start"), text(end).alias("end"), F.lit("").alias("detail"), F.lit("").alias("url"))
    return D.upcoming(events, NOW).select("o_orderkey", "relative", "when_text")


@query("l7_weekday_labels", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || '(' || substr('월화수목금토일', isodow(o_orderdate), 1) || ')' AS label FROM orders")
def l7(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", D.weekday_label(F.to_date("o_orderdate")).alias("label"))


@query("l9_l12_l13_texts", "SELECT event_id, 'https://x/' || replace(md5(CAST(event_id AS VARCHAR)), '-', '') AS url, 'a  b' AS text, ts - INTERVAL (second(ts)) SECOND - INTERVAL (microsecond(ts) % 1000000) MICROSECOND AS stamp FROM events")
def l91213(spark, sf):
    e = read(spark, sf, "events").withColumn("id", F.md5(F.col("event_id").cast("string").cast("binary")))
    dashed = F.concat_ws("-", F.substring("id", 1, 8), F.substring("id", 9, 24))
    stamp = F.concat(F.lit("지금 "), D.weekday_label(F.to_date("ts")), F.lit(" "), F.date_format("ts", "HH:mm"), F.lit(" 입니다"))
    return e.select("event_id", D.page_url(dashed, "https://x/").alias("url"), D.without_comments(F.lit("a <!-- x\ny --> b")).alias("text"), D.date_stamp(stamp).alias("stamp"))


@query("l11_m11_judge", """WITH a AS (SELECT conv_id, turn, text, NOT regexp_matches(text, 'the|die|les') AS missing, regexp_matches(text, 'qu[ae]') AS forbidden, role <> 'assistant' AS unused FROM conversations)
SELECT count(*) AS cases, count(*) FILTER (NOT missing AND NOT forbidden AND NOT unused) AS passed, count(*) FILTER (missing) AS missing, count(*) FILTER (forbidden) AS forbidden, count(*) FILTER (unused) AS unused FROM a""")
def l11(spark, sf):
    c = read(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("answer"), F.array("role").alias("tools"), F.array(F.lit("the"), F.lit("die"), F.lit("les")).alias("expect_any"), F.array(F.lit("qu[ae]")).alias("expect_none"), F.lit("assistant").alias("tool"), F.lit(None).cast("string").alias("not_tool"))
    j = D.judged(c)
    has = lambda x: F.count_if(F.array_contains("failures", x))
    return j.agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.size("failures") == 0).alias("passed"), has("missing").alias("missing"), has("forbidden").alias("forbidden"), has("tool not used").alias("unused"))


def training_rows(spark: SparkSession, sf: str) -> DataFrame:
    p = burst_ranks(set_percentiles(photos(spark, sf), NAMES))
    return p.withColumn("embed_group_id", F.col("user_id") % 12)


@query("m2_sample", RANK_SQL + """, o AS (SELECT *, CASE WHEN selected THEN 1 ELSE 0 END AS sel, sum(CASE WHEN selected THEN 1 ELSE 0 END) OVER (PARTITION BY gallery_id, burst_id) AS hits, row_number() OVER (PARTITION BY gallery_id, burst_id ORDER BY burst_rank, display_order, photo_id) AS f FROM rr),
k AS (SELECT *, CASE WHEN selected THEN 1.0 / hits ELSE 1.0 END AS raw FROM o WHERE selected OR (hits = 0 AND f = 1))
SELECT photo_id, CAST(sel AS DOUBLE) AS y, round(0.5 * raw / sum(raw) OVER (PARTITION BY gallery_id, sel), 9) AS weight FROM k QUALIFY max(sel) OVER (PARTITION BY gallery_id) = 1 AND min(sel) OVER (PARTITION BY gallery_id) = 0""")
def m2(spark, sf):
    return P.sample(training_rows(spark, sf)).select("photo_id", "y", F.round("weight", 9).alias("weight"))


@query("m1_features", RANK_SQL + """, z AS (SELECT *, count(*) OVER (PARTITION BY gallery_id) AS n_all, count(*) OVER (PARTITION BY gallery_id, user_id % 12) AS n_group, row_number() OVER (PARTITION BY gallery_id ORDER BY display_order, photo_id) - 1 AS idx FROM rr)
SELECT photo_id, round(technical_pct / 100, 6) AS s0, round(aesthetic_pct / 100, 6) AS s1, round(sharpness_pct / 100, 6) AS s2, CAST(subject = 'bride' AS DOUBLE) AS s3, CAST(subject = 'groom' AS DOUBLE) AS s4, CAST(subject = 'couple' AS DOUBLE) AS s5, CAST(subject = 'group' AS DOUBLE) AS s6,
  round(ln(n_group / n_all), 6) AS s7, round(idx / greatest(n_all - 1, 1), 6) AS s8, round(n / max(n) OVER (PARTITION BY gallery_id), 6) AS s9, CAST(n > 1 AS DOUBLE) AS s10, (SELECT max(2 * len(embedding)) FROM embeddings) AS dims FROM z""")
def m1(spark, sf):
    rows = P.scalars(training_rows(spark, sf))
    f = P.centred(with_vectors(rows, spark, sf), P.gallery_means(with_vectors(photos(spark, sf), spark, sf)))
    return f.select("photo_id", *[F.round(F.get("scalar", F.lit(i)), 6).alias(f"s{i}") for i in range(P.SCALARS)], F.size("emb").alias("dims"))


@query("m6_recalls", DEDUP_SQL + """, kk AS (SELECT *, 3 * greatest(sum(CASE WHEN selected THEN 1 ELSE 0 END) OVER (PARTITION BY gallery_id), 1) AS k FROM dd), tt AS (SELECT *, coalesce(dedup_rank <= k, FALSE) AS intop FROM kk),
bt AS (SELECT *, bool_or(intop) OVER (PARTITION BY gallery_id, b) AND b >= 0 AS burst_top FROM tt)
SELECT gallery_id, count(*) AS positives, round(avg(CAST(intop AS INT)), 6) AS recall_strict, round(avg(CAST(intop OR burst_top AS INT)), 6) AS recall_burst FROM bt WHERE selected GROUP BY 1""")
def m6(spark, sf):
    p = photos(spark, sf).withColumn("burst_id", F.when(F.col("photo_id") % 29 == 0, -1).otherwise(F.col("burst_id")))
    r = P.recalls(p, "aesthetic_score")
    return r.select("gallery_id", "positives", F.round("recall_strict", 6).alias("recall_strict"), F.round("recall_burst", 6).alias("recall_burst"))


@query("m6_auc", "SELECT quality_group AS gallery_id, round(sum(CASE WHEN p.n_chars > q.n_chars THEN 1.0 WHEN p.n_chars = q.n_chars THEN 0.5 ELSE 0 END) / count(*), 6) AS auc FROM (SELECT doc_id % 5 AS quality_group, n_chars FROM documents JOIN labels USING (doc_id) WHERE quality = 1) p JOIN (SELECT doc_id % 5 AS g, n_chars FROM documents JOIN labels USING (doc_id) WHERE quality = 0) q ON quality_group = g GROUP BY 1")
def m6_auc(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "n_chars").join(read(spark, sf, "labels"), "doc_id")
    rows = d.select((F.col("doc_id") % 5).alias("gallery_id"), F.col("quality").cast("double").alias("y"), "n_chars")
    return P.auc(rows, "n_chars").select("gallery_id", F.round("auc", 6).alias("auc"))


@query("m7_m8_compared", f"""WITH {PHOTOS_SQL}, u AS (SELECT *, 'aesthetic' AS which, aesthetic_score AS v FROM photos UNION ALL SELECT *, 'technical', technical_score FROM photos), o AS (SELECT *, CASE WHEN photo_id % 29 = 0 THEN -1 ELSE burst_id END AS b FROM u),
t AS (SELECT *, row_number() OVER (PARTITION BY which, gallery_id, CASE WHEN b >= 0 THEN b ELSE -1 - photo_id END ORDER BY v DESC NULLS LAST, display_order, photo_id) = 1 AS top FROM o),
d AS (SELECT *, CASE WHEN top THEN row_number() OVER (PARTITION BY which, gallery_id, top ORDER BY v DESC NULLS LAST, display_order, photo_id) END AS place, 3 * greatest(sum(CAST(selected AS INT)) OVER (PARTITION BY which, gallery_id), 1) AS k FROM t),
r AS (SELECT which, gallery_id, avg(CAST(coalesce(place <= k, FALSE) AS INT)) AS recall FROM d WHERE selected GROUP BY 1, 2),
g AS (SELECT p.recall - q.recall AS gain FROM r p JOIN r q USING (gallery_id) WHERE p.which = 'technical' AND q.which = 'aesthetic'),
c AS (SELECT count(*) AS galleries, count(*) FILTER (gain > 0) AS better, count(*) FILTER (gain < 0) AS worse, avg(gain) AS mean_diff FROM g),
x AS (SELECT *, worse / galleries AS worse_ratio, (SELECT sum(CAST(factorial(CAST(better + worse AS INT)) AS DOUBLE) / CAST(factorial(CAST(i AS INT)) AS DOUBLE) / CAST(factorial(CAST(better + worse - i AS INT)) AS DOUBLE)) FROM range(0, 100) k(i) WHERE i BETWEEN better AND better + worse) / pow(2, better + worse) AS p_value FROM c)
SELECT galleries, better, worse, round(mean_diff, 6) AS mean_diff, round(worse_ratio, 6) AS worse_ratio, round(p_value, 6) AS p_value, p_value < 0.05 AND worse_ratio <= 0.3 AS passed FROM x""")
def m78(spark, sf):
    p = photos(spark, sf).withColumn("burst_id", F.when(F.col("photo_id") % 29 == 0, -1).otherwise(F.col("burst_id")))
    found = [P.recalls(p, f"{s}_score").withColumn("score", F.lit(s)) for s in ("aesthetic", "technical")]
    out = P.compared(found[0].unionByName(found[1]), "aesthetic", "technical", "recall_strict")
    return out.select("galleries", "better", "worse", *[F.round(c, 6).alias(c) for c in ("mean_diff", "worse_ratio", "p_value")], "passed")


@query("m3_m9_fused_ranking")
def m39(spark, sf):
    """Fits on the galleries up to the 15th and ranks the others."""
    plain = durable(P.scalars(training_rows(spark, sf)).select("gallery_id", *ORDER, "burst_id", "burst_rank", "selected", "technical_pct", "aesthetic_pct", "scalar"), "scalars")
    means = durable(P.gallery_means(with_vectors(photos(spark, sf), spark, sf)), "means")
    add = lambda rows: P.centred(with_vectors(rows, spark, sf), means)
    sampled = durable(P.sample(plain.filter("gallery_id <= 15")), "sample")
    model = P.fit(add(sampled).select("gallery_id", "photo_id", "scalar", "emb", "y", "weight"))
    return P.scored(add(plain.filter("gallery_id > 15")), model).select("photo_id", "gallery_id", F.round("prior", 6).alias("prior"), F.round("pref", 4).alias("pref"), F.round("fused", 4).alias("fused"))


@query("n7_deadline", "WITH b AS (SELECT user_id AS run_id, event_id AS batch, value AS seconds, 400.0 - value AS remaining FROM events) SELECT batch, remaining < coalesce(max(seconds) OVER (PARTITION BY run_id ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 10 AS stop FROM b")
def n7(spark, sf):
    from lumenflow.streaming.ingest import deadline_stop

    b = read(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("batch"), F.col("value").alias("seconds"), (400.0 - F.col("value")).alias("remaining"))
    return deadline_stop(b, 10.0).select("batch", "stop")


@query("n14_batch_sessions", f"""WITH {PHOTOS_SQL}, g AS (SELECT *, epoch_us(taken_at) - lag(epoch_us(taken_at)) OVER (PARTITION BY gallery_id ORDER BY taken_at) AS gap FROM photos),
s AS (SELECT *, sum(CASE WHEN gap > 300000000 THEN 1 ELSE 0 END) OVER (PARTITION BY gallery_id ORDER BY taken_at ROWS UNBOUNDED PRECEDING) AS seg FROM g)
SELECT gallery_id, min(taken_at) AS start, count(*) AS n FROM s GROUP BY gallery_id, seg""")
def n14(spark, sf):
    s = photos(spark, sf).groupBy("gallery_id", F.session_window("taken_at", "300 seconds")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("gallery_id", F.col("session_window.start").alias("start"), "n")


@query("b8_messages", """SELECT event_id, CASE WHEN event_id % 23 = 0 THEN 'not JSON' WHEN event_id % 5 = 0 THEN 'unknown version' WHEN event_id % 11 = 0 THEN 'galleryId' WHEN event_id % 13 = 0 THEN 'embeddingModel' WHEN event_id % 17 = 0 THEN 'photos'
WHEN event_id % 19 = 0 OR event_id % 7 IN (1, 2) THEN 'photo' END AS error FROM events""")
def b8(spark, sf):
    i = F.col("event_id")
    vector = F.when(i % 7 == 1, "0000807F").when(i % 7 == 2, "0000803F0000803F").otherwise("0000803F")  # infinite, too long, 1.0
    photo = F.struct(i.alias("photoId"), F.when(i % 19 == 0, F.repeat(F.lit("k"), 501)).otherwise("k").alias("storageKey"), F.lit("p").alias("previewKey"), F.base64(F.unhex(vector)).alias("vector"), F.struct((i % 100).alias("iso"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("takenAt")).alias("metadata"))
    body = F.to_json(F.struct(F.when(i % 5 == 0, 2).otherwise(1).alias("v"), F.when(i % 11 != 0, F.col("user_id")).alias("galleryId"), F.when(i % 13 == 0, "").otherwise(F.col("event_type")).alias("embeddingModel"), F.when(i % 17 != 0, F.array(photo)).alias("photos")))
    e = read(spark, sf, "events").withColumn("body", F.when(i % 23 == 0, F.expr("'{'")).otherwise(body))
    return e.select("event_id", scan.message_error("body", 1).alias("error"))


@query("b9_admin_events", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'UNSUPPORTED_JOB_TYPE' WHEN event_id % 7 = 0 THEN 'INVALID_STORAGE_KEY' WHEN event_id % 11 = 0 THEN 'INVALID_JOBID' WHEN event_id % 13 = 0 THEN 'INVALID_PHOTOID'
WHEN user_id <= 0 THEN 'INVALID_GALLERYID' WHEN event_id % 17 <= 1 THEN 'INVALID_REVISIONID' END AS error FROM events""")
def b9(spark, sf):
    i = F.col("event_id")
    job = F.when(i % 5 == 0, F.col("event_type")).otherwise("EMBEDDING").alias("jobType")
    key = F.when(i % 7 == 0, " ").otherwise(F.concat(F.lit("k"), i.cast("string"))).alias("storageKey")
    body = F.to_json(F.struct(job, key, (i % 11).alias("jobId"), F.lit("1").alias("attemptCount"), (i % 13).alias("photoId"), F.col("user_id").alias("galleryId"), (i % 17 - 1).cast("string").alias("revisionId")))
    return read(spark, sf, "events").select("event_id", body.alias("body")).select("event_id", scan.admin_event_error("body").alias("error"))


@query("b11_paired_keys", "SELECT event_id, CASE WHEN event_id % 3 = 2 AND event_type <> '' AND props <> '' THEN 2 END AS pairs FROM events")
def b11(spark, sf):
    i = F.col("event_id")
    keys = F.when(i % 3 == 0, F.array("event_type")).when(i % 3 == 1, F.array("event_type", F.lit(""))).otherwise(F.array("event_type", "props"))
    e = read(spark, sf, "events").select("event_id", F.array(i, i + 1).alias("ids"), keys.alias("keys"))
    found = e.select("event_id", scan.paired_keys(F.col("ids"), F.col("keys")).alias("p"))
    return found.select("event_id", F.when(F.col("p").isNotNull(), F.size("p")).alias("pairs"))


@query("k7_image_measures", """WITH p AS (SELECT event_id, event_id % 256 AS a, event_id * 7 % 256 AS b, event_id * 31 % 256 AS c, event_id * 101 % 256 AS d FROM events),
x AS (SELECT event_id, unnest([a, b, c, d]) AS v, unnest([b + c - 2 * a, a + d - 2 * b, a + d - 2 * c, b + c - 2 * d]) AS l FROM p)
SELECT CAST(event_id AS VARCHAR) AS path, round(var_pop(l), 6) AS sharpness, avg(CASE WHEN v >= 250 THEN 1.0 ELSE 0.0 END) AS highlights, avg(CASE WHEN v <= 5 THEN 1.0 ELSE 0.0 END) AS shadows, avg(v) AS luma, 'ok' AS status FROM x GROUP BY event_id""")
def k7(spark, sf):
    i = F.col("event_id")
    pixels = F.unhex(F.format_string("%02X%02X%02X%02X", *[(i * k % 256).cast("int") for k in (1, 7, 31, 101)]))
    images = read(spark, sf, "events").select(i.cast("string").alias("path"), F.concat(F.encode(F.lit("P5\n2 2\n255\n"), "UTF-8"), pixels).alias("content"))
    return I.measured(images, I.pgm).withColumn("sharpness", F.round("sharpness", 6))


@query("a17_result_messages", """WITH r AS (SELECT event_id, user_id % 10 AS gallery_id, CAST(floor((row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) - 1) / 8) AS BIGINT) AS chunk, event_type FROM events)
SELECT gallery_id, count(DISTINCT chunk) AS messages, count(*) AS photos, max(n) AS largest FROM (SELECT *, count(*) OVER (PARTITION BY gallery_id, chunk) AS n FROM r) GROUP BY gallery_id""")
def a17(spark, sf):
    rows = read(spark, sf, "events").select((F.col("user_id") % 10).alias("gallery_id"), F.col("event_id").alias("photo_id"), F.col("event_id").alias("display_order"), F.concat(F.lit("k"), "event_id").alias("storage_key"), F.concat(F.lit("p"), "event_id").alias("preview_key"), F.lit("AACAPw==").alias("vector"), F.lit("m").alias("embedding_model"))
    sent = scan.message_rows(result_messages(rows).withColumn("error", scan.message_error("body", 1)).filter("error is null"))
    return sent.groupBy("gallery_id", "chunk").agg(F.count_distinct("photo_id").alias("n")).groupBy("gallery_id").agg(F.count(F.lit(1)).alias("messages"), F.sum("n").alias("photos"), F.max("n").alias("largest"))


def line_tree(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of each document as a block tree: a line's parent is halfway up; some parents are missing, and the root is also inside line 3."""
    lines = read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    kind = F.when(F.col("pos") % 5 == 0, "heading_2").when(F.col("pos") % 5 == 3, "quote").when(F.col("pos") % 5 == 4, "bulleted_list_item").otherwise("numbered_list_item")
    parent = F.when(F.col("pos") == 0, None).when(F.col("pos") % 11 == 10, -1).otherwise(F.floor((F.col("pos") - 1) / 2)).cast("string")
    none = F.lit(None).cast("string")
    blocks = lines.select("doc_id", F.col("pos").cast("string").alias("block_id"), parent.alias("parent_id"), "pos", kind.alias("type"), "text", F.lit(False).alias("checked"), none.alias("language"), none.alias("title"), none.alias("url"), F.lit(None).cast("array<string>").alias("cells"))
    ring = blocks.filter("pos = 3").withColumns({"block_id": F.lit("0"), "parent_id": F.lit("3"), "pos": F.lit(100_000), "type": F.lit("heading_2"), "text": F.lit("again")})
    return blocks.unionByName(ring)


TREE_SQL = """WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents),
e AS (SELECT doc_id, k AS block, CASE WHEN k = 0 THEN NULL WHEN k % 11 = 10 THEN -1 ELSE (k - 1) // 2 END AS parent, k AS pos, line,
    CASE k % 5 WHEN 0 THEN 'heading_2' WHEN 3 THEN 'quote' WHEN 4 THEN 'bulleted_list_item' ELSE 'numbered_list_item' END AS type FROM l
  UNION ALL SELECT doc_id, 0, 3, 100000, 'again', 'heading_2' FROM l WHERE k = 3),
r AS (SELECT *, sum((type <> 'numbered_list_item')::INT) OVER (PARTITION BY doc_id, parent ORDER BY pos) AS run FROM e),
n AS (SELECT *, sum((type = 'numbered_list_item')::INT) OVER (PARTITION BY doc_id, parent, run ORDER BY pos) AS number FROM r),
w AS (SELECT doc_id, block, lpad(pos::VARCHAR, 8, '0') AS path, [block] AS seen, 0 AS depth FROM e WHERE parent IS NULL
  UNION ALL SELECT e.doc_id, e.block, w.path || '/' || lpad(e.pos::VARCHAR, 8, '0'), list_append(w.seen, e.block), w.depth + 1
  FROM w JOIN e ON e.doc_id = w.doc_id AND e.parent = w.block WHERE NOT list_contains(w.seen, e.block))
"""


@query("a21_l1_tree_markdown", TREE_SQL + """SELECT w.doc_id, string_agg(repeat('  ', depth) || CASE n.type WHEN 'heading_2' THEN '## ' || line WHEN 'quote' THEN '> ' || line WHEN 'bulleted_list_item' THEN '- ' || line ELSE number::BIGINT || '. ' || line END, chr(10) ORDER BY path) AS markdown
FROM w JOIN n ON n.doc_id = w.doc_id AND n.block = w.block AND n.pos < 100000 GROUP BY 1""")
def a21(spark, sf):
    from lumenflow.functions.trees import tree_markdown

    return tree_markdown(line_tree(spark, sf))


@query("o_flatten_tree", TREE_SQL + "SELECT doc_id, block::VARCHAR AS block_id, depth, path FROM w")
def o_flatten(spark, sf):
    from lumenflow.functions import trees

    trees.register(spark)
    tree = line_tree(spark, sf).select("doc_id", "block_id", "parent_id", "pos")
    return spark.sql("SELECT * FROM flatten_tree(TABLE(SELECT * FROM {tree}) PARTITION BY (doc_id), 'doc_id')", tree=tree)
