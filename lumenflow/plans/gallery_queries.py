"""Windows, clustering and vectors over the adapter view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenflow.functions import vectors as V
from lumenflow.operators import cluster, windows
from lumenflow.plans.catalog import query
from lumenflow.plans.tables import durable
from lumenflow.sources.adapter import PHOTOS_SQL, SUBJECTS, VECTORS_SQL, photos, with_vectors

PCT_SQL = f"""WITH {PHOTOS_SQL}, pc AS (SELECT *,
  {', '.join(f"CASE WHEN {s} IS NULL OR count({s}) OVER (PARTITION BY gallery_id) <= 1 THEN 50.0 ELSE 100.0 * (row_number() OVER (PARTITION BY gallery_id ORDER BY {s} IS NULL, {s}, display_order, photo_id) - 1) / (count({s}) OVER (PARTITION BY gallery_id) - 1) END AS {n}" for s, n in (("technical_score", "technical_pct"), ("aesthetic_score", "aesthetic_pct"), ("sharpness", "sharpness_pct")))} FROM photos)"""
NAMES = {"technical_score": "technical_pct", "aesthetic_score": "aesthetic_pct", "sharpness": "sharpness_pct"}


def ranked(spark: SparkSession, sf: str) -> DataFrame:
    return windows.burst_ranks(windows.set_percentiles(photos(spark, sf), NAMES))


RANK_SQL = PCT_SQL + """, br AS (SELECT *, row_number() OVER w - 1 AS burst_rank, count(*) OVER (PARTITION BY gallery_id, burst_id) AS n,
  max(technical_pct) OVER rest AS t, max(coalesce(sharpness, 0)) OVER rest AS s, max(aesthetic_pct) OVER rest AS a FROM pc
  WINDOW w AS (PARTITION BY gallery_id, burst_id ORDER BY technical_pct DESC, coalesce(sharpness, 0) DESC, aesthetic_pct DESC, CAST(photo_id AS VARCHAR)),
  rest AS (PARTITION BY gallery_id, burst_id ORDER BY technical_pct DESC, coalesce(sharpness, 0) DESC, aesthetic_pct DESC, CAST(photo_id AS VARCHAR) ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
rr AS (SELECT *, CASE WHEN burst_rank > 0 THEN NULL WHEN n = 1 THEN 'single' WHEN technical_pct - t > 5 THEN 'technical' WHEN coalesce(sharpness, 0) > 1.25 * s THEN 'sharpness' WHEN aesthetic_pct - a > 5 THEN 'aesthetic' ELSE 'tie' END AS rank_reason FROM br)
"""


@query("f3_f4_burst_rank", RANK_SQL + "SELECT photo_id, burst_rank, rank_reason FROM rr")
def f34(spark, sf):
    return ranked(spark, sf).select("photo_id", F.col("burst_rank").cast("long").alias("burst_rank"), "rank_reason")


@query("f5_clear_ranks", RANK_SQL + ", q AS (SELECT gallery_id, bool_and(event_type <> 'refund' OR gallery_id % 2 = 0) AS ok FROM photos GROUP BY 1) SELECT photo_id, CASE WHEN ok THEN burst_rank END AS burst_rank FROM rr JOIN q USING (gallery_id)")
def f5(spark, sf):
    r = ranked(spark, sf).withColumn("done", (F.col("event_type") != "refund") | (F.col("gallery_id") % 2 == 0))
    return windows.clear_unranked(r, "done", ["burst_rank"]).select("photo_id", F.col("burst_rank").cast("long").alias("burst_rank"))


ORDER_SQL = f"""WITH {PHOTOS_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY gallery_id ORDER BY display_order, photo_id) - 1 AS idx FROM photos),
c AS (SELECT *, min(idx) OVER (PARTITION BY gallery_id, camera) AS f, bool_or(TIME IS NULL) OVER (PARTITION BY gallery_id, camera) AS gap FROM i),
po AS (SELECT *, dense_rank() OVER (PARTITION BY gallery_id ORDER BY f) - 1 AS part, row_number() OVER (PARTITION BY gallery_id, camera ORDER BY CASE WHEN NOT gap THEN TIME END, idx) - 1 AS pos FROM c)
"""


@query("f6_partition_order", ORDER_SQL.replace("TIME", "taken_at_gaps") + "SELECT photo_id, part, pos FROM po")
def f6(spark, sf):
    return windows.partition_order(photos(spark, sf), "taken_at_gaps").select("photo_id", F.col("part").cast("long").alias("part"), F.col("pos").cast("long").alias("pos"))


SEG_SQL = f"""WITH {PHOTOS_SQL}, g AS (SELECT *, epoch_us(taken_at) - lag(epoch_us(taken_at)) OVER (PARTITION BY gallery_id ORDER BY taken_at, display_order, photo_id) AS gap FROM photos),
sg AS (SELECT *, CAST(sum(CASE WHEN gap > 300000000 THEN 1 ELSE 0 END) OVER (PARTITION BY gallery_id ORDER BY taken_at, display_order, photo_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM g)
"""


@query("f7_time_segments", SEG_SQL + "SELECT photo_id, segment FROM sg")
def f7(spark, sf):
    return windows.time_segments(photos(spark, sf)).select("photo_id", "segment")


@query("f8_timeline", f"WITH {PHOTOS_SQL} SELECT photo_id, round((row_number() OVER (PARTITION BY gallery_id ORDER BY display_order, photo_id) - 1) / greatest(count(*) OVER (PARTITION BY gallery_id) - 1, 1), 9) AS line FROM photos")
def f8(spark, sf):
    return photos(spark, sf).select("photo_id", F.round(windows.timeline(), 9).alias("line"))


@query("f9_f10_renumbered", f"WITH {PHOTOS_SQL}, m AS (SELECT *, min(photo_id) OVER (PARTITION BY gallery_id, user_id) AS f FROM photos) SELECT photo_id, dense_rank() OVER (PARTITION BY gallery_id ORDER BY f) - 1 AS id FROM m")
def f910(spark, sf):
    return windows.renumbered(photos(spark, sf), "user_id", "id").select("photo_id", F.col("id").cast("long").alias("id"))


@query("f11_coverage_prefix", f"""WITH {PHOTOS_SQL}, g AS (SELECT gallery_id, user_id % 12 AS group_id, count(*) AS size, least(count(*), 2) AS reps FROM photos GROUP BY ALL),
s AS (SELECT *, count(*) OVER (PARTITION BY gallery_id) AS n, sum(size) OVER (PARTITION BY gallery_id) AS total, coalesce(sum(size) OVER w, 0) AS covered, coalesce(sum(reps) OVER w, 0) AS shown FROM g WINDOW w AS (PARTITION BY gallery_id ORDER BY size DESC, group_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT gallery_id, group_id, n >= 2 AND (covered = 0 OR (covered < 0.85 * total AND shown + reps <= 15)) AS taken FROM s""")
def f11(spark, sf):
    g = photos(spark, sf).groupBy("gallery_id", (F.col("user_id") % 12).alias("group_id")).agg(F.count(F.lit(1)).alias("size"), F.least(F.count(F.lit(1)), F.lit(2)).alias("reps"))
    return windows.coverage_prefix(g).select("gallery_id", "group_id", "taken")


DEDUP_SQL = f"""WITH {PHOTOS_SQL}, o AS (SELECT *, CASE WHEN photo_id % 29 = 0 THEN -1 ELSE burst_id END AS b FROM photos),
t AS (SELECT *, row_number() OVER (PARTITION BY gallery_id, CASE WHEN b >= 0 THEN b ELSE -1 - photo_id END ORDER BY aesthetic_score DESC, display_order, photo_id) = 1 AS top FROM o),
dd AS (SELECT *, CASE WHEN top THEN row_number() OVER (PARTITION BY gallery_id, top ORDER BY aesthetic_score DESC, display_order, photo_id) END AS dedup_rank FROM t)
"""


@query("f12_dedup_order", DEDUP_SQL + "SELECT photo_id, dedup_rank FROM dd")
def f12(spark, sf):
    p = photos(spark, sf).withColumn("burst_id", F.when(F.col("photo_id") % 29 == 0, -1).otherwise(F.col("burst_id")))
    return windows.dedup_order(p, "aesthetic_score").select("photo_id", F.col("dedup_rank").cast("long").alias("dedup_rank"))


@query("f13_zscore", f"WITH {PHOTOS_SQL} SELECT photo_id, round((aesthetic_score - avg(aesthetic_score) OVER w) / CASE WHEN stddev_pop(aesthetic_score) OVER w <= 1e-12 THEN 1 ELSE stddev_pop(aesthetic_score) OVER w END, 6) AS z FROM photos WINDOW w AS (PARTITION BY gallery_id)")
def f13(spark, sf):
    return photos(spark, sf).select("photo_id", F.round(windows.zscore("aesthetic_score"), 6).alias("z"))


@query("f14_quantile_picks", f"""WITH {PHOTOS_SQL}, o AS (SELECT gallery_id, photo_id, row_number() OVER (PARTITION BY gallery_id ORDER BY display_order, photo_id) - 1 AS pos, count(*) OVER (PARTITION BY gallery_id) AS n FROM photos),
q AS (SELECT unnest([0, 1, 2, 3]) AS pick, unnest([0.1, 0.37, 0.63, 0.9]) AS q) SELECT gallery_id, pick, photo_id FROM o JOIN q ON pos = CAST(round_even(CAST(q AS DOUBLE) * (n - 1), 0) AS BIGINT)""")
def f14(spark, sf):
    return windows.quantile_picks(photos(spark, sf), ["gallery_id"], windows.ORDER).select("gallery_id", "pick", "photo_id")


@query("f15_unique_names", f"""WITH {PHOTOS_SQL}, n AS (SELECT gallery_id, photo_id, coalesce(nullif(trim(CASE WHEN photo_id % 3 = 0 THEN ' ' ELSE subject || ' ' END), ''), '컨셉') AS nm FROM photos), k AS (SELECT *, row_number() OVER (PARTITION BY gallery_id, nm ORDER BY photo_id) AS k FROM n) SELECT photo_id, CASE WHEN k = 1 THEN nm ELSE nm || ' ' || k END AS unique_name FROM k""")
def f15(spark, sf):
    p = photos(spark, sf).withColumn("name", F.when(F.col("photo_id") % 3 == 0, " ").otherwise(F.concat("subject", F.lit(" "))))
    return windows.unique_names(p, "name", "photo_id").select("photo_id", "unique_name")


@query("f16_frames", "SELECT o_orderkey, ntile(4) OVER w AS quartile, round(cume_dist() OVER w, 6) AS dist, first_value(o_orderkey) OVER w AS first, lag(o_totalprice, 2) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey)")
def f16(spark, sf):
    w = Window.partitionBy("o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.ntile(4).over(w).cast("long").alias("quartile"), F.round(F.cume_dist().over(w), 6).alias("dist"), F.first("o_orderkey").over(w).alias("first"), F.lag("o_totalprice", 2).over(w).alias("before"))


EDGE_SQL = ORDER_SQL.replace("TIME", "taken_at").replace(PHOTOS_SQL, f"{PHOTOS_SQL}, {VECTORS_SQL}").replace("FROM photos),\nc AS", "FROM pv),\nc AS").replace("WITH photos", "WITH RECURSIVE photos") + """, ed AS (SELECT a.photo_id AS a, b.photo_id AS b FROM po a JOIN po b ON a.gallery_id = b.gallery_id AND a.part = b.part AND b.pos > a.pos AND b.pos - a.pos <= 8
  WHERE list_dot_product(a.embedding, b.embedding) / sqrt(list_dot_product(a.embedding, a.embedding)) / sqrt(list_dot_product(b.embedding, b.embedding)) >= 0.2)
"""


@query("c12_burst_edges", EDGE_SQL + "SELECT a, b FROM ed")
def c12(spark, sf):
    return cluster.burst_edges(with_vectors(windows.partition_order(photos(spark, sf)), spark, sf), 0.2).select("a", "b")


@query("i1_bursts", EDGE_SQL + """, un AS (SELECT a AS x, b AS y FROM ed UNION SELECT b, a FROM ed), rc AS (SELECT photo_id AS node, photo_id AS root FROM po UNION SELECT un.y, rc.root FROM rc JOIN un ON un.x = rc.node),
cm AS (SELECT node, min(root) AS c FROM rc GROUP BY 1), fi AS (SELECT po.gallery_id, po.photo_id, po.part, min(po.pos) OVER (PARTITION BY po.gallery_id, po.part, cm.c) AS f FROM po JOIN cm ON cm.node = po.photo_id)
SELECT photo_id, dense_rank() OVER (PARTITION BY gallery_id ORDER BY part, f) - 1 AS burst_id FROM fi""")
def i1(spark, sf):
    p = with_vectors(windows.partition_order(photos(spark, sf).drop("burst_id")), spark, sf)
    return cluster.bursts(p, 0.2, durable).select("photo_id", F.col("burst_id").cast("long").alias("burst_id"))


@query("i2_i3_absorbed_segments")
def i23(spark, sf):
    s = windows.time_segments(photos(spark, sf), 200)
    t = s.groupBy("gallery_id", "segment").agg(F.count(F.lit(1)).alias("size"), F.max(F.when(F.col("gap_s") > 200, F.col("gap_s"))).alias("gap_s"))
    return cluster.absorbed_segments(t.withColumn("n", F.sum("size").over(Window.partitionBy("gallery_id"))), 0.01, 40)


@query("i3_segment_cap", f"""WITH {PHOTOS_SQL}, g AS (SELECT *, (epoch_us(taken_at) - lag(epoch_us(taken_at)) OVER (PARTITION BY gallery_id ORDER BY taken_at, display_order, photo_id)) / 1e6 AS gap_s FROM photos),
r AS (SELECT *, row_number() OVER (PARTITION BY gallery_id ORDER BY CASE WHEN gap_s > 200 THEN gap_s END DESC NULLS LAST, taken_at DESC, photo_id DESC) AS k FROM g)
SELECT photo_id, CAST(sum(CASE WHEN gap_s > 200 AND k <= 9 THEN 1 ELSE 0 END) OVER (PARTITION BY gallery_id ORDER BY taken_at, display_order, photo_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS unit FROM r""")
def i3(spark, sf):
    s = windows.time_segments(photos(spark, sf), 200)
    t = s.groupBy("gallery_id", "segment").agg(F.count(F.lit(1)).alias("size"), F.max(F.when(F.col("gap_s") > 200, F.col("gap_s"))).alias("gap_s"))
    units = cluster.absorbed_segments(t.withColumn("n", F.lit(0)), 0, 10)
    return s.join(units, ["gallery_id", "segment"]).select("photo_id", "unit")


@query("i4_segment_mode", f"WITH {PHOTOS_SQL}, t AS (SELECT gallery_id, CASE WHEN gallery_id % 4 = 0 AND photo_id % 2 = 0 THEN NULL ELSE taken_at_gaps END AS t FROM photos) SELECT gallery_id, CASE WHEN count(t) >= 0.9 * count(*) AND count(DISTINCT t) > 1 THEN 'time' ELSE 'visual' END AS mode FROM t GROUP BY 1")
def i4(spark, sf):
    p = photos(spark, sf).withColumn("t", F.when(~((F.col("gallery_id") % 4 == 0) & (F.col("photo_id") % 2 == 0)), F.col("taken_at_gaps")))
    return cluster.segment_mode(p, "t")


@query("i5_visual_units")
def i5(spark, sf):
    return cluster.visual_units(photos(spark, sf), 36, vectors=lambda rows: with_vectors(rows, spark, sf))


@query("i6_bursts_whole", f"WITH {PHOTOS_SQL}, u AS (SELECT *, display_order // 7 AS unit FROM photos), n AS (SELECT gallery_id, burst_id, unit, count(*) AS n FROM u GROUP BY ALL), h AS (SELECT *, row_number() OVER (PARTITION BY gallery_id, burst_id ORDER BY n DESC, unit) AS r FROM n) SELECT photo_id, h.unit FROM u JOIN h ON h.gallery_id = u.gallery_id AND h.burst_id = u.burst_id AND r = 1")
def i6(spark, sf):
    p = photos(spark, sf).withColumn("unit", F.floor(F.col("display_order") / 7))
    return cluster.bursts_whole(p).select("photo_id", "unit")


NEAR_SQL = """WITH PHOTOS, VECTORS, u AS (SELECT gallery_id, user_id % 6 AS g, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM pv WHERE taken_at_gaps IS NOT NULL), m AS (SELECT gallery_id, g, i, avg(x) AS x FROM u GROUP BY ALL),
ce AS (SELECT gallery_id, g, list(x ORDER BY i) AS v FROM m GROUP BY ALL), s AS (SELECT pv.photo_id, g, row_number() OVER (PARTITION BY photo_id ORDER BY round(list_dot_product(embedding, v), 9) DESC, g) AS r FROM pv JOIN ce ON ce.gallery_id = pv.gallery_id WHERE taken_at_gaps IS NULL)
SELECT photo_id, user_id % 6 AS unit FROM photos WHERE taken_at_gaps IS NOT NULL UNION ALL SELECT photo_id, g FROM s WHERE r = 1""".replace("PHOTOS", PHOTOS_SQL).replace("VECTORS", VECTORS_SQL)


@query("i7_c15_untimed", NEAR_SQL)
def i7(spark, sf):
    p = with_vectors(photos(spark, sf), spark, sf).withColumn("unit", F.col("user_id") % 6)
    return cluster.untimed_assigned(p, time="taken_at_gaps").select("photo_id", "unit")


@query("i8_i9_detail_groups")
def i89(spark, sf):
    p = with_vectors(photos(spark, sf), spark, sf).withColumns({"concept": F.col("user_id") % 4, "x": V.concat_space(F.col("embedding"), F.col("clip"))})
    return cluster.detail_groups(p).select("photo_id", "concept", F.col("embed_group_id").cast("long").alias("embed_group_id"))


@query("i10_c16_claimed_concepts", f"""WITH {PHOTOS_SQL}, s AS (SELECT DISTINCT gallery_id, display_order % 10 AS segment FROM photos), cl AS (SELECT gallery_id, photo_id AS pos, (photo_id * 7) % 15 AS segment, photo_id % 4 AS concept FROM photos WHERE photo_id % 40 < 3),
f AS (SELECT gallery_id, segment, arg_min(concept, pos) AS concept FROM cl JOIN s USING (gallery_id, segment) GROUP BY 1, 2), a AS (SELECT s.*, f.concept, row_number() OVER w AS rn, lead(f.concept, 1) OVER w AS l1, lead(f.concept, 2) OVER w AS l2 FROM s LEFT JOIN f USING (gallery_id, segment) WINDOW w AS (PARTITION BY gallery_id ORDER BY segment)),
f0 AS (SELECT gallery_id, arg_min(concept, segment) AS c0 FROM f GROUP BY 1), b AS (SELECT a.*, CASE WHEN rn = 1 AND concept IS NULL THEN coalesce(l1, l2, c0) ELSE concept END AS c FROM a LEFT JOIN f0 USING (gallery_id)),
g AS (SELECT *, count(c) OVER (PARTITION BY gallery_id ORDER BY segment) AS k FROM b), h AS (SELECT gallery_id, segment, max(c) OVER (PARTITION BY gallery_id, k) AS c FROM g)
SELECT gallery_id, segment, dense_rank() OVER (PARTITION BY gallery_id ORDER BY c NULLS FIRST) - 1 AS concept FROM h""")
def i10(spark, sf):
    p = photos(spark, sf)
    segments = p.select("gallery_id", (F.col("display_order") % 10).alias("segment")).distinct()
    claims = p.filter("photo_id % 40 < 3").select("gallery_id", F.col("photo_id").alias("pos"), ((F.col("photo_id") * 7) % 15).alias("segment"), (F.col("photo_id") % 4).alias("concept"))
    return cluster.claimed_concepts(claims, segments).select("gallery_id", "segment", F.col("concept").cast("long").alias("concept"))


@query("i11_propagated_names", f"""WITH {PHOTOS_SQL}, {VECTORS_SQL}, g AS (SELECT gallery_id, subject AS concept, min(photo_id) AS group_id FROM photos GROUP BY gallery_id, subject, user_id % 3), c AS (SELECT g.*, embedding AS v, count(*) OVER (PARTITION BY g.gallery_id, g.concept) AS n, CASE WHEN group_id % 3 = 0 THEN 'd' || group_id END AS d FROM g JOIN pv ON pv.photo_id = g.group_id),
s AS (SELECT a.gallery_id, a.group_id, b.d, b.group_id AS og, round(list_dot_product(a.v, b.v), 9) AS sim FROM c a JOIN c b ON a.gallery_id = b.gallery_id AND a.concept = b.concept AND b.d IS NOT NULL WHERE a.d IS NULL AND a.n > 1),
k AS (SELECT *, row_number() OVER (PARTITION BY gallery_id, group_id ORDER BY sim DESC, og) AS r FROM s)
SELECT c.group_id, CASE WHEN n = 1 THEN '전체' ELSE coalesce(c.d, k.d) END AS detail, CASE WHEN n = 1 OR c.d IS NOT NULL THEN 'vlm' ELSE 'nearest' END AS assigned_by, CASE WHEN n = 1 OR c.d IS NOT NULL THEN 1.0 ELSE round(greatest(0.0, sim), 3) END AS confidence FROM c LEFT JOIN k ON k.gallery_id = c.gallery_id AND k.group_id = c.group_id AND r = 1""")
def i11(spark, sf):
    p = with_vectors(photos(spark, sf), spark, sf)
    g = p.groupBy("gallery_id", F.col("subject").alias("concept"), (F.col("user_id") % 3).alias("m")).agg(F.min("photo_id").alias("group_id"))
    g = g.join(p.select(F.col("photo_id").alias("group_id"), F.col("embedding").alias("centroid")), "group_id")
    named = g.filter("group_id % 3 = 0").select("gallery_id", "group_id", F.concat(F.lit("d"), F.col("group_id").cast("string")).alias("detail"))
    return cluster.propagated_names(g, named).select("group_id", "detail", "assigned_by", "confidence")


def joint_vectors(rows: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    return with_vectors(rows, spark, sf).withColumn("x", V.concat_space(F.col("embedding"), F.col("clip")))


@query("i12_full_grouping")
def i12(spark, sf):
    out = cluster.grouped_gallery(photos(spark, sf).drop("burst_id"), durable, 0.2, 200, vectors=lambda rows: joint_vectors(rows, spark, sf))
    return out.select("photo_id", "gallery_id", *[F.col(c).cast("long").alias(c) for c in ("burst_id", "segment", "unit", "concept", "embed_group_id")])


@query("i12_mode_grouping")
def i12_modes(spark, sf):
    """Galleries of both modes, and photos without a time in those that go by time."""
    timed = ~((F.col("gallery_id") % 4 == 0) & (F.col("photo_id") % 2 == 0))
    p = photos(spark, sf).drop("burst_id").withColumn("taken_at", F.when(timed, F.col("taken_at_gaps")))
    out = cluster.grouped_gallery(p, durable, 0.2, 200, vectors=lambda rows: joint_vectors(rows, spark, sf))
    return out.select("photo_id", "gallery_id", "mode", *[F.col(c).cast("long").alias(c) for c in ("burst_id", "segment", "unit", "concept", "embed_group_id")])


@query("g6_member_order", """WITH PHOTOS, VECTORS, u AS (SELECT gallery_id, user_id % 6 AS g, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM pv), m AS (SELECT gallery_id, g, i, avg(x) AS x FROM u GROUP BY ALL),
ce AS (SELECT gallery_id, g, list(x ORDER BY i) AS v FROM m GROUP BY ALL)
SELECT photo_id, user_id % 6 AS unit, row_number() OVER (PARTITION BY pv.gallery_id, user_id % 6 ORDER BY round(list_dot_product(embedding, v), 9) DESC, display_order, photo_id) - 1 AS place FROM pv JOIN ce ON ce.gallery_id = pv.gallery_id AND ce.g = user_id % 6""".replace("PHOTOS", PHOTOS_SQL).replace("VECTORS", VECTORS_SQL))
def g6(spark, sf):
    p = with_vectors(photos(spark, sf), spark, sf).withColumn("unit", F.col("user_id") % 6)
    return cluster.members_by_closeness(p).select("photo_id", "unit", F.col("place").cast("long").alias("place"))


@query("j1_j3_concat_space", f"""WITH {PHOTOS_SQL}, {VECTORS_SQL}, n AS (SELECT photo_id, embedding, clip, sqrt(list_dot_product(embedding, embedding)) AS ne, sqrt(list_dot_product(clip, clip)) AS nc FROM pv)
SELECT photo_id, round((list_dot_product(embedding, clip) / ne / nc + 1) / 2, 6) AS joint, round(list_dot_product(embedding, clip) / ne / nc, 6) AS cosine FROM n""")
def j13(spark, sf):
    p = with_vectors(photos(spark, sf), spark, sf)
    # the joint space of (e, c) against (c, c): the mean of both parts' cosines
    joint = V.dot(V.concat_space(F.col("embedding"), F.col("clip")), V.concat_space(F.col("clip"), F.col("clip")))
    return p.select("photo_id", F.round(joint, 6).alias("joint"), F.round(V.cosine("embedding", "clip"), 6).alias("cosine"))


@query("j6_one_hot", f"WITH {PHOTOS_SQL} SELECT photo_id, {', '.join(f'CAST(subject = {chr(39)}{s}{chr(39)} AS INT) AS {s}' for s in SUBJECTS[:4])} FROM photos")
def j6(spark, sf):
    return photos(spark, sf).select("photo_id", *[(F.col("subject") == s).cast("int").alias(s) for s in SUBJECTS[:4]])


@query("j8_zero_shot_label", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT vec_id, (v[1] + v[2]) / sqrt(2) / sqrt(list_dot_product(v, v)) AS a, (v[3] - v[4]) / sqrt(2) / sqrt(list_dot_product(v, v)) AS b, (v[5] + v[6]) / sqrt(2) / sqrt(list_dot_product(v, v)) AS c FROM e),
r AS (SELECT vec_id, unnest(['a', 'b', 'c']) AS label, unnest([a, b, c]) AS sc FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sc DESC, label DESC) AS r, sc - lead(sc) OVER (PARTITION BY vec_id ORDER BY sc DESC, label DESC) AS margin FROM r)
SELECT vec_id, CASE WHEN margin < 0.01 THEN 'unknown' ELSE label END AS label, round(sc, 6) AS score FROM k WHERE r = 1""")
def j8(spark, sf):
    unit = lambda **k: [float(k.get(f"x{i}", 0)) for i in range(64)]
    best = V.best_label(F.col("v"), {"a": unit(x0=1, x1=1), "b": unit(x2=1, x3=-1), "c": unit(x4=1, x5=1)})
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.withColumn("b", best).select("vec_id", F.col("b.label").alias("label"), F.round("b.score", 6).alias("score"))


@query("j9_affine_score", "SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * (i % 5))) + 0.25, 5) AS score FROM embeddings")
def j9(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.select("vec_id", F.round(V.affine_score("v", [float((i + 1) % 5) for i in range(64)], 0.25), 5).alias("score"))


@query("j10_vector_codec", "SELECT vec_id, len(embedding) AS dims, TRUE AS same FROM embeddings")
def j10(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    return e.withColumn("back", V.decode_f32(V.encode_f32("embedding"))).select("vec_id", F.size("back").cast("long").alias("dims"), (F.col("back") == F.col("embedding")).alias("same"))


