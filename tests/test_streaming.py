"""Streaming ingest: isolation of bad messages, idempotent replay, poison lists, live sessions."""

import base64
import json
import struct
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lumenflow.sources.files import fetched, golden_list, image_files, paged_source, predicate, put, result_messages, xlsx_golden
from lumenflow.streaming import ingest as S


def body(photo_id, key="k"):
    vec = base64.b64encode(struct.pack("<4f", photo_id, 2, 3, 4)).decode()
    return json.dumps({"v": 1, "galleryId": 7, "embeddingModel": "m", "photos": [{"photoId": photo_id, "storageKey": key, "previewKey": "p", "vector": vec}]})


def test_ingest_isolates_and_replays(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    lines = [("a", body(1)), ("b", "{"), ("c", body(2)), ("d", body(3, "stale"))]
    (src / "1.json").write_text("\n".join(json.dumps({"message_id": i, "body": b}) for i, b in lines))
    photos = lambda: spark.createDataFrame([(1, 7, "k", None), (2, 7, "k", None), (3, 7, "k", None)], "photo_id long, gallery_id long, storage_key string, deleted_at timestamp")
    galleries = lambda: spark.createDataFrame([(7, None)], "gallery_id long, deleted_at timestamp")
    run = lambda: S.ingest(S.message_stream(spark, str(src)), photos, galleries, out, str(tmp_path / "cp"), 4).awaitTermination()
    run()
    assert sorted(r.photo_id for r in S.latest_vectors(spark, out).collect()) == [1, 2]
    assert [r.message_id for r in spark.read.json(f"{out}/rejected").collect()] == ["b"]
    (src / "2.json").write_text(json.dumps({"message_id": "a", "body": body(1)}))
    run()
    rows = {r.photo_id: r.version for r in S.latest_vectors(spark, out).collect()}
    assert rows == {1: 1, 2: 0}


def test_poison_list(spark, tmp_path):
    rows = [(1, i, False) for i in range(3)] + [(2, 0, False), (2, 1, True), (2, 2, False)]
    spark.createDataFrame(rows, "photo_id long, at long, ok boolean").coalesce(1).write.json(str(tmp_path / "a"))
    stream = spark.readStream.schema("photo_id long, at long, ok boolean").json(str(tmp_path / "a"))
    q = S.poison_list(stream).writeStream.format("memory").queryName("poison").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert [(r.photo_id, r.failures) for r in spark.table("poison").collect()] == [(1, 3)]


def test_live_sessions(spark, tmp_path):
    t = datetime(2026, 1, 1)
    rows = [(1, t), (1, t + timedelta(seconds=200)), (1, t + timedelta(seconds=900)), (1, t + timedelta(days=1))]
    spark.createDataFrame(rows, "gallery_id long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("gallery_id long, ts timestamp").parquet(str(tmp_path / "e"))
    q = S.live_sessions(stream).writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("sessions").collect()) == [1, 2]


def test_golden_list(spark, tmp_path):
    p = tmp_path / "g.json"
    p.write_text('{"files": ["a.jpg", {"cut": "B", "file": "b.jpg"}]}')
    assert [(r.cut, r.file) for r in golden_list(spark, str(p)).orderBy("pos").collect()] == [("A", "a.jpg"), ("B", "b.jpg")]
    p.write_text('["c.jpg"]')
    assert [(r.cut, r.file) for r in golden_list(spark, str(p)).collect()] == [("A", "c.jpg")]


def test_image_files(spark, tmp_path):
    for f in ("x/y/z/1.jpg", "x/y/2.PNG", "x/3.txt", "q/4.jpeg"):
        (tmp_path / "imgs" / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "imgs" / f).write_bytes(b"0")
    got = {(r.gallery, r.name) for r in image_files(spark, str(tmp_path / "imgs")).collect()}
    assert got == {("x/y", "1.jpg"), ("x/y", "2.PNG"), ("q", "4.jpeg")}


def test_paged_source(spark):
    def pages(collection, cursor):
        n = cursor or 0
        return [f"{collection}{2 * n + k}" for k in range(2)], n + 1 if n < 2 else None

    spark.dataSource.register(paged_source("paged_test", pages))
    df = spark.read.format("paged_test").option("collections", "a,b").load()
    assert df.count() == 12 and df.select("collection").distinct().count() == 2
    assert spark.read.format("paged_test").option("collections", "a").option("maxpages", "1").load().count() == 2


def test_predicate(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "n long, s string")
    spec = {"or": [{"property": "n", "number": {"greater_than": 2}}, {"and": [{"property": "s", "text": {"contains": "x"}}]}]}
    assert [r.n for r in df.filter(predicate(spec)).orderBy("n").collect()] == [1, 3]


def test_result_messages(spark):
    df = spark.range(10).select(F.lit(7).cast("long").alias("gallery_id"), F.col("id").alias("photo_id"), F.col("id").alias("display_order"), F.lit("k").alias("storage_key"), F.lit("p").alias("preview_key"), F.lit("v").alias("vector"), F.lit("m").alias("embedding_model"))
    got = [json.loads(r.body) for r in result_messages(df).orderBy("chunk").collect()]
    assert [len(m["photos"]) for m in got] == [8, 2] and got[0]["v"] == 1


def test_xlsx_golden(spark):
    import io
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>A컷</t></si><si><t>IMG_1.JPG</t></si><si><t>title</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c t="s"><v>2</v></c></row><row><c t="s"><v>0</v></c><c t="s"><v>1</v></c></row><row><c t="inlineStr"><is><t>b</t></is></c><c t="inlineStr"><is><t>x.png</t></is></c></row></sheetData></worksheet>')
    df = spark.createDataFrame([("p", bytearray(buffer.getvalue()))], "path string, content binary")
    assert [(r.cut, r.file) for r in xlsx_golden(df).orderBy("pos").collect()] == [("A", "IMG_1.JPG"), ("B", "x.png")]


def test_fetch_and_put(spark, tmp_path):
    root = str(tmp_path)

    def writer():
        return lambda key, content: open(f"{root}/{key}", "wb").write(content)

    def getter():
        import os

        return lambda key: open(f"{root}/{key}", "rb").read() if os.path.exists(f"{root}/{key}") else None

    put(spark.createDataFrame([("a", bytearray(b"1"))], "key string, content binary"), writer)
    got = {r.key: (r.content, r.status) for r in fetched(spark.createDataFrame([("a",), ("b",)], "key string"), "key", getter).collect()}
    assert got == {"a": (b"1", "ok"), "b": (None, "missing")}


def test_gate_and_leave_one_out(spark):
    import numpy as np
    import pandas as pd

    from lumenflow.plans import preference as P

    assert P.gate({1: pd.DataFrame()})["reasons"] == ["fewer than 2 galleries"]

    def results(n, better):
        return pd.DataFrame([(g, s, 0.5 + (0.1 * (g < better) if s == "fused" else 0)) for g in range(n) for s in ("prior", "fused")], columns=["gallery_id", "score", "recall_burst"])

    assert P.gate({m: results(m, m) for m in range(5, 9)})["passed"]
    bad = P.gate({m: results(m, 2) for m in range(5, 9)})
    assert not bad["passed"] and "not significant" in bad["reasons"]
    assert np.isclose(bad["mean_diff"], 0.025)
