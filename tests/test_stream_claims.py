"""Lease timers, unanswered photos, the sink of messages and the cursor source, each with a restart."""

import json
import os
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumenflow.operators.scan import lease_claims
from lumenflow.sources import streams
from lumenflow.streaming import leases

EVENTS = "photo_id long, kind string, worker string, seq long"


def put_rows(folder, name, rows, columns):
    """One JSON-lines file that appears at once."""
    os.makedirs(folder, exist_ok=True)
    part = f"{folder}/.{name}"
    with open(part, "w") as f:
        f.write("\n".join(json.dumps(dict(zip(columns, r))) for r in rows))
    os.replace(part, f"{folder}/{name}.json")


@pytest.fixture
def timers(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    leases.timers_available(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def wait_for(check, seconds=60):
    end = time.monotonic() + seconds
    while time.monotonic() < end:
        if (found := check()) is not None:
            return found
        time.sleep(0.3)
    raise AssertionError("timed out")


def test_leases_run_out_without_a_new_row(spark, tmp_path, timers):
    src, out, lease = str(tmp_path / "in"), str(tmp_path / "out"), 10.0
    columns = ["photo_id", "kind", "worker", "seq"]
    put_rows(src, "0", [(100, "ready", None, 0)], columns)  # workers are up before a lease begins
    first = [(1, "ready", None, 0), (2, "ready", None, 0), (3, "ready", None, 0), (1, "claim", "w1", 1), (1, "claim", "w2", 2), (2, "claim", "w1", 1), (9, "claim", "w1", 1), (3, "claim", "w3", 1), (3, "scored", "w3", 2), (3, "claim", "w1", 3)]

    def start():
        rows = leases.lease_stream(spark.readStream.schema(EVENTS).json(src), lease)
        return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()

    def log():
        return spark.read.schema(leases.LEASE_ROWS).parquet(out)

    def seen(photo, event, n=1):
        return lambda: (r if len(r := log().filter((F.col("photo_id") == photo) & (F.col("event") == event)).orderBy("at").collect()) >= n else None) if os.path.exists(f"{out}/_spark_metadata") else None

    q = start()
    try:
        wait_for(seen(100, "claimable"))
        put_rows(src, "a", first, columns)
        granted = wait_for(seen(1, "granted"))[0]
        assert granted.worker == "w1" and (granted.until - granted.at).total_seconds() == lease
        put_rows(src, "b", [(1, "renew", "w1", 3), (1, "renew", "w2", 4)], columns)
        renewed = wait_for(seen(1, "renewed"))[0]
        q.stop()
        q = start()  # from the checkpoint: leases and timers are still there
        again = wait_for(seen(1, "claimable", 2))[1]
        assert again.at >= renewed.until and again.worker == "w1"
        other = wait_for(seen(2, "claimable", 2))[1]
        assert (other.at - wait_for(seen(2, "granted"))[0].at).total_seconds() >= lease
        put_rows(src, "c", [(1, "claim", "w2", 5)], columns)
        wait_for(seen(1, "granted", 2))
    finally:
        q.stop()
    rows = log().orderBy("at").collect()
    assert [r.event for r in rows if r.photo_id == 3] == ["claimable", "granted", "scored", "refused"]
    assert sorted(r.worker for r in rows if r.photo_id == 1 and r.event == "refused") == ["w2", "w2"]
    assert [(r.event, r.worker) for r in rows if r.photo_id == 9] == [("refused", "w1")]
    # at each instant the table form gives the photos that the stream has as free
    none = spark.createDataFrame([], "photo_id long")
    for at in {r.at for r in rows}:
        now = at + timedelta(milliseconds=1)
        state = {}
        for r in rows:
            if r.at <= now and r.event != "refused":
                state[r.photo_id] = r
        free = {p for p, r in state.items() if r.event == "claimable" or (r.event in ("granted", "renewed") and r.until < now)}
        table = leases.lease_table(log(), now)
        assert {r.photo_id for r in lease_claims(table, none, F.lit(now), int(lease), 100).collect()} == free


def test_photos_without_a_result(spark, tmp_path):
    t = datetime(2026, 3, 1, 12)
    at = lambda m: (t + timedelta(minutes=m)).isoformat()
    ready, results, out = str(tmp_path / "ready"), str(tmp_path / "results"), str(tmp_path / "out")

    def run():
        a = spark.readStream.schema("photo_id long, ready_at timestamp").json(ready)
        b = spark.readStream.schema("photo_id long, done_at timestamp").json(results)
        q = leases.unanswered(a, b).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    put_rows(ready, "1", [(1, at(0)), (2, at(0)), (3, at(1)), (4, at(2))], ["photo_id", "ready_at"])
    put_rows(results, "1", [(1, at(5)), (1, at(5)), (3, at(20)), (77, at(1))], ["photo_id", "done_at"])
    run()
    put_rows(ready, "2", [(5, at(60))], ["photo_id", "ready_at"])
    put_rows(results, "2", [(5, at(61)), (4, at(60))], ["photo_id", "done_at"])
    run()
    put_rows(ready, "3", [(6, at(200))], ["photo_id", "ready_at"])
    put_rows(results, "3", [(6, at(201))], ["photo_id", "done_at"])
    run()
    got = spark.read.schema("photo_id long, ready_at timestamp").parquet(out)
    assert sorted(r.photo_id for r in got.collect()) == [2, 3, 4]


def test_messages_are_published_by_batch(spark, tmp_path):
    src, out, fail = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "fail")
    schema = "gallery_id long, chunk long, body string"
    spark.dataSource.register(streams.message_sink("message_sink", size=1000))
    columns = ["gallery_id", "chunk", "body"]

    def start():
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(src)
        fails = F.udf(lambda b: b if not (os.path.exists(fail) and b == "poison") else 1 / 0, "string")
        return rows.withColumn("body", fails("body")).repartition(3).writeStream.format("message_sink").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()

    put_rows(src, "1", [(7, k, f"m{k}") for k in range(20)], columns)
    start().awaitTermination()
    open(fail, "w").close()
    put_rows(src, "2", [(8, k, "poison" if k == 11 else f"n{k}") for k in range(20)], columns)
    with pytest.raises(Exception):
        start().awaitTermination()
    bodies = lambda: sorted(r.body for r in streams.published(spark, out, schema).collect())
    assert bodies() == sorted(f"m{k}" for k in range(20))  # nothing of the failed batch
    os.remove(fail)
    start().awaitTermination()
    want = sorted([f"m{k}" for k in range(20)] + [f"n{k}" for k in range(20) if k != 11] + ["poison"])
    assert bodies() == want
    # the last batch is written again, as after a crash between the sink's commit and the engine's
    commits = sorted((p for p in os.listdir(tmp_path / "cp" / "commits") if p.isdigit()), key=int)
    os.remove(tmp_path / "cp" / "commits" / commits[-1])
    crc = tmp_path / "cp" / "commits" / f".{commits[-1]}.crc"
    if crc.exists():
        crc.unlink()
    start().awaitTermination()
    assert bodies() == want and len(os.listdir(f"{out}/manifests")) == 2


def test_a_message_too_large_fails(spark, tmp_path):
    spark.dataSource.register(streams.message_sink("small_sink", size=10))
    put_rows(str(tmp_path / "in"), "1", [(7, 0, "x" * 11)], ["gallery_id", "chunk", "body"])
    rows = spark.readStream.schema("gallery_id long, chunk long, body string").json(str(tmp_path / "in"))
    with pytest.raises(Exception, match="over 10 bytes"):
        rows.writeStream.format("small_sink").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()


def test_pages_are_read_once(spark, tmp_path):
    data = str(tmp_path / "api.json")

    def pages(content):
        with open(f"{data}.part", "w") as f:
            json.dump(content, f)
        os.replace(f"{data}.part", data)

    def fetch(collection, cursor):
        with open(data) as f:
            own = json.load(f)[collection]
        at = int(cursor or 0)
        return own[at], str(at + 1) if at + 1 < len(own) else None

    spark.dataSource.register(streams.cursor_source("cursor_test", fetch))

    def run(name):
        q = spark.readStream.format("cursor_test").option("collections", "a,b").option("maxpages", 3).load()
        q = q.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
        try:
            want = sorted(x for own in name.values() for p in own for x in p)
            wait_for(lambda: True if os.path.exists(tmp_path / "out" / "_spark_metadata") and sorted(r.body for r in spark.read.schema("collection string, cursor string, pos int, body string").parquet(str(tmp_path / "out")).collect()) == want else None)
        finally:
            q.stop()

    content = {"a": [[f"a{p}{k}" for k in range(4)] for p in range(5)], "b": [["b00"]]}
    pages(content)
    run(content)
    content["a"][4].append("a44")
    content["a"] += [["a50", "a51"], []]
    content["b"] += [["b10"]]
    pages(content)
    run(content)  # a new reader, from the checkpoint
    content["a"][6].append("a60")
    pages(content)
    run(content)
