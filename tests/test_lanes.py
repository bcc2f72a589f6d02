"""Lanes over one state (order, idle stop, abort, poison, replay) and summaries of runs."""

import json
import time

import pytest
from pyspark.sql import functions as F

from lumenflow.streaming import ingest
from lumenflow.streaming.lanes import FAST, QUALITY, Lanes
from lumenflow.streaming.summaries import RunLog, run_totals


class Clock:
    t = 0.0

    def __call__(self):
        return self.t


@pytest.fixture
def candidates(spark):
    rows = [(p, FAST) for p in (1, 2, 3, 4, 5)] + [(p, QUALITY) for p in (1, 2, 6)] + [(1, FAST), (None, FAST)]
    return lambda: spark.createDataFrame(rows, "photo_id long, stage int")


def all_ok(claimed):
    return claimed.select("photo_id", F.lit("ok").alias("status"))


def done(lanes):
    return sorted((r.photo_id, r.stage, r.status) for r in lanes.outcomes().collect())


def test_fast_goes_first_and_failures_are_poison(spark, tmp_path, candidates):
    clock, seen = Clock(), []

    def work(claimed):
        seen.append(sorted((r.photo_id, r.stage) for r in claimed.collect()))
        return claimed.select("photo_id", F.when(F.col("photo_id") == 2, "failed").otherwise("ok").alias("status"))

    lanes = Lanes(spark, candidates, work, str(tmp_path), batch=3, idle_seconds=10, now=clock)
    for k in range(3):
        lanes.step(k % 2, k)
    # photo 2 failed in the fast stage, so the quality stage never takes it
    assert seen == [[(1, FAST), (2, FAST), (3, FAST)], [(1, QUALITY), (4, FAST), (5, FAST)], [(6, QUALITY)]]
    assert lanes.summary["batches"] == 3 and lanes.summary["processed"] == 6 and lanes.summary["failed"] == 1
    lanes.step(1, 3)
    clock.t = 9.0
    lanes.step(0, 4)
    assert not lanes.summary["idle_stopped"]
    clock.t = 10.0
    lanes.step(1, 5)
    assert lanes.summary["idle_stopped"] and len(seen) == 3


def test_claims_hold_until_their_lease_runs_out(spark, tmp_path, candidates):
    clock = Clock()
    lanes = Lanes(spark, candidates, all_ok, str(tmp_path), batch=3, lease_seconds=100, now=clock)
    ids = lambda df: sorted(r.photo_id for r in df.collect())
    assert ids(lanes.claim(0, 0)) == [1, 2, 3]
    assert ids(lanes.claim(1, 0)) == [4, 5, 6]
    assert lanes.claim(1, 1) is None
    assert ids(lanes.claim(0, 0)) == [1, 2, 3]  # replayed: the same claim
    clock.t = 101.0
    assert ids(lanes.claim(1, 2)) == [1, 2, 3]


def test_a_replayed_batch_counts_once(spark, tmp_path, candidates):
    first = Lanes(spark, candidates, all_ok, str(tmp_path), batch=3, now=Clock())
    first.step(0, 0)
    again = Lanes(spark, candidates, all_ok, str(tmp_path), batch=3, now=Clock())
    again.step(0, 0)
    assert [r.photo_id for r in again.results().orderBy("photo_id").collect()] == [1, 2, 3]


def test_failures_in_a_row_abort(spark, tmp_path, candidates):
    left = [True, False, True, True, True]

    def work(claimed):
        if left.pop(0):
            raise ValueError("no encoder")
        return all_ok(claimed)

    lanes = Lanes(spark, candidates, work, str(tmp_path), batch=2, failures=2, now=Clock())
    for k in range(4):
        lanes.step(k % 2, k)
    assert lanes.summary["aborted"] and lanes.summary["batches"] == 1 and len(lanes.summary["errors"]) == 3 and "no encoder" in lanes.summary["errors"][0]
    lanes.step(0, 4)
    assert len(left) == 1  # nothing is started any more
    assert done(lanes) == [(1, FAST, "ok"), (2, FAST, "ok")]
    assert sorted(r.photo_id for r in lanes.open_photos().filter(F.col("stage") == FAST).collect()) == [3, 4, 5]  # given back


def test_lanes_run_as_streams(spark, tmp_path, candidates):
    lanes = Lanes(spark, candidates, all_ok, str(tmp_path), batch=4, idle_seconds=1)
    got = lanes.run(timeout=60)
    assert got["idle_stopped"], got
    assert not got["errors"] and got["processed"] == 8
    assert done(lanes) == sorted([(p, FAST, "ok") for p in (1, 2, 3, 4, 5)] + [(p, QUALITY, "ok") for p in (1, 2, 6)])
    assert {r.lane for r in lanes.results().collect()} <= {0, 1}


def test_summary_of_a_batch_job(spark, tmp_path):
    log = RunLog("r1")
    df = spark.range(10).select("id", F.expr("case when id < 6 then 'ok' when id < 8 then 'skipped' when id = 8 then 'failed' end").alias("status"))
    seen, end = log.batch(df, "score", "status")
    with end:
        seen.write.parquet(str(tmp_path / "out"))
    broken, end = log.batch(df.withColumn("x", F.raise_error(F.lit("bad"))), "broken", "status")
    with pytest.raises(Exception, match="bad"), end:
        broken.write.parquet(str(tmp_path / "none"))
    (row,) = log.table(spark).collect()
    assert row[:8] == ("r1", "score", 0, 10, 6, 2, 1, 1) and row.seconds > 0


def test_summary_of_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k, n in enumerate((3, 5)):
        (src / f"{k}.json").write_text("\n".join(json.dumps({"message_id": str(i), "body": "{"}) for i in range(n)))
    log = RunLog("r2")
    with log.listening(spark):
        s = log.stream(ingest.message_stream(spark, str(src), files=1), "read", F.when(F.col("body") == "{", "failed"))
        s.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        until = time.monotonic() + 20
        while len(log.rows()) < 2 and time.monotonic() < until:
            time.sleep(0.1)
    (t,) = run_totals(log.table(spark)).collect()
    assert (t.batches, t.targets, t.failed, t.remaining) == (2, 8, 8, 0)
    photos = lambda: spark.createDataFrame([], "photo_id long, gallery_id long, storage_key string, deleted_at timestamp")
    galleries = lambda: spark.createDataFrame([], "gallery_id long, deleted_at timestamp")
    log = RunLog("r3")
    ingest.ingest(ingest.message_stream(spark, str(src), files=1), photos, galleries, str(tmp_path / "out"), str(tmp_path / "c2"), 4, log).awaitTermination()
    (t,) = run_totals(log.table(spark)).collect()
    assert (t.stage, t.batches, t.targets, t.processed, t.failed) == ("ingest", 2, 8, 0, 8)
