"""Structured Streaming: message ingest with failure isolation, leases and poison lists, live sessions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import nullcontext

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenflow.operators.merge import accepted, last_wins
from lumenflow.operators.scan import message_error, message_rows
from lumenflow.streaming.summaries import RunLog


def message_stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """(message_id, body) of JSON-lines files; ``files`` bounds a micro-batch."""
    return spark.readStream.schema("message_id string, body string").option("maxFilesPerTrigger", files).json(path)


def ingest(messages: DataFrame, photos: Callable[[], DataFrame], galleries: Callable[[], DataFrame], out: str, checkpoint: str, dim: int, log: RunLog | None = None):
    """Starts the ingest query: valid photos go to ``out``/vectors as one append, bad messages to ``out``/rejected.

    Rows carry batch_id and a sequence, so a reader takes the latest of each
    photo; a batch that is replayed overwrites its own folder, which makes
    at-least-once delivery idempotent. ``log`` gets each batch's summary from the
    same pass that writes the bad messages.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumns({"error": message_error("body", dim), "seq": F.monotonically_increasing_id()}).persist()
        status = F.when(F.col("error").isNull(), "ok").otherwise("failed")
        seen, end = log.batch(batch, "ingest", status, batch_id) if log else (batch, nullcontext())
        with end:
            seen.filter("error is not null").select("message_id", "body", "error").write.mode("overwrite").json(f"{out}/rejected/batch_id={batch_id}")
        rows = last_wins(message_rows(batch.filter("error is null").select("message_id", "seq", "body")), "photo_id", "seq")
        live = accepted(rows, photos(), galleries())
        live.drop("body").write.mode("overwrite").parquet(f"{out}/vectors/batch_id={batch_id}")
        batch.unpersist()

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_vectors(spark: SparkSession, out: str) -> DataFrame:
    """The current vector of each photo with its version: replays change nothing but the version."""
    v = spark.read.parquet(f"{out}/vectors")
    w = Window.partitionBy("photo_id")
    return v.withColumns({"_n": F.row_number().over(w.orderBy(F.desc("batch_id"), F.desc("seq"))), "version": F.count(F.lit(1)).over(w) - 1}).filter("_n = 1").drop("_n")


POISON_STATE = "failures int"


def poison_list(attempts: DataFrame, limit: int = 3) -> DataFrame:
    """Photos whose attempts (photo_id, ok) failed ``limit`` times in a row; a success clears the count."""

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        before = n
        for pdf in batches:
            for ok in pdf.sort_values("at")["ok"]:
                n = 0 if ok else n + 1
        state.update((n,))
        if n >= limit > before:
            yield pd.DataFrame({"photo_id": [key[0]], "failures": [n]})

    return attempts.groupBy("photo_id").applyInPandasWithState(count, "photo_id long, failures int", POISON_STATE, "append", GroupStateTimeout.NoTimeout)


def live_sessions(events: DataFrame, gap: str = "300 seconds", late: str = "10 minutes") -> DataFrame:
    """Sessions of a stream of photos by gallery, closed by the watermark."""
    s = events.withWatermark("ts", late).groupBy("gallery_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return s.select("gallery_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deadline_stop(batches: DataFrame, margin: float, by: str = "run_id") -> DataFrame:
    """stop: whether a run ends before a batch, as less time remains than its longest batch so far and the margin."""
    w = Window.partitionBy(by).orderBy("batch")
    longest = F.coalesce(F.max("seconds").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return batches.withColumn("stop", F.col("remaining") < longest + margin)
