"""Claims of photos as streams: leases that run out by timers, and photos whose result never came."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Timers and state that expires need this store.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a lease stream gives: grants and refusals of claims, and photos that can be claimed (again).
LEASE_ROWS = "photo_id long, event string, worker string, at timestamp, until timestamp"


def timers_available(spark: SparkSession) -> None:
    """Chooses the state store for the queries that are started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class LeaseBook(StatefulProcessor):
    """One photo's lease: who holds it and until when (milliseconds).

    Events (kind, worker): ``ready`` makes a photo claimable, ``claim`` grants it
    to the first worker that asks, ``renew`` by its holder makes the lease last
    anew, ``release`` gives it back, and ``scored`` or ``failed`` end it. A lease
    that isn't renewed runs out by a timer: the photo is claimable again without
    any new row. What is done is remembered for ``keep_ms``, so a claim that comes
    late is refused; then the state goes by its time to live.
    """

    def __init__(self, lease_ms: int, keep_ms: int):
        self.lease_ms, self.keep_ms = lease_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "worker string, until long")
        self.open = handle.getValueState("open", "since long")
        self.done = handle.getValueState("done", "at long", self.keep_ms)

    def _row(self, key: tuple, event: str, worker: str | None, at: int, until: int | None = None) -> tuple:
        return key[0], event, worker, pd.Timestamp(at, unit="ms"), None if until is None else pd.Timestamp(until, unit="ms")

    def _held(self, worker: str, until: int) -> None:
        """A timer of an earlier lease stays; when it fires, the lease says that it isn't over."""
        self.lease.update((worker, until))
        self.handle.registerTimer(until)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentProcessingTimeInMs(), []
        events = pd.concat(list(rows)).sort_values(["seq", "kind", "worker"], na_position="first")
        for kind, worker in zip(events["kind"], events["worker"], strict=True):
            holder = self.lease.get()[0] if self.lease.exists() else None
            if kind in ("scored", "failed"):
                if not self.done.exists():
                    out.append(self._row(key, kind, worker, now))
                self.lease.clear()
                self.open.clear()
                self.done.update((now,))
            elif self.done.exists():
                if kind in ("claim", "renew"):
                    out.append(self._row(key, "refused", worker, now))
            elif kind == "ready":
                if holder is None and not self.open.exists():
                    self.open.update((now,))
                    out.append(self._row(key, "claimable", None, now))
            elif kind == "claim":
                if holder is None and self.open.exists():
                    self.open.clear()
                    self._held(worker, now + self.lease_ms)
                    out.append(self._row(key, "granted", worker, now, now + self.lease_ms))
                else:
                    out.append(self._row(key, "refused", worker, now))
            elif kind == "renew":
                if holder is not None and holder == worker:
                    self._held(worker, now + self.lease_ms)
                    out.append(self._row(key, "renewed", worker, now, now + self.lease_ms))
                else:
                    out.append(self._row(key, "refused", worker, now))
            elif kind == "release" and holder is not None and holder == worker:
                self.lease.clear()
                self.open.update((now,))
                out.append(self._row(key, "claimable", None, now))
        if out:
            yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.lease.exists() and self.lease.get()[1] <= expiredTimerInfo.getExpiryTimeInMs():
            worker, now = self.lease.get()[0], timerValues.getCurrentProcessingTimeInMs()
            self.lease.clear()
            self.open.update((now,))
            yield _frame([self._row(key, "claimable", worker, now)])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["photo_id", "event", "worker", "at", "until"])
    return out.assign(at=pd.to_datetime(out["at"]), until=pd.to_datetime(out["until"]))


def lease_stream(events: DataFrame, lease_seconds: float = 120, keep_seconds: float = 86_400) -> DataFrame:
    """Rows (photo_id, event, worker, at, until) of a stream of lease events (photo_id, kind, worker, seq).

    Events of one batch are taken by ``seq``. The clock is the batch's, so an
    event that is replayed after a failure of the batch gives one result. Timers
    fire in batches, and a query that is started again runs none before new data
    come; so a clock of one row a second, which reaches no lease, is a source too.
    Call ``timers_available`` before the query is started.
    """
    beat = events.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load()
    none = F.lit(None).cast("string")
    beat = beat.select(F.when(F.col("value") < 0, F.col("value")).alias("photo_id"), none.alias("kind"), none.alias("worker"), F.lit(0).cast("long").alias("seq"))  # always null
    book = LeaseBook(int(lease_seconds * 1000), int(keep_seconds * 1000))
    rows = events.select(F.col("photo_id").cast("long").alias("photo_id"), "kind", "worker", F.col("seq").cast("long").alias("seq")).unionByName(beat)
    return rows.filter("photo_id is not null").groupBy("photo_id").transformWithStateInPandas(book, LEASE_ROWS, "append", "processingTime")


def lease_table(log: DataFrame, now) -> DataFrame:
    """The photos of a lease stream's rows as an analysis table (photo_id, has_clip, quality_scored_at, claimed_at, error) at an instant.

    What ``lease_claims`` gives for it are the photos that the stream has as
    claimable by then, or as held by a lease that has run out.
    """
    until = log.filter(F.col("at") <= F.lit(now))
    order = F.struct("at", F.when(F.col("event") == "claimable", 1).when(F.col("event").isin("granted", "renewed"), 2).otherwise(3))
    last = until.filter(F.col("event") != "refused").groupBy("photo_id").agg(F.max_by(F.struct("event", "at"), order).alias("l"))
    return last.select(
        "photo_id",
        F.lit(True).alias("has_clip"),
        F.when(F.col("l.event") == "scored", F.col("l.at")).alias("quality_scored_at"),
        F.when(F.col("l.event").isin("granted", "renewed"), F.col("l.at")).alias("claimed_at"),
        F.when(F.col("l.event") == "failed", "FAILED").alias("error"),
    )


def unanswered(ready: DataFrame, results: DataFrame, within: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """Photos (photo_id, ready_at) of a stream whose result didn't come ``within`` the time: an anti join of two streams.

    ``ready`` (photo_id, ready_at) and ``results`` (photo_id, done_at) are joined
    outward under watermarks and the time bound, so state is kept for that time
    only. A photo is given once both watermarks say that no result can come any
    more. A result that comes after the bound doesn't answer, one that comes twice
    answers once, and one for an unknown photo does nothing.
    """
    left = ready.select(F.col("photo_id").cast("long").alias("photo_id"), "ready_at").withWatermark("ready_at", late)
    right = results.select(F.col("photo_id").cast("long").alias("answered"), "done_at").withWatermark("done_at", late).dropDuplicatesWithinWatermark(["answered"])
    on = (F.col("photo_id") == F.col("answered")) & (F.col("done_at") >= F.col("ready_at")) & (F.col("done_at") <= F.col("ready_at") + F.expr(f"INTERVAL {within}"))
    return left.join(right, on, "left_outer").filter("answered is null").select("photo_id", "ready_at")
