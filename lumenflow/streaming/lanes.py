"""Workers' lanes: streams that claim batches of photos from one shared state, the fast stage before the quality stage."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenflow.operators.scan import staged
from lumenflow.plans.tables import remove

FAST, QUALITY = 0, 1
CLAIMS = "photo_id long, stage int, claimed_at double, lane int, batch_id long"
RESULTS = "photo_id long, stage int, status string, lane int, batch_id long"


class Lanes:
    """Two lanes (or more) over one state folder; ``run`` gives back a summary.

    ``candidates()`` gives (photo_id, stage) of the photos that could be worked on;
    ``work(claimed)`` takes (photo_id, stage) and gives (photo_id, status), ``ok``
    or ``failed``. A lane is a stream with a clock as its source: while one lane's
    jobs run, the other claims and starts its own batch.

    * A claim is written before its work starts and holds for ``lease_seconds``; one
      lane claims at a time, so no photo goes to two. All of the fast stage goes
      before any of the quality stage.
    * Results and claims lie in a folder for each lane and micro-batch. A batch that
      is replayed after a restart has its old claim, and its results replace those
      it may have left.
    * A photo whose lease runs out without a result is claimed again; ``outcomes`` has
      one row for each photo and stage, should both come back.
    * A photo that failed once is poison: no stage takes it again. A batch whose
      work raises is given back.
    * Lanes stop once ``failures`` batches in a row raised (aborted), or when nothing
      could be claimed for ``idle_seconds`` while no lane was at work (idle).

    Photos that come twice among the candidates are worked on once; a null photo_id never.
    """

    def __init__(self, spark: SparkSession, candidates: Callable[[], DataFrame], work: Callable[[DataFrame], DataFrame], state: str, *, batch: int = 8, lease_seconds: float = 600, idle_seconds: float = 60, failures: int = 5, lanes: int = 2, now: Callable[[], float] = time.time):
        self.spark, self.candidates, self.work, self.state = spark, candidates, work, state.rstrip("/")
        self.size, self.lease, self.idle, self.most, self.lanes, self.now = batch, lease_seconds, idle_seconds, failures, lanes, now
        self.summary = {"batches": 0, "processed": 0, "failed": 0, "idle_stopped": False, "aborted": False, "errors": []}
        self._claiming, self._counting, self._over = threading.RLock(), threading.Lock(), threading.Event()
        self._in_a_row, self._at_work, self._idle_since = 0, 0, None
        for name, schema in (("claims", CLAIMS), ("results", RESULTS)):  # so that there is a table from the start
            spark.createDataFrame([], schema).drop("lane", "batch_id").write.mode("ignore").parquet(f"{self._folder(name, -1, -1)}")

    def _folder(self, name: str, lane: int, batch_id: int) -> str:
        return f"{self.state}/{name}/lane={lane}/batch_id={batch_id}"

    def claims(self) -> DataFrame:
        return self.spark.read.schema(CLAIMS).parquet(f"{self.state}/claims")

    def results(self) -> DataFrame:
        return self.spark.read.schema(RESULTS).parquet(f"{self.state}/results")

    def outcomes(self) -> DataFrame:
        """(photo_id, stage, status): of several results the best."""
        return self.results().groupBy("photo_id", "stage").agg(F.max("status").alias("status"))

    def open_photos(self) -> DataFrame:
        """(photo_id, stage) that nobody holds or has done, without poison."""
        results = self.results()
        ready = self.candidates().select(F.col("photo_id").cast("long").alias("photo_id"), F.col("stage").cast("int").alias("stage")).filter("photo_id is not null").distinct()
        done = results.select("photo_id", "stage")
        # a claim whose stage has its result holds no more
        held = self.claims().filter(F.col("claimed_at") > self.now() - self.lease).join(done, ["photo_id", "stage"], "left_anti").select("photo_id")
        return ready.join(done, ["photo_id", "stage"], "left_anti").join(results.filter("status = 'failed'").select("photo_id"), "photo_id", "left_anti").join(held, "photo_id", "left_anti")

    def claim(self, lane: int, batch_id: int) -> DataFrame | None:
        """The photos of a lane's batch, written as claimed; None if there are none."""
        path = self._folder("claims", lane, batch_id)
        with self._claiming:
            if not self._written(path):
                ready = self.open_photos()
                rows = staged(ready.filter(F.col("stage") == FAST).select("photo_id"), ready.filter(F.col("stage") == QUALITY).select("photo_id"), self.size)
                rows.select("photo_id", "stage", F.lit(float(self.now())).alias("claimed_at")).coalesce(1).write.mode("overwrite").parquet(path)
            mine = self.spark.read.schema("photo_id long, stage int, claimed_at double").parquet(path).select("photo_id", "stage")
            if mine.isEmpty():
                remove(self.spark, path)
                return None
            return mine

    def _written(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def step(self, lane: int, batch_id: int) -> None:
        """One micro-batch of a lane: claim, work, write; what happens goes into the summary."""
        if self._over.is_set():
            return
        mine = None
        try:
            with self._claiming:  # who finds nothing after this lane's claim sees it at work
                mine = self.claim(lane, batch_id)
                with self._counting:
                    self._at_work += mine is not None
            if mine is not None:
                done = self.work(mine).select("photo_id", "status").join(mine, "photo_id").select("photo_id", "stage", "status")
                done.write.mode("overwrite").parquet(self._folder("results", lane, batch_id))
                n = {r.status: r["count"] for r in self.spark.read.parquet(self._folder("results", lane, batch_id)).groupBy("status").count().collect()}
        except Exception as error:  # the batch goes back, the lane goes on until too many fail in a row
            if self._over.is_set():  # stopped at work: a restart takes the same claim again
                raise
            remove(self.spark, self._folder("claims", lane, batch_id))
            with self._counting:
                self._at_work -= mine is not None
                self._in_a_row += 1
                self._idle_since = None
                self.summary["errors"].append(f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}")
                if 0 < self.most <= self._in_a_row:
                    self.summary["aborted"] = True
                    self._over.set()
            return
        with self._counting:
            self._at_work -= mine is not None
            if mine is not None:
                self._in_a_row, self._idle_since = 0, None
                self.summary["batches"] += 1
                self.summary["processed"] += n.get("ok", 0)
                self.summary["failed"] += n.get("failed", 0)
            elif self._at_work == 0:
                self._idle_since = self.now() if self._idle_since is None else self._idle_since
                if self.now() - self._idle_since >= self.idle:
                    self.summary["idle_stopped"] = True
                    self._over.set()

    def run(self, poll: str = "1 second", timeout: float | None = None) -> dict:
        """Starts the lanes and waits until they are idle or aborted (or for ``timeout`` seconds)."""
        queries = []
        for lane in range(self.lanes):
            clock = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
            start = clock.writeStream.foreachBatch(lambda _, batch_id, lane=lane: self.step(lane, batch_id))
            queries.append(start.option("checkpointLocation", f"{self.state}/checkpoints/lane={lane}").trigger(processingTime=poll).start())
        self._over.wait(timeout)
        self._over.set()  # a lane that is between batches starts no other
        for q in queries:
            q.stop()
        return dict(self.summary)
