"""Run summaries while jobs run: observed metrics of batches and streams, without a second scan."""

from __future__ import annotations

import threading
import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: What a summary row holds; remaining: targets without any outcome.
SUMMARY_ROWS = "run string, stage string, batch long, targets long, processed long, skipped long, failed long, remaining long, seconds double"


def outcome_counts(status: str | Column) -> list[Column]:
    """Aggregates of a status column: ``ok``, ``skipped``, ``failed``, or null where nothing has happened yet."""
    s = F.col(status) if isinstance(status, str) else status
    one = lambda v: F.count_if(s == v)
    return [F.count(F.lit(1)).alias("targets"), one("ok").alias("processed"), one("skipped").alias("skipped"), one("failed").alias("failed")]


class RunLog(StreamingQueryListener):
    """The summaries of one run's stages, in the order in which they ended.

    Counts come with the work itself: Spark adds them up in its tasks and hands
    them over at the end of a job or micro-batch. A task that is tried again
    counts once. A micro-batch that is replayed replaces its row.
    """

    def __init__(self, run: str):
        self.run, self._rows, self._lock = run, {}, threading.Lock()
        self._stages: set[str] = set()

    def _put(self, stage: str, batch: int, m: dict, seconds: float) -> None:
        done = m["processed"] + m["skipped"] + m["failed"]
        with self._lock:
            self._rows.pop((stage, batch), None)
            self._rows[stage, batch] = (self.run, stage, batch, m["targets"], m["processed"], m["skipped"], m["failed"], m["targets"] - done, seconds)

    def stream(self, df: DataFrame, stage: str, status: str | Column) -> DataFrame:
        """A stream whose micro-batches are summed up; the log must be a listener of the session (``listening``)."""
        self._stages.add(stage)
        return df.observe(stage, *outcome_counts(status))

    def batch(self, df: DataFrame, stage: str, status: str | Column, batch: int = 0) -> tuple[DataFrame, StageEnd]:
        """A table whose first action is summed up once ``with`` its end is left without an error."""
        seen = Observation(f"{self.run}-{stage}-{batch}-{time.monotonic_ns()}")
        return df.observe(seen, *outcome_counts(status)), StageEnd(self, stage, batch, seen)

    def listening(self, spark: SparkSession) -> Listening:
        return Listening(self, spark)

    def rows(self) -> list[tuple]:
        with self._lock:
            return list(self._rows.values())

    def table(self, spark: SparkSession) -> DataFrame:
        """A row for each stage and batch: some thousand for a long run."""
        return spark.createDataFrame(self.rows(), SUMMARY_ROWS)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        for stage, row in p.observedMetrics.items():
            if stage in self._stages:
                self._put(stage, p.batchId, row.asDict(), p.batchDuration / 1000.0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


class StageEnd:
    """Times an action and takes its counts to the log; a stage that fails leaves no row."""

    def __init__(self, log: RunLog, stage: str, batch: int, seen: Observation):
        self.log, self.stage, self.batch, self.seen = log, stage, batch, seen

    def __enter__(self) -> None:
        self.began = time.monotonic()

    def __exit__(self, kind, error, trace) -> None:
        if kind is None:
            self.log._put(self.stage, self.batch, self.seen.get, time.monotonic() - self.began)


class Listening:
    """The log as a listener for as long as the block lasts."""

    def __init__(self, log: RunLog, spark: SparkSession):
        self.log, self.spark = log, spark

    def __enter__(self) -> RunLog:
        self.spark.streams.addListener(self.log)
        return self.log

    def __exit__(self, kind, error, trace) -> None:
        self.spark.streams.removeListener(self.log)


def run_totals(summaries: DataFrame) -> DataFrame:
    """(run, stage, …): what all batches of a stage come to."""
    sums = [F.sum(c).alias(c) for c in ("targets", "processed", "skipped", "failed", "remaining", "seconds")]
    return summaries.groupBy("run", "stage").agg(F.count(F.lit(1)).alias("batches"), *sums)
