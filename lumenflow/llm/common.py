"""Session helpers of the training-data operators: scratch tables in the shared folder, and Arrow plumbing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenflow.plans.tables import durable as stored
from lumenflow.plans.tables import made, remove, scratch_path

__all__ = ["Scratch", "lower_ascii", "made", "map_arrow", "map_batches", "quoted", "remove", "row_struct", "scratch_path", "small", "stored", "table"]

#: Bytes of an Arrow batch that goes to a Python worker (or one row, where a row is longer).
BATCH_BYTES = 4 << 20
#: Rows of one or two numbers that may be broadcast; beyond that a join is shuffled.
BROADCAST_ROWS = 500_000
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables of one job in a folder of their own, which goes as a whole once nothing reads them any more."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path, self.n = spark, scratch_path(spark, label), 0

    def stored(self, df: DataFrame, label: str, group: int | None = None) -> DataFrame:
        """``group``: rows of a Parquet row group at most, for rows of megabytes. A task holds one whole, as writer and as reader."""
        self.n += 1
        path = f"{self.path}/{self.n:03d}-{label}"
        out = df.write.option("compression", "zstd")
        (out.option("parquet.block.row.count.limit", group) if group else out).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def small(stored_table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if it is counted to have few rows; else left to a shuffled join, which splits skewed keys."""
    return F.broadcast(stored_table) if stored_table.limit(rows + 1).count() <= rows else stored_table


def _give_back() -> None:
    """Frees what a worker process holds for reuse, as it lives on after its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with batches bounded by bytes; a worker gives its memory back at the end of a task."""
    spark = df.sparkSession
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH_BYTES)) > BATCH_BYTES:
        spark.conf.set(_BATCH_BYTES, f"{BATCH_BYTES}b")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return df.mapInArrow(each, schema)


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """map_arrow of a function of one batch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)

    return map_arrow(df, each, schema)


def quoted(name: str) -> Column:
    """A column by its very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_struct(df: DataFrame) -> Column:
    """The whole row as one struct, so none of its columns can clash with those an operator makes."""
    return F.struct(*map(quoted, df.columns))


def lower_ascii(column):
    """A-Z to a-z; all else as it is."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
