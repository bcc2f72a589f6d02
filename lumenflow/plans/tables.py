"""Durable intermediate tables in the folder the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Work folders this driver has made, the oldest first.
made: list[str] = []
#: Folders of the durable tables in use.
_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: Spark's setting (since 4.1) by which a query's shuffle files go when it has ended; else they stay until the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that a join may broadcast, by Spark's guess from files, and by what was shuffled.
_GUESSED, _SHUFFLED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``); a session on one machine without it gets a folder of its own."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="lumenflow-")
        spark.sparkContext.setCheckpointDir(shared)
    return shared.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    made.append(f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return made[-1]


def remove(spark: SparkSession, path: str) -> None:
    """Through Spark's own file systems, so any shared folder will do."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def durable(df: DataFrame, label: str) -> DataFrame:
    """The rows as Parquet in the shared folder: computed once, column-pruned when read, safe when an executor is lost; cuts the lineage.

    What was shuffled for them isn't read again, so it goes once they are written.
    Compressed files are many times smaller than their rows, so joins broadcast by
    the size of what they shuffle alone, or where they say so: a table of a row for
    each photo would otherwise go through the driver.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    settings = {_CLEANUP: "true", _GUESSED: "-1", _SHUFFLED: spark.conf.get(_SHUFFLED, None) or spark.conf.get(_GUESSED)}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Removes durable tables that nothing reads any more; what another ``keep`` made stays."""
    for t in tables:
        if t is not None and (path := _folders.pop(t, None)):
            remove(t.sparkSession, path)
