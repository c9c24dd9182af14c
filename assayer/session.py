"""Session defaults, table access and scratch storage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Streaming state on disk, not on the heap; Spark's default store has no keyed state (``transformWithState``).
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def build_session(name: str = "assayer", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; cluster settings stay the cluster's own."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        STATE_STORE[0]: STATE_STORE[1],
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder of ``spark.checkpoint.dir``.

    Without that setting a session on one machine gets a temporary folder, which goes when the program ends; on a
    cluster, where executors would not see it, it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return os.path.join(base, f"assayer-{spark.sparkContext.applicationId}", f"{name}-{uuid.uuid4().hex}")


def clear_scratch(spark: SparkSession) -> None:
    """Remove what this application has written under ``spark.checkpoint.dir``; its results must have been read."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(os.path.join(base, f"assayer-{spark.sparkContext.applicationId}"))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to shared storage and read it back (cuts the lineage)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan over all task slots, for work that is heavy per row.

    A table of few row groups gives few splits; only then its rows are dealt
    out. A scan that already has enough splits is left as it is.
    """
    slots = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(slots) if scan.rdd.getNumPartitions() < slots else scan


def tasks(spark: SparkSession, amount: float | None, each: int) -> int:
    """Tasks for ``amount`` units of work, ``each`` at most in one of equal tasks and no fewer than the slots.

    For a ``repartition`` by key before steps that hold the rows of a task in memory: left to itself Spark sizes such tasks by
    their compressed bytes, or keeps their number while the input grows.
    """
    return max(spark.sparkContext.defaultParallelism, -(-int(amount or 0) // each))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern matches anything, asked of its own file system (nothing is listed)."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return bool(found)


def values_frame(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    """A fixed dimension as a local relation (its size is known to the planner)."""
    return spark.sql(values_sql(rows, columns))


def values_sql(rows: list[tuple], columns: list[str]) -> str:
    def literal(value: object) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return "TRUE" if value else "FALSE"
        if isinstance(value, float):
            return f"CAST({value!r} AS DOUBLE)"
        if isinstance(value, int):
            return str(value)
        return "'" + str(value).replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({', '.join(columns)})"


def r6(column, digits: int = 6):
    return F.round(column, digits)
