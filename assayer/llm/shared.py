"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import time

from pyspark.sql import DataFrame

from assayer.session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once under ``spark.checkpoint.dir`` and read back: a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Let Spark drop the shuffle files of finished jobs now instead of at some later collection.

    Twice: the first round frees the plans that Python still named, the second what only these plans held.
    """
    for _ in range(2):
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(0.3)
