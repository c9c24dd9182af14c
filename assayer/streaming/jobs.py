"""Streams over case files. Each job can be stopped and started again at any time.

Results are written per micro-batch to ``batch=<id>`` directories that a repeated
batch overwrites, so a batch that runs twice counts once. What a job must know of
earlier batches is in its keyed state (``stateful``), never in its own output, so
the cost of a batch does not grow with the history.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from assayer.session import STATE_STORE
from assayer.streaming.stateful import FirstCrossing, FirstRow, RunningCost, combined


def files(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def _start(stream: DataFrame, mode: str, each: Callable[[DataFrame, int], None], checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
    conf, (key, provider) = stream.sparkSession.conf, STATE_STORE
    before = conf.get(key, None)
    conf.set(key, provider)  # a query copies its session's settings when it starts
    try:
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def _written(out: str, change: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Callable[[DataFrame, int], None]:
    def each(batch: DataFrame, number: int) -> None:
        change(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")
    return each


def _keyed(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str | T.StructType, mode: str, time: str) -> DataFrame:
    return stream.groupBy(key).transformWithState(processor, schema, mode, time)


def resume_scoring(stream: DataFrame, key: str, order: str | None, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
                   once: bool = True, forget_ms: int | None = None, late: tuple[str, str] | None = None) -> StreamingQuery:
    """Every id is scored once: rows of ids in earlier batches are left out.

    Without ``order`` any one of the repeats in a batch stands for the id, and the ids are kept by Spark's own operator for
    duplicates: for good, or with ``late`` = (time column, delay) until the watermark is past. With ``order`` it is the first of
    the batch (a null order comes first), and a flag per id is kept for ``forget_ms`` of processing time or for good; that
    costs a call of Python per id. Rows without an id share one.
    """
    schema = stream.schema

    def first(table: pa.Table) -> pa.Table:
        places = table.select([key, *([order] if order else [])]).append_column("__row", pa.array(range(table.num_rows), pa.int64()))
        by = [(order, "ascending")] if order else []
        places = places.take(pc.sort_indices(places, [*by, ("__row", "ascending")], null_placement="at_start"))
        return table.take(places.group_by(key, use_threads=False).aggregate([("__row", "first")])["__row_first"])

    some = combined(stream, first, schema)
    if order:
        new = _keyed(some, key, FirstRow(order, schema.names, forget_ms), schema, "append", "processingTime" if forget_ms else "none")
    elif late:
        new = some.withWatermark(*late).dropDuplicatesWithinWatermark([key])
    else:
        new = some.dropDuplicates([key])
    return _start(new, "append", _written(out, score), checkpoint, once)


def first_crossing(stream: DataFrame, out: str, checkpoint: str, limit: float = 0.5, once: bool = True, time: str = "ts",
                   late: str = "1 hour", idle_ms: int = 30 * 86_400_000) -> StreamingQuery:
    """The first snippet over the limit of each video, told once, when no earlier snippet can come any more.

    Snippets of a video have rising indexes in the order of ``time``. They may arrive in any order if they are less than
    ``late`` behind the latest one of all; later ones are dropped. A crossing is told when the watermark passes its time, so
    a job that stands still at the end of its input needs a ``heartbeat`` to tell the last ones. A video without snippets
    for ``idle_ms`` of event time is forgotten, which bounds the state by the videos of that time.
    """
    rows = stream.select("video_id", F.when(F.col("score") > limit, F.col("idx").cast("long")).alias("idx"),
                         F.col(time).cast("timestamp").alias("ts"))
    seen = rows.select("video_id", "idx", F.unix_millis("ts").alias("seen"), F.when(F.col("idx").isNotNull(), F.unix_millis("ts")).alias("at"))

    def least(table: pa.Table) -> pa.Table:
        latest = table.group_by("video_id").aggregate([("seen", "max")]).rename_columns(["video_id", "seen"])
        over = table.filter(pc.is_valid(table["idx"]))
        best = over.group_by("video_id").aggregate([("idx", "min")]).rename_columns(["video_id", "idx"])
        # the indexes rise with time, so the least one has the least time
        first = over.group_by("video_id").aggregate([("at", "min")]).rename_columns(["video_id", "at"])
        none = table.filter(pc.is_null(table["video_id"]))
        told = latest.filter(pc.is_valid(latest["video_id"])).join(best, "video_id", join_type="left outer").join(first, "video_id", join_type="left outer")
        beat = none.group_by("video_id").aggregate([("seen", "max")]).rename_columns(["video_id", "seen"])
        beat = beat.append_column("idx", pa.nulls(beat.num_rows, pa.int64())).append_column("at", pa.nulls(beat.num_rows, pa.int64()))
        return pa.concat_tables([t.select(["video_id", "idx", "at", "seen"]) for t in (told, beat)])

    kind = stream.schema["video_id"].dataType.simpleString()
    marked = combined(seen, least, f"video_id {kind}, idx long, at long, seen long").withColumn(
        "ts", F.timestamp_millis("seen")).withWatermark("ts", late)
    first = _keyed(marked, "video_id", FirstCrossing(idle_ms), f"video_id {kind}, first_idx long", "append", "eventTime")
    return _start(first, "append", _written(out), checkpoint, once)


def heartbeat(like: DataFrame, time: Column, column: str = "ts") -> DataFrame:
    """One row of the shape of ``like`` that holds nothing but a time: it moves the watermark and is no video's."""
    one = like.sparkSession.range(1)
    return one.select(*[time.cast(f.dataType).alias(f.name) if f.name == column else F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema])


def running_metrics(stream: DataFrame, out: str, checkpoint: str, time: str = "ts", width: str = "1 day", late: str = "1 day",
                    once: bool = True) -> StreamingQuery:
    """Counts, accuracy and conflict kinds per run and time window; rows later than the watermark are dropped."""
    w = stream.withColumn("__ts", F.col(time).cast("timestamp")).withWatermark("__ts", late)
    agg = w.groupBy(F.window("__ts", width).alias("w"), "run_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("ground_truth") == F.col("predicted")).alias("n_correct"),
        *[F.count_if(F.col("conflict_type") == k).alias(f"n_{k.lower()}") for k in ("HARD", "SOFT", "NONE")])
    flat = agg.select(F.col("w.start").alias("start"), "run_id", "n", "n_correct", "n_hard", "n_soft", "n_none")

    return _start(flat, "update", _written(out), checkpoint, once)


def budget_guard(stream: DataFrame, cost: Column, limit: float | str | Decimal, out: str, checkpoint: str, once: bool = True,
                 forget_ms: int | None = None) -> StreamingQuery:
    """Running cost per backend, exact; ``raised`` is set in the first batch that passes the limit and never again.

    With ``forget_ms`` a backend that is silent for so much processing time begins anew, flag included.
    """
    calls = stream.select("backend", F.lit(1).cast("long").alias("calls"), cost.cast("decimal(38,10)").alias("cost"))

    def total(table: pa.Table) -> pa.Table:
        return table.group_by("backend").aggregate([("calls", "sum"), ("cost", "sum")]).rename_columns(["backend", "calls", "cost"])

    sums = combined(calls, total, "backend string, calls long, cost decimal(38,10)")
    told = _keyed(sums, "backend", RunningCost(Decimal(str(limit)), forget_ms), "backend string, calls long, cost decimal(38,10), raised boolean",
                  "update", "processingTime" if forget_ms else "none")
    return _start(told, "update", _written(out), checkpoint, once)


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Newest row per key over all batches of an update-mode result."""
    rows = spark.read.option("basePath", path).parquet(path)
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__r")).select(*keys, "__r.*")
