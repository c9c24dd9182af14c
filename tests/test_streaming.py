"""Restarted streams give the batch result; a repeated batch changes nothing."""

import random
import shutil
from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from assayer.streaming import jobs


def crossings(spark, tmp_path, parts, **options):
    schema = "video_id long, idx long, score double, ts timestamp_ntz"
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    told = []
    for part in parts:
        rows = spark.createDataFrame([(v, i, s, datetime(2024, 1, 1) + timedelta(minutes=m)) for v, i, s, m in part], schema)
        rows.write.mode("append").parquet(source)
        jobs.first_crossing(jobs.files(spark, source, schema), out, state, **options).awaitTermination()
        got = spark.read.schema("video_id long, first_idx long").parquet(out).collect()
        told.append(sorted((r.video_id, r.first_idx) for r in got))
    return told


END = [(None, None, None, 10_000_000)]


def test_crossing_is_told_once(spark, tmp_path):
    parts = [[(1, 0, 0.1, 0), (2, 0, 0.9, 0)], [(1, 1, 0.8, 10), (2, 1, 0.9, 10)], [(1, 2, 0.9, 200), (3, 0, 0.2, 200)], END]
    told = crossings(spark, tmp_path, parts, late="1 hour")
    assert told[0] == told[1] == [] and told[2] == [(1, 1), (2, 0)] == told[3]


def test_earlier_snippet_comes_later(spark, tmp_path):
    told = crossings(spark, tmp_path, [[(1, 5, 0.9, 50)], [(1, 2, 0.8, 20), (1, 7, 0.9, 55)], [(2, 0, 0.1, 300)], [(1, 9, 0.9, 301)], END])
    assert told[:2] == [[], []] and told[2] == told[4] == [(1, 2)]


def test_shuffled_snippets_equal_the_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(v, i, rng.random(), 10 * i + v) for v in range(12) for i in range(12)]
    first = {v: min(i for w, i, s, _ in rows if w == v and s > 0.9) for v in {w for w, _, s, _ in rows if s > 0.9}}
    rng.shuffle(rows)
    told = crossings(spark, tmp_path, [rows[:50], rows[50:110], rows[110:], END], limit=0.9, late="1 day")
    assert told[-1] == sorted(first.items())


def test_idle_video_is_forgotten(spark, tmp_path):
    hour = 3_600_000
    told = crossings(spark, tmp_path, [[(1, 0, 0.9, 0)], [(2, 0, 0.1, 200)], [(2, 1, 0.1, 900)], [(1, 0, 0.9, 1000)], END], late="1 minute", idle_ms=2 * hour)
    assert told[1] == [(1, 0)] and told[-1] == [(1, 0), (1, 0)]  # after two silent hours it is another video


def test_each_id_is_scored_once(spark, tmp_path):
    schema = "id long, t long, v double"
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def run():
        jobs.resume_scoring(jobs.files(spark, source, schema), "id", "t", lambda d: d.withColumn("w", F.col("v") * 2), out, state).awaitTermination()
    spark.createDataFrame([(1, 2, 0.5), (1, 1, 0.25), (2, 1, 1.0)], schema).write.mode("append").parquet(source)
    run()
    spark.createDataFrame([(2, 0, 9.0), (3, 1, 2.0)], schema).write.mode("append").parquet(source)
    run()
    run()
    assert sorted((r.id, r.w) for r in spark.read.parquet(out).collect()) == [(1, 0.5), (2, 2.0), (3, 4.0)]


def test_repeats_in_one_batch_keep_the_first(spark, tmp_path):
    schema = "id string, t long, v double, extra string"
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = [("hot", i, float(i), None) for i in range(500, 0, -1)] + [(None, 3, 3.0, "x"), (None, None, 4.0, "y"), ("one", None, 5.0, None)]
    for part in (rows, rows[::-1]):
        spark.createDataFrame(part, schema).repartition(3).write.mode("append").parquet(source)
        jobs.resume_scoring(jobs.files(spark, source, schema), "id", "t", lambda d: d, out, state).awaitTermination()
    got = sorted(((r.id, r.t, r.v, r.extra) for r in spark.read.parquet(out).collect()), key=str)
    assert got == sorted([("hot", 1, 1.0, None), (None, None, 4.0, "y"), ("one", None, 5.0, None)], key=str)


def test_ids_without_order(spark, tmp_path):
    schema = "id string, t timestamp, v double"
    for late in (None, ("t", "1 day")):
        source, out, state = (str(tmp_path / f"{n}{late is None}") for n in ("in", "out", "state"))
        now = datetime(2024, 1, 1)
        for part in ([("a", now, 1.0)] * 9 + [(None, now, 2.0)] * 2, [("a", now, 1.0), ("b", now, 3.0), (None, now, 2.0)]):
            spark.createDataFrame(part, schema).write.mode("append").parquet(source)
            jobs.resume_scoring(jobs.files(spark, source, schema), "id", None, lambda d: d, out, state, late=late).awaitTermination()
        assert sorted((str(r.id), r.v) for r in spark.read.parquet(out).collect()) == [("None", 2.0), ("a", 1.0), ("b", 3.0)]


def test_a_batch_reads_no_earlier_output(spark, tmp_path):
    schema = "id string, t long"
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.createDataFrame([("a", 1)], schema).write.mode("append").parquet(source)
    jobs.resume_scoring(jobs.files(spark, source, schema), "id", "t", lambda d: d, out, state).awaitTermination()
    shutil.rmtree(out)  # whatever became of the output, the ids are known
    spark.createDataFrame([("a", 2), ("b", 1)], schema).write.mode("append").parquet(source)
    jobs.resume_scoring(jobs.files(spark, source, schema), "id", "t", lambda d: d, out, state).awaitTermination()
    assert [r.id for r in spark.read.parquet(out).collect()] == ["b"]


def test_budget_flag_is_raised_once(spark, tmp_path):
    schema = "backend string, cost double"
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in ([("a", 0.6), ("b", 0.1), (None, 3.0)], [("a", 0.4), ("b", 0.1)], [("a", 0.6), ("b", None)], [("a", 0.2)]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(source)
        jobs.budget_guard(jobs.files(spark, source, schema), F.col("cost"), 1, out, state).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert sorted([(r.backend, r.cost) for r in rows if r.raised], key=str) == [(None, Decimal(3)), ("a", Decimal("1.6"))][::-1]
    last = {r.backend: (r.calls, r.cost) for r in jobs.latest(spark, out, ["backend"]).collect()}
    assert last == {"a": (4, Decimal("1.8")), "b": (3, Decimal("0.2")), None: (1, Decimal(3))}


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "run_id string, ground_truth string, predicted string, conflict_type string, ts timestamp_ntz"
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for day in ("2024-01-10", "2024-01-20", "2024-01-01"):
        rows = spark.createDataFrame([("r", "A", "A", "HARD", day)], "run_id string, ground_truth string, predicted string, conflict_type string, d string")
        rows.withColumn("ts", F.col("d").cast("timestamp_ntz")).drop("d").write.mode("append").parquet(source)
        jobs.running_metrics(jobs.files(spark, source, schema), out, state).awaitTermination()
    got = jobs.latest(spark, out, ["start", "run_id"])
    assert sorted(str(r.start)[:10] for r in got.collect()) == ["2024-01-10", "2024-01-20"]


def test_keyed_state_needs_no_setting(spark, tmp_path):
    other, key = spark.newSession(), "spark.sql.streaming.stateStore.providerClass"
    plain = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"  # what a session has by default
    other.conf.set(key, plain)
    schema = "backend string, cost double"
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    other.createDataFrame([("a", 2.0)], schema).write.parquet(source)
    jobs.budget_guard(jobs.files(other, source, schema), F.col("cost"), 1, out, state).awaitTermination()
    assert [(r.backend, r.raised) for r in spark.read.parquet(out).collect()] == [("a", True)]
    assert other.conf.get(key) == plain


def test_crossing_needs_no_setting(spark, tmp_path):
    other, key = spark.newSession(), "spark.sql.streaming.stateStore.providerClass"
    other.conf.set(key, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    told = crossings(other, tmp_path, [[(1, 0, 0.1, 0), (1, 1, 0.8, 10), (2, 0, 0.9, 10)], END])
    assert told[-1] == [(1, 1), (2, 0)]
