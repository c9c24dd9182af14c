"""Streams over the driver tables, run to their end and compared with the batch result.

The rows arrive in three deliveries by time; the stream is stopped and started
again from its checkpoint after each.
"""

from pyspark.sql import functions as F

from assayer import bindings as B
from assayer import dims
from assayer.operators import judging as J
from assayer.plans.judging import CALLS_SQL, COST_SQL, judge_calls
from assayer.plans.metrics import rounded
from assayer.plans.registry import query
from assayer.session import scratch_path
from assayer.streaming import jobs

NORMAL = "view"


def deliveries(df, part, source, run):
    """Append the rows of each part to the source folder and let the stream take them in."""
    for p in range(3):
        df.filter(part == p).write.mode("append").parquet(source)
        run().awaitTermination()


def stream_session(spark):
    """A session for streams with no more state partitions than task slots (their number is fixed at the first start)."""
    other = spark.newSession()
    slots = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    other.conf.set("spark.sql.shuffle.partitions", str(slots))
    other.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return other


def third(df, column="ts"):
    """0, 1, 2 for the first, second and last third of the days that the rows cover (a NULL time comes last)."""
    day = F.unix_date(F.col(column).cast("date"))
    low, high = df.agg(F.min(day), F.max(day)).first()
    low, high = low or 0, high or 0
    return F.coalesce(F.floor((day - low) * 3 / (high - low + 1)), F.lit(2)).cast("bigint")


@query("st_resume_scoring", B.ctes("cases") + "SELECT case_id, round(confidence, 6) AS confidence, ground_truth = predicted AS correct FROM cases")
def st_resume_scoring(spark, d):
    c = B.cases(spark, d).select("case_id", "ground_truth", "predicted", "confidence", "ts")
    own = stream_session(spark)
    source, out, state = (scratch_path(spark, n) for n in ("resume-in", "resume-out", "resume-state"))

    def score(rows):
        return rows.select("case_id", "confidence", (F.col("ground_truth") == F.col("predicted")).alias("correct"))
    # later deliveries bring every earlier row again, unchanged, so any of the repeats will do
    again = c.withColumn("part", F.explode(F.sequence(third(c), F.lit(2).cast("bigint"))))
    schema = again.drop("part").schema
    deliveries(again, F.col("part"), source, lambda: jobs.resume_scoring(
        jobs.files(own, source, schema), "case_id", None, score, out, state))
    return rounded(spark.read.parquet(out).select("case_id", "confidence", "correct"), "confidence")


@query("st_first_crossing", B.ctes("snippets") + """
SELECT video_id, min(idx) AS first_idx, 1 AS emitted FROM snippets WHERE score > 0.5 GROUP BY video_id""")
def st_first_crossing(spark, d):
    e = B.table(spark, d, "events").select(F.col("event_id"), "ts")
    s = B.snippets(spark, d).join(e, "event_id").select("video_id", "idx", "score", "ts", "event_id")
    own = stream_session(spark)
    source, out, state = (scratch_path(spark, n) for n in ("crossing-in", "crossing-out", "crossing-state"))
    # one snippet in five comes a delivery later than its time says
    part = F.least(third(s) + (F.pmod(F.xxhash64("event_id"), F.lit(5)) == 0).cast("bigint"), F.lit(2).cast("bigint"))
    days, end = s.agg(F.date_diff(F.max("ts"), F.min("ts")), F.max("ts")).first()
    late = f"{(days or 0) * 2 // 3 + 2} days"
    shape = s.drop("event_id")

    def run():
        return jobs.first_crossing(jobs.files(own, source, shape.schema), out, state, late=late, idle_ms=100 * 365 * 86_400_000)
    deliveries(s.withColumn("part", part).select(*shape.columns, "part"), F.col("part"), source, run)
    if end:
        jobs.heartbeat(shape, F.lit(end) + F.expr(f"INTERVAL '{(days or 0) * 2 + 4}' DAY")).write.mode("append").parquet(source)
        run().awaitTermination()
    told = spark.read.schema("video_id bigint, first_idx bigint").parquet(out)
    return told.groupBy("video_id").agg(F.min("first_idx").alias("first_idx"), F.count(F.lit(1)).alias("emitted"))


@query("st_running_metrics", B.ctes("cases") + """
SELECT strftime(ts, '%Y-%m-%d') AS day, run_id, count(*) AS n, count(*) FILTER (WHERE ground_truth = predicted) AS n_correct,
       count(*) FILTER (WHERE conflict_type = 'HARD') AS n_hard, count(*) FILTER (WHERE conflict_type = 'SOFT') AS n_soft,
       count(*) FILTER (WHERE conflict_type = 'NONE') AS n_none FROM cases GROUP BY ALL""")
def st_running_metrics(spark, d):
    c = B.cases(spark, d).select("run_id", "ground_truth", "predicted", "conflict_type", "ts")
    own = stream_session(spark)
    source, out, state = (scratch_path(spark, n) for n in ("metrics-in", "metrics-out", "metrics-state"))
    deliveries(c, third(c), source, lambda: jobs.running_metrics(jobs.files(own, source, c.schema), out, state))
    # a window starts at midnight UTC; its middle is on that day in every zone near UTC
    m = jobs.latest(spark, out, ["start", "run_id"])
    day = F.date_format(F.to_utc_timestamp("start", F.current_timezone()), "yyyy-MM-dd")
    return m.select(day.alias("day"), "run_id", "n", "n_correct", "n_hard", "n_soft", "n_none")


@query("st_budget_guard", B.ctes("model_reports") + ", " + CALLS_SQL + f"""
SELECT backend, calls, CAST(round(cost, 6) AS DOUBLE) AS cost, cost > 0.05 AS raised
FROM (SELECT c.backend, count(*) AS calls, {COST_SQL} AS cost FROM calls c JOIN prices p ON p.backend = c.backend GROUP BY c.backend) s""")
def st_budget_guard(spark, d):
    prices = F.broadcast(dims.prices(spark))  # fixed price list
    calls = judge_calls(spark, d).join(prices, "backend").select("item_id", "backend", J.call_cost().alias("cost"))
    own = stream_session(spark)
    source, out, state = (scratch_path(spark, n) for n in ("budget-in", "budget-out", "budget-state"))
    deliveries(calls, F.pmod("item_id", F.lit(3)), source, lambda: jobs.budget_guard(
        jobs.files(own, source, calls.schema), F.col("cost"), "0.05", out, state))
    last = jobs.latest(spark, out, ["backend"]).drop("raised", "batch")
    flags = spark.read.parquet(out).groupBy("backend").agg(F.count_if("raised").alias("times"))
    return last.join(flags, "backend").select("backend", "calls", F.round("cost", 6).cast("double").alias("cost"), (F.col("times") == 1).alias("raised"))
