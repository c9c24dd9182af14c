"""Views of the driver tables in the shapes the operators expect.

Each view exists twice: as DataFrames and as the SQL text the checks use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators import prefix
from assayer.session import materialise, spread, tasks, values_frame, values_sql
from assayer import dims

# event types stand for these classes
EVENT_ALIAS = {"view": "Normal", "signup": "Arrest", "click": "Shoplifting",
               "purchase": "Burglary", "error": "Assault"}
TOTAL_FRAMES = 90_000
FPS = 25.0


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _d(column, by: int):
    return column.cast("double") / F.lit(float(by))


# ---- cases -------------------------------------------------------------------
CASES_SQL = """
SELECT event_id AS case_id,
       concat('r', CAST(user_id % 4 AS STRING)) AS run_id,
       event_type AS ground_truth,
       CASE WHEN event_id * 31 % 10 < 6 THEN event_type
            ELSE coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'view') END AS predicted,
       CAST(event_id * 7919 % 1000 AS DOUBLE) / 1000 AS confidence,
       CAST(event_id * 104729 % 997 AS DOUBLE) / 997 AS score,
       CAST(event_id * 13 % 89 AS DOUBLE) / 89 AS rcons,
       CAST(event_id * 37 % 97 AS DOUBLE) / 97 AS rlegal,
       1 + event_id % 9 AS total_turns,
       CASE event_id % 7 WHEN 0 THEN 'HARD' WHEN 1 THEN 'SOFT' ELSE 'NONE' END AS conflict_type,
       user_id, ts, value, props
FROM events"""


def cases_from(events: DataFrame) -> DataFrame:
    e = prefix.previous(events, ["user_id"], prefix.minute_of("ts"), ["ts", "event_id"], {"before": "event_type"})
    i = F.col("event_id")
    return e.select(
        i.alias("case_id"),
        F.concat(F.lit("r"), (F.col("user_id") % 4).cast("string")).alias("run_id"),
        F.col("event_type").alias("ground_truth"),
        F.when(i * 31 % 10 < 6, F.col("event_type"))
         .otherwise(F.coalesce("before", F.lit("view"))).alias("predicted"),
        _d(i * 7919 % 1000, 1000).alias("confidence"),
        _d(i * 104729 % 997, 997).alias("score"),
        _d(i * 13 % 89, 89).alias("rcons"),
        _d(i * 37 % 97, 97).alias("rlegal"),
        (1 + i % 9).alias("total_turns"),
        F.when(i % 7 == 0, "HARD").when(i % 7 == 1, "SOFT").otherwise("NONE").alias("conflict_type"),
        "user_id", "ts", "value", "props",
    )


def cases(spark: SparkSession, d: str) -> DataFrame:
    return cases_from(table(spark, d, "events"))


def cases_table(spark: SparkSession, d: str) -> DataFrame:
    """The cases written once, for queries that read them several times."""
    return materialise(cases(spark, d), "cases")


# ---- snippets: the events of a user in time order are the pieces of one video ------
SNIPPETS_SQL = """
SELECT user_id AS video_id,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
       CAST(event_id * 104729 % 997 AS DOUBLE) / 997 AS score,
       CAST(event_id * 23 % 101 AS DOUBLE) / 101 AS illumination,
       CAST(event_id * 29 % 103 AS DOUBLE) / 103 AS occlusion,
       CAST(event_id * 41 % 256 AS DOUBLE) AS luminance,
       event_type, event_id
FROM events"""


def snippets(spark: SparkSession, d: str) -> DataFrame:
    e = prefix.row_numbers(table(spark, d, "events"), ["user_id"], [prefix.minute_of("ts")], ["ts", "event_id"])
    i = F.col("event_id")
    return e.select(
        F.col("user_id").alias("video_id"), (F.col("rn") - 1).alias("idx"),
        _d(i * 104729 % 997, 997).alias("score"),
        _d(i * 23 % 101, 101).alias("illumination"),
        _d(i * 29 % 103, 103).alias("occlusion"),
        (i * 41 % 256).cast("double").alias("luminance"),
        "event_type", i,
    )


CLASSES_SQL = values_sql(
    [r + dims.WEIGHTS[r[5]] for r in dims.class_rows(EVENT_ALIAS)],
    dims.CLASS_COLUMNS + ["w1", "w2", "w3", "w4"])


def event_classes(spark: SparkSession) -> DataFrame:
    return dims.classes(spark, EVENT_ALIAS)


# ---- scored ------------------------------------------------------------------
SCORED_SQL = """
SELECT l_orderkey, l_linenumber, l_linestatus AS run_id,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
       l_quantity / CAST(50 AS DOUBLE) AS score
FROM lineitem"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_linestatus").alias("run_id"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        (F.col("l_quantity") / F.lit(50.0)).alias("score"))


# ---- paired ------------------------------------------------------------------
PAIRED_SQL = """
SELECT user_id AS item_id,
       avg(CASE WHEN event_type = 'view' THEN value END) AS a,
       avg(CASE WHEN event_type = 'click' THEN value END) AS b
FROM events GROUP BY user_id
HAVING count(CASE WHEN event_type = 'view' THEN 1 END) > 0
   AND count(CASE WHEN event_type = 'click' THEN 1 END) > 0"""


def paired(spark: SparkSession, d: str) -> DataFrame:
    return (table(spark, d, "events")
            .filter(F.col("event_type").isin("view", "click"))
            .groupBy(F.col("user_id").alias("item_id"))
            .agg(F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("a"),
                 F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("b"))
            .filter(F.col("a").isNotNull() & F.col("b").isNotNull()))


# ---- judge scores: one exchange (two turns) is an item, the role is the model --------
QUESTIONS = [("q1", 1, 3), ("q2", 2, 4), ("q3", 3, 3), ("q4", 4, 4), ("q5", 5, 3), ("q6", 6, 3), ("q7", 7, 3)]
JUDGES = [("ja", 0), ("jb", 1)]

REPORTS_SQL = """
SELECT conv_id * 1000000000 + turn // 2 AS item_id, role AS model, text AS body FROM conversations"""

JUDGE_SQL = f"""
SELECT c.item_id, c.model, j.judge, q.q_key, q.max_score,
       (length(c.body) * (3 + 2 * j.jn) + q.qn * 5 + c.item_id) % (q.max_score + 1) AS raw
FROM ({REPORTS_SQL}) c
CROSS JOIN ({values_sql(JUDGES, ['judge', 'jn'])}) j
CROSS JOIN ({values_sql(QUESTIONS, ['q_key', 'qn', 'max_score'])}) q"""


def reports_by_model(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "conversations")).select(
        (F.col("conv_id") * 1_000_000_000 + F.expr("turn div 2")).alias("item_id"),
        F.col("role").alias("model"), F.col("text").alias("body"))


def judge(spark: SparkSession, d: str) -> DataFrame:
    sheet = F.array(*[
        F.struct(F.lit(j).alias("judge"), F.lit(jn).alias("jn"), F.lit(q).alias("q_key"),
                 F.lit(qn).alias("qn"), F.lit(m).alias("max_score"))
        for j, jn in JUDGES for q, qn, m in QUESTIONS])
    long = reports_by_model(spark, d).select(
        "item_id", "model", F.length("body").alias("size"), F.explode(sheet).alias("s"))
    return long.select(
        "item_id", "model", "s.judge", "s.q_key", "s.max_score",
        ((F.col("size") * (3 + 2 * F.col("s.jn")) + F.col("s.qn") * 5 + F.col("item_id"))
         % (F.col("s.max_score") + 1)).alias("raw"))


# ---- corpus ------------------------------------------------------------------
CORPUS_SQL = """
SELECT doc_id, CASE WHEN lang = 'en' THEN 'law' ELSE 'judgment' END AS layer, lang, source, text FROM documents"""


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents")).select(
        "doc_id", F.when(F.col("lang") == "en", "law").otherwise("judgment").alias("layer"),
        "lang", "source", "text")


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# ---- intervals -----------------------------------------------------------------
INTERVALS_SQL = """
SELECT user_id AS video_id, event_id AS seg_idx,
       CAST(event_id * 17 % 1000 AS DOUBLE) AS start_s,
       CAST(event_id * 17 % 1000 AS DOUBLE) + value AS end_s,
       event_type AS description
FROM events"""


def intervals(spark: SparkSession, d: str) -> DataFrame:
    start = (F.col("event_id") * 17 % 1000).cast("double")
    return table(spark, d, "events").select(
        F.col("user_id").alias("video_id"), F.col("event_id").alias("seg_idx"),
        start.alias("start_s"), (start + F.col("value")).alias("end_s"),
        F.col("event_type").alias("description"))


# ---- agents --------------------------------------------------------------------
# a case is a user and a day since 1970
CASE_DAYS = 1_000_000
AGENTS_SQL = """
SELECT user_id * 1000000 + datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS case_id,
       row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS pos,
       event_type AS category,
       CAST(event_id * 7919 % 1000 AS DOUBLE) / 1000 AS confidence,
       event_id % 4 AS n_frames,
       event_id % 32 AS first_frame,
       event_id * 11 % 320 AS escalation_start_frame,
       event_id % 3 AS n_pre, event_id % 2 AS n_post, event_id,
       CAST(event_id * 19 % 53 AS DOUBLE) / 53 AS rag_match_ratio,
       CAST(event_id * 43 % 61 AS DOUBLE) / 61 AS mil_confidence,
       CASE event_id % 5 WHEN 0 THEN 'view' WHEN 1 THEN 'click' WHEN 2 THEN 'purchase' WHEN 3 THEN 'error'
            ELSE 'signup' END AS mil_category,
       event_id % 2 = 0 AS vlm_used,
       event_id % 11 = 0 AS gated,
       CAST(event_id * 37 % 97 AS DOUBLE) / 97 AS rlegal,
       event_id % 5 < 2 AS has_causal_chain,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id * 47 % 67 AS DOUBLE) / 67 END AS env_contribution
FROM events"""


def agents(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    e = prefix.row_numbers(e, ["user_id", "day"], [prefix.minute_of("ts")], ["ts", "event_id"], "pos")
    i = F.col("event_id")
    labels = F.array(*[F.lit(v) for v in ("view", "click", "purchase", "error", "signup")])
    return e.select(
        (F.col("user_id") * CASE_DAYS + F.unix_date("day")).alias("case_id"), "pos",
        F.col("event_type").alias("category"), _d(i * 7919 % 1000, 1000).alias("confidence"),
        (i % 4).alias("n_frames"), (i % 32).alias("first_frame"),
        (i * 11 % 320).alias("escalation_start_frame"), (i % 3).alias("n_pre"), (i % 2).alias("n_post"), i,
        _d(i * 19 % 53, 53).alias("rag_match_ratio"), _d(i * 43 % 61, 61).alias("mil_confidence"),
        labels[(i % 5).cast("int")].alias("mil_category"), (i % 2 == 0).alias("vlm_used"),
        (i % 11 == 0).alias("gated"), _d(i * 37 % 97, 97).alias("rlegal"),
        (i % 5 < 2).alias("has_causal_chain"),
        F.when(i % 3 != 0, _d(i * 47 % 67, 67)).alias("env_contribution"))


# ---- reports with citations -------------------------------------------------------
REPORT_STEP = 10_000_000
TASK_LINES = 75_000  # sentences of the reports that one task holds
SENTENCES_SQL = """
SELECT l_orderkey * 10000000 + l_partkey // 10000 AS item_id, l_orderkey, l_linenumber AS ord, l_partkey, l_suppkey,
       concat('刑法第 ', CAST(l_partkey % 40 AS STRING), ' 條',
              CASE WHEN l_linenumber % 3 = 0 THEN '不構成本罪' ELSE '' END) AS sentence
FROM lineitem"""
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
PRIORITY_ARTICLES = [(p, str(8 * k + j)) for k, p in enumerate(PRIORITIES) for j in range(3)]
PRIORITY_ELEMENTS = [(p, e) for k, p in enumerate(PRIORITIES) for e in (f"第 {8 * k} 條", "不構成")]
REPORT_TEXT_SQL = f"""
SELECT s.item_id, o.o_orderpriority AS class, s.body AS body
FROM (SELECT item_id, string_agg(sentence, '。' ORDER BY ord, l_partkey, l_suppkey) AS body
      FROM ({SENTENCES_SQL}) x GROUP BY item_id) s JOIN orders o ON o.o_orderkey = s.item_id // 10000000"""


def sentences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * REPORT_STEP + F.expr("l_partkey div 10000")).alias("item_id"), "l_orderkey",
        F.col("l_linenumber").alias("ord"), "l_partkey", "l_suppkey",
        F.concat(F.lit("刑法第 "), (F.col("l_partkey") % 40).cast("string"), F.lit(" 條"),
                 F.when(F.col("l_linenumber") % 3 == 0, "不構成本罪").otherwise("")).alias("sentence"))


def report_tasks(spark: SparkSession, d: str) -> int:
    """Tasks for work on the report texts (counting rows reads no data)."""
    return tasks(spark, table(spark, d, "lineitem").count(), TASK_LINES)


def report_texts(spark: SparkSession, d: str) -> DataFrame:
    """One text per order and block of parts: the block bounds the lines that become one row."""
    lines = sentences(spark, d).repartition(report_tasks(spark, d), "l_orderkey").groupBy("item_id", "l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("ord", "l_partkey", "l_suppkey", "sentence"))).alias("lines"))
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("class"))
    return lines.join(orders, "l_orderkey").select(
        "item_id", "class", F.array_join(F.col("lines.sentence"), "。").alias("body"))


def priority_articles(spark: SparkSession) -> DataFrame:
    return values_frame(spark, PRIORITY_ARTICLES, ["class", "article_no"])


def priority_elements(spark: SparkSession) -> DataFrame:
    return values_frame(spark, PRIORITY_ELEMENTS, ["class", "element"])


VIEWS = {
    "cases": CASES_SQL, "snippets": SNIPPETS_SQL, "dim_class": CLASSES_SQL, "scored": SCORED_SQL,
    "paired": PAIRED_SQL, "judge_scores": JUDGE_SQL, "model_reports": REPORTS_SQL, "corpus": CORPUS_SQL,
    "intervals": INTERVALS_SQL, "agents": AGENTS_SQL, "sentences": SENTENCES_SQL,
    "report_texts": REPORT_TEXT_SQL,
}


def ctes(*names: str, **extra: str) -> str:
    """``WITH`` clause over the named views and further ``name=sql`` parts."""
    parts = [f"{n} AS ({VIEWS[n]})" for n in names] + [f"{n} AS ({s})" for n, s in extra.items()]
    return "WITH " + ",\n".join(parts) + "\n"
