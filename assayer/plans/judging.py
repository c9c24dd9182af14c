"""Queries over judge and human scores."""

from pyspark.sql import functions as F

from assayer import bindings as B
from assayer import dims
from assayer.operators import judging as J
from assayer.plans.metrics import rounded
from assayer.plans.registry import query

JUDGES = [j for j, _ in B.JUDGES]
# a human sheet made from the first judge; an unanswered question is NULL
HUMAN_SQL = """SELECT item_id, model, q_key, max_score,
       nullif((raw * 2 + item_id) % (max_score + 1), CASE WHEN q_key = 'q7' THEN 0 ELSE -1 END) AS raw
FROM judge_scores WHERE judge = 'ja'"""
NORM_SQL = "n AS (SELECT *, raw / CAST(max_score AS DOUBLE) AS norm FROM judge_scores)"
OVERALL_SQL = NORM_SQL + ", o AS (SELECT item_id, model, judge, avg(norm) AS overall FROM n GROUP BY ALL)"


def human(spark, d):
    j = B.judge(spark, d).filter(F.col("judge") == "ja")
    raw = (F.col("raw") * 2 + F.col("item_id")) % (F.col("max_score") + 1)
    return j.select("item_id", "model", "q_key", "max_score",
                    F.when(~((F.col("q_key") == "q7") & (raw == 0)), raw).alias("raw"))


@query("jn_common_items", B.ctes("model_reports") + """
SELECT item_id FROM model_reports WHERE model IN ('user', 'assistant') GROUP BY item_id HAVING count(DISTINCT model) = 2""")
def jn_common_items(spark, d):
    return J.common_items(B.reports_by_model(spark, d), ["user", "assistant"])


@query("jn_pair_reports", B.ctes("model_reports") + """
SELECT a.item_id, a.body AS body_a, b.body AS body_b FROM model_reports a JOIN model_reports b
ON a.item_id = b.item_id AND a.model = 'user' AND b.model = 'assistant' WHERE length(a.body) > 0 AND length(b.body) > 0""")
def jn_pair_reports(spark, d):
    return J.report_pairs(B.reports_by_model(spark, d), "user", "assistant")


@query("jn_semi_full_coverage", B.ctes("judge_scores", human=HUMAN_SQL) + """
SELECT item_id, model FROM human GROUP BY item_id, model HAVING count(raw) = 7
INTERSECT SELECT item_id, model FROM judge_scores""")
def jn_semi_full_coverage(spark, d):
    return J.fully_scored(human(spark, d), B.judge(spark, d))


@query("jn_judge_pairs", B.ctes("judge_scores") + ", " + OVERALL_SQL + """
SELECT a.item_id, a.model, a.judge AS judge_a, b.judge AS judge_b, round(a.overall, 6) AS score_a, round(b.overall, 6) AS score_b
FROM o a JOIN o b ON a.item_id = b.item_id AND a.model = b.model AND a.judge < b.judge""")
def jn_judge_pairs(spark, d):
    return rounded(J.judge_pairs(B.judge(spark, d), JUDGES), "score_a", "score_b")


@query("set_intersect_ids", B.ctes("model_reports") + """
SELECT item_id FROM model_reports WHERE model = 'user' INTERSECT SELECT item_id FROM model_reports WHERE model = 'assistant'""")
def set_intersect_ids(spark, d):
    r = B.reports_by_model(spark, d)
    def side(m):
        return r.filter(F.col("model") == m).select("item_id")
    return side("user").intersect(side("assistant"))


@query("agg_judge_summary", B.ctes("judge_scores") + ", " + OVERALL_SQL + """, u AS (
SELECT model, judge, overall FROM o UNION ALL SELECT model, 'ALL', avg(overall) FROM o GROUP BY item_id, model)
SELECT model, judge, round(avg(overall), 4) AS mean, round(coalesce(stddev_samp(overall), 0), 4) AS std, count(*) AS n
FROM u GROUP BY model, judge""")
def agg_judge_summary(spark, d):
    return J.summary(B.judge(spark, d))


@query("agg_judge_agreement", B.ctes("judge_scores") + ", " + OVERALL_SQL + """
SELECT a.model, a.judge AS judge_a, b.judge AS judge_b, count(*) AS n, round(corr(a.overall, b.overall), 6) AS r
FROM o a JOIN o b ON a.item_id = b.item_id AND a.model = b.model AND a.judge < b.judge GROUP BY ALL""")
def agg_judge_agreement(spark, d):
    return rounded(J.agreement(B.judge(spark, d), JUDGES), "r")


@query("agg_model_delta", B.ctes("judge_scores") + ", " + OVERALL_SQL + """, i AS (
SELECT item_id, avg(overall) FILTER (WHERE model = 'user') AS a, avg(overall) FILTER (WHERE model = 'assistant') AS b
FROM o GROUP BY item_id)
SELECT count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(a) - avg(b), 6) AS delta
FROM i WHERE a IS NOT NULL AND b IS NOT NULL""")
def agg_model_delta(spark, d):
    return rounded(J.model_delta(B.judge(spark, d), "user", "assistant"), "mean_a", "mean_b", "delta")


@query("agg_question_corr", B.ctes("judge_scores", human=HUMAN_SQL) + ", " + NORM_SQL + """
SELECT n.q_key, n.judge, count(*) AS n, round(corr(h.raw / CAST(h.max_score AS DOUBLE), n.norm), 6) AS r
FROM human h JOIN n ON n.item_id = h.item_id AND n.model = h.model AND n.q_key = h.q_key WHERE h.raw IS NOT NULL
GROUP BY n.q_key, n.judge HAVING count(*) >= 2""")
def agg_question_corr(spark, d):
    return rounded(J.question_correlation(human(spark, d), B.judge(spark, d)).filter("n >= 2"), "r")


PASSES_SQL = """passes AS (SELECT item_id, model, q_key, max_score,
       max(raw) FILTER (WHERE judge = 'ja' AND raw > 0) AS raw_1, max(raw) FILTER (WHERE judge = 'jb' AND raw > 0) AS raw_2
       FROM judge_scores GROUP BY ALL),
packed AS (SELECT item_id, model, q_key, (coalesce(raw_1, (max_score + 1) // 2) + coalesce(raw_2, (max_score + 1) // 2)) / 2.0 AS raw,
       (coalesce(raw_1, (max_score + 1) // 2) + coalesce(raw_2, (max_score + 1) // 2)) / 2.0 / max_score AS norm,
       abs(coalesce(raw_1, (max_score + 1) // 2) - coalesce(raw_2, (max_score + 1) // 2)) / CAST(max_score AS DOUBLE) AS change FROM passes),
items AS (SELECT item_id, model, avg(norm) AS overall, max(change) AS max_change, max(change) < 0.29 AS is_stable
       FROM packed GROUP BY item_id, model)"""


def passes(spark, d):
    """The two judges stand for two passes; a score of 0 stands for a missing answer."""
    given = F.col("raw") > 0
    return B.judge(spark, d).groupBy("item_id", "model", "q_key", "max_score").agg(
        F.max(F.when(given & (F.col("judge") == "ja"), F.col("raw"))).alias("raw_1"),
        F.max(F.when(given & (F.col("judge") == "jb"), F.col("raw"))).alias("raw_2"))


@query("agg_rubric_pack", B.ctes("judge_scores") + ", " + PASSES_SQL + """
SELECT item_id, model, round(overall, 6) AS overall, round(max_change, 6) AS max_change, is_stable FROM items""")
def agg_rubric_pack(spark, d):
    return rounded(J.rubric_items(J.pack_rubric(passes(spark, d))), "overall", "max_change")


@query("agg_rubric_config", B.ctes("judge_scores") + ", " + PASSES_SQL + """
SELECT model, q_key, round(avg(raw), 6) AS value, count(*) AS n FROM packed GROUP BY model, q_key
UNION ALL SELECT model, 'overall', round(avg(overall), 6), count(*) FROM items GROUP BY model
UNION ALL SELECT model, 'stable_rate', round(avg(CASE WHEN is_stable THEN 1.0 ELSE 0.0 END), 6), count(*) FROM items GROUP BY model""")
def agg_rubric_config(spark, d):
    return rounded(J.rubric_config(J.pack_rubric(passes(spark, d))), "value")


PAIRWISE_SQL = OVERALL_SQL + """, w AS (
SELECT item_id, max(overall) FILTER (WHERE model = 'user' AND judge = 'ja') AS ab_a, max(overall) FILTER (WHERE model = 'assistant' AND judge = 'ja') AS ab_b,
       max(overall) FILTER (WHERE model = 'user' AND judge = 'jb') AS ba_a, max(overall) FILTER (WHERE model = 'assistant' AND judge = 'jb') AS ba_b
FROM o GROUP BY item_id),
v AS (SELECT *, CASE sign(round(ab_a - ab_b, 9)) WHEN 1 THEN 'A' WHEN -1 THEN 'B' ELSE 'tie' END AS w1,
       CASE sign(round(ba_a - ba_b, 9)) WHEN 1 THEN 'A' WHEN -1 THEN 'B' ELSE 'tie' END AS w2
      FROM w WHERE ab_a IS NOT NULL AND ab_b IS NOT NULL),
outcome AS (SELECT item_id, CASE WHEN w1 = w2 THEN w1 ELSE 'tie' END AS winner, 5 * (ab_a + ba_a) / 2 AS score_a,
       5 * (ab_b + ba_b) / 2 AS score_b, w1 = w2 AS is_consistent FROM v)"""


def outcomes(spark, d):
    """First judge saw A first, second judge saw B first; scores on the five-point scale."""
    o = J.overall(B.judge(spark, d)).filter(F.col("model").isin("user", "assistant"))
    s = o.groupBy("item_id", "judge").agg(
        F.max(F.when(F.col("model") == "user", F.col("overall") * 5)).alias("a"),
        F.max(F.when(F.col("model") == "assistant", F.col("overall") * 5)).alias("b"))
    ab = F.col("judge") == "ja"
    return J.pairwise_outcomes(s.select(
        "item_id", F.when(ab, "AB").otherwise("BA").alias("direction"),
        F.when(ab, F.col("a")).otherwise(F.col("b")).alias("score_first"),
        F.when(ab, F.col("b")).otherwise(F.col("a")).alias("score_second")))


@query("agg_pairwise_outcome", B.ctes("judge_scores") + ", " + PAIRWISE_SQL + """
SELECT item_id, winner, round(score_a, 6) AS score_a, round(score_b, 6) AS score_b, is_consistent FROM outcome""")
def agg_pairwise_outcome(spark, d):
    return rounded(outcomes(spark, d), "score_a", "score_b")


@query("agg_pairwise_summary", B.ctes("judge_scores") + ", " + PAIRWISE_SQL + """
SELECT count(*) AS n, count(*) FILTER (WHERE winner = 'A') AS wins_a, count(*) FILTER (WHERE winner = 'B') AS wins_b,
       count(*) FILTER (WHERE winner = 'tie') AS ties, round(avg(CASE WHEN is_consistent THEN 1.0 ELSE 0.0 END), 6) AS consistency_rate
FROM outcome""")
def agg_pairwise_summary(spark, d):
    return rounded(J.pairwise_summary(outcomes(spark, d)), "consistency_rate")


@query("agg_preferences", B.ctes("judge_scores") + ", " + PAIRWISE_SQL + """
SELECT concat('c', CAST(item_id % 5 AS STRING)) AS class, item_id, winner AS chosen, CASE winner WHEN 'A' THEN 'B' ELSE 'A' END AS rejected,
       round(greatest(score_a, score_b), 6) AS score_chosen, round(least(score_a, score_b), 6) AS score_rejected
FROM outcome WHERE is_consistent AND winner <> 'tie' AND round(abs(score_a - score_b), 9) >= 0.5
QUALIFY row_number() OVER (PARTITION BY item_id % 5 ORDER BY item_id) <= 15""")
def agg_preferences(spark, d):
    o = outcomes(spark, d).withColumn("class", F.concat(F.lit("c"), (F.col("item_id") % 5).cast("string")))
    return rounded(J.preferences(o), "score_chosen", "score_rejected")


BACKENDS = {"user": "openai", "assistant": "claude", "system": "gemini"}


def judge_calls(spark, d):
    """Tokens of the calls a report needs: a third of its characters in, a tenth of that out."""
    names = F.create_map(*[F.lit(x) for kv in BACKENDS.items() for x in kv])
    size = F.length("body")
    return B.reports_by_model(spark, d).select(
        "item_id", names[F.col("model")].alias("backend"),
        F.floor(size / 3).alias("input_tokens"), F.floor(size / 30).alias("output_tokens"))


CALLS_SQL = """calls AS (SELECT item_id, CASE model WHEN 'user' THEN 'openai' WHEN 'assistant' THEN 'claude' ELSE 'gemini' END AS backend,
       length(body) // 3 AS input_tokens, length(body) // 30 AS output_tokens FROM model_reports),
prices AS (""" + B.values_sql(dims.PRICES, ["backend", "input_price", "output_price"]) + ")"


#: Money is decimal on both sides: a price has four places, a token costs its millionth.
COST_SQL = """(CAST(sum(input_tokens) AS DECIMAL(18, 0)) * CAST(any_value(input_price) AS DECIMAL(8, 4))
       + CAST(sum(output_tokens) AS DECIMAL(18, 0)) * CAST(any_value(output_price) AS DECIMAL(8, 4))) * CAST(0.000001 AS DECIMAL(6, 6))"""


@query("agg_token_cost", B.ctes("model_reports") + ", " + CALLS_SQL + f""", s AS (
SELECT c.backend, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
       {COST_SQL} AS cost FROM calls c JOIN prices p ON p.backend = c.backend GROUP BY c.backend)
SELECT backend, calls, input_tokens, output_tokens, CAST(round(cost, 6) AS DOUBLE) AS cost,
       CAST(round(CAST(0.05 AS DECIMAL(4, 2)) - cost, 6) AS DOUBLE) AS remaining, cost > CAST(0.05 AS DECIMAL(4, 2)) AS over FROM s""")
def agg_token_cost(spark, d):
    c = J.token_cost(judge_calls(spark, d), dims.prices(spark), "0.05")
    return c.withColumns({n: F.round(n, 6).cast("double") for n in ("cost", "remaining")})
