"""Queries over case tables: metrics per run."""

from pyspark.sql import functions as F

from assayer import bindings as B
from assayer.operators import metrics as M
from assayer.operators import prefix
from assayer.operators import thresholds as T
from assayer.plans.registry import query

NORMAL = "view"
LABELS = list(B.EVENT_ALIAS)
LABEL_VALUES = "(VALUES " + ", ".join(f"('{x}')" for x in LABELS) + ") AS v(class)"


def rounded(df, *columns, digits=6):
    """Rounded columns. A float sum depends on the order of its rows in the last place, so a value is first rounded at
    twelve places: ties at the wanted digit then fall the same way in every run."""
    return df.withColumns({c: F.round(F.round(c, 12), digits) for c in columns})


@query("agg_run_metrics", B.ctes("cases") + """
SELECT run_id, count(*) AS n, round(round(avg(CASE WHEN ground_truth = predicted THEN 1.0 ELSE 0.0 END), 12), 4) AS accuracy,
       round(round(avg(confidence), 12), 4) AS mean_confidence, round(round(avg(rcons), 12), 4) AS mean_rcons,
       round(round(avg(rlegal), 12), 4) AS mean_rlegal, round(round(avg(total_turns), 12), 2) AS mean_turns
FROM cases GROUP BY run_id""")
def agg_run_metrics(spark, d):
    return M.run_metrics(B.cases(spark, d))


@query("agg_per_class_acc", B.ctes("cases") + """
SELECT coalesce(run_id, 'ALL') AS run_id, coalesce(ground_truth, 'ALL') AS class,
       CAST(grouping(run_id) * 2 + grouping(ground_truth) AS INTEGER) AS level, count(*) AS total,
       CAST(sum(CASE WHEN ground_truth = predicted THEN 1 ELSE 0 END) AS BIGINT) AS n_correct,
       round(avg(CASE WHEN ground_truth = predicted THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM cases GROUP BY ROLLUP (run_id, ground_truth)""")
def agg_per_class_acc(spark, d):
    return rounded(M.per_class_accuracy(B.cases(spark, d)), "accuracy")


@query("agg_subset_rates", B.ctes("cases", "dim_class") + """
SELECT run_id, CAST(sum(c) AS BIGINT) AS n_crime, CAST(sum(o) AS BIGINT) AS n_non_crime,
       round(CASE WHEN sum(c) = 0 THEN 0.0 ELSE sum(c * s) / CAST(sum(c) AS DOUBLE) END, 6) AS crime_accuracy,
       round(CASE WHEN sum(o) = 0 THEN 0.0 ELSE sum(o * pc) / CAST(sum(o) AS DOUBLE) END, 6) AS non_crime_fp_rate,
       round(CASE WHEN sum(o) = 0 THEN 0.0 ELSE sum(o * s) / CAST(sum(o) AS DOUBLE) END, 6) AS non_crime_accuracy
FROM (SELECT run_id, CASE WHEN g.kind = 'crime' THEN 1 ELSE 0 END AS c,
             CASE WHEN g.kind = 'non_crime' THEN 1 ELSE 0 END AS o,
             CASE WHEN p.kind = 'crime' THEN 1 ELSE 0 END AS pc,
             CASE WHEN ground_truth = predicted THEN 1 ELSE 0 END AS s
      FROM cases JOIN dim_class g ON g.class = ground_truth JOIN dim_class p ON p.class = predicted) x
GROUP BY run_id""")
def agg_subset_rates(spark, d):
    return rounded(M.subset_rates(B.cases(spark, d), B.event_classes(spark)),
                   "crime_accuracy", "non_crime_fp_rate", "non_crime_accuracy")


BINARY_SQL = B.ctes("cases") + """, s AS (
SELECT run_id, count(*) AS n, count(*) FILTER (WHERE ground_truth <> 'view' AND predicted <> 'view') AS tp,
       count(*) FILTER (WHERE ground_truth = 'view' AND predicted <> 'view') AS fp,
       count(*) FILTER (WHERE ground_truth <> 'view' AND predicted = 'view') AS fn,
       count(*) FILTER (WHERE ground_truth = 'view' AND predicted = 'view') AS tn,
       count(*) FILTER (WHERE ground_truth = predicted) AS same
FROM cases GROUP BY run_id), q AS (
SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / CAST(tp + fp AS DOUBLE) END AS p,
       CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / CAST(tp + fn AS DOUBLE) END AS r FROM s)
SELECT run_id, n, tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall,
       round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS f1,
       round((tp + tn) / CAST(n AS DOUBLE), 6) AS accuracy, round(same / CAST(n AS DOUBLE), 6) AS class_accuracy
FROM q"""


@query("agg_binary_prf", BINARY_SQL)
def agg_binary_prf(spark, d):
    return rounded(M.binary_prf(B.cases(spark, d), NORMAL), "precision", "recall", "f1", "accuracy", "class_accuracy")


@query("agg_confusion", B.ctes("cases") + """, k AS (
SELECT DISTINCT run_id, ground_truth AS class FROM cases UNION SELECT DISTINCT run_id, predicted FROM cases),
g AS (SELECT a.run_id, a.class AS ground_truth, b.class AS predicted FROM k a JOIN k b ON a.run_id = b.run_id),
m AS (SELECT g.run_id, g.ground_truth, g.predicted, count(c.case_id) AS n
      FROM g LEFT JOIN cases c ON c.run_id = g.run_id AND c.ground_truth = g.ground_truth AND c.predicted = g.predicted
      GROUP BY ALL)
SELECT run_id, ground_truth, predicted, n,
       round(CASE WHEN sum(n) OVER w = 0 THEN 0.0 ELSE n / CAST(sum(n) OVER w AS DOUBLE) END, 6) AS share
FROM m WINDOW w AS (PARTITION BY run_id, ground_truth)""")
def agg_confusion(spark, d):
    return rounded(M.confusion(B.cases(spark, d)), "share")


@query("agg_confusion_wide", B.ctes("cases") + "SELECT run_id, ground_truth, " + ", ".join(
    f"count(*) FILTER (WHERE predicted = '{x}') AS \"{x}\"" for x in LABELS)
    + " FROM cases GROUP BY run_id, ground_truth")
def agg_confusion_wide(spark, d):
    return M.confusion_wide(B.cases(spark, d), LABELS)


PRF_SQL = """k AS (
SELECT DISTINCT run_id, ground_truth AS class FROM cases UNION SELECT DISTINCT run_id, predicted FROM cases),
s AS (SELECT k.run_id, k.class,
       count(*) FILTER (WHERE ground_truth = class AND predicted = class) AS tp,
       count(*) FILTER (WHERE ground_truth <> class AND predicted = class) AS fp,
       count(*) FILTER (WHERE ground_truth = class AND predicted <> class) AS fn
      FROM k JOIN cases c ON c.run_id = k.run_id GROUP BY ALL),
q AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / CAST(tp + fp AS DOUBLE) END AS p,
       CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / CAST(tp + fn AS DOUBLE) END AS r FROM s),
prf AS (SELECT run_id, class, tp, fp, fn, tp + fn AS support, p AS precision, r AS recall,
       CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f1 FROM q)"""


@query("agg_per_class_prf", B.ctes("cases") + ", " + PRF_SQL + """
SELECT run_id, class, tp, fp, fn, support, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1 FROM prf""")
def agg_per_class_prf(spark, d):
    return rounded(M.per_class_prf(B.cases(spark, d)), "precision", "recall", "f1")


@query("agg_macro_f1", B.ctes("cases") + ", " + PRF_SQL + """
SELECT run_id, count(*) AS n_classes, round(avg(f1), 6) AS macro_f1 FROM prf WHERE support > 0 GROUP BY run_id""")
def agg_macro_f1(spark, d):
    return rounded(M.macro_f1(B.cases(spark, d)), "macro_f1")


@query("agg_pred_dist", B.ctes("cases") + "SELECT run_id, predicted, count(*) AS n FROM cases GROUP BY ALL")
def agg_pred_dist(spark, d):
    return M.prediction_histogram(B.cases(spark, d))


RELIABILITY_SQL = """b AS (
SELECT run_id, least(CAST(floor(confidence * 10) AS INTEGER), 9) AS bin, confidence,
       CASE WHEN ground_truth = predicted THEN 1.0 ELSE 0.0 END AS ok FROM cases WHERE confidence IS NOT NULL),
rel AS (SELECT r.run_id, i.bin, count(b.bin) AS n, coalesce(avg(b.confidence), (i.bin + 0.5) / 10) AS mean_conf,
       avg(b.ok) AS accuracy
FROM (SELECT DISTINCT run_id FROM b) r CROSS JOIN (SELECT CAST(unnest(range(10)) AS INTEGER) AS bin) i
LEFT JOIN b ON b.run_id = r.run_id AND b.bin = i.bin GROUP BY r.run_id, i.bin),
ece AS (SELECT run_id, sum(n * abs(accuracy - mean_conf)) / sum(n) AS ece FROM rel WHERE n > 0 GROUP BY run_id)"""


@query("agg_reliability", B.ctes("cases") + ", " + RELIABILITY_SQL + """
SELECT run_id, bin, n, round(round(mean_conf, 12), 6) AS mean_conf, round(round(accuracy, 12), 6) AS accuracy FROM rel""")
def agg_reliability(spark, d):
    return rounded(M.reliability(B.cases(spark, d)), "mean_conf", "accuracy")


@query("agg_ece", B.ctes("cases") + ", " + RELIABILITY_SQL + "SELECT run_id, round(ece, 6) AS ece FROM ece")
def agg_ece(spark, d):
    return rounded(M.calibration_error(B.cases(spark, d)), "ece")


@query("agg_conf_degenerate", B.ctes("cases") + """
SELECT run_id, count(DISTINCT round(confidence, 3)) AS n_values, count(DISTINCT round(confidence, 3)) <= 2 AS degenerate
FROM cases GROUP BY run_id""")
def agg_conf_degenerate(spark, d):
    return M.confidence_degenerate(B.cases(spark, d))


@query("agg_index_percentile", B.ctes("cases") + """, s AS (
SELECT run_id, count(*) AS n, list(confidence ORDER BY confidence) AS l FROM cases
WHERE ground_truth = predicted GROUP BY run_id)
SELECT run_id, n, CASE WHEN n > 3 THEN l[n // 4 + 1] END AS p25, CASE WHEN n > 3 THEN l[n // 2 + 1] END AS p50,
       CASE WHEN n > 3 THEN l[3 * n // 4 + 1] END AS p75 FROM s""")
def agg_index_percentile(spark, d):
    return M.index_percentiles(B.cases(spark, d).filter(M.correct()))


@query("agg_describe", B.ctes("cases") + """
SELECT run_id, count(*) AS n, round(avg(confidence), 6) AS mean, round(median(confidence), 6) AS median,
       round(coalesce(stddev_samp(confidence), 0), 6) AS stdev, min(confidence) AS min, max(confidence) AS max,
       round(avg(CASE WHEN ground_truth = predicted THEN confidence END), 6) AS mean_correct,
       round(avg(CASE WHEN ground_truth <> predicted THEN confidence END), 6) AS mean_wrong
FROM cases GROUP BY run_id""")
def agg_describe(spark, d):
    return rounded(M.describe(B.cases(spark, d)), "mean", "median", "stdev", "mean_correct", "mean_wrong")


@query("agg_zero_filled_dist", B.ctes("cases") + """
SELECT r.run_id, t.conflict_type, count(c.case_id) AS n, count(c.case_id) < 20 AS too_few
FROM (SELECT DISTINCT run_id FROM cases) r
CROSS JOIN (VALUES ('NONE'), ('SOFT'), ('HARD'), ('UNKNOWN')) AS t(conflict_type)
LEFT JOIN cases c ON c.run_id = r.run_id AND c.conflict_type = t.conflict_type GROUP BY ALL""")
def agg_zero_filled_dist(spark, d):
    return M.zero_filled_counts(B.cases(spark, d), "run_id", "conflict_type", ["NONE", "SOFT", "HARD", "UNKNOWN"], 20)


PRIORS_SQL = f"""c AS (
SELECT r.run_id, v.class, count(k.case_id) AS n
FROM (SELECT DISTINCT run_id FROM cases) r CROSS JOIN {LABEL_VALUES}
LEFT JOIN cases k ON k.run_id = r.run_id AND k.predicted = v.class GROUP BY ALL),
p AS (SELECT run_id, class, n, ln(((n + 0.5) / (sum(n) OVER (PARTITION BY run_id) + 0.5 * 5)) / (1.0 / 5)) AS bias FROM c)"""


@query("agg_bias_priors", B.ctes("cases") + ", " + PRIORS_SQL + """
SELECT run_id, class, n, round(bias, 6) AS bias,
       CASE WHEN bias > 0.3 THEN 'over' WHEN bias < -0.3 THEN 'under' ELSE 'ok' END AS flag FROM p""")
def agg_bias_priors(spark, d):
    return rounded(M.bias_priors(B.cases(spark, d), LABELS), "bias")


@query("srt_summary", B.ctes("cases") + ", " + PRIORS_SQL + """
SELECT run_id, class, round(bias, 6) AS bias,
       row_number() OVER (PARTITION BY run_id ORDER BY round(bias, 6) DESC, class) AS position FROM p
ORDER BY run_id, position""")
def srt_summary(spark, d):
    from pyspark.sql import Window
    p = rounded(M.bias_priors(B.cases(spark, d), LABELS), "bias")
    w = Window.partitionBy("run_id").orderBy(F.col("bias").desc(), "class")
    return p.select("run_id", "class", "bias", F.row_number().over(w).cast("long").alias("position")).orderBy(
        "run_id", "position")


@query("agg_class_weights", B.ctes("cases") + f"""
SELECT run_id, class, n, round(CASE WHEN n = 0 THEN 0.0 ELSE sum(n) OVER (PARTITION BY run_id)
       / CAST(6 * n AS DOUBLE) END, 6) AS weight
FROM (SELECT r.run_id, v.class, count(k.case_id) AS n
      FROM (SELECT DISTINCT run_id FROM cases) r
      CROSS JOIN (SELECT class FROM {LABEL_VALUES} UNION ALL SELECT 'other') v
      LEFT JOIN cases k ON k.run_id = r.run_id AND k.ground_truth = v.class GROUP BY ALL) x""")
def agg_class_weights(spark, d):
    return rounded(M.class_weights(B.cases(spark, d), "ground_truth", LABELS + ["other"]), "weight")


@query("agg_convergence", B.ctes("cases") + """, s AS (
SELECT user_id, rcons, row_number() OVER (PARTITION BY user_id ORDER BY case_id) AS step FROM cases)
SELECT user_id, coalesce(min(CASE WHEN rcons > 0.8 THEN step - 1 END), count(*)) AS first_step,
       round(max_by(rcons, step), 6) AS last_reward, round(avg(rcons), 6) AS mean_reward FROM s GROUP BY user_id""")
def agg_convergence(spark, d):
    c = M.convergence(B.cases(spark, d), ["user_id"], "case_id", F.col("rcons"), prefix.block_of("case_id"))
    return rounded(c, "last_reward", "mean_reward")


# ---- thresholds -----------------------------------------------------------------
POINTS_SQL = """h AS (
SELECT run_id, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
FROM scored GROUP BY ALL),
t AS (SELECT run_id, sum(pos) AS n_pos, sum(neg) AS n_neg FROM h GROUP BY run_id),
c AS (SELECT h.*, n_pos, n_neg, sum(pos) OVER w AS pos_upto, sum(neg) OVER w AS neg_upto
      FROM h JOIN t ON t.run_id = h.run_id WINDOW w AS (PARTITION BY h.run_id ORDER BY score)),
pts AS (SELECT run_id, score AS tau, (pos_upto - pos) / CAST(n_pos AS DOUBLE) AS p_miss,
       (n_neg - neg_upto + neg) / CAST(n_neg AS DOUBLE) AS p_fa FROM c
  UNION ALL SELECT run_id, CAST('-inf' AS DOUBLE), 0.0, 1.0 FROM t UNION ALL SELECT run_id, CAST('inf' AS DOUBLE), 1.0, 0.0 FROM t),
r AS (SELECT * FROM (VALUES (1.0, 1.0), (2.0, 1.0), (5.0, 1.0), (10.0, 1.0)) AS v(c_miss, c_fa)),
priced AS (SELECT run_id, tau, CAST(c_miss AS DOUBLE) AS c_miss, CAST(c_fa AS DOUBLE) AS c_fa,
      round((c_miss * 0.5 * p_miss + c_fa * 0.5 * p_fa) / least(c_miss * 0.5, c_fa * 0.5), 12) AS ndcf
      FROM pts CROSS JOIN r),
best AS (SELECT run_id, c_miss, c_fa, c_miss / c_fa AS ratio, ndcf, tau FROM priced
      QUALIFY row_number() OVER (PARTITION BY run_id, c_miss, c_fa ORDER BY ndcf, tau) = 1)"""
TAU_TEXT = "CASE WHEN isinf(tau) THEN CASE WHEN tau > 0 THEN 'inf' ELSE '-inf' END ELSE printf('%.6f', tau) END"
AUROC_SQL = """a AS (SELECT run_id, CAST(any_value(n_pos) AS BIGINT) AS n_pos, CAST(any_value(n_neg) AS BIGINT) AS n_neg,
       CASE WHEN any_value(n_pos) * any_value(n_neg) = 0 THEN 0.5
            ELSE sum(pos * (neg_upto - neg / 2.0)) / (any_value(n_pos) * any_value(n_neg)) END AS auroc
FROM c GROUP BY run_id)"""


@query("flt_has_score", B.ctes("cases") + """
SELECT run_id, case_id, round(score, 6) AS score, CASE WHEN ground_truth <> 'view' THEN 1 ELSE 0 END AS label
FROM cases WHERE score IS NOT NULL""")
def flt_has_score(spark, d):
    return rounded(T.labelled(B.cases(spark, d), "score", NORMAL).select("run_id", "case_id", "score", "label"), "score")


@query("agg_auroc", B.ctes("scored") + ", " + POINTS_SQL + ", " + AUROC_SQL + """
SELECT run_id, n_pos, n_neg, round(auroc, 6) AS auroc FROM a""")
def agg_auroc(spark, d):
    return rounded(T.auroc(B.scored(spark, d), ["run_id"]), "auroc")


@query("agg_ndcf", B.ctes("scored") + """
SELECT run_id, round(m, 6) AS p_miss, round(f, 6) AS p_fa, round((2.5 * m + 0.5 * f) / 0.5, 6) AS ndcf
FROM (SELECT run_id, coalesce(avg(CASE WHEN label = 1 THEN CASE WHEN score < 0.4 THEN 1.0 ELSE 0.0 END END), 0) AS m,
             coalesce(avg(CASE WHEN label = 0 THEN CASE WHEN score >= 0.4 THEN 1.0 ELSE 0.0 END END), 0) AS f
      FROM scored GROUP BY run_id) x""")
def agg_ndcf(spark, d):
    return rounded(T.ndcf_at(B.scored(spark, d), ["run_id"], 0.4), "p_miss", "p_fa", "ndcf")


@query("agg_min_ndcf", B.ctes("scored") + ", " + POINTS_SQL + f"""
SELECT run_id, round(ndcf, 6) AS ndcf, {TAU_TEXT} AS tau FROM best WHERE c_miss = 5""")
def agg_min_ndcf(spark, d):
    m = T.min_ndcf(B.scored(spark, d), ["run_id"])
    return m.select("run_id", F.round("ndcf", 6).alias("ndcf"), T.threshold_text(F.col("tau")).alias("tau"))


@query("agg_ndcf_sweep", B.ctes("scored") + ", " + POINTS_SQL + f"""
SELECT run_id, c_miss, c_fa, ratio, round(ndcf, 6) AS ndcf, {TAU_TEXT} AS tau, 'optimal' AS mode FROM best
UNION ALL
SELECT run_id, CAST(c_miss AS DOUBLE), CAST(c_fa AS DOUBLE), CAST(c_miss / c_fa AS DOUBLE),
       round((c_miss * 0.5 * m + c_fa * 0.5 * f) / least(c_miss * 0.5, c_fa * 0.5), 6), '0.400000', 'fixed'
FROM (SELECT run_id, avg(CASE WHEN label = 1 THEN CASE WHEN score < 0.4 THEN 1.0 ELSE 0.0 END END) AS m,
             avg(CASE WHEN label = 0 THEN CASE WHEN score >= 0.4 THEN 1.0 ELSE 0.0 END END) AS f
      FROM scored GROUP BY run_id) x CROSS JOIN r""")
def agg_ndcf_sweep(spark, d):
    s = B.scored(spark, d)
    both = T.ndcf_sweep(s, ["run_id"]).unionByName(T.ndcf_sweep(s, ["run_id"], 0.4))
    return both.withColumns({"ndcf": F.round("ndcf", 6), "tau": T.threshold_text(F.col("tau"))})


@query("agg_roc_det_points", B.ctes("scored") + ", " + POINTS_SQL + """
SELECT run_id, round(tau, 6) AS tau, round(p_fa, 6) AS fpr, round(1 - p_miss, 6) AS tpr, round(p_miss, 6) AS fnr
FROM pts WHERE NOT isinf(tau)""")
def agg_roc_det_points(spark, d):
    return rounded(T.curve_points(B.scored(spark, d), ["run_id"]), "tau", "fpr", "tpr", "fnr")


@query("agg_detection_summary", B.ctes("scored") + ", " + POINTS_SQL + ", " + AUROC_SQL + """
SELECT a.run_id, n_pos AS n_anomaly, n_neg AS n_normal, round(any_value(auroc), 4) AS auroc,
       max(CASE WHEN c_miss = 1 THEN round(ndcf, 4) END) AS min_ndcf_1_1,
       max(CASE WHEN c_miss = 2 THEN round(ndcf, 4) END) AS min_ndcf_2_1,
       max(CASE WHEN c_miss = 5 THEN round(ndcf, 4) END) AS min_ndcf_5_1,
       max(CASE WHEN c_miss = 10 THEN round(ndcf, 4) END) AS min_ndcf_10_1,
       max(CASE WHEN c_miss = 5 THEN CASE WHEN isinf(tau) THEN CASE WHEN tau > 0 THEN 'inf' ELSE '-inf' END
           ELSE printf('%.6f', round(tau, 4)) END END) AS tau_optimal
FROM a JOIN best ON best.run_id = a.run_id WHERE n_pos > 0 AND n_neg > 0 GROUP BY a.run_id, n_pos, n_neg""")
def agg_detection_summary(spark, d):
    s = T.detection_summary(B.scored(spark, d), ["run_id"])
    return s.withColumn("tau_optimal", T.threshold_text(F.col("tau_optimal")))
