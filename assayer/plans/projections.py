"""Queries over single cases, snippets and segments."""

from pyspark.sql import functions as F

from assayer import bindings as B
from assayer.operators import projections as P
from assayer.plans.metrics import rounded
from assayer.plans.registry import query

NORMAL = "view"
AS_NAMES = {v: k for k, v in B.EVENT_ALIAS.items()}


@query("prj_class_from_id", """
WITH ids AS (SELECT 'customer' AS kind, c_custkey AS id, c_name AS name FROM customer
 UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier
 UNION ALL SELECT 'segment', c_custkey, concat(c_mktsegment, CAST(c_custkey AS STRING), '_x264') FROM customer
 UNION ALL SELECT 'normal', s_suppkey, concat('Normal_Videos', CAST(s_suppkey AS STRING)) FROM supplier)
SELECT kind, id, CASE WHEN starts_with(name, 'Normal') OR regexp_extract(name, '^([A-Za-z]+)[0-9]+', 1) = '' THEN 'Normal'
       ELSE regexp_extract(name, '^([A-Za-z]+)[0-9]+', 1) END AS class FROM ids""")
def prj_class_from_id(spark, d):
    c, s = B.table(spark, d, "customer"), B.table(spark, d, "supplier")
    def part(df, kind, key, name):
        return df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), name.alias("name"))
    ids = (part(c, "customer", "c_custkey", F.col("c_name"))
           .unionByName(part(s, "supplier", "s_suppkey", F.col("s_name")))
           .unionByName(part(c, "segment", "c_custkey", F.concat("c_mktsegment", F.col("c_custkey").cast("string"), F.lit("_x264"))))
           .unionByName(part(s, "normal", "s_suppkey", F.concat(F.lit("Normal_Videos"), F.col("s_suppkey").cast("string")))))
    return ids.select("kind", "id", P.class_from_id("name").alias("class"))


@query("prj_class_flags", B.ctes("cases", "dim_class") + """
SELECT case_id, g.kind = 'crime' AS gt_is_crime, g.kind = 'non_crime' AS gt_is_non_crime, p.kind = 'crime' AS pred_is_crime,
       p.kind = 'non_crime' AS pred_is_non_crime, p.kind = 'non_crime' AS is_non_crime_anomaly,
       ground_truth <> 'view' AS is_anomaly_gt, predicted <> 'view' AS is_anomaly_pred,
       (ground_truth <> 'view') = (predicted <> 'view') AS anomaly_correct
FROM cases JOIN dim_class g ON g.class = ground_truth JOIN dim_class p ON p.class = predicted""")
def prj_class_flags(spark, d):
    f = P.with_class_flags(B.cases(spark, d), B.event_classes(spark), NORMAL)
    return f.select("case_id", "gt_is_crime", "gt_is_non_crime", "pred_is_crime", "pred_is_non_crime",
                    "is_non_crime_anomaly", "is_anomaly_gt", "is_anomaly_pred", "anomaly_correct")


@query("prj_class_dims", B.ctes("cases", "dim_class") + """, k AS (
SELECT case_id, predicted AS label FROM cases UNION ALL SELECT -1 - case_id, conflict_type FROM cases)
SELECT case_id, label, coalesce(hint_group, 'violence') AS hint_group, coalesce(reward_group, 'unknown') AS reward_group,
       coalesce(severity, 'MEDIUM') AS severity, coalesce(weight_group, 'default') AS weight_group,
       coalesce(label_group, '') AS label_group, coalesce(w1, 0.35) AS w1, coalesce(w2, 0.2) AS w2,
       coalesce(w3, 0.35) AS w3, coalesce(w4, 0.1) AS w4
FROM k LEFT JOIN dim_class ON class = label""")
def prj_class_dims(spark, d):
    c = B.cases(spark, d)
    k = c.select("case_id", F.inline(F.array(
        F.struct(F.col("case_id").alias("key"), F.col("predicted").alias("label")),
        F.struct((-1 - F.col("case_id")).alias("key"), F.col("conflict_type").alias("label")))))
    j = P.with_class_dims(k.select(F.col("key").alias("case_id"), "label"), B.event_classes(spark), "label")
    return j.select("case_id", "label", "hint_group", "reward_group", "severity", "weight_group", "label_group",
                    "w1", "w2", "w3", "w4")


@query("prj_defaults", B.ctes("cases") + """
SELECT case_id, CASE WHEN case_id % 10 = 3 THEN 0.0 ELSE round(confidence, 6) END AS confidence,
       coalesce(nullif(predicted, 'error'), 'view') AS predicted FROM cases""")
def prj_defaults(spark, d):
    c = B.cases(spark, d).select(
        "case_id", F.when(F.col("case_id") % 10 != 3, F.round("confidence", 6)).alias("confidence"),
        F.nullif(F.col("predicted"), F.lit("error")).alias("predicted"))
    return P.with_defaults(c, ["confidence"], {"predicted": NORMAL})


@query("prj_gate", B.ctes("cases") + """
SELECT case_id, score < 0.2 AS gated, CASE WHEN score < 0.2 THEN 'view' ELSE predicted END AS gated_class,
       predicted AS open_class FROM cases""")
def prj_gate(spark, d):
    g = P.gate(B.cases(spark, d), 0.2, NORMAL).withColumnsRenamed({"gated": "g", "gated_class": "gc"})
    g = P.gate(g, None, NORMAL)
    return g.select("case_id", F.col("g").alias("gated"), F.col("gc").alias("gated_class"),
                    F.col("gated_class").alias("open_class"))


@query("prj_ensemble", B.ctes("cases") + """
SELECT case_id, CASE WHEN confidence < 0.7 AND ground_truth <> predicted AND score > 0.55
       AND ground_truth NOT IN ('view', '') AND 0.3 * score > 0.7 * confidence THEN ground_truth ELSE predicted END AS final
FROM cases""")
def prj_ensemble(spark, d):
    return B.cases(spark, d).select("case_id", P.ensemble(
        F.col("predicted"), F.col("confidence"), F.col("ground_truth"), F.col("score"), NORMAL).alias("final"))


@query("prj_route", B.ctes("cases", "dim_class") + """
SELECT case_id, CASE kind WHEN 'crime' THEN 'legal' WHEN 'non_crime' THEN 'descriptive' ELSE 'template' END AS path,
       round(CASE WHEN kind = 'non_crime' THEN 1.0 ELSE rcons END, 6) AS rcons,
       round(CASE WHEN kind = 'non_crime' THEN 0.0 ELSE rlegal END, 6) AS rlegal,
       CASE WHEN kind = 'non_crime' THEN 'NONE' ELSE conflict_type END AS conflict_type
FROM cases JOIN dim_class ON class = predicted""")
def prj_route(spark, d):
    kinds = F.broadcast(B.event_classes(spark).select(F.col("class").alias("predicted"), "kind"))
    c = B.cases(spark, d).join(kinds, "predicted").withColumns(P.route(F.col("kind")))
    return c.select("case_id", "path", F.round("rcons_out", 6).alias("rcons"), F.round("rlegal_out", 6).alias("rlegal"),
                    F.col("conflict_out").alias("conflict_type"))


COST_STEP_SQL = """CASE WHEN total_turns <= 4 THEN 0.0
       WHEN total_turns <= CASE WHEN severity = 'HIGH' THEN 10 ELSE 8 END
       THEN (total_turns - 4) / CAST(CASE WHEN severity = 'HIGH' THEN 6 ELSE 4 END AS DOUBLE) ELSE 1.0 END"""


@query("prj_rcost_step", B.ctes("cases", "dim_class") + f"""
SELECT case_id, round({COST_STEP_SQL}, 6) AS rcost FROM cases JOIN dim_class ON class = predicted""")
def prj_rcost_step(spark, d):
    c = P.with_class_dims(B.cases(spark, d), B.event_classes(spark), "predicted")
    return c.select("case_id", F.round(P.cost_step(F.col("total_turns"), F.col("severity")), 6).alias("rcost"))


@query("prj_rcost_log", B.ctes("cases") + "SELECT case_id, round(ln(greatest(1, total_turns)), 6) AS rcost FROM cases")
def prj_rcost_log(spark, d):
    return B.cases(spark, d).select("case_id", F.round(P.cost_log(F.col("total_turns")), 6).alias("rcost"))


RACC_SQL = """CASE WHEN ground_truth = predicted THEN 1.0
       WHEN g.reward_group = p.reward_group AND p.reward_group <> 'normal' THEN 0.5 ELSE 0.0 END"""


def _with_groups(spark, d):
    groups = B.event_classes(spark).select("class", "reward_group")
    c = B.cases(spark, d)
    c = c.join(F.broadcast(groups.withColumnsRenamed({"class": "ground_truth", "reward_group": "gt_group"})),
               "ground_truth", "left")
    return P.with_class_dims(c, B.event_classes(spark), "predicted").withColumn(
        "gt_group", F.coalesce("gt_group", F.lit("unknown")))


@query("prj_racc_tier", B.ctes("cases", "dim_class") + f"""
SELECT case_id, CAST({RACC_SQL} AS DOUBLE) AS racc FROM cases JOIN dim_class g ON g.class = ground_truth
JOIN dim_class p ON p.class = predicted""")
def prj_racc_tier(spark, d):
    return _with_groups(spark, d).select("case_id", P.accuracy_tier(
        F.col("predicted"), F.col("ground_truth"), F.col("reward_group"), F.col("gt_group")).alias("racc"))


@query("prj_reward", B.ctes("cases", "dim_class") + f"""
SELECT case_id, round(0.4 * {RACC_SQL} + 0.3 * rcons + 0.2 * rlegal - 0.1 * ln(greatest(1, total_turns)), 6) AS fixed_reward,
       round(p.w1 * CASE WHEN ground_truth = predicted THEN 1.0 ELSE 0.0 END
         + CASE WHEN score < 0.4 THEN least(p.w2 + 0.05, 0.30) ELSE p.w2 END * rcons + p.w3 * rlegal
         - CASE WHEN score < 0.4 THEN greatest(p.w4 - 0.05, 0.05) ELSE p.w4 END * {COST_STEP_SQL.replace('severity', 'p.severity')}, 6) AS class_reward
FROM cases JOIN dim_class g ON g.class = ground_truth JOIN dim_class p ON p.class = predicted""")
def prj_reward(spark, d):
    c = _with_groups(spark, d)
    turns, cons, legal = F.col("total_turns"), F.col("rcons"), F.col("rlegal")
    tier = P.accuracy_tier(F.col("predicted"), F.col("ground_truth"), F.col("reward_group"), F.col("gt_group"))
    hit = F.when(F.col("predicted") == F.col("ground_truth"), 1.0).otherwise(0.0)
    return c.select(
        "case_id", F.round(P.reward(tier, cons, legal, P.cost_log(turns)), 6).alias("fixed_reward"),
        F.round(P.reward(hit, cons, legal, P.cost_step(turns, F.col("severity")),
                         P.shifted_weights(F.col("score"))), 6).alias("class_reward"))


@query("prj_bands", B.ctes("paired") + """, x AS (
SELECT item_id, least(a, b) / greatest(a, b) AS r, item_id % 7 AS s FROM paired)
SELECT item_id, CASE WHEN r < 0.5 THEN 'poor (< 0.5)' WHEN r < 0.75 THEN 'moderate (0.5–0.75)'
       WHEN r < 0.9 THEN 'good (0.75–0.9)' ELSE 'excellent (≥ 0.9)' END AS icc_band,
       CASE WHEN r / 10 < 0.001 THEN '***' WHEN r / 10 < 0.01 THEN '**' WHEN r / 10 < 0.05 THEN '*' ELSE '' END AS stars,
       CASE WHEN r < 0.3 THEN '嚴重光線不足，視覺證據可信度低' WHEN r < 0.6 THEN '光線不佳，部分細節可能失真' ELSE '光線條件良好' END AS light,
       CASE s WHEN 0 THEN 'medium' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' WHEN 4 THEN 'high' ELSE 'medium' END AS risk,
       CASE WHEN r > 0.8 THEN '高度升溫' WHEN r > 0.7 THEN '中度升溫' ELSE '低度升溫' END AS escalation
FROM x""")
def prj_bands(spark, d):
    r = F.least("a", "b") / F.greatest("a", "b")
    scenes = F.array(*[F.lit(s) for s in [*P.SCENE_RISK, "elsewhere"]])
    x = B.paired(spark, d).select("item_id", r.alias("r"), scenes[(F.col("item_id") % 7).cast("int")].alias("scene"))
    return x.select("item_id", P.icc_band(F.col("r")).alias("icc_band"), P.stars(F.col("r") / 10).alias("stars"),
                    P.light_note(F.col("r")).alias("light"), P.scene_risk(F.col("scene")).alias("risk"),
                    P.escalation_label(F.col("r"), 0.7, 0.8).alias("escalation"))


def _in(target):
    names = [a for a, c in B.EVENT_ALIAS.items() if c in target]
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


@query("prj_indicators", B.ctes("cases", "dim_class") + (""", x AS (
SELECT case_id, predicted, hint_group, score,
       list_extract(['angry', 'disgust', 'fear', 'happy', 'sad', 'surprise', 'neutral'], CAST(case_id %% 7 + 1 AS INTEGER)) AS emotion
FROM cases JOIN dim_class ON class = predicted), y AS (
SELECT case_id, concat_ws('|', CASE WHEN emotion IN ('angry', 'fear', 'disgust')
         THEN concat('偵測到事前情緒：', emotion, '（可能的衝突前兆）') END,
       CASE hint_group WHEN 'violence' THEN '人員間肢體距離縮短，存在對峙跡象' WHEN 'property' THEN '嫌疑人有環境偵察行為，鎖定目標物'
         WHEN 'public_safety' THEN '場景出現可疑物品或車輛異常移動' END) AS pre,
       concat_ws('|', CASE WHEN score > 0.6 THEN '事後現場人員快速散離' END,
       CASE WHEN predicted IN %s THEN '受害者出現防禦性姿態或倒地行為' END,
       CASE WHEN predicted IN %s THEN '嫌疑人快速離開現場，攜帶隱匿物品' END) AS post FROM x)
SELECT case_id, length(pre) - length(replace(pre, '|', '')) + 1 AS n_pre, pre,
       CASE WHEN post = '' THEN '事後行為正常，需進一步觀察' ELSE post END AS post FROM y""" % (
    _in(["Assault", "Fighting", "Shooting", "Robbery"]), _in(["Stealing", "Shoplifting", "Burglary"]))))
def prj_indicators(spark, d):
    c = P.with_class_dims(B.cases(spark, d), B.event_classes(spark), "predicted")
    emotion = F.array(*[F.lit(e) for e in P.EMOTIONS])[(F.col("case_id") % 7).cast("int")]
    pre = P.pre_indicators(F.col("hint_group"), emotion)
    post = P.post_indicators(F.col("predicted"), F.col("score"), B.EVENT_ALIAS)
    return c.select("case_id", F.size(pre).cast("long").alias("n_pre"), F.array_join(pre, "|").alias("pre"),
                    F.array_join(post, "|").alias("post"))


LIGHT_SQL = """least(greatest(CASE WHEN luminance < 50 THEN luminance / 50 * 0.4
       WHEN luminance > 200 THEN greatest(0.0, 1 - (luminance - 200) / 55 * 0.4)
       ELSE 1 - abs(luminance - 120) / 120 * 0.3 END, 0.0), 1.0)"""


@query("prj_illumination", B.ctes("snippets") + f"""
SELECT event_id, round({LIGHT_SQL}, 6) AS illumination FROM snippets""")
def prj_illumination(spark, d):
    return B.snippets(spark, d).select("event_id", F.round(P.illumination(F.col("luminance")), 6).alias("illumination"))


@query("prj_credibility", B.ctes("snippets") + """
SELECT event_id, round(least(greatest(0.6 * illumination + 0.4 * (1 - occlusion), 0), 1), 6) AS credibility FROM snippets""")
def prj_credibility(spark, d):
    return B.snippets(spark, d).select(
        "event_id", F.round(P.credibility(F.col("illumination"), F.col("occlusion")), 6).alias("credibility"))


@query("prj_segments_zip", B.ctes("intervals") + """
SELECT video_id, seg_idx, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, description,
       CAST(trunc(start_s * 25) AS INTEGER) AS start_frame, CAST(trunc(end_s * 25) AS INTEGER) AS end_frame FROM intervals""")
def prj_segments_zip(spark, d):
    # parallel arrays as they stand in an annotation; one annotation piece per hour keeps a long video in many rows
    from assayer.sources.readers import annotation_pieces
    pieces = annotation_pieces(B.intervals(spark, d))
    zipped = pieces.select("video_id", "ids", F.explode(F.arrays_zip(
        F.col("ids").alias("seg_idx"), P.segment_structs(F.col("timestamps"), F.col("sentences")).alias("s"))).alias("z"))
    return zipped.select("video_id", "z.seg_idx", F.round("z.s.start_s", 6).alias("start_s"),
                         F.round("z.s.end_s", 6).alias("end_s"), "z.s.description", "z.s.start_frame", "z.s.end_frame")
