"""Queries over the agent reports of a case."""

from pyspark.sql import functions as F

from assayer import bindings as B
from assayer.operators import audit as A
from assayer.operators import projections as P
from assayer.plans.metrics import rounded
from assayer.plans.registry import query
from assayer.session import materialise

NORMAL = "view"
KEYS = ["case_id"]


def is_env():
    """The environment report stands first, second, nowhere, or first and third in a case."""
    kind = F.col("case_id") % 4
    return F.when(kind == 0, F.col("pos") == 1).when(kind == 1, F.col("pos") == 2).when(kind == 2, F.lit(False)).otherwise(
        F.col("pos").isin(1, 3))


IS_ENV_SQL = "CASE case_id % 4 WHEN 0 THEN pos = 1 WHEN 1 THEN pos = 2 WHEN 2 THEN false ELSE pos IN (1, 3) END"


def reports(spark, d, agents=None):
    a = B.agents(spark, d) if agents is None else agents
    refs = F.when(F.col("n_frames") > 0, F.sequence(
        F.col("first_frame").cast("int"), (F.col("first_frame") + F.col("n_frames") - 1).cast("int"))).otherwise(
        F.array().cast("array<int>"))
    return a.withColumns({"is_env": is_env(), "frame_refs": refs, "video_fps": F.lit(30.0)})


def parts(spark, d):
    """Reports written once: the audit reads them for rules, environment, ranges and votes."""
    return materialise(reports(spark, d), "agent-reports"), KEYS, B.event_classes(spark), NORMAL


SEV_SQL = "CASE category WHEN 'error' THEN 'HIGH' WHEN 'purchase' THEN 'MEDIUM' WHEN 'click' THEN 'LOW_PLANNED' WHEN 'signup' THEN 'MEDIUM' END"
BASE = """g AS (SELECT *, %s AS is_env, %s AS severity, escalation_start_frame - first_frame AS gap FROM agents),
cat AS (SELECT *, min(pos) OVER (PARTITION BY case_id) AS first_pos FROM g WHERE NOT is_env), env AS (SELECT * FROM g WHERE is_env),
env1 AS (SELECT * FROM env QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY pos) = 1), ids AS (SELECT DISTINCT case_id FROM agents),
temporal AS (SELECT case_id, pos, 'attack_first' AS rule, 0.9 AS severity, gap FROM cat WHERE pos = first_pos AND n_frames > 0 AND gap > 30
  UNION ALL SELECT case_id, pos, 'far_apart', 0.7, gap FROM cat WHERE pos = first_pos AND n_frames > 0 AND abs(gap) > 90),
pairs AS (SELECT a.case_id, a.pos AS pos_a, b.pos AS pos_b, a.category AS category_a, b.category AS category_b,
       a.confidence AS confidence_a, b.confidence AS confidence_b
  FROM cat a JOIN cat b ON a.case_id = b.case_id AND a.pos < b.pos AND a.category <> b.category
   AND a.category <> 'view' AND b.category <> 'view' AND abs(a.confidence - b.confidence) > 0.5),
mil AS (SELECT case_id, pos FROM cat WHERE pos = first_pos AND vlm_used AND mil_category NOT IN ('view', '') AND category NOT IN ('view', '')
   AND mil_category <> category AND mil_confidence >= 0.4 AND abs(confidence - mil_confidence) > 0.5),
causal AS (SELECT case_id, pos, 1 AS rule_order, 'no_antecedent_high' AS rule, true AS hard, 0.85 AS severity FROM cat WHERE severity = 'HIGH' AND n_pre = 0 AND confidence > 0.96
  UNION ALL SELECT case_id, pos, 2, 'few_antecedents', false, 0.4 FROM cat WHERE severity = 'MEDIUM' AND n_pre < 2 AND confidence > 0.81
  UNION ALL SELECT case_id, pos, 3, 'no_watching', false, 0.35 FROM cat WHERE severity = 'LOW_PLANNED' AND n_pre = 0 AND confidence > 0.81
  UNION ALL SELECT case_id, pos, 5, 'element_mismatch', false, 0.5 FROM cat WHERE rag_match_ratio < 0.3 AND confidence > 0.7),
spurious AS (SELECT c.case_id, c.pos, e.pos AS env_pos, coalesce(e.env_contribution, (c.confidence - e.confidence) * 0.5) AS env_drop
  FROM cat c JOIN env1 e ON e.case_id = c.case_id
  WHERE e.confidence < 0.4 AND c.confidence > 0.75 AND coalesce(e.env_contribution, (c.confidence - e.confidence) * 0.5) > 0.3),
lowp AS (SELECT a.case_id, a.pos AS p1, b.pos AS p2, CASE WHEN a.confidence < b.confidence THEN a.pos ELSE b.pos END AS weaker
  FROM cat a JOIN cat b ON a.case_id = b.case_id AND a.pos < b.pos AND a.category = b.category AND a.confidence < 0.7 AND b.confidence < 0.7
  QUALIFY row_number() OVER (PARTITION BY a.case_id ORDER BY a.pos, b.pos) = 1),
l1 AS (SELECT case_id FROM temporal UNION SELECT case_id FROM pairs UNION SELECT case_id FROM mil),
soft2 AS (SELECT case_id, pos FROM causal WHERE NOT hard QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY rule_order, pos) = 1),
flags AS (SELECT k.case_id, k.case_id IN (SELECT case_id FROM l1) AS l1, k.case_id IN (SELECT case_id FROM causal WHERE hard) AS h2,
       k.case_id IN (SELECT case_id FROM causal) AS l2, (SELECT min(pos) FROM spurious s WHERE s.case_id = k.case_id) AS l3,
       (SELECT weaker FROM lowp p WHERE p.case_id = k.case_id) AS low, (SELECT pos FROM soft2 s WHERE s.case_id = k.case_id) AS s2
  FROM (SELECT DISTINCT case_id FROM agents) k),
cls AS (SELECT case_id, CASE WHEN l1 OR h2 THEN 'HARD' WHEN low IS NOT NULL OR l3 IS NOT NULL OR l2 THEN 'SOFT' ELSE 'NONE' END AS conflict_type,
       CASE WHEN l1 THEN 'TEMPORAL' WHEN h2 THEN 'CAUSAL' WHEN low IS NOT NULL THEN 'NONE' WHEN l3 IS NOT NULL THEN 'SPURIOUS'
            WHEN l2 THEN 'CAUSAL' ELSE 'NONE' END AS layer,
       CASE WHEN l1 OR h2 THEN '' ELSE coalesce('agent' || CAST(coalesce(low, l3, s2) AS STRING), '') END AS target FROM flags),
v AS (SELECT case_id, category, round(sum(confidence), 9) AS votes, min(pos) AS first FROM cat GROUP BY ALL),
cons AS (SELECT ids.case_id, coalesce(consensus, 'view') AS consensus, coalesce(is_convergent, false) AS is_convergent FROM ids LEFT JOIN (
   SELECT case_id, category AS consensus, round(votes / total, 9) >= 0.8 AS is_convergent FROM (
   SELECT *, nullif(sum(votes) OVER (PARTITION BY case_id), 0) AS total FROM v) x
   QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY votes DESC, first) = 1) y ON y.case_id = ids.case_id),
frames AS (SELECT case_id, pos, unnest(range(first_frame, first_frame + n_frames)) AS frame FROM g WHERE n_frames > 0),
ov AS (SELECT n.case_id, n_reports, n_reports >= 2 AND holders = n_reports AS overlap FROM
   (SELECT case_id, count(*) AS n_reports FROM g WHERE n_frames > 0 GROUP BY case_id) n
   JOIN (SELECT case_id, max(c) AS holders FROM (SELECT case_id, frame, count(*) AS c FROM frames GROUP BY ALL) y GROUP BY case_id) h ON h.case_id = n.case_id),
mass AS (SELECT *, confidence * (1 - u) * (0.5 + 0.5 * rag_match_ratio) AS mc, confidence * (1 - u) AS ec FROM (
   SELECT *, CASE WHEN n_frames = 0 THEN 0.3 WHEN n_frames <= 2 THEN 0.15 ELSE 0.05 END AS u FROM g) z),
mass2 AS (SELECT *, greatest(0, 1 - mc - u) AS mn, greatest(0, 1 - ec - (u + (1 - confidence) * 0.3)) AS en FROM mass),
kk AS (SELECT c.case_id, avg(least(c.mc * e.en + c.mn * e.ec, 1)) AS k FROM mass2 c JOIN mass2 e
   ON e.case_id = c.case_id AND NOT c.is_env AND e.is_env GROUP BY c.case_id),
kd AS (SELECT case_id, avg(least(mc * (0.88 - 0.85 * confidence) + mn * 0.95 * confidence, 1)) AS k FROM mass2 WHERE NOT is_env GROUP BY case_id),
bonus AS (SELECT case_id, CASE WHEN bool_or(NOT is_env AND has_causal_chain AND n_pre > 0 AND n_post > 0) THEN 0.2 ELSE 0 END
       + CASE WHEN bool_or(NOT is_env AND rlegal > 0.8) THEN 0.1 ELSE 0 END AS b FROM g GROUP BY case_id),
ds AS (SELECT b.case_id, coalesce(kk.k, kd.k, 0) AS k, CAST(b.b + CASE WHEN ov.overlap THEN 0.2 ELSE 0 END AS DOUBLE) AS bonus,
       least(greatest(1 - coalesce(kk.k, kd.k, 0) + b.b + CASE WHEN ov.overlap THEN 0.2 ELSE 0 END, 0), 1.3) AS rcons, coalesce(kd.k, 0) AS k_default
   FROM bonus b LEFT JOIN kk ON kk.case_id = b.case_id LEFT JOIN kd ON kd.case_id = b.case_id LEFT JOIN ov ON ov.case_id = b.case_id)""" % (IS_ENV_SQL, SEV_SQL)
AUDIT_SQL = B.ctes("agents") + ", " + BASE


@query("jn_pairs_theta", AUDIT_SQL + """
SELECT case_id, pos_a, pos_b, category_a, category_b, round(confidence_a, 6) AS confidence_a, round(confidence_b, 6) AS confidence_b FROM pairs""")
def jn_pairs_theta(spark, d):
    p = A.mismatch_pairs(reports(spark, d), KEYS, NORMAL)
    return rounded(p.drop("frames_a", "frames_b"), "confidence_a", "confidence_b")


@query("jn_evidence_overlap", AUDIT_SQL + "SELECT case_id, n_reports, overlap FROM ov")
def jn_evidence_overlap(spark, d):
    return A.common_frame(reports(spark, d), KEYS)


@query("aud_temporal", AUDIT_SQL + "SELECT case_id, rule, CAST(severity AS DOUBLE) AS severity, gap FROM temporal")
def aud_temporal(spark, d):
    a = A.annotated(*parts(spark, d))
    return a.select("case_id", F.inline("temporal"))


@query("aud_category", AUDIT_SQL + """
SELECT case_id, 'category_mismatch' AS rule, 'agent' || CAST(pos_a AS STRING) AS agent_a, 'agent' || CAST(pos_b AS STRING) AS agent_b,
       category_a || '（信心 ' || printf('%.2f', confidence_a) || '）' AS claim_a, category_b || '（信心 ' || printf('%.2f', confidence_b) || '）' AS claim_b FROM pairs
UNION ALL SELECT m.case_id, 'second_opinion', 'agent' || CAST(m.pos AS STRING), 'second opinion', category || '（信心 ' || printf('%.2f', confidence) || '）',
       mil_category || '（信心 ' || printf('%.2f', mil_confidence) || '）' FROM mil m JOIN cat ON cat.case_id = m.case_id AND cat.pos = m.pos""")
def aud_category(spark, d):
    c = A.conflicts(*parts(spark, d))
    return c.filter(F.col("rule").isin("category_mismatch", "second_opinion")).select(
        "case_id", "rule", "agent_a", "agent_b", "claim_a", "claim_b")


@query("aud_causal", AUDIT_SQL + "SELECT case_id, pos, rule_order, rule, hard, CAST(severity AS DOUBLE) AS severity FROM causal")
def aud_causal(spark, d):
    return A.annotated(*parts(spark, d)).select("case_id", "pos", F.inline("causal"))


@query("aud_spurious", AUDIT_SQL + "SELECT case_id, pos, env_pos, round(env_drop, 6) AS env_drop FROM spurious")
def aud_spurious(spark, d):
    a = A.annotated(*parts(spark, d)).filter("spurious")
    return a.select("case_id", "pos", F.col("env.pos").alias("env_pos"), F.round("env_drop", 6).alias("env_drop"))


@query("aud_classify", AUDIT_SQL + "SELECT case_id, conflict_type, layer, target FROM cls")
def aud_classify(spark, d):
    return A.classify(*parts(spark, d)).select("case_id", "conflict_type", "layer", "target")


@query("aud_focus", AUDIT_SQL + """, own AS (
SELECT case_id, pos FROM temporal UNION SELECT case_id, pos_a FROM pairs UNION SELECT case_id, pos_b FROM pairs
UNION SELECT case_id, pos FROM mil UNION SELECT case_id, pos FROM causal),
fr AS (SELECT f.case_id, CAST(f.frame AS INTEGER) AS frame FROM frames f JOIN own o ON o.case_id = f.case_id AND o.pos = f.pos
  UNION SELECT t.case_id, CAST(c.escalation_start_frame AS INTEGER) FROM temporal t JOIN cat c ON c.case_id = t.case_id AND c.pos = t.pos)
SELECT case_id, string_agg(CAST(frame AS STRING), ',' ORDER BY frame) AS frames FROM (
  SELECT fr.* FROM fr JOIN cls ON cls.case_id = fr.case_id AND conflict_type = 'HARD'
  QUALIFY row_number() OVER (PARTITION BY fr.case_id ORDER BY frame) <= 10) x GROUP BY case_id""")
def aud_focus(spark, d):
    f = A.focus_frames(*parts(spark, d))
    return f.select("case_id", F.array_join(F.transform("frames", lambda x: x.cast("string")), ",").alias("frames"))


CLAIM_SQL = "{0}category || '（信心 ' || printf('%.2f', {0}confidence) || '）'"
FRAMES_SQL = "range({0}first_frame, {0}first_frame + least({0}n_frames, 3))"
PAIRS_SQL = AUDIT_SQL + f""", cf AS (
SELECT t.case_id, 0 AS o, rule, t.pos AS pa, 'agent' || CAST(t.pos AS STRING) AS b, {CLAIM_SQL.format('c.')} AS ca, {CLAIM_SQL.format('c.')} AS cb,
       {FRAMES_SQL.format('c.')} AS fa, [CAST(c.escalation_start_frame AS BIGINT)] AS fb, t.severity FROM temporal t JOIN cat c ON c.case_id = t.case_id AND c.pos = t.pos
UNION ALL SELECT p.case_id, 1, 'category_mismatch', pos_a, 'agent' || CAST(pos_b AS STRING), {CLAIM_SQL.format('a.')}, {CLAIM_SQL.format('b.')},
       {FRAMES_SQL.format('a.')}, {FRAMES_SQL.format('b.')}, 0.85
  FROM pairs p JOIN cat a ON a.case_id = p.case_id AND a.pos = pos_a JOIN cat b ON b.case_id = p.case_id AND b.pos = pos_b
UNION ALL SELECT m.case_id, 2, 'second_opinion', m.pos, 'second opinion', {CLAIM_SQL.format('c.')}, mil_category || '（信心 ' || printf('%.2f', mil_confidence) || '）',
       {FRAMES_SQL.format('c.')}, [], 0.85 FROM mil m JOIN cat c ON c.case_id = m.case_id AND c.pos = m.pos
UNION ALL SELECT u.case_id, 2 + rule_order, rule, u.pos, 'rule', {CLAIM_SQL.format('c.')}, 'rule', {FRAMES_SQL.format('c.')}, [], u.severity
  FROM causal u JOIN cat c ON c.case_id = u.case_id AND c.pos = u.pos)
SELECT cf.case_id, count(*) AS n_pairs, string_agg(concat_ws('|', CAST(o AS STRING), rule, 'agent' || CAST(pa AS STRING), b, ca,
         list_aggregate(fa, 'string_agg', ','), cb, coalesce(list_aggregate(fb, 'string_agg', ','), ''), '[' || upper(rule) || '] ' || ca || ' ↔ ' || cb || ' severity=' || printf('%.2f', severity)),
       chr(10) ORDER BY o, rule, 'agent' || CAST(pa AS STRING), b) AS pairs
FROM cf JOIN cls ON cls.case_id = cf.case_id AND conflict_type = 'HARD' GROUP BY cf.case_id"""


@query("aud_focus_pairs", PAIRS_SQL.replace("list_aggregate(fa, 'string_agg', ',')", "coalesce(list_aggregate(fa, 'string_agg', ','), '')"))
def aud_focus_pairs(spark, d):
    p = A.focus_pairs(*parts(spark, d))

    def frames(x):
        return F.array_join(F.transform(x, lambda f: f.cast("string")), ",")
    line = F.transform("pairs", lambda x: F.concat_ws("|", x["rule_order"].cast("string"), x["rule"], x["agent_a"], x["agent_b"], x["claim_a"],
                                                      frames(x["frames_a"]), x["claim_b"], frames(x["frames_b"]), x["description"]))
    return p.select("case_id", F.size("pairs").cast("long").alias("n_pairs"), F.array_join(line, "\n").alias("pairs"))


@query("aud_null", AUDIT_SQL + """
SELECT case_id, 'NONE' AS conflict_type, CAST(1 AS DOUBLE) AS rcons, coalesce(arg_min(category, pos) FILTER (WHERE NOT is_env), 'view') AS consensus
FROM g GROUP BY case_id""")
def aud_null(spark, d):
    return A.null_audit(reports(spark, d), KEYS, NORMAL)


@query("aud_log", AUDIT_SQL + """
SELECT k.case_id, 0 AS section, concat('reports=', CAST(n AS STRING), ' type=', conflict_type, ' consensus=', consensus, ' Rcons=', printf('%.3f', rcons)) AS line
FROM (SELECT case_id, count(*) AS n FROM agents GROUP BY case_id) k JOIN cls ON cls.case_id = k.case_id
JOIN cons ON cons.case_id = k.case_id JOIN ds ON ds.case_id = k.case_id
UNION ALL SELECT case_id, 1, concat('[', upper(rule), '] agent', CAST(pos AS STRING), ' ↔ agent', CAST(pos AS STRING), ' severity=', printf('%.2f', severity)) FROM temporal
UNION ALL SELECT case_id, 2, concat('[CATEGORY_MISMATCH] agent', CAST(pos_a AS STRING), ' ↔ agent', CAST(pos_b AS STRING), ' severity=0.85') FROM pairs
UNION ALL SELECT case_id, 3, concat('[SECOND_OPINION] agent', CAST(pos AS STRING), ' ↔ second opinion severity=0.85') FROM mil
UNION ALL SELECT case_id, rule_order + 3, concat('[', upper(rule), '] agent', CAST(pos AS STRING), ' ↔ rule severity=', printf('%.2f', severity)) FROM causal
UNION ALL SELECT case_id, 10, concat('[WEAK_ENVIRONMENT] agent', CAST(pos AS STRING), ' ↔ agent', CAST(env_pos AS STRING), ' severity=0.40') FROM spurious""")
def aud_log(spark, d):
    return A.audit_log(*parts(spark, d))


@query("agg_vote_consensus", AUDIT_SQL + "SELECT case_id, consensus, coalesce(is_convergent, false) AS is_convergent FROM cons")
def agg_vote_consensus(spark, d):
    return A.consensus(reports(spark, d), KEYS, NORMAL)


@query("agg_ds_conflict", AUDIT_SQL + """
SELECT case_id, round(k, 6) AS k, round(bonus, 6) AS bonus, round(rcons, 6) AS rcons, round(k_default, 6) AS k_default FROM ds""")
def agg_ds_conflict(spark, d):
    r = parts(spark, d)[0]
    default = A.consistency(r, KEYS, "default").select("case_id", F.col("k").alias("k_default"))
    return rounded(A.consistency(r, KEYS).join(default, "case_id"), "k", "bonus", "rcons", "k_default")


@query("prj_revote", AUDIT_SQL + """
SELECT p.case_id, CASE WHEN gated THEN 'view' WHEN vlm_used AND conflict_type = 'HARD' AND confidence < 0.6 AND consensus <> category AND consensus <> 'view'
       THEN consensus WHEN vlm_used THEN category ELSE consensus END AS final_class
FROM cat p JOIN cls ON cls.case_id = p.case_id JOIN cons ON cons.case_id = p.case_id WHERE p.pos = p.first_pos""")
def prj_revote(spark, d):
    r, keys, classes, normal = parts(spark, d)
    audited = A.classify(r, keys, classes, normal).join(A.consensus(r, keys, normal), keys)
    return A.final_class(r, audited, keys, lambda *c: P.revote(*c, normal=NORMAL))


@query("prj_uncertainty", AUDIT_SQL + """
SELECT case_id, 'low_confidence' AS kind, concat('agent', CAST(pos AS STRING), ': conf=', printf('%.2f', confidence)) AS note FROM cat WHERE confidence < 0.6
UNION ALL SELECT case_id, 'conflicting', concat('agent', CAST(pos AS STRING), ': ', rule) FROM causal
UNION ALL SELECT case_id, 'insufficient', 'environment' FROM env WHERE confidence < 0.4
UNION ALL SELECT cls.case_id, 'insufficient', concat('unresolved ', layer) FROM cls JOIN cons ON cons.case_id = cls.case_id
  WHERE conflict_type = 'HARD' AND NOT coalesce(is_convergent, false)""")
def prj_uncertainty(spark, d):
    r, keys, classes, normal = parts(spark, d)
    audited = A.classify(r, keys, classes, normal).join(A.consensus(r, keys, normal), keys)
    return A.uncertainty(r, audited, keys, classes, normal)


# three days in a row are the three passes over one case of a user
DAYS = B.CASE_DAYS
GROUP_SQL = f"(case_id // {DAYS}) * {DAYS} + (case_id % {DAYS}) // 3"
ROUNDS_SQL = B.ctes(agents0=B.AGENTS_SQL, dayrank=f"""
SELECT case_id AS daycase, {GROUP_SQL} AS grp, dense_rank() OVER (PARTITION BY {GROUP_SQL} ORDER BY case_id) - 1 AS rnd
FROM (SELECT DISTINCT case_id FROM agents0) x""", agents="SELECT * FROM agents0") + ", " + BASE


@query("aud_rounds", ROUNDS_SQL + """, anyc AS (
SELECT d.*, f.l1, f.h2, f.l2, f.l3, c.conflict_type, c.layer FROM dayrank d JOIN flags f ON f.case_id = d.daycase JOIN cls c ON c.case_id = d.daycase),
k AS (SELECT grp, rnd, CASE WHEN rnd >= 2 AND (l1 OR l2 OR l3 IS NOT NULL) THEN 'HARD' ELSE conflict_type END AS kind,
       CASE WHEN rnd >= 2 AND (l1 OR l2 OR l3 IS NOT NULL) THEN CASE WHEN l1 THEN 'TEMPORAL' WHEN l2 THEN 'CAUSAL' ELSE 'SPURIOUS' END ELSE layer END AS layer,
       max(rnd) OVER (PARTITION BY grp) AS last FROM anyc),
lim AS (SELECT grp, CASE WHEN category = 'error' THEN 2 ELSE 1 END AS lim FROM dayrank d JOIN cat ON cat.case_id = d.daycase AND pos = first_pos WHERE rnd = 0),
e AS (SELECT k.*, kind = 'NONE' OR rnd = last OR (kind = 'SOFT' AND rnd >= 2) OR (kind = 'HARD' AND rnd >= coalesce(lim, 1)) AS stop FROM k LEFT JOIN lim ON lim.grp = k.grp),
s AS (SELECT grp, min(rnd) AS r FROM e WHERE stop GROUP BY grp)
SELECT s.grp AS case_id, s.r AS rounds_used, max(CASE WHEN e.rnd = s.r THEN kind END) AS conflict_type, max(CASE WHEN e.rnd = s.r THEN layer END) AS layer,
       CAST(sum(CASE WHEN e.rnd < s.r THEN CASE kind WHEN 'HARD' THEN 2 WHEN 'SOFT' THEN 1 ELSE 0 END ELSE 0 END) AS BIGINT) AS extra_turns
FROM s JOIN e ON e.grp = s.grp GROUP BY s.grp, s.r""")
def aud_rounds(spark, d):
    from pyspark.sql import Window
    a = reports(spark, d)
    day = F.col("case_id") % DAYS
    group = (F.col("case_id") - day + F.floor(day / 3)).cast("long")
    # at most three days per group: number those that exist
    days = a.select("case_id").distinct().withColumn("grp", group)
    days = days.withColumn("round", F.row_number().over(Window.partitionBy("grp").orderBy("case_id")) - 1)
    r = materialise(a.join(days, "case_id").drop("case_id").withColumnRenamed("grp", "case_id"), "rounds")
    return A.rounds(r, KEYS, "round", B.event_classes(spark), NORMAL)
