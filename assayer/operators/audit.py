"""Rules over the reports of a case, belief fusion and the final vote.

Rows are agent reports: ``case_id, pos`` (order in the case), ``is_env``,
``category, confidence, frame_refs array<int>, escalation_start_frame,
video_fps, mil_category, mil_confidence, vlm_used, rag_match_ratio, n_pre,
n_post, has_causal_chain, rlegal, env_contribution``. ``case_id`` may be
several columns, given as ``keys``.

Everything a case needs is an aggregate of its rows (map-side combined), so no
rule except :func:`mismatch_pairs`, whose result is pairs, meets rows with rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.operators.text_format import fixed
from assayer.session import materialise

# ---- fixed values -----------------------------------------------------------------
GAP_SECONDS, DEFAULT_FPS = 1.0, 30.0
GAP_CONFIDENCE = 0.5
SOFT_CONFIDENCE = 0.7
HARD_CAUSAL, SOFT_CAUSAL = 0.96, 0.81
CALM_ESCALATION, ESCALATION_TRUSTED = 0.15, False
MIL_MIN = 0.4
ELEMENT_RATIO, ELEMENT_CONFIDENCE = 0.3, 0.7
ENV_WEAK, ENV_CLAIM, ENV_DROP = 0.4, 0.75, 0.3
CONSENSUS_SHARE = 0.8
# ---- end of fixed values ------------------------------------------------------------


def _keep(*options: Column) -> Column:
    return F.filter(F.array(*options), lambda x: x.isNotNull())


def name(pos: Column | str = "pos") -> Column:
    return F.concat(F.lit("agent"), F.col(pos).cast("string") if isinstance(pos, str) else pos.cast("string"))


def claim(category: Column, confidence: Column) -> Column:
    return F.concat(category, F.lit("（信心 "), fixed(confidence, 2), F.lit("）"))


def _first_frames(n: int = 3) -> Column:
    return F.slice("frame_refs", 1, n)


# ---- layer 1: time and class ----------------------------------------------------------

def temporal_rules(primary: Column) -> Column:
    """Array of rule hits on the primary report: attack before the build-up, or far from it."""
    attack = F.array_min("frame_refs")
    limit = F.floor(F.lit(GAP_SECONDS) * F.coalesce(F.col("video_fps"), F.lit(DEFAULT_FPS)))
    gap = F.col("escalation_start_frame") - attack

    def hit(rule: str, severity: float) -> Column:
        return F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), gap.cast("long").alias("gap"))
    found = _keep(F.when(gap > limit, hit("attack_first", 0.9)), F.when(F.abs(gap) > limit * 3, hit("far_apart", 0.7)))
    return F.when(primary & gap.isNotNull(), found).otherwise(F.filter(found, lambda x: F.lit(False)))


def mil_conflict(primary: Column, normal: str) -> Column:
    """First and second opinion of the primary report differ by class and by far in confidence."""
    m, c = F.col("mil_category"), F.col("category")
    return F.coalesce(primary & F.col("vlm_used") & ~m.isin(normal, "") & ~c.isin(normal, "") & (m != c)
                      & (F.col("mil_confidence") >= MIL_MIN)
                      & (F.abs(F.col("confidence") - F.col("mil_confidence")) > GAP_CONFIDENCE), F.lit(False))


def mismatch_pairs(reports: DataFrame, keys: list[str], normal: str = "Normal", chunk: int = 4096) -> DataFrame:
    """Pairs of a case with different classes and confidences more than 0.5 apart, on any scale.

    Confidences are cut into bands of width 0.5. Two reports in one band are never far enough apart, so a report meets
    only those of lower bands. Both sides of a large case are cut into chunks by hashes of the
    position, and a pair of chunks is one join key, so the pairs of one case are made by many tasks. (In [0, 1] there are two
    bands and the report of exactly 1.)
    """
    r = reports.filter(~F.col("is_env") & (F.col("category") != normal) & F.col("confidence").isNotNull()).select(
        *keys, "pos", "category", "confidence", _first_frames().alias("frames"),
        F.floor(F.col("confidence") / GAP_CONFIDENCE).alias("__band"))
    sizes = r.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / chunk).alias("__n"), F.collect_set("__band").alias("__bands"))
    r = r.join(sizes, keys).withColumn("__part", F.pmod(F.xxhash64("pos"), F.col("__n")))
    every = F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)
    cols = ["pos", "category", "confidence", "frames"]
    low = r.select(*keys, "__band", F.col("__part").alias("__low"), F.explode(every).alias("__high"),
                   *[F.col(c).alias(f"l_{c}") for c in cols])
    below = F.filter("__bands", lambda x: x < F.col("__band"))
    high = (r.select(*keys, F.col("__part").alias("__high"), "__n", F.explode(below).alias("__band"), *cols)
            .select(*keys, "__band", "__high", F.explode(every).alias("__low"), *[F.col(c).alias(f"h_{c}") for c in cols]))
    hits = low.join(high, [*keys, "__band", "__low", "__high"]).filter(
        (F.col("l_category") != F.col("h_category"))
        & (F.abs(F.col("h_confidence") - F.col("l_confidence")) > GAP_CONFIDENCE))
    low_first = F.col("l_pos") < F.col("h_pos")

    def side(c: str, first: bool) -> Column:
        a, b = (f"l_{c}", f"h_{c}") if first else (f"h_{c}", f"l_{c}")
        return F.when(low_first, F.col(a)).otherwise(F.col(b)).alias(f"{c}_{'a' if first else 'b'}")
    return hits.select(*keys, *[side(c, f) for c in cols for f in (True, False)])


# ---- layer 2: cause ---------------------------------------------------------------------

def causal_rules(severity: Column, escalation_trusted: bool = ESCALATION_TRUSTED) -> Column:
    """Array of rule hits of one classifying report, in rule order."""
    conf = F.col("confidence")

    def hit(order: int, rule: str, hard: bool, weight: float) -> Column:
        return F.struct(F.lit(order).alias("rule_order"), F.lit(rule).alias("rule"), F.lit(hard).alias("hard"),
                        F.lit(weight).alias("severity"))
    rules = []
    if escalation_trusted:
        rules.append(F.when((severity == "HIGH") & (F.col("escalation_score") < CALM_ESCALATION) & (conf > HARD_CAUSAL),
                            hit(0, "calm_escalation", True, 0.9)))
    rules += [
        F.when((severity == "HIGH") & (F.col("n_pre") == 0) & (conf > HARD_CAUSAL), hit(1, "no_antecedent_high", True, 0.85)),
        F.when((severity == "MEDIUM") & (F.col("n_pre") < 2) & (conf > SOFT_CAUSAL), hit(2, "few_antecedents", False, 0.40)),
        F.when((severity == "LOW_PLANNED") & (F.col("n_pre") == 0) & (conf > SOFT_CAUSAL), hit(3, "no_watching", False, 0.35)),
        F.when((severity == "LOW_ACCIDENT") & (F.col("n_post") == 0) & (conf > SOFT_CAUSAL), hit(4, "no_aftermath", False, 0.35)),
        F.when((F.col("rag_match_ratio") < ELEMENT_RATIO) & (conf > ELEMENT_CONFIDENCE), hit(5, "element_mismatch", False, 0.50)),
    ]
    return _keep(*rules)


def first_classifying() -> Column:
    """Place of the first report of a case that is not about the environment (an aggregate)."""
    return F.min(F.when(~F.col("is_env"), F.col("pos")))


def annotated(reports: DataFrame, keys: list[str], classes: DataFrame, normal: str = "Normal") -> DataFrame:
    """Reports with severity, rule hits and the environment of their case."""
    severity = F.broadcast(classes.select(F.col("class").alias("category"), F.col("severity").alias("class_severity")))
    r = reports.join(severity, "category", "left")
    # one row per case: its first environment report and the place of its first classifying one
    heads = reports.groupBy(*keys).agg(
        F.min_by(F.when(F.col("is_env"), F.struct("pos", "confidence", "env_contribution")),
                 F.when(F.col("is_env"), F.col("pos"))).alias("env"),
        first_classifying().alias("__first"))
    r = r.join(heads, keys, "left")
    sees = ~F.col("is_env")
    primary = F.col("pos") == F.col("__first")
    none = F.filter(causal_rules(F.col("class_severity")), lambda x: F.lit(False))
    drop = F.coalesce(F.col("env.env_contribution"), (F.col("confidence") - F.col("env.confidence")) * 0.5)
    return r.withColumns({
        "temporal": temporal_rules(sees & primary),
        "mil_hit": mil_conflict(sees & primary, normal),
        "causal": F.when(sees, causal_rules(F.col("class_severity"))).otherwise(none),
        "env_drop": drop,
        "spurious": F.coalesce(sees & (F.col("env.confidence") < ENV_WEAK) & (F.col("confidence") > ENV_CLAIM)
                               & (drop > ENV_DROP), F.lit(False)),
    })


def class_ranges(reports: DataFrame, keys: list[str], normal: str = "Normal") -> DataFrame:
    """Per case the lowest and highest confidence of each class (one entry per class)."""
    r = reports.filter(~F.col("is_env") & (F.col("category") != normal))
    per = r.groupBy(*keys, "category").agg(F.min("confidence").alias("lo"), F.max("confidence").alias("hi"))
    return per.groupBy(*keys).agg(F.collect_list(F.struct("category", "lo", "hi")).alias("ranges"))


def agreeing_pair(reports: DataFrame, keys: list[str]) -> DataFrame:
    """The first two unsure reports of one class in a case, and the weaker of them."""
    low = reports.filter(~F.col("is_env") & (F.col("confidence") < SOFT_CONFIDENCE))
    rank = Window.partitionBy(*keys, "category").orderBy("pos")
    two = low.withColumn("__rn", F.row_number().over(rank)).filter("__rn <= 2")
    pair = two.groupBy(*keys, "category").agg(
        F.min("pos").alias("first"), F.max("pos").alias("second"), F.count(F.lit(1)).alias("n"),
        F.min_by("confidence", "pos").alias("c1"), F.max_by("confidence", "pos").alias("c2"),
        F.min_by("frame_refs", "pos").alias("f1"), F.max_by("frame_refs", "pos").alias("f2")).filter("n = 2")
    weaker_first = F.col("c1") < F.col("c2")
    return pair.groupBy(*keys).agg(F.min(F.struct(
        "first", "second", F.when(weaker_first, F.col("first")).otherwise(F.col("second")).alias("weaker"),
        F.slice(F.when(weaker_first, F.col("f1")).otherwise(F.col("f2")), 1, 5).alias("frames"))).alias("low_pair"))


def classify(reports: DataFrame, keys: list[str], classes: DataFrame, normal: str = "Normal",
             retry: Column | None = None) -> DataFrame:
    """Conflict type, layer and target of each case."""
    retry = F.lit(0) if retry is None else retry
    a = annotated(reports, keys, classes, normal)
    soft = F.filter("causal", lambda x: ~x["hard"])
    first_soft = F.when(F.size(soft) > 0, F.struct(soft[0]["rule_order"].alias("rule_order"), F.col("pos").alias("pos"),
                                                   F.slice("frame_refs", 1, 3).alias("frames")))
    flags = a.groupBy(*keys).agg(
        F.max(retry).alias("retry"),
        F.bool_or((F.size("temporal") > 0) | F.col("mil_hit")).alias("own_l1"),
        F.bool_or(F.exists("causal", lambda x: x["hard"])).alias("hard_l2"),
        F.bool_or(F.size("causal") > 0).alias("any_l2"),
        F.bool_or("spurious").alias("any_l3"),
        F.min(F.when(F.col("spurious"), F.col("pos"))).alias("l3_pos"),
        F.min(first_soft).alias("l2_first"))
    ranges = class_ranges(reports, keys, normal).select(*keys, F.exists("ranges", lambda x: F.exists(
        "ranges", lambda y: (x["category"] != y["category"]) & (x["hi"] - y["lo"] > GAP_CONFIDENCE))).alias("pair_l1"))
    f = flags.join(ranges, keys, "left").join(agreeing_pair(reports, keys), keys, "left")
    l1 = F.col("own_l1") | F.coalesce("pair_l1", F.lit(False))
    stuck = (F.col("retry") >= 2) & (l1 | F.col("any_l2") | F.col("any_l3"))
    pair = F.col("low_pair").isNotNull()
    hard = stuck | l1 | F.col("hard_l2")
    kind = F.when(hard, "HARD").when(pair | F.col("any_l3") | F.col("any_l2"), "SOFT").otherwise("NONE")
    layer = (F.when(l1, "TEMPORAL").when(stuck & F.col("any_l2"), "CAUSAL").when(stuck, "SPURIOUS")
             .when(F.col("hard_l2"), "CAUSAL").when(pair, "NONE").when(F.col("any_l3"), "SPURIOUS")
             .when(F.col("any_l2"), "CAUSAL").otherwise("NONE"))
    target = F.when(hard, F.lit(None).cast("long")).when(pair, F.col("low_pair.weaker")).when(
        F.col("any_l3"), F.col("l3_pos")).when(F.col("any_l2"), F.col("l2_first.pos"))
    empty = F.array().cast("array<int>")
    frames = (F.when(hard, empty).when(pair, F.col("low_pair.frames")).when(F.col("any_l3"), empty)
              .when(F.col("any_l2"), F.col("l2_first.frames")).otherwise(empty))
    return f.select(*keys, "retry", kind.alias("conflict_type"), layer.alias("layer"),
                    F.coalesce(name(target), F.lit("")).alias("target"), frames.cast("array<int>").alias("target_frames"))


def conflicts(reports: DataFrame, keys: list[str], classes: DataFrame, normal: str = "Normal") -> DataFrame:
    """Every conflict as a row, with both claims and the frames they rest on."""
    a = annotated(reports, keys, classes, normal)
    no_frames = F.array().cast("array<int>")
    own = claim(F.col("category"), F.col("confidence"))

    def rows(df, layer, order, rule, severity, hard, b, claim_b, frames_a, frames_b):
        return df.select(*keys, F.lit(layer).alias("layer"), order.cast("int").alias("rule_order"), rule.alias("rule"),
                         hard.alias("hard"), severity.cast("double").alias("severity"), name("pos").alias("agent_a"),
                         b.alias("agent_b"), own.alias("claim_a"), claim_b.alias("claim_b"),
                         frames_a.cast("array<int>").alias("frames_a"), frames_b.cast("array<int>").alias("frames_b"))
    t = a.select("*", F.explode("temporal").alias("t"))
    temporal = rows(t, "TEMPORAL", F.lit(0), F.col("t.rule"), F.col("t.severity"), F.lit(True), name("pos"), own,
                    _first_frames(), F.array("escalation_start_frame"))
    m = a.filter("mil_hit")
    mil = rows(m, "TEMPORAL", F.lit(2), F.lit("second_opinion"), F.lit(0.85), F.lit(True), F.lit("second opinion"),
               claim(F.col("mil_category"), F.col("mil_confidence")), _first_frames(), no_frames)
    c = a.select("*", F.explode("causal").alias("c"))
    causal = rows(c, "CAUSAL", F.lit(2) + F.col("c.rule_order"), F.col("c.rule"), F.col("c.severity"), F.col("c.hard"),
                  F.lit("rule"), F.lit("rule"), _first_frames(), no_frames)
    s = a.filter("spurious")
    spurious = rows(s, "SPURIOUS", F.lit(9), F.lit("weak_environment"), F.lit(0.4), F.lit(False), name(F.col("env.pos")),
                    F.lit("environment"), no_frames, no_frames)
    p = mismatch_pairs(reports, keys, normal)
    pairs = p.select(*keys, F.lit("TEMPORAL").alias("layer"), F.lit(1).alias("rule_order"),
                     F.lit("category_mismatch").alias("rule"), F.lit(True).alias("hard"), F.lit(0.85).alias("severity"),
                     name("pos_a").alias("agent_a"), name("pos_b").alias("agent_b"),
                     claim(F.col("category_a"), F.col("confidence_a")).alias("claim_a"),
                     claim(F.col("category_b"), F.col("confidence_b")).alias("claim_b"),
                     F.col("frames_a").cast("array<int>").alias("frames_a"),
                     F.col("frames_b").cast("array<int>").alias("frames_b"))
    return temporal.unionByName(pairs).unionByName(mil).unionByName(causal).unionByName(spurious)


def focus_frames(reports: DataFrame, keys: list[str], classes: DataFrame, normal: str = "Normal", top: int = 10) -> DataFrame:
    """The first distinct frames any layer 1 or 2 conflict of a HARD case rests on.

    A report takes part in a class mismatch if the class ranges of its case hold
    an opponent, so no pair is formed to find out.
    """
    hard = classify(reports, keys, classes, normal).filter("conflict_type = 'HARD'").select(*keys)
    a = annotated(reports, keys, classes, normal).join(class_ranges(reports, keys, normal), keys, "left")
    clash = ~F.col("is_env") & (F.col("category") != normal) & F.exists(F.coalesce("ranges", F.array()), lambda x: (
        x["category"] != F.col("category")) & ((x["hi"] - F.col("confidence") > GAP_CONFIDENCE)
                                              | (F.col("confidence") - x["lo"] > GAP_CONFIDENCE)))
    own = (F.size("temporal") > 0) | F.col("mil_hit") | (F.size("causal") > 0) | clash
    empty = F.array().cast("array<int>")
    frames = F.concat(F.when(own, _first_frames().cast("array<int>")).otherwise(empty),
                      F.when(F.size("temporal") > 0, F.array(F.col("escalation_start_frame").cast("int"))).otherwise(empty))
    distinct = a.join(hard, keys, "left_semi").select(*keys, F.explode(frames).alias("frame")).distinct()
    rank = Window.partitionBy(*keys).orderBy("frame")
    first = distinct.withColumn("__rn", F.row_number().over(rank)).filter(F.col("__rn") <= top)
    return first.groupBy(*keys).agg(F.sort_array(F.collect_list("frame")).alias("frames"))


def focus_pairs(reports: DataFrame, keys: list[str], classes: DataFrame, normal: str = "Normal", size: int = 256) -> DataFrame:
    """The layer 1 and 2 conflicts of each HARD case as nested rows: ``keys, part, pairs``.

    A pair has both agents, their claims and frames, the rule and what it says. All pairs of a case are one array in
    the order of the rules and agents; a case with more than ``size`` is cut into parts of about that many by a hash
    of the agents, so the array of a case with millions of pairs is not one row, and none is left out.
    """
    c = conflicts(reports, keys, classes, normal).filter(F.col("layer").isin("TEMPORAL", "CAUSAL"))
    hard = classify(reports, keys, classes, normal).filter("conflict_type = 'HARD'").select(*keys)
    told = F.concat(F.lit("["), F.upper("rule"), F.lit("] "), "claim_a", F.lit(" ↔ "), "claim_b", F.lit(" severity="), fixed(F.col("severity"), 2))
    held = materialise(c.join(hard, keys, "left_semi").withColumn("description", told), "conflicts")
    parts = held.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).alias("__parts"))
    pair = F.struct("rule_order", "rule", "agent_a", "agent_b", "claim_a", "frames_a", "claim_b", "frames_b", "description")
    return (held.join(parts, keys).withColumn("part", F.pmod(F.xxhash64("rule", "agent_a", "agent_b"), F.col("__parts")))
            .groupBy(*keys, "part").agg(F.sort_array(F.collect_list(pair)).alias("pairs")))


# ---- vote and belief fusion ---------------------------------------------------------------

def consensus(reports: DataFrame, keys: list[str], normal: str = "Normal") -> DataFrame:
    """Class with the largest summed confidence; equal sums go to the class seen first."""
    votes = reports.filter(~F.col("is_env")).groupBy(*keys, "category").agg(
        F.round(F.sum("confidence"), 9).alias("votes"), F.min("pos").alias("first"))
    best = votes.groupBy(*keys).agg(
        F.min(F.struct((-F.col("votes")).alias("v"), "first", "category")).alias("best"), F.sum("votes").alias("total"))
    share = F.when(F.col("total") > 0, -F.col("best.v") / F.col("total")).otherwise(F.lit(0.0))
    cases = reports.select(*keys).distinct()
    return cases.join(best, keys, "left").select(
        *keys, F.coalesce("best.category", F.lit(normal)).alias("consensus"),
        F.coalesce(F.round(share, 9) >= CONSENSUS_SHARE, F.lit(False)).alias("is_convergent"))


def common_frame(reports: DataFrame, keys: list[str]) -> DataFrame:
    """Cases in which at least two reports have frames and all of those share one."""
    seen = reports.filter(F.size("frame_refs") > 0)
    n = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_reports"))
    frames = (seen.select(*keys, F.explode(F.array_distinct("frame_refs")).alias("frame"))
              .groupBy(*keys, "frame").agg(F.count(F.lit(1)).alias("holders")))
    top = frames.groupBy(*keys).agg(F.max("holders").alias("holders"))
    return n.join(top, keys).select(*keys, "n_reports", ((F.col("n_reports") >= 2) & (
        F.col("holders") == F.col("n_reports"))).alias("overlap"))


def consistency(reports: DataFrame, keys: list[str], env_mode: str = "reports") -> DataFrame:
    """Belief conflict of a case as 1 - K plus bonuses, clipped to [0, 1.3].

    K averages c_i*n_j + n_i*c_j over pairs of a classifying and an environment
    report. The product is bilinear, so the mean over all pairs is the product
    of the two sides' means: two aggregates, no pairs. ``env_mode='default'``
    uses the built-in environment belief for every report.
    """
    size = F.size("frame_refs")
    u = F.when(size == 0, F.lit(0.30)).when(size <= 2, F.lit(0.15)).otherwise(F.lit(0.05))
    conf = F.col("confidence")
    m_crime = conf * (1 - u) * F.coalesce(0.5 + 0.5 * F.col("rag_match_ratio"), F.lit(1.0))
    m_no = F.greatest(F.lit(0.0), 1 - m_crime - u)
    e_crime = conf * (1 - u)
    e_no = F.greatest(F.lit(0.0), 1 - e_crime - (u + (1 - conf) * 0.3))
    k_default = m_crime * (0.88 - 0.85 * conf) + m_no * 0.95 * conf
    cat, env = ~F.col("is_env"), F.col("is_env")
    s = reports.groupBy(*keys).agg(
        F.avg(F.when(cat, m_crime)).alias("c_cat"), F.avg(F.when(cat, m_no)).alias("n_cat"),
        F.avg(F.when(env, e_crime)).alias("c_env"), F.avg(F.when(env, e_no)).alias("n_env"),
        F.avg(F.when(cat, F.least(k_default, F.lit(1.0)))).alias("k_default"),
        F.bool_or(cat & F.col("has_causal_chain") & (F.col("n_pre") > 0) & (F.col("n_post") > 0)).alias("chain"),
        F.bool_or(cat & (F.col("rlegal") > 0.8)).alias("legal"))
    paired = F.col("c_cat") * F.col("n_env") + F.col("n_cat") * F.col("c_env")
    k = F.coalesce(F.col("k_default") if env_mode == "default" else F.coalesce(paired, F.col("k_default")), F.lit(0.0))
    bonus_rows = reports if env_mode == "reports" else reports.filter(cat)
    j = s.join(common_frame(bonus_rows, keys), keys, "left")

    def add(flag: Column, value: float) -> Column:
        return F.when(F.coalesce(flag, F.lit(False)), F.lit(value)).otherwise(F.lit(0.0))
    bonus = add(F.col("overlap"), 0.2) + add(F.col("chain"), 0.2) + add(F.col("legal"), 0.1)
    return j.select(*keys, k.alias("k"), bonus.alias("bonus"),
                    F.least(F.greatest(1 - k + bonus, F.lit(0.0)), F.lit(1.3)).alias("rcons"))


def null_audit(reports: DataFrame, keys: list[str], normal: str = "Normal") -> DataFrame:
    """The switched-off audit: no conflict, full consistency, class of the first classifying report."""
    first = reports.groupBy(*keys).agg(F.min(F.when(~F.col("is_env"), F.struct("pos", "category"))).alias("first"))
    return first.select(*keys, F.lit("NONE").alias("conflict_type"), F.lit(1.0).alias("rcons"),
                        F.coalesce("first.category", F.lit(normal)).alias("consensus"))


def audit(reports: DataFrame, keys: list[str], classes: DataFrame, normal: str = "Normal",
          retry: Column | None = None) -> DataFrame:
    """Conflict class, consensus and consistency of each case in one row."""
    return (classify(reports, keys, classes, normal, retry)
            .join(consensus(reports, keys, normal), keys).join(consistency(reports, keys), keys))


def final_class(reports: DataFrame, audited: DataFrame, keys: list[str], revote) -> DataFrame:
    """Class after gate, second opinion and consensus; ``revote`` is the column rule."""
    fields = F.struct("category", "confidence", "vlm_used", "gated")
    primary = (reports.filter(~F.col("is_env")).groupBy(*keys).agg(F.min_by(fields, "pos").alias("first"))
               .select(*keys, "first.*"))
    j = audited.join(primary, keys)
    return j.select(*keys, revote(F.col("gated"), F.col("vlm_used"), F.col("category"), F.col("confidence"),
                                  F.col("conflict_type"), F.col("consensus")).alias("final_class"))


def uncertainty(reports: DataFrame, audited: DataFrame, keys: list[str], classes: DataFrame, normal: str = "Normal",
                weak_env: float = 0.4) -> DataFrame:
    """Notes of a case as rows: unsure reports, conflict flags, insufficient evidence."""
    sure = reports.filter(~F.col("is_env") & (F.col("confidence") < 0.6)).select(
        *keys, F.lit("low_confidence").alias("kind"),
        F.concat(name("pos"), F.lit(": conf="), fixed(F.col("confidence"), 2)).alias("note"))
    a = annotated(reports, keys, classes, normal)
    flags = a.select(*keys, "pos", F.explode("causal").alias("c")).select(
        *keys, F.lit("conflicting").alias("kind"), F.concat(name("pos"), F.lit(": "), F.col("c.rule")).alias("note"))
    weak = reports.filter(F.col("is_env") & (F.col("confidence") < weak_env)).select(
        *keys, F.lit("insufficient").alias("kind"), F.lit("environment").alias("note"))
    stuck = audited.filter((F.col("conflict_type") == "HARD") & ~F.col("is_convergent")).select(
        *keys, F.lit("insufficient").alias("kind"), F.concat(F.lit("unresolved "), F.col("layer")).alias("note"))
    return sure.unionByName(flags).unionByName(weak).unionByName(stuck)


def audit_log(reports: DataFrame, keys: list[str], classes: DataFrame, normal: str = "Normal") -> DataFrame:
    """Log lines of each case as rows: a head line, then one line per conflict."""
    head = audit(reports, keys, classes, normal).join(
        reports.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_reports")), keys)
    lines = head.select(*keys, F.lit(0).alias("section"), F.concat(
        F.lit("reports="), F.col("n_reports").cast("string"), F.lit(" type="), F.col("conflict_type"),
        F.lit(" consensus="), F.col("consensus"), F.lit(" Rcons="), fixed(F.col("rcons"), 3)).alias("line"))
    c = conflicts(reports, keys, classes, normal)
    detail = c.select(*keys, (F.col("rule_order") + 1).alias("section"), F.concat(
        F.lit("["), F.upper("rule"), F.lit("] "), F.col("agent_a"), F.lit(" ↔ "), F.col("agent_b"),
        F.lit(" severity="), fixed(F.col("severity"), 2)).alias("line"))
    return lines.unionByName(detail)


def rounds(reports: DataFrame, keys: list[str], round_column: str, classes: DataFrame, normal: str = "Normal") -> DataFrame:
    """Bounded re-audit. Round r holds the refreshed reports of the r-th pass over a case.

    Every round is audited in one job. A case stops at the first round without
    conflict, at a SOFT conflict after two retries, at a HARD conflict after one
    retry (two for high severity), or at its last round.
    """
    by_round = [*keys, round_column]
    r = classify(reports, by_round, classes, normal, F.col(round_column))
    high = F.broadcast(classes.filter("severity = 'HIGH'").select(F.col("class").alias("category"), F.lit(2).alias("__limit")))
    first = (reports.filter(~F.col("is_env") & (F.col(round_column) == 0)).groupBy(*keys)
             .agg(F.min_by("category", "pos").alias("category")))
    limit = (first.join(high, "category", "left")
             .select(*keys, F.coalesce("__limit", F.lit(1)).alias("limit")))
    last = r.groupBy(*keys).agg(F.max(round_column).alias("last"))
    j = r.join(limit, keys, "left").join(last, keys).withColumn("limit", F.coalesce("limit", F.lit(1)))
    n, kind = F.col(round_column), F.col("conflict_type")
    stop = (kind == "NONE") | (n == F.col("last")) | ((kind == "SOFT") & (n >= 2)) | ((kind == "HARD") & (n >= F.col("limit")))
    turns = F.when(kind == "HARD", 2).when(kind == "SOFT", 1).otherwise(0)
    first = j.groupBy(*keys).agg(
        F.min(F.when(stop, F.struct(n.alias("r"), kind.alias("kind"), F.col("layer").alias("layer")))).alias("end"),
        F.collect_list(F.struct(n.alias("r"), turns.alias("t"))).alias("steps"))  # at most one entry per round
    spent = F.aggregate("steps", F.lit(0), lambda acc, s: acc + F.when(s["r"] < F.col("end.r"), s["t"]).otherwise(0))
    return first.select(*keys, F.col("end.r").cast("long").alias("rounds_used"), F.col("end.kind").alias("conflict_type"),
                        F.col("end.layer").alias("layer"), spent.cast("long").alias("extra_turns"))
