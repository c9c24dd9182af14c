"""Edge rows: empty, one class, ties, NULLs, limits."""

from pyspark.sql import functions as F

from assayer import dims
from assayer.functions import text as X
from assayer.operators import audit as A
from assayer.operators import metrics as M
from assayer.operators import projections as P
from assayer.operators import sampling as S
from assayer.operators import stats as St
from assayer.operators import tables as Tb
from assayer.operators import thresholds as T


def scored(spark, rows):
    return spark.createDataFrame(rows, "run_id string, label int, score double")


def test_empty_input(spark, cases_frame):
    empty = cases_frame([("r", "X", "X", 0.5, 0.5)]).filter("false")
    for out in (M.binary_prf(empty), M.macro_f1(empty), M.reliability(empty), M.confusion(empty),
                T.auroc(T.labelled(empty), ["run_id"]), S.suggest_thresholds(empty, ["run_id"], "case_id")):
        assert out.count() == 0


def test_one_class_only(spark):
    df = scored(spark, [("r", 1, 0.2), ("r", 1, 0.8)])
    assert T.auroc(df, ["run_id"]).collect()[0]["auroc"] == 0.5
    assert T.curve_points(df, ["run_id"]).count() == 0
    assert T.detection_summary(df, ["run_id"]).count() == 0


def test_equal_scores(spark):
    df = scored(spark, [("r", 1, 0.5), ("r", 0, 0.5), ("r", 0, 0.5)])
    assert T.auroc(df, ["run_id"]).collect()[0]["auroc"] == 0.5


def test_threshold_without_use(spark):
    """With costs on false alarms only, staying silent is best; the lowest of equal thresholds wins."""
    best = T.min_ndcf(scored(spark, [("r", 0, 0.5), ("r", 0, 0.7)]), ["run_id"]).collect()[0]
    assert best["tau"] == float("inf") and best["ndcf"] == 0.0
    best = T.min_ndcf(scored(spark, [("r", 1, 0.5)]), ["run_id"]).collect()[0]
    assert best["tau"] == float("-inf")


def test_null_scores_are_left_out(cases_frame):
    c = cases_frame([("r", "X", "X", None, None), ("r", "Normal", "X", 1.0, 0.4), ("r", None, "X", 0.5, None)])
    assert T.labelled(c).count() == 1
    r = {x["bin"]: x for x in M.reliability(c).collect()}
    assert r[9]["n"] == 1 and r[9]["accuracy"] == 0.0  # confidence 1.0 is in the last bin
    assert r[5]["n"] == 1 and r[5]["accuracy"] == 0.0  # an unknown truth is not right
    assert r[0]["n"] == 0 and r[0]["accuracy"] is None and r[0]["mean_conf"] == 0.05


def test_class_only_predicted(cases_frame):
    c = cases_frame([("r", "A", "A"), ("r", "A", "B")])
    f = {x["class"]: x for x in M.per_class_prf(c).collect()}
    assert f["B"]["support"] == 0 and f["B"]["f1"] == 0.0
    assert abs(M.macro_f1(c).collect()[0]["macro_f1"] - 2 / 3) < 1e-12
    assert {(x["ground_truth"], x["predicted"]): x["n"] for x in M.confusion(c).collect()} == {
        ("A", "A"): 1, ("A", "B"): 1, ("B", "A"): 0, ("B", "B"): 0}


def test_paired_edges(spark):
    same = spark.createDataFrame([("s", 1.0, 0.5), ("s", 2.0, 1.5), ("n", 1.0, 2.0)], "k string, a double, b double")
    t = {r.k: r for r in St.paired_ttest(same, ["k"]).collect()}
    assert t["s"]["t"] is None and t["s"]["p_approx"] is None
    assert (t["n"]["t"], t["n"]["p_approx"], t["n"]["p_value"]) == (0.0, 1.0, 1.0)
    flat = spark.createDataFrame([("k", 1.0, 3.0), ("k", 1.0, 4.0)], "k string, a double, b double")
    assert St.pearson(flat, ["k"]).collect()[0]["r"] is None
    assert St.cohens_d(flat.filter("b < 4"), ["k"]).collect()[0]["d"] == 0.0


def test_describe_of_one_row(cases_frame):
    d = M.describe(cases_frame([("r", "A", "A", 0.4)])).collect()[0]
    assert d["stdev"] == 0.0 and d["median"] == 0.4 and d["mean_wrong"] is None
    assert M.index_percentiles(cases_frame([("r", "A", "A", 0.4)])).collect()[0]["p50"] is None


def test_missing_metrics_are_null(cases_frame):
    c = cases_frame([("r", "A", "A", None, None)]).withColumns({x: F.lit(None).cast("double") for x in ("total_turns", "rcons", "rlegal")})
    t = Tb.ablation_table(c)
    row = t.collect()[0]
    assert row["auroc"] is None and row["ece"] is None and row["mean_rcons"] is None and row["accuracy"] == 1.0
    lines = [r["line"] for r in Tb.markdown_rows(t).orderBy("part", "key").collect()]
    assert lines[2] == "| r | 1 | 1.000 | 1.000 | — | — | — | — | — | — | — |"


def test_cost_steps(spark):
    df = spark.createDataFrame([(t, s) for t in (4, 5, 8, 9, 10, 11) for s in ("HIGH", "LOW")], "t int, s string")
    got = {(r.t, r.s): round(r.c, 6) for r in df.select("t", "s", P.cost_step(F.col("t"), F.col("s")).alias("c")).collect()}
    assert [got[(t, "HIGH")] for t in (4, 5, 8, 10, 11)] == [0.0, 0.166667, 0.666667, 1.0, 1.0]
    assert [got[(t, "LOW")] for t in (4, 5, 8, 9)] == [0.0, 0.25, 1.0, 1.0]


def test_threshold_guard(cases_frame):
    c = cases_frame([("r", "A", "A", 0.9), ("r", "A", "A", 0.8)])
    row = S.suggest_thresholds(c, ["run_id"], "case_id").collect()[0]
    assert row["hard"] is None and row["soft"] is None
    c = cases_frame([("r", "A", "A", 0.9)] * 3)
    assert S.suggest_thresholds(c, ["run_id"], "case_id").collect()[0]["hard"] == 0.9


REPORT = ("case_id int, pos int, is_env boolean, category string, confidence double, frame_refs array<int>, escalation_start_frame int, "
          "video_fps double, mil_category string, mil_confidence double, vlm_used boolean, rag_match_ratio double, n_pre int, n_post int, "
          "has_causal_chain boolean, rlegal double, env_contribution double")


def report(case, pos, category, confidence, frames=(), env=False, esc=None, pre=2, post=1, ratio=None, chain=False, legal=0.0, contribution=None):
    return (case, pos, env, category, confidence, list(frames), esc, None, None, None, False, ratio, pre, post, chain, legal, contribution)


def test_vote_tie_goes_to_the_first(spark):
    df = spark.createDataFrame([report(1, 1, "B", 0.5), report(1, 2, "A", 0.5), report(2, 1, "E", 0.9, env=True)], REPORT)
    got = {r.case_id: (r.consensus, r.is_convergent) for r in A.consensus(df, ["case_id"]).collect()}
    assert got == {1: ("B", False), 2: ("Normal", False)}


def test_belief_masses(spark):
    """One report each with 0, 1, 2 and 3 frames, no environment; K by hand."""
    rows = [report(n, 1, "A", 0.8, range(n)) for n in range(4)]
    rows += [report(9, 1, "A", 0.8, (1, 2, 3), ratio=0.5), report(9, 2, "E", 0.5, (3,), env=True)]
    got = {r.case_id: r for r in A.consistency(spark.createDataFrame(rows, REPORT), ["case_id"]).collect()}
    for n, u in ((0, 0.30), (1, 0.15), (2, 0.15), (3, 0.05)):
        c = 0.8 * (1 - u)
        k = c * (0.88 - 0.85 * 0.8) + max(0, 1 - c - u) * 0.95 * 0.8
        assert abs(got[n].k - k) < 1e-12 and got[n].bonus == 0.0
    c, e = 0.8 * 0.95 * 0.75, 0.5 * 0.85
    k = c * (1 - e - (0.15 + 0.5 * 0.3)) + (1 - c - 0.05) * e
    assert abs(got[9].k - k) < 1e-12 and abs(got[9].rcons - (1 - k + 0.2)) < 1e-12  # both share frame 3
    default = A.consistency(spark.createDataFrame(rows, REPORT), ["case_id"], "default").filter("case_id = 9").collect()[0]
    assert abs(default.k - (c * 0.2 + (1 - c - 0.05) * 0.76)) < 1e-12 and default.bonus == 0.0


def brute_pairs(rows):
    out = set()
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] < b[1] and not a[2] and not b[2] and "Normal" not in (a[3], b[3]) and a[3] != b[3] and abs(a[4] - b[4]) > 0.5:
                out.add((a[0], a[1], b[1]))
    return out


def test_mismatch_pairs_in_chunks(spark):
    import random
    r = random.Random(5)
    rows = [report(1 if i < 60 else 2 + i % 5, i, r.choice(["A", "B", "Normal"]), round(r.random(), 3), env=r.random() < 0.1) for i in range(90)]
    df = spark.createDataFrame(rows, REPORT)
    for chunk in (4096, 7):
        got = A.mismatch_pairs(df, ["case_id"], chunk=chunk)
        assert {(x.case_id, x.pos_a, x.pos_b) for x in got.collect()} == brute_pairs(rows) and got.count() == len(brute_pairs(rows))
    flagged = {x.case_id for x in A.class_ranges(df, ["case_id"]).filter(F.exists("ranges", lambda x: F.exists(
        "ranges", lambda y: (x["category"] != y["category"]) & (x["hi"] - y["lo"] > 0.5)))).collect()}
    assert flagged == {c for c, _, _ in brute_pairs(rows)}


def test_conflict_classes(spark):
    classes = dims.classes(spark)
    rows = [report(1, 1, "Stealing", 0.9, (10,), esc=100),                      # attack 90 before the build-up: rule 1 only
            report(2, 1, "Shooting", 0.97, (5,), pre=0),                        # high severity without antecedent
            report(3, 1, "Fighting", 0.5, (7, 8)), report(3, 3, "Fighting", 0.6),  # two unsure reports agree
            report(4, 1, "Fighting", 0.9, pre=1),                               # few antecedents
            report(5, 1, "Stealing", 0.9, (1,)), report(5, 2, "E", 0.1, env=True),  # weak environment
            report(6, 1, "Stealing", 0.9, (1,))]
    got = {r.case_id: (r.conflict_type, r.layer, r.target) for r in A.classify(
        spark.createDataFrame(rows, REPORT), ["case_id"], classes).collect()}
    assert got == {1: ("HARD", "TEMPORAL", ""), 2: ("HARD", "CAUSAL", ""), 3: ("SOFT", "NONE", "agent1"), 4: ("SOFT", "CAUSAL", "agent1"),
                   5: ("SOFT", "SPURIOUS", "agent1"), 6: ("NONE", "NONE", "")}
    stuck = A.classify(spark.createDataFrame(rows, REPORT), ["case_id"], classes, retry=F.lit(2))
    assert {r.case_id: r.conflict_type for r in stuck.collect()}[4] == "HARD"


def test_text_without_header_and_broken_json(spark):
    df = spark.createDataFrame([("本文" * 600,)], "t string")
    rows = X.sections(df, "t").collect()
    assert [(r.type, len(r.content)) for r in rows] == [("full", 1000)]
    cases = ['{"a": 2}', 'x ```json\n{"a": "3"}\n``` y', 'so {"a": 1.9} it is', '{"a": 1', "", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    got = {r.i: r.s for r in df.select("i", X.clamped_score(X.salvage_json(F.col("t")), F.lit("a"), F.lit(3)).alias("s")).collect()}
    assert got == {0: 2, 1: 3, 2: 1, 3: 2, 4: 2, 5: 2}


def test_sections_and_headers(spark):
    body = "前言" + "犯罪事實" + "甲" * 60 + "理 由" + "乙" * 60 + "主文短"
    rows = X.sections(spark.createDataFrame([(body,)], "t string"), "t").orderBy("section_no").collect()
    assert [(r.section_no, r.type) for r in rows] == [(1, "facts"), (2, "legal_reasoning")]


def test_statute_text(spark):
    law = "第一章 總則\n第 1 條（罪刑法定）\n行為之處罰以法律有明文規定者為限\n第二章\n第185-3條\n不能安全駕駛，依第 2 條之罪處斷\n\n第3條\n短"
    rows = X.statute_articles(spark.createDataFrame([(law,)], "t string"), "t").orderBy("article_pos").collect()
    # a number inside the running text ends an article, and is none itself; too short articles go
    assert [r.article_id for r in rows] == ["1", "185-3"]
    assert rows[0].content == "第1條\n行為之處罰以法律有明文規定者為限"


def brute_cover(spans, total, fps):
    frames = set()
    for s, e in spans:
        frames |= set(range(max(0, int(s * fps)), min(int(e * fps) + 1, total)))
    return sorted(frames)


def test_cover_and_guided_picks(spark):
    spans = {1: [(0.0, 1.0), (0.5, 2.0), (2.0, 2.1), (5.0, 99.0)], 2: [(50.0, 60.0)], 3: [(1.0, 1.1)]}
    total, fps, n = 200, 10.0, 10
    df = spark.createDataFrame([(v, i, s, e) for v, l in spans.items() for i, (s, e) in enumerate(l)], "video_id int, seg_idx int, start_s double, end_s double")
    got = {}
    for r in S.cover(df, total, fps).collect():
        got.setdefault(r.video_id, set()).update(range(r.start_frame, r.end_frame + 1))
    assert {v: sorted(f) for v, f in got.items()} == {v: brute_cover(l, total, fps) for v, l in spans.items() if brute_cover(l, total, fps)}
    picks = {}
    for r in S.guided_picks(df, df, total, fps, n).collect():
        picks.setdefault(r.video_id, []).append(r.frame)
    for v, l in spans.items():
        frames, k = brute_cover(l, total, fps), int(n * 0.7)
        if not frames:
            want = [int(i * total / n) for i in range(n)]
        else:
            event = [frames[int(i * len(frames) / k)] for i in range(k)] if len(frames) >= k else frames
            want = sorted(set(event + [int(i * total / (n - k)) for i in range(n - k)]))[:n]
        assert sorted(picks[v]) == want


def test_environment_report_may_come_first(spark):
    """The verdict of a case does not depend on where its environment report stands."""
    rows = []
    for case, order in enumerate(("AE", "EA", "A", "EAE", "E")):
        for pos, kind in enumerate(order, 1):
            rows.append(report(case, pos, "Stealing", 0.9, (10,), esc=100) if kind == "A" else report(case, pos, "E", 0.8, env=True))
    got = {r.case_id: (r.conflict_type, r.layer) for r in A.classify(spark.createDataFrame(rows, REPORT), ["case_id"], dims.classes(spark)).collect()}
    assert got[0] == ("HARD", "TEMPORAL") and got[1] == got[0] and got[2] == got[0] and got[3] == got[0]
    assert got[4] == ("NONE", "NONE")


def test_mismatch_pairs_on_any_scale(spark):
    rows = [(1, i, False, c, conf) for i, (c, conf) in enumerate(
        [("Assault", 10.0), ("Arson", 90.0), ("Arson", 10.3), ("Assault", -3.0), ("Normal", 50.0), ("Robbery", 10.5), ("Robbery", None)])]
    df = spark.createDataFrame(rows, "case_id int, pos int, is_env boolean, category string, confidence double").withColumn(
        "frame_refs", F.array().cast("array<int>"))
    want = {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and "Normal" not in (a[3], b[3]) and a[3] != b[3]
            and None not in (a[4], b[4]) and abs(a[4] - b[4]) > 0.5}
    for chunk in (1, 2, 4096):
        got = A.mismatch_pairs(df, ["case_id"], chunk=chunk).collect()
        assert len(got) == len(want) and {(r.pos_a, r.pos_b) for r in got} == want
