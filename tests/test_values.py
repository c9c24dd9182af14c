"""Published values and hand-computed results."""

import math
import random

from pyspark.sql import functions as F

from assayer.functions import citations as C
from assayer.functions.overlap import bleu4, common_length, rouge_l
from assayer.operators import judging as J
from assayer.operators import metrics as M
from assayer.operators import stats as S
from assayer.operators import thresholds as T


def one(df):
    return df.collect()[0].asDict()


def test_binary_metrics_of_a_published_run(cases_frame):
    rows = [("m", "X", "X")] * 113 + [("m", "Normal", "X")] * 2 + [("m", "X", "Normal")] * 93 + [("m", "Normal", "Normal")] * 198
    m = one(M.binary_prf(cases_frame(rows)))
    assert [round(m[k], 4) for k in ("precision", "recall", "f1", "accuracy")] == [0.9826, 0.5485, 0.704, 0.766]


def test_prior_of_an_over_predicted_class(cases_frame):
    names = [f"c{i}" for i in range(13)]
    rows = [("m", "c1", "c0")] * 16 + [("m", "c1", names[1 + i % 12]) for i in range(36)]
    p = {r["class"]: r for r in M.bias_priors(cases_frame(rows), names).collect()}
    assert round(p["c0"]["bias"], 4) == 1.2993 and p["c0"]["flag"] == "over"


def test_icc_of_the_classic_table(spark):
    table = [(9, 2, 5, 8), (6, 1, 3, 2), (8, 4, 6, 8), (7, 1, 2, 6), (10, 5, 6, 9), (6, 2, 4, 7)]
    rows = [("all", i, str(j), float(v)) for i, line in enumerate(table) for j, v in enumerate(line)]
    r = one(S.icc21(spark.createDataFrame(rows, "scope string, item_id int, rater string, value double"), ["scope"]))
    assert (r["n"], r["k"], round(r["icc"], 2)) == (6, 4, 0.29)


def test_t_tail(spark):
    df = spark.createDataFrame([(2.0, 10.0), (0.0, 5.0), (12.706, 1.0), (-2.5, 30.0)], "t double, k double")
    got = [r.p for r in df.select(S.t_tail("t", "k").alias("p")).collect()]
    for value, want in zip(got, (0.0733880, 1.0, 0.05, 0.0181156)):
        assert abs(value - want) < 1e-5


def test_spearman_ties(spark):
    df = spark.createDataFrame([("a", 1, 0.1, 0.1), ("a", 2, 0.1, 0.2), ("a", 3, 0.3, 0.2), ("a", 4, 0.4, 0.9)],
                               "scope string, item_id int, a double, b double")
    ordinal = one(S.spearman(df, ["scope"], "item_id"))["rho"]
    average = one(S.spearman(df, ["scope"], "item_id", ties="average"))["rho"]
    assert ordinal == 1.0
    assert abs(average - 0.8333333) < 1e-6


def test_auroc_ties_and_costs(spark):
    rows = [("r", 1, 0.9), ("r", 0, 0.9), ("r", 1, 0.4), ("r", 0, 0.1)]
    df = spark.createDataFrame(rows, "run_id string, label int, score double")
    assert one(T.auroc(df, ["run_id"]))["auroc"] == (0.5 + 1 + 0 + 1) / 4
    best = one(T.min_ndcf(df, ["run_id"]))
    assert best["tau"] == 0.4 and best["ndcf"] == 0.5  # one false alarm of two, nothing missed


def test_rubric_pack(spark):
    rows = [(1, "m", "q1", 3, 3, 2), (1, "m", "q2", 4, None, 4), (2, "m", "q1", 3, 1, 1), (2, "m", "q2", 4, 2, 3)]
    df = spark.createDataFrame(rows, "item_id int, model string, q_key string, max_score int, raw_1 int, raw_2 int")
    got = {r.item_id: r for r in J.rubric_items(J.pack_rubric(df)).collect()}
    assert abs(got[1].overall - (2.5 / 3 + 3 / 4) / 2) < 1e-12 and got[1].is_stable is False
    assert got[2].is_stable is True
    single = {r.item_id: r for r in J.rubric_items(J.pack_rubric(df.drop("raw_2"))).collect()}
    assert single[1].is_stable and abs(single[1].overall - (1 + 0.5) / 2) < 1e-12


def test_chinese_numerals(spark):
    words = {"第二百七十七條": "277", "第一百〇五條": "105", "第十條": "10", "第 八 條": "8", "第千二百條": "1200", "第三十一條": "31", "第二七條": None,
             "第一千〇五條": "1005", "第一千〇五十條": "1050", "第二千零一十條": "2010", "第百十條": "110", "第零條": "0", "第十百條": None}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r.w: r.c for r in df.select("w", C.cited_articles(F.col("w")).alias("c")).collect()}
    assert got == {w: ([v] if v else []) for w, v in words.items()}


def test_citations_keep_suffixes(spark):
    df = spark.createDataFrame([("依第 185 - 3 條、第185-3條與第277-F條",)], "w string")
    assert sorted(one(df.select(C.cited_articles(F.col("w")).alias("c")))["c"]) == ["185-3", "277-F"]


def test_legal_score_window(spark):
    expected = spark.createDataFrame([("A", ["1", "2"], ["故意", "過失"]), ("B", ["9"], ["x"])],
                                     "class string, article_nos array<string>, elements array<string>")
    far = "故意" + "無" * 170 + "不構成"
    near = "故意，故意不構成"
    text = [(1, "A", "第1條 第9條 " + far), (2, "A", "第 2 條 " + near), (3, "A", ""), (4, "Z", "第9條"), (5, "A", "第1條第2條故意過失" + "。" * 200 + "不構成本罪")]
    df = spark.createDataFrame(text, "id int, class string, body string")
    got = {r.id: r for r in C.legal_score(df, "body", expected, "class").collect()}
    assert (got[1].tier1, got[1].tier2, round(got[1].tier3, 6)) == (0.5, 0.5, 0.666667)
    assert got[2].tier2 == 0.0 and round(got[2].tier1, 6) == 0.666667
    assert got[3].rlegal == 0.3
    assert (got[4].tier1, got[4].tier2, round(got[4].tier3, 6)) == (0.0, 0.0, 0.666667)
    assert abs(got[5].tier2 - 0.3) < 1e-12 and got[5].tier1 == 1.0


def test_common_length_of_long_lists():
    rng = random.Random(9)
    for n in (0, 1, 7, 63, 64, 65, 200):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(0, n))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert common_length(a, b) == common_length(b, a) == table[-1][-1]


def test_overlap_scores(spark):
    df = spark.createDataFrame([(1, "a b c d e", "a b c d e"), (2, "x", "a b"), (3, "a c b d", "a b c d")], "id int, c string, r string")
    bleu = {r.id: r.bleu for r in bleu4(df, "id", "c", "r").collect()}
    assert abs(bleu[1] - 1) < 1e-12 and bleu[2] == 0.0
    want = math.exp((math.log(1) + math.log(1 / 4) + math.log(1 / 3) + math.log(1 / 2)) / 4)
    assert abs(bleu[3] - want) < 1e-12
    df = df.union(df.selectExpr("id + 10", "NULL", "r")).select("id", F.split("c", " ").alias("c"), F.split("r", " ").alias("r"))
    rouge = {r.id: r.rouge_l for r in rouge_l(df, "id", "c", "r").collect()}
    assert [rouge.pop(i) for i in (11, 12, 13)] == [0.0] * 3
    assert rouge == {1: 1.0, 2: 0.0, 3: 0.75}


def test_focus_pairs_in_parts(spark):
    from assayer.plans import audit as P
    folder = "/root/testdata/sf0.001"
    reports, keys, classes, normal = P.parts(spark, folder)
    whole = {r.case_id: r.pairs for r in P.A.focus_pairs(reports, keys, classes, normal).collect()}
    cut = P.A.focus_pairs(reports, keys, classes, normal, size=1).collect()
    assert len(cut) > len(whole) and max(len(p) for p in whole.values()) > 1
    joined = {}
    for r in cut:
        joined.setdefault(r.case_id, []).extend(r.pairs)
    assert {k: sorted(map(str, v)) for k, v in joined.items()} == {k: sorted(map(str, v)) for k, v in whole.items()}
    assert P.A.focus_pairs(reports.limit(0), keys, classes, normal).count() == 0
