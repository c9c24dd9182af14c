"""Ranking against brute force, scorers, judge keys."""

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from assayer.functions import scorers
from assayer.functions import text as X
from assayer.operators import retrieval as R


def test_tokens_of_mixed_text(spark):
    t = "刑法第 277 條 Über-Fall"
    row = spark.createDataFrame([(t,)], "t string").select(X.tokens(F.col("t")).alias("k")).collect()[0]
    assert row.k == ["über", "fall", "刑", "法", "第", "刑法", "法第", "條", "277"]


def brute_bm25(docs, query):
    split = {d: re.findall(r"[a-z]+", t) for d, t in docs.items()}
    n, avg = len(docs), sum(map(len, split.values())) / len(docs)
    df = {}
    for words in split.values():
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    out = []
    for d, words in split.items():
        s = sum(idf.get(q, 0) * words.count(q) * 2.5 / (words.count(q) + 1.5 * (0.25 + 0.75 * len(words) / avg)) for q in query.split())
        out.append((d, s))
    return [(d, round(s, 6)) for d, s in sorted(out, key=lambda x: (-round(x[1], 9), x[0]))[:5] if round(s, 9) > 0]


def test_bm25_against_brute_force(spark):
    r = random.Random(2)
    words = ["aa", "bb", "cc", "dd", "ee", "ff"]
    docs = {i: " ".join(r.choice(words[: 2 + i % 5]) for _ in range(3 + i % 7)) for i in range(30)}
    corpus = spark.createDataFrame([(i, "all", t) for i, t in docs.items()], "doc_id long, layer string, text string")
    asked = {1: "aa cc cc", 2: "ff zz", 3: "zz"}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    got = {}
    for row in R.bm25(corpus, queries).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append((row.doc_id, round(row.score, 6)))
    assert got == {q: brute_bm25(docs, t) for q, t in asked.items() if brute_bm25(docs, t)}


def test_dense_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 6))
    base[7] = base[3]  # an exact copy: the lower id comes first
    vectors = spark.createDataFrame([(i, "ab"[i % 2], [float(x) for x in v]) for i, v in enumerate(base)], "doc_id long, layer string, vector array<float>")
    asked = rng.normal(size=(9, 6))
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(asked)], "query_id long, vector array<double>")
    whole = [tuple(r) for r in R.dense(vectors, queries, 4).orderBy("layer", "query_id", "rank").collect()]
    monkeypatch.setattr(R, "BLOCK_BYTES", 100)  # blocks of two vectors
    sliced = [tuple(r) for r in R.dense(vectors, queries, 4).orderBy("layer", "query_id", "rank").collect()]
    assert whole == sliced and len(whole) == 2 * 9 * 4
    f32 = base.astype("float32").astype("float64")
    sims = np.round((f32 / np.linalg.norm(f32, axis=1, keepdims=True)) @ (asked / np.linalg.norm(asked, axis=1, keepdims=True)).T, 9)
    for layer in (0, 1):
        ids = np.arange(layer, 40, 2)
        for q in range(9):
            want = sorted(ids, key=lambda i: (-sims[i, q], i))[:4]
            got = [r[2] if isinstance(r[2], int) else r[2] for r in whole if r[0] == "ab"[layer] and r[1] == q]
            assert got == want


def test_fusion_order(spark):
    def ranked(ids):
        return spark.createDataFrame([("x", 1, d, i + 1) for i, d in enumerate(ids)], "layer string, query_id long, doc_id long, rank int")
    got = R.fuse([ranked([5, 6]), ranked([7, 6])], ["layer", "query_id"]).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [6, 5, 7]


def test_a_failing_row_keeps_the_others(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, [0.0, 2.0])], "id long, vector array<double>")
    got = {r.id: (r.category, r.evidence[:5]) for r in scorers.run_scorer(
        rows, "nearest_centroid", labels=["x", "y"], matrix=np.eye(2)).collect()}
    assert got == {1: ("x", "cosin"), 2: ("Normal", "error"), 3: ("y", "cosin")}


def test_judge_keys(spark):
    def keys(models):
        df = spark.createDataFrame([(m,) for m in models], "judge_model string")
        return {r.judge_model: r.judge_key for r in X.judge_key(df).collect()}
    assert keys(["claude-a-1", "gpt-4o"]) == {"claude-a-1": "claude", "gpt-4o": "openai"}
    assert keys(["claude-a-1", "claude-b-1", "gpt-4o"]) == {"claude-a-1": "claude_a", "claude-b-1": "claude_b", "gpt-4o": "gpt_4o"}


def test_answers(spark):
    labels = ["Normal", "Robbery", "RoadAccidents"]
    texts = {"category: roadaccidents": "RoadAccidents", "a robbery, or CATEGORY: none": "Robbery", "": "Normal", "CATEGORY: Normal robbery": "Normal"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.v for r in df.select("t", X.label(F.col("t"), labels).alias("v")).collect()} == texts
    yes = {"Yes.": True, "'no' yes": False, "yes": True, "maybe": False, "well yes yes no": True, "nothing": False, None: False}
    df = spark.createDataFrame([(t,) for t in yes], "t string")
    assert {r.t: r.v for r in df.select("t", X.yes_no(F.col("t")).alias("v")).collect()} == yes
