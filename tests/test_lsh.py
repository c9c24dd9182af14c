"""Approximate nearest vectors: exact scores, recall, hot buckets."""

import numpy as np
import pytest

from assayer.operators import lsh
from assayer.operators import retrieval as R
from assayer.plans import retrieval as P

FOLDER = "/root/testdata/sf0.01"


def frame(spark, rows, id_name):
    if id_name == "doc_id":
        return spark.createDataFrame([(i, "ab"[i % 2], [float(x) for x in v]) for i, v in rows], "doc_id long, layer string, vector array<double>")
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "query_id long, vector array<double>")


def test_recall_and_scores_on_the_table(spark):
    got = P.jn_knn_lsh(spark, FOLDER).collect()
    v = P.doc_vectors(spark, FOLDER)
    exact = R.dense(P.one_layer(v), v.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")).collect()
    want = {(r.query_id, r.doc_id): round(r.score, 6) for r in exact}
    met = [r for r in got if (r.query_id, r.doc_id) in want]
    assert len(met) / len(want) >= 0.9
    assert all(r.score == pytest.approx(want[r.query_id, r.doc_id], abs=2e-6) for r in met)
    assert len({(r.query_id, r["rank"]) for r in got}) == len(got) and {r.query_id for r in got} == {q for q, _ in want}


def test_all_buckets_give_the_exact_answer(spark, monkeypatch):
    monkeypatch.setattr(lsh, "CELL", 7)  # many cells a bucket, on both sides
    rng = np.random.default_rng(1)
    base = rng.normal(size=(120, 5))
    base[30:90] = base[3]  # half of all vectors are equal: one hot bucket, ties by id
    docs = frame(spark, list(enumerate(base)), "doc_id")
    asked = frame(spark, list(enumerate(np.vstack([base[3:6], rng.normal(size=(20, 5))]))), "query_id")
    got = lsh.dense_approx(docs, asked, k=4, tables=1, bits=2, probes=3).orderBy("layer", "query_id", "rank")
    want = R.dense(docs, asked, 4).orderBy("layer", "query_id", "rank")
    assert [tuple(r) for r in got.select(want.columns).collect()] == [tuple(r) for r in want.collect()]


def test_probes_are_the_cheapest_flips():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(50, 6))
    some, more = lsh.codes(v, 3, 5, 2, 9), lsh.codes(v, 3, 5, 15, 9)
    assert some.shape == (50, 9) and more.shape == (50, 48)
    own = lsh.codes(v, 3, 5, 0, 9)
    assert (some.reshape(50, 3, 3)[:, :, 0] == own).all() and (more.reshape(50, 3, 16)[:, :, :3] == some.reshape(50, 3, 3)).all()
    assert all(len(set(x)) == 48 for x in more.tolist())
    side = np.abs(v @ lsh.hyperplanes(6, 3, 5, 9)).reshape(50, 3, 5)
    assert ((some.reshape(50, 3, 3)[:, :, 1] ^ own) % 32 == 1 << side.argmin(2)).all()


def test_odd_vectors(spark):
    docs = frame(spark, [(0, [0, 0, 0]), (1, [1, 0, 0]), (2, [1, 0, 0])], "doc_id").union(
        spark.createDataFrame([(3, "a", None)], "doc_id long, layer string, vector array<double>"))
    asked = frame(spark, [(1, [0, 0, 0]), (2, [2, 0, 0])], "query_id")
    got = {(r.layer, r.query_id, r.doc_id): r.score for r in lsh.dense_approx(docs, asked, tables=4, bits=3, probes=6).collect()}
    assert got["a", 2, 2] == got["b", 2, 1] == 1.0 and got["a", 1, 0] == 0.0 and not [k for k in got if k[2] == 3]
    assert lsh.dense_approx(docs.limit(0), asked).count() == lsh.dense_approx(docs, asked.limit(0)).count() == 0
