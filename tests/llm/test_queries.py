"""Registered queries: SQL, brute force on small tables, the pipeline."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from assayer.llm import queries
from check import TABLES, rows

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = queries.QUERIES[name](spark, FOLDER)
    cur = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert not [c for c in cur.description if "HUGEINT" in str(c[1])]
    got = [tuple(r) for r in df.collect()]
    assert rows(df.columns, got) == rows(columns, cur.fetchall()) and got


def test_archives_are_parsed_once(spark, tmp_path):
    pages = [(1, "http://a.example/x", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://c.example", None), (4, "http://d.example", ""),
             (5, "http://e.example", "a\r\n\r\nWARC/1.1\r\n\r\n")]
    want = [(1, 9, "response", None), (2, 9, "revisit", 1), (3, 0, "response", None), (4, 0, "revisit", 3), (5, 17, "response", None)]
    for n in (len(pages), 0):
        spark.createDataFrame(pages[:n], "page_id long, url string, html string").write.parquet(f"{tmp_path}/{n}/pages.parquet")
        df = queries.op1_warc_captures(spark, f"{tmp_path}/{n}")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan and "binaryFile" not in plan and "FileScan parquet" in plan
        got = df.select("page_id", "payload_bytes", "record_type", "refers_to").collect()
        assert sorted(map(tuple, got)) == want[:n]


def test_round_trip(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in queries.op5_bpe_round_trip(spark, FOLDER).collect():
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_passages_brute_force(spark):
    from test_duplicates import spans_truth
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = queries.op10_repeated_passages(spark, FOLDER).collect()
    assert sorted(map(str, map(tuple, got))) == spans_truth(docs)


def test_near_brute_force(spark):
    from test_duplicates import near_truth
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = queries.op7_bagminhash(spark, FOLDER).collect()
    assert sorted(map(str, map(tuple, got))) == near_truth(docs)


def test_pipeline(spark):
    from test_duplicates import near_truth
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    pieces = corpus_pipeline.run(spark, FOLDER).collect()
    kept = {r.doc_id: r.text for r in corpus_pipeline.quality_rules(spark, docs, FOLDER).collect()}
    last = {}
    for i in sorted(kept):
        last[kept[i].lower() if kept[i].isascii() else queries.exact.UPPER and "".join(
            c.lower() if c in queries.exact.UPPER else c for c in kept[i])] = i
    left = [(i, kept[i]) for i in sorted(last.values())]
    classes = [eval(x) for x in near_truth(left)]
    stay = sorted({c for _, c, _ in classes})
    assert {p.doc_id for p in pieces} == set(stay)
    left_bytes = kept_bytes([(i, kept[i].encode()) for i in stay])
    tokenizer = Tokenizer.from_file(queries.public_tokenizers.path(queries.PACK_TOKENS))
    parts = {}
    for p in pieces:
        parts.setdefault(p.doc_id, []).append(p)
    assert any(len(left_bytes[i]) < len(kept[i].encode()) for i in stay)
    for i in stay:
        ids = tokenizer.encode(left_bytes[i].decode("utf-8", "ignore"), add_special_tokens=False).ids + [1]
        raw = np.array(ids, "<u4").tobytes()
        at = 0
        for p in sorted(parts[i], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids)) and p.ids_crc32 == zlib.crc32(raw[4 * at:4 * (at + p.length)])
            at += p.length
        assert at == len(ids)


def kept_bytes(docs):
    """Bytes left of each document when those under 50 bytes of an earlier one are gone."""
    out, seen = {}, set()
    for i, text in sorted(docs):
        here = [text[k:k + 50] for k in range(len(text) - 49)]
        gone = bytearray(len(text))
        for k, x in enumerate(here):
            if x in seen:
                gone[k:k + 50] = b"\1" * 50
        seen.update(here)
        out[i] = bytes(c for c, g in zip(text, gone) if not g)
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __key long, __text string, __digest string, __id int"


def odd_rows(spark, rows):
    return spark.createDataFrame([(*r, "en", "s", len(r[1] or ""), 7, "x", "y", 1) for r in rows], SCHEMA)


def words(seed, n=60):
    return " ".join(f"w{seed}x{k}" for k in range(n))


def test_deduplication_keeps_texts_of_repeated_and_null_ids(spark):
    rows = [(None, words(1)), (None, words(2)), (None, words(3)), (7, words(4)), (7, words(5)), (8, words(6)), (9, words(7)), (None, None)]
    for stage in (corpus_pipeline.exact_dedup, corpus_pipeline.near_dedup):
        out = stage(spark, odd_rows(spark, rows + rows), FOLDER)
        assert out.columns == odd_rows(spark, rows).columns
        assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(rows, key=str)
    near = words(8).replace("w8x3 ", "changed ", 1)
    out = corpus_pipeline.near_dedup(spark, odd_rows(spark, [(5, near), (None, words(8)), (5, words(9)), (6, words(8))]), FOLDER).collect()
    assert sorted((r.doc_id, r.text) for r in out) == [(5, near), (5, words(9))] and out[0]["__digest"] == "y"


def test_passages_of_repeated_ids(spark):
    shared = "this passage of more than fifty bytes stands in several documents. "
    rows = [(1, shared), (2, shared + words(1)), (2, words(2) + shared), (2, words(3)), (None, shared), (3, None)]
    out = corpus_pipeline.repeated_passages(spark, odd_rows(spark, rows), FOLDER).collect()
    want = [(1, shared), (2, words(1)), (2, words(2)), (2, words(3)), (None, shared), (3, None)]
    assert sorted(((r.doc_id, (r.text or "").strip()) for r in out), key=str) == sorted(((i, (t or "").strip()) for i, t in want), key=str)
    assert {r["__text"] for r in out} == {"x"} and all(r.n_chars == len(r.text or "") for r in out)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, name, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = "This is a clean line of text with enough words in it to stay. "
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, text, "en", "s", 9), (2, text, "en", "s", 9),
                                 (3, text.upper(), None, "s", 9), (4, "é" * 120_000, "en", None, 120_000)], schema)
    out = stage(spark, odd, FOLDER)
    left = out.select("doc_id", *([] if name == "packing" else ["text"])).collect()
    if name == "quality_rules":
        assert [r.doc_id for r in left if r.doc_id != 3] == [2, 2]
    elif name in ("exact_dedup", "near_dedup"):
        assert sorted(str(r.doc_id) for r in left) == (["1", "3", "4"] if name == "exact_dedup" else ["1", "2", "4"])
    elif name == "repeated_passages":
        assert len(left) == odd.count() and [r.text for r in left if r.doc_id == 4] == ["é" * 120_000]
    else:
        assert sorted({str(r.doc_id) for r in left}) == ["1", "2", "3", "4", "None"]
    if name != "packing":
        assert out.columns == odd.columns
    assert stage(spark, odd.limit(0), FOLDER).count() == 0
