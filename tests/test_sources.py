"""Native files: one document per file, missing and broken files, sinks."""

import json

import duckdb

import __spark_entry__ as entry
from assayer import dims
from assayer.operators import thresholds as T
from assayer.sources import readers as R
from assayer.sources import writers as W
from check import rows


def test_annotations_file(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({
        "Arson001": {"duration": 9.5, "timestamps": [[0.0, 1.5], [2.0, 3.0]], "sentences": ["one", "two"]},
        "Normal_1": {"duration": 2.0, "timestamps": [], "sentences": []}}, indent=1))
    got = {r.video_id: (r.duration, r.sentences) for r in R.annotations(spark, str(tmp_path)).collect()}
    assert got == {"Arson001": (9.5, ["one", "two"]), "Normal_1": (2.0, [])}
    assert R.annotations(spark, str(tmp_path / "missing")).count() == 0


def test_statutes_file(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([
        {"article_id": "277", "content": "a"}, {"article_id": "185-3", "law_name": "x", "crime_category": "Own", "content": "b"},
        {"article_id": "999", "chapter": "c", "content": "d"}], ensure_ascii=False))
    got = {r.article_id: (r.law_name, r.crime_category, r.chapter) for r in R.statutes(spark, str(tmp_path), dims.article_classes(spark)).collect()}
    assert got == {"277": ("中華民國刑法", "Assault", ""), "185-3": ("x", "Own", ""), "999": ("中華民國刑法", "Other", "c")}
    twice = spark.createDataFrame([("1", "old", 1), ("1", "new", 2)], "article_id string, content string, no int")
    assert [r.content for r in R.keyed_statutes(twice, "no").collect()] == ["new"]


def test_judgment_texts(spark, tmp_path):
    (tmp_path / "Arson").mkdir()
    (tmp_path / "Arson" / "j1.txt").write_bytes("臺灣臺北地方法院 100年度第5號\n犯罪事實：甲於某日放火\n理由：證據充分\n主文：有罪".encode() + b"\xff")
    (tmp_path / "Arson" / "j2.txt").write_text("沒有標題的文字一二三四")
    got = {r.source_file: r for r in R.judgment_texts(spark, str(tmp_path)).collect()}
    assert got["j1"].crime_category == "Arson" and got["j1"].facts == "甲於某日放火" and got["j1"].court == "臺灣臺北地方法院"
    assert got["j1"].legal_reasoning == "證據充分" and got["j1"].verdict.startswith("有罪")
    assert got["j2"].facts == "沒有標題的" and got["j2"].legal_reasoning == "文字一二三四" and got["j2"].court == "未知法院"


def test_reports_accept_both_headings(spark, tmp_path):
    rule = "─" * 10
    for name, heading in (("a", "一、鑑定報告（x）"), ("b", "一、Model 鑑定報告")):
        (tmp_path / f"{name}.txt").write_text(f"  正確答案：Arson\n  模型判定：Normal  ✗\n{rule}\n  {heading}\n{rule}\n\n內容 {name}\n\n{rule}\n  一-b、摘要\n{rule}\n")
    (tmp_path / "c.txt").write_text("正確答案：Arson\n")
    got = {r.report_id: (r.ground_truth, r.predicted, r.body) for r in R.reports(spark, str(tmp_path)).collect()}
    assert got == {"a": ("Arson", "Normal", "內容 a"), "b": ("Arson", "Normal", "內容 b")}
    assert {r.report_id: r.predicted for r in R.reports(spark, str(tmp_path), keep_empty=True).collect()}["c"] == "Unknown"


def test_run_stats_of_uneven_age(spark, tmp_path):
    for run, text in (("new", json.dumps([{"video_id": "v", "confidence": 0.5, "rlegal_gt": 0.1}])),
                      ("old", json.dumps([{"video_id": "w", "correct": True, "other": 1}])), ("broken", "[{")):
        (tmp_path / run).mkdir()
        (tmp_path / run / "stats.json").write_text(text)
    got = {r.run_id: (r.video_id, r.confidence, r.correct) for r in R.run_stats(spark, str(tmp_path)).collect()}
    assert got == {"new": ("v", 0.5, None), "old": ("w", None, True)}
    scored = T.labelled(R.run_stats(spark, str(tmp_path)), "confidence", "x")
    assert [(r.score, r.label) for r in scored.collect()] == [(0.5, 0)]
    named = R.run_stats(spark, {"L": str(tmp_path / "new")}).collect()
    assert [(r.run_id, r.video_id) for r in named] == [("L", "v")]


def test_judge_file(spark, tmp_path):
    item = {"video_id": "v", "m1_gt": "A", "m1_scores": {"j": {"q_norm": {"q1": 0.5}, "overall": 0.5}}, "m2_judged_by": {"j": {"q_norm": {"q1": 1}}}}
    (tmp_path / "p.json").write_text(json.dumps([item]))
    assert sorted((r.model, r.judge, r.q_key, r.norm) for r in R.judge_scores(spark, str(tmp_path)).collect()) == [
        ("m1", "j", "q1", 0.5), ("m2", "j", "q1", 1.0)]


def test_priors_cues_and_splits(spark, tmp_path):
    (tmp_path / "r1").mkdir()
    (tmp_path / "r1" / "p.json").write_text(json.dumps({"_comment": "text", "A": 0.25, "B": "n/a"}))
    assert [(r.run_id, r["class"], r.bias) for r in R.priors(spark, str(tmp_path / "r1")).collect()] == [("r1", "A", 0.25)]
    (tmp_path / "c.json").write_text(json.dumps({"_meta": {"v": 1}, "A": {"applicable_articles": ["x", "y", "z"], "visual_mappings": [
        {"visual_cue": "c1", "legal_element": "e", "evidence_type": "直接證據", "notes": ""}, {"visual_cue": "c2", "legal_element": "e", "evidence_type": "間接證據"}]}}))
    cues = R.cues(spark, str(tmp_path / "c.json"))
    assert [(r["class"], r.cue_no, r.cue) for r in cues.orderBy("cue_no").collect()] == [("A", 0, "c1"), ("A", 1, "c2")]
    lines = {r["class"]: r.line for r in R.cue_lines(cues).collect()}
    assert lines["A"] == "- A（x／y）：c1" and "A: c1." in lines["Normal"]
    (tmp_path / "train").mkdir()
    (tmp_path / "train" / "001.txt").write_text("Abuse/Abuse001_x264.mp4  \nAbuse 1\n\n")
    assert [tuple(r) for r in R.split_lists(spark, str(tmp_path / "train")).collect()] == [("Abuse", "Abuse001_x264", "train")]


def test_law_page(spark):
    html = ('<div class="row"><div class="col-no">第 二十三 章 傷害罪</div></div><div class="row"><div class="col-no"><a name="277">第 277 條</a></div>'
            '<div class="col-data"><div>傷害人之身體</div></div></div><div class="row"><div class="col-no"><a name="5">第 5 條</a></div><div class="col-data">x</div></div>')
    rows = R.law_pages(spark.createDataFrame([(html,)], "html string"), "html", dims.article_classes(spark)).collect()
    assert [(r.article_id, r.chapter, r["class"], r.content) for r in rows] == [("277", "第 二十三 章 傷害罪", "Assault", "第 277 條　傷害人之身體")]


def test_snapshot_counts_only_when_committed(spark, tmp_path):
    base = str(tmp_path / "snap")
    assert W.latest_version(spark, base) is None
    W.write_snapshot(spark.range(3), base)
    spark.range(9).write.parquet(f"{base}/data-lost")  # a job that was never published
    assert W.latest_version(spark, base) == 1 and W.read_snapshot(spark, base).count() == 3
    W.write_snapshot(spark.range(5), base)
    assert W.read_snapshot(spark, base).count() == 5


def test_two_writers_never_take_one_version(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "snap2")
    W.write_snapshot(spark.range(3), base)
    monkeypatch.setattr(W, "latest_version", lambda *_: None)  # a writer that did not see the first version
    assert W.write_snapshot(spark.range(7), base) == 2
    monkeypatch.undo()
    assert W.read_snapshot(spark, base).count() == 7


def test_form_feeds_survive(spark, tmp_path):
    texts = ["a\fb", "plain", "\x1a1 \x1a2\f\f", ""]
    df = spark.createDataFrame([("r", t) for t in texts], "run_id string, text string")
    W.write_reports(df, "text", str(tmp_path / "ff"))
    got = R.documents(spark, str(tmp_path / "ff"), R.SEPARATOR)
    assert sorted(r.value for r in got.collect()) == sorted(texts)


def test_reports_are_written_small(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "REPORTS_PER_FILE", 300)
    path = tmp_path / "small"
    df = spark.range(1000).selectExpr("'r' AS run_id", "concat('report ', id, repeat(' of the same lines', 200)) AS text").coalesce(1)
    W.write_reports(df, "text", str(path))
    files = [f for f in (path / "run_id=r").iterdir() if f.name.startswith("part-")]
    assert len(files) == 4 and sum(f.stat().st_size for f in files) < 1000 * 200 * 18 / 20
    assert R.documents(spark, str(path), R.SEPARATOR).select("value").distinct().count() == 1000


def test_essays_of_odd_texts(spark, tmp_path):
    ends = ["", " ", "\n", "\r\n", "\r", "\t", "\f", "\v", "\u0085", "\u00a0", "\u3000", "\u2028", "\x1a", "\x1a2", "\ufeff"]
    texts = [None, "", "標題：x\ny", "Title: \n\ny", "a\r\nb\r\nc", *[f for a in ends for b in ends for f in (
        f"{a}head{b}\n{b}body{a}", f"{a}{b}", f"{a}head{b}")]]
    docs = [(i, t, [None, "", " s "][i % 3]) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    df = entry.queries()["src_essays"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(entry.oracle_sql()["src_essays"])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in cur.description], cur.fetchall())


def test_essay_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("標題：\r\n\r\n一\r\n二\r\n".encode())
    (tmp_path / "b.json").write_text(json.dumps([{"content": "c"}, {"source": "s", "title": "t"}]))
    got = R.essays(spark, str(tmp_path / "a.txt"), str(tmp_path / "b.json")).collect()
    assert sorted(map(tuple, got)) == [("json", "", "c"), ("s", "t", ""), ("text", "", "一\n二")]


def test_essay_of_any_length(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"title": "t", "content": "x" * 20_000_001}]))
    got = R.essays(spark, json=str(tmp_path)).selectExpr("title", "length(content) AS n").collect()
    assert list(map(tuple, got)) == [("t", 20_000_001)]
