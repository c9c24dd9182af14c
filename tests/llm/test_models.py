"""Line labels, toxicity, grades and page text."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.llm import hashing, html_blocks, line_crf, ordinal, toxicity
from assayer.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    marked = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i:i + 5])] > 1:
            marked |= set(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
            "n_dup_lines": dup, "n_repeat_words": len(marked)}


@pytest.mark.parametrize("text", ["", " \n\t", "a", "a b c d e", "a b c d e f a b c d e", "x\x85y z \x1c w", "é| é|\né| é|\n \né| é|",
                                  "a " * 300, "l1\r\nl1\r\nl1", "\ud800 x", "one two three four five\none two three four five\n"])
def test_base_counts(text):
    assert line_crf.measure(text)[0] == counts(text)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 8):
        model = line_crf.LineCRF(rng.normal(size=(2, line_crf.FEATURES)), rng.normal(size=(2, 2)))
        x = rng.random((n, line_crf.FEATURES))

        def score(path):
            s = sum(x[i] @ model.emit[p] for i, p in enumerate(path))
            return s + sum(model.step[a, b] for a, b in zip(path, path[1:]))
        best = max(score([int(b) for b in np.binary_repr(k, n)]) for k in range(2 ** n))
        assert score(model.viterbi(x)) == pytest.approx(best)


def test_gradient_of_the_field_sums_to_one():
    rng = np.random.default_rng(1)
    model = line_crf.LineCRF(rng.normal(size=(2, line_crf.FEATURES)), rng.normal(size=(2, 2)))
    state, pairs = line_crf._forward_backward(model, rng.random((6, line_crf.FEATURES)))
    assert np.allclose(state.sum(1), 1) and pairs.sum() == pytest.approx(5)


def test_line_labels_against_grades(spark):
    got = QUERIES["op3_line_labels"](spark, SF)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = got.collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = counts(docs[r.doc_id])
        assert {k: r[k] for k in base} == base
        failed = base["n_words"] < 10 or 100 * base["n_repeat_words"] > 20 * base["n_words"]
        assert r.base_failed == failed and not (failed and r.kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [(labels[r.doc_id], r.kept) for r in rows if r.doc_id in labels and not r.base_failed]
    assert np.mean([bool(q) == k for q, k in judged]) > 0.97
    assert np.mean([k for q, k in judged if q]) > 0.99


def test_line_labels_edges(spark):
    model = line_crf.weak_crf([("Fine words stand here. " * 4 + "\nAnd more of them follow.", 1), ("BAD!! *** $$$ ||| BAD!!", 0)])
    df = spark.createDataFrame([(None, None, 1), (1, "", 1), (1, "", 1), (2, "w " * 100_000, 1)], "doc_id long, text string, kept int")
    assert [r.kept for r in line_crf.line_labels(df, model).collect()] == [False] * 4
    assert line_crf.line_labels(df.limit(0), model).count() == 0
    assert df.filter(line_crf.kept_text(model)("text")).count() == 0
    assert line_crf.weak_crf([]).content_share(*line_crf.measure("a b")[1:]) == 1.0


def test_toxicity_held_out(spark):
    got = QUERIES["op4_toxicity"](spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = got.join(labels, "doc_id").filter("held_out").select("score", "predicted", "toxic").collect()
    score, y = np.array([r.score for r in rows]), np.array([r.toxic for r in rows])
    rank = np.argsort(np.argsort(score))
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert auc > 0.97 and np.mean((score >= 0.5) == y) > 0.97
    assert got.count() == spark.read.parquet("/root/testdata/sf0.1/documents.parquet").count()


def test_toxicity_edges(spark):
    model = toxicity.fit([(f"you idiot number {i}", 1) for i in range(20)] + [(f"good day number {i}", 0) for i in range(20)])
    df = spark.createDataFrame([(None, None, 2.0), (1, "", 2.0), (2, "what an IDIOT", 2.0), (2, "good day", 2.0)], "doc_id long, text string, score double")
    got = toxicity.toxicity(df, model).collect()
    assert [r.predicted for r in got[2:]] == [1, 0] and got[0].score == got[1].score and 0 <= got[0].score <= 1
    assert toxicity.toxicity(df.limit(0), model).count() == 0
    assert toxicity.fit([]).scores(["x"]) == [0.5] and toxicity.fit([("a", 1)]).scores(["x"]) == [0.5]


def test_sample_has_no_held_out_rows(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    got = hashing.labelled_sample(docs, labels, F.col("toxic"), {0: 1000, 1: 1000}, 100)
    held = {r.doc_id for r in docs.filter(hashing.held_out()).collect()}
    assert {int(t) for t, _ in got} == set(range(200)) - held and held
    assert sorted(c for _, c in hashing.labelled_sample(docs, labels, F.col("toxic"), {0: 7, 1: 3}, 100)) == [0] * 7 + [1] * 3
    odd = labels.union(labels.limit(3)).unionByName(labels.limit(1).withColumn("toxic", F.lit(None).cast("int")))
    assert {int(t) for t, _ in hashing.labelled_sample(docs, odd, F.col("toxic"), {0: 1000, 1: 1000}, 2)} == {
        i for i in range(100) if i not in held}
    assert hashing.labelled_sample(docs.limit(0), labels, F.col("toxic"), {0: 5, 1: 5}, 100) == []


def test_grades(spark):
    got = QUERIES["op8_ordinal_quality"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.selected == bool(r.quality) for r in rows]) > 0.95
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 for r in rows)
    model = ordinal.fit([(" ".join(["low"] * 5), 0), ("mid mid", 1), ("top top top", 2)] * 5, 3)
    assert model.cuts[0] < model.cuts[1]
    values = [model.tails(t).sum() for t in ("low low", "mid", "top top")]
    assert values == sorted(values)
    df = spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string")
    assert len({r.expected_grade for r in ordinal.grade(df, model, 1).collect()}) == 1
    assert ordinal.grade(df.limit(0), ordinal.fit([], 3), 1).count() == 0


PAGES = {
    "": "", "plain text only": "", "<p>" + "word " * 30: ("word " * 30).strip(),
    "<article><h1>T &amp; U</h1><p>a  b\n c<br>d</p></article><footer>f</footer>": "T & U a b c d",
    "<nav><ul><li><a href=1>x</a></li></ul></nav><article><p>Kept<!-- no --><script>var t='</p>';</script> one.</article>": "Kept one.",
    "<main><p>In main text.</p><aside>no</aside><form>no <label>no</label></form><p>Last &lt;b&gt; &eacute;&#33;</p></main>": "In main text. Last <b> é!",
    "<article><p>Body of it.</p></article><section id='comments'><article class='comment'><p>nice, nice, very nice indeed</p></article></section>": "Body of it.",
    "<article><div class='ad'>buy</div><p>Story here <a href='x'>with link</a>.</p><p hidden>no</p></article>": "Story here with link.",
    "<article><p>cut off in the mid": "cut off in the mid", "<article><p>cut <b": "cut", "<article>a<!-- open": "a",
    "<form id=f><div><article><p>Body in a form.</p><form>mail <input></form></article></div><footer>f</footer></form>": "Body in a form.",
    "<div class='layout has-sidebar'><article><p>Text.</p></article><div class=sidebar>s</div></div>": "Text.",
    "<div class='no-sidebar'><p>" + "word " * 30 + "</p></div>": ("word " * 30).strip(),
    "<div class='page with-ads'><article>Text.</article><div class='ads'>buy</div></div>": "Text.",
    "<div class='post-content social'><p>Long text of a post that is shared.</p></div><div class=social>share</div>": "Long text of a post that is shared.",
    "<article class='search-results-page'><p>Results.</p></article>": "Results.",
    "<div id='side-effects'><article><p>Side effects.</p></article></div>": "Side effects.",
    "<div class='legal-article'><p>The law says this and that about it.</p></div>": "The law says this and that about it.",
    "<article>Area is <math><mi>x</mi></math> here.<noscript>And there.</noscript></article>": "Area is x here. And there.",
    "<noscript>Switch scripts on</noscript><article>A.</article><aside><article>teaser</article></aside>": "A.",
    "<div class=comments><article><p>A reader's words, quite a few of them here.</p></article></div><article>A.</article>": "A.",
    "<article>A.<div class='main-nav'>n</div><div class='article-footer'>f</div><div class='related-post'>r</div></article>": "A.",
    "<article>a<script>never closed": "a", "<ARTICLE><P>Upper</P></ARTICLE>": "Upper", "<article>1 < 2 and 3 > 2</article>": "1 < 2 and 3 > 2",
}


@pytest.mark.parametrize("page", PAGES)
def test_pages(page):
    assert html_blocks.main_text(page) == PAGES[page]


def test_tree_uses_density_and_place():
    tree = html_blocks.default_tree()
    used = {html_blocks.FEATURES[c] for c in tree.column if c >= 0}
    assert {"link_density", "side"} <= used
    table = np.array(html_blocks.TABLE, float)
    assert (tree.predict(table[:, :-1]) == table[:, -1]).mean() > 0.97


def test_extract_frame(spark):
    df = spark.createDataFrame([(None, None, None, "t"), (1, "u", "", "t"), (1, "u", "<article>" + "é " * 60_000, "t")],
                               "page_id long, url string, html string, text string")
    assert [len(r.text) for r in html_blocks.extract(df).collect()] == [0, 0, 119_999]
    assert html_blocks.extract(df.limit(0)).count() == 0


def test_pages_table_against_article_tags(spark):
    import html
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in QUERIES["op9_main_text"](spark, SF).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)
        want = " ".join(html.unescape(re.sub(r"<[^>]*>|<[^>]*$", " ", inner[1])).split()) if inner else ""
        assert r.text == want and r.n_chars == len(want)
