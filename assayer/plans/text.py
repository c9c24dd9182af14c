"""Queries over texts: documents, pages, reports, model answers."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from assayer import bindings as B
from assayer.functions import citations as C
from assayer.functions import text as X
from assayer.operators import judging as J
from assayer.plans.metrics import LABELS, rounded
from assayer.plans.registry import query
from assayer.session import values_frame, values_sql

NORMAL = "view"
TOKENS_SQL = "list_filter(string_split_regex(lower(text), '[^\\p{L}]+'), lambda t: t <> '')"


@query("tx_tokenize", B.ctes("corpus") + f"""
SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS_SQL}) AS term FROM corpus) x GROUP BY ALL""")
def tx_tokenize(spark, d):
    t = B.corpus(spark, d).select("doc_id", F.explode_outer(X.tokens(F.col("text"))).alias("term")).filter(F.col("term").isNotNull())
    return t.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


TERMS = ["that", "with", "tion", "der", "que", "ment", "este", "und", "zzz"]


@query("tx_keywords", B.ctes("corpus") + """
SELECT doc_id, array_to_string(list_sort(list_filter(['that', 'with', 'tion', 'der', 'que', 'ment', 'este', 'und', 'zzz'],
       lambda t: contains(text, t))), ',') AS keywords FROM corpus""")
def tx_keywords(spark, d):
    return B.corpus(spark, d).select("doc_id", F.array_join(X.keywords(F.col("text"), TERMS), ",").alias("keywords"))


PAGE_TYPES = [("title", "<h1>"), ("text", "<p>"), ("footer", "<footer>")]


@query("tx_segment_sections", """
WITH s AS (SELECT page_id, html, string_split(regexp_replace(html, '(<h1>|<p>|<footer>)', chr(1) || '\\1', 'g'), chr(1)) AS l FROM pages),
p AS (SELECT page_id, unnest(range(1, len(l))) AS section_no, unnest(l[2:]) AS piece FROM s),
k AS (SELECT page_id, CAST(section_no AS INTEGER) AS section_no, CASE WHEN starts_with(piece, '<h1>') THEN 'title' WHEN starts_with(piece, '<p>') THEN 'text' ELSE 'footer' END AS type,
  trim(piece, ' ') AS content FROM p WHERE length(trim(piece, ' ')) >= 50)
SELECT * FROM k UNION ALL SELECT page_id, 0, 'full', substr(html, 1, 1000) FROM pages
WHERE length(html) > 0 AND page_id NOT IN (SELECT page_id FROM k)""")
def tx_segment_sections(spark, d):
    p = B.table(spark, d, "pages").select("page_id", "html")
    return X.sections(p, "html", PAGE_TYPES).drop("html")


PAGE_SPANS = {"facts": (["<h2>", "<h1>"], ["</h1>"], 1500), "legal_reasoning": (["<p>"], ["</article>", "</p>"], 1500),
              "verdict": (["<footer>"], ["</footer>"], 500)}


def _between_sql(text, starts, ends, cap):
    after = "CASE " + " ".join(
        f"WHEN regexp_matches({text}, '{p}') THEN regexp_extract({text}, '(?s)^.*?(?:{p})(.*)$', 1)" for p in starts) + " ELSE '' END"
    upto = "CASE " + " ".join(
        f"WHEN regexp_matches(a, '{p}') THEN regexp_extract(a, '(?s)^(.*?)(?:{p})', 1)" for p in ends) + " ELSE substr(a, 1, 2000) END"
    strip = "regexp_replace(regexp_replace(regexp_replace(u, '^\\s+', ''), '\\s+$', ''), '^[：:]\\s*', '')"
    return f"(SELECT substr({strip}, 1, {cap}) FROM (SELECT {upto} AS u FROM (SELECT {after} AS a) q) r)"


@query("tx_between", """
WITH t AS (SELECT page_id, url, regexp_replace(regexp_replace(html, '\\r\\n', chr(10), 'g'), ' {2,}', ' ', 'g') AS t FROM pages),
f AS (SELECT page_id, url, t, """ + ", ".join(_between_sql("t", *v) + f" AS {k}" for k, v in PAGE_SPANS.items()) + """ FROM t)
SELECT page_id, CASE WHEN regexp_extract(t, '(track\\([0-9]+\\))', 1) <> '' THEN regexp_extract(t, '(track\\([0-9]+\\))', 1) ELSE url END AS case_id,
       CASE WHEN regexp_extract(substr(t, 1, 500), '(lang="(?:fr|de)")', 1) <> '' THEN regexp_extract(substr(t, 1, 500), '(lang="(?:fr|de)")', 1) ELSE '未知法院' END AS court,
       CASE WHEN facts = '' AND legal_reasoning = '' THEN substr(substr(t, 1, length(t) // 2), 1, 1500) ELSE facts END AS facts,
       CASE WHEN facts = '' AND legal_reasoning = '' THEN substr(substr(t, length(t) // 2 + 1), 1, 1500) ELSE legal_reasoning END AS legal_reasoning,
       verdict, length(substr(t, 1, 3000)) AS content_chars FROM f""")
def tx_between(spark, d):
    p = B.table(spark, d, "pages").select("page_id", "url", "html")
    j = X.judgment_fields(p, "html", "url", PAGE_SPANS, "(track\\([0-9]+\\))", '(lang="(?:fr|de)")')
    return j.select("page_id", "case_id", "court", "facts", "legal_reasoning", "verdict",
                    F.length("content").cast("long").alias("content_chars"))


# a blank line after every line, and a closing paragraph that cites a statute
CITING_SQL = """SELECT doc_id, concat(replace(text, chr(10), chr(10) || chr(10)), chr(10), chr(10), chr(10), '依刑法第',
  CAST(doc_id % 340 AS STRING), '條', repeat('規定', 40)) AS text FROM documents"""


def citing(spark, d):
    t = B.table(spark, d, "documents")
    return t.select("doc_id", F.concat(
        F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")), F.lit("\n\n\n依刑法第"), (F.col("doc_id") % 340).cast("string"),
        F.lit("條"), F.repeat(F.lit("規定"), 40)).alias("text"))


@query("tx_paragraphs", f"""
WITH c AS ({CITING_SQL}), p AS (SELECT doc_id, text, string_split_regex(text, '\\n{{2,}}') AS l FROM c),
e AS (SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS paragraph_idx, regexp_replace(regexp_replace(unnest(l), '^\\s+', ''), '\\s+$', '') AS paragraph,
      regexp_extract_all(text, '刑法第([0-9]+(?:-[0-9]+)?)條', 1) AS whole FROM p)
SELECT doc_id, paragraph_idx, paragraph, array_to_string(list_distinct(CASE WHEN len(regexp_extract_all(paragraph, '刑法第([0-9]+(?:-[0-9]+)?)條', 1)) > 0
       THEN regexp_extract_all(paragraph, '刑法第([0-9]+(?:-[0-9]+)?)條', 1) ELSE whole END), ',') AS articles
FROM e WHERE length(paragraph) >= 80""")
def tx_paragraphs(spark, d):
    p = X.paragraphs(citing(spark, d), "text")
    return p.select("doc_id", "paragraph_idx", "paragraph", F.array_join("articles", ",").alias("articles"))


@query("tx_chunks", B.ctes("corpus") + """, c AS (
SELECT doc_id, text, unnest(range(CAST(greatest(ceil((length(text) - 64) / 448.0), 1) AS BIGINT))) AS chunk_no FROM corpus)
SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, substr(text, chunk_no * 448 + 1, 512) AS chunk FROM c""")
def tx_chunks(spark, d):
    return X.chunks(B.corpus(spark, d).select("doc_id", "text"), "text").drop("text")


# ---- statutes in reports -------------------------------------------------------------------
CN = "〇一二三四五六七八九"
NUMERAL_SQL = f"""(WITH z AS (SELECT '{CN}' AS c, 100 + n AS v)
 SELECT concat(substr(c, v // 100 + 1, 1), '百', CASE WHEN v % 100 = 0 THEN '' WHEN v % 100 < 10 THEN concat('〇', substr(c, v % 10 + 1, 1))
  ELSE concat(substr(c, v // 10 % 10 + 1, 1), '十', CASE WHEN v % 10 = 0 THEN '' ELSE substr(c, v % 10 + 1, 1) END) END) FROM z)"""


def chinese_numeral(v):
    """Three-digit number as a Chinese numeral (input of the check)."""
    digit = lambda n: F.substring(F.lit(CN), n.cast("int") + 1, F.lit(1))
    tens = F.concat(digit(F.floor(v / 10) % 10), F.lit("十"), F.when(v % 10 == 0, "").otherwise(digit(v % 10)))
    tail = F.when(v % 100 == 0, "").when(v % 100 < 10, F.concat(F.lit("〇"), digit(v % 10))).otherwise(tens)
    return F.concat(digit(F.floor(v / 100)), F.lit("百"), tail)


@query("tx_cited_articles", B.ctes("report_texts") + """
SELECT item_id, array_to_string(list_sort(list_distinct(list_append(regexp_extract_all(body, '第\\s*([0-9]+)\\s*條', 1),
       CAST(100 + item_id % 900 AS STRING)))), ',') AS cited FROM report_texts""")
def tx_cited_articles(spark, d):
    r = B.report_texts(spark, d)
    body = F.concat("body", F.lit("，第"), chinese_numeral(100 + F.col("item_id") % 900), F.lit("條"))
    return r.select("item_id", F.array_join(F.sort_array(C.cited_articles(body)), ",").alias("cited"))


ARTICLES_SQL = "articles AS (" + values_sql(B.PRIORITY_ARTICLES, ["class", "article_no"]) + ")"
CITED_SQL = ARTICLES_SQL + """, cited AS (
SELECT item_id, class, body, list_distinct(regexp_extract_all(body, '第\\s*([0-9]+)\\s*條', 1)) AS nos,
       regexp_extract_all(body, '第\\s*([0-9]+)\\s*條', 1) AS seq FROM report_texts)"""


def statutes(spark):
    return B.priority_articles(spark).select(F.col("article_no").alias("article_id"), "class")


def expected(spark):
    """Articles and elements per class, one row each."""
    a = B.priority_articles(spark).groupBy("class").agg(F.sort_array(F.collect_list("article_no")).alias("article_nos"))
    e = B.priority_elements(spark).groupBy("class").agg(F.sort_array(F.collect_list("element")).alias("elements"))
    return a.join(e, "class")


@query("jn_citations", B.ctes("report_texts") + ", " + CITED_SQL + """
SELECT item_id, article_no AS article_id, a.class AS class FROM (SELECT item_id, unnest(nos) AS article_no FROM cited) c JOIN articles a USING (article_no)""")
def jn_citations(spark, d):
    return C.join_citations(B.report_texts(spark, d).select("item_id", "body"), "item_id", "body", statutes(spark)).select(
        "item_id", "article_id", "class")


@query("tx_infer_class", B.ctes("report_texts") + ", " + CITED_SQL + """
SELECT r.item_id, coalesce(x.class, 'Other') AS class FROM report_texts r LEFT JOIN (
  SELECT item_id, min_by(a.class, pos) AS class FROM (SELECT item_id, unnest(seq) AS article_no, unnest(range(len(seq))) AS pos FROM cited) c
  JOIN articles a USING (article_no) GROUP BY item_id) x ON x.item_id = r.item_id""")
def tx_infer_class(spark, d):
    r = B.report_texts(spark, d).drop("class")
    return C.infer_class(r, "item_id", X.article_numbers(F.col("body")), statutes(spark))


OVERLAP_SQL = """own AS (SELECT class, list_sort(list(article_no)) AS own FROM articles GROUP BY class),
everything AS (SELECT list(DISTINCT article_no) AS every FROM articles),
hits AS (SELECT c.item_id, c.class, body, nos, own, list_filter(nos, lambda x: list_contains(own, x)) AS hit,
         list_filter(nos, lambda x: list_contains(every, x) AND NOT list_contains(own, x)) AS stray
  FROM cited c JOIN own ON own.class = c.class CROSS JOIN everything)"""


@query("set_article_diff", B.ctes("report_texts") + ", " + CITED_SQL + ", " + OVERLAP_SQL + """
SELECT item_id, array_to_string(list_sort(hit), ',') AS hits, array_to_string(list_sort(stray), ',') AS strays FROM hits""")
def set_article_diff(spark, d):
    r = C.with_class_articles(B.report_texts(spark, d), expected(spark), "class").withColumns(C.article_overlap(F.col("body")))
    return r.select("item_id", *[F.array_join(F.sort_array(c), ",").alias(c) for c in ("hits", "strays")])


def _score_sql(extra, column, where=""):
    return CITED_SQL.replace("SELECT item_id, class, body", f"SELECT item_id, {column} AS class, body") + ", " + OVERLAP_SQL + """,
el AS (""" + values_sql(B.PRIORITY_ELEMENTS, ["class", "element"]) + """),
cov AS (SELECT h.item_id, count(*) AS n, sum(CASE WHEN len(list_filter(range(1, len(string_split(body, element))),
     lambda i: NOT regexp_matches(element || substr(body, CAST(list_sum(list_transform(list_slice(string_split(body, element), 1, i), lambda p: length(p))) + i * length(element) + 1 AS BIGINT), 160),
     '不該當|不構成|不成立|未該當|未構成|無法滿足|無法成立|未具備|欠缺|不具有|不具備'))) > 0 THEN 1 ELSE 0 END) AS c
   FROM hits h JOIN el ON el.class = h.class GROUP BY h.item_id),
sc AS (SELECT h.item_id, h.class, CASE WHEN len(hit) = 0 THEN 0.0 ELSE
     2 * (len(hit) / CAST(len(nos) AS DOUBLE)) * (len(hit) / CAST(len(own) AS DOUBLE)) / (len(hit) / CAST(len(nos) AS DOUBLE) + len(hit) / CAST(len(own) AS DOUBLE)) END AS tier1,
     cov.c / CAST(cov.n AS DOUBLE) * CASE WHEN regexp_matches(body, '(不構成|不成立|不該當|無法適用)本[罪案件]|本[罪案件](不構成|不成立|不該當|無法適用)') THEN 0.3 ELSE 1 END AS tier2,
     greatest(0, 1 - len(stray) / 3.0) AS tier3 FROM hits h JOIN cov ON cov.item_id = h.item_id)""" + extra


@query("tx_legal_score", B.ctes("report_texts") + ", " + _score_sql("""
SELECT item_id, round(CAST(tier1 AS DOUBLE), 6) AS tier1, round(CAST(tier2 AS DOUBLE), 6) AS tier2, round(CAST(tier3 AS DOUBLE), 6) AS tier3,
       round(CAST(0.4 * tier1 + 0.3 * tier2 + 0.3 * tier3 AS DOUBLE), 3) AS rlegal FROM sc""", "class"))
def tx_legal_score(spark, d):
    s = C.legal_score(B.report_texts(spark, d), "body", expected(spark), "class")
    return rounded(s.select("item_id", "tier1", "tier2", "tier3", "rlegal"), "tier1", "tier2", "tier3")


TRUE_SQL = "CASE class WHEN '1-URGENT' THEN '2-HIGH' WHEN '2-HIGH' THEN '3-MEDIUM' WHEN '3-MEDIUM' THEN '4-NOT SPECIFIED' WHEN '4-NOT SPECIFIED' THEN '5-LOW' ELSE '1-URGENT' END"


@query("tx_legal_score_gt", B.ctes("report_texts") + ", " + _score_sql("""
SELECT item_id, CASE WHEN class = '5-LOW' THEN 0.0 ELSE round(CAST(0.4 * tier1 + 0.3 * tier2 + 0.3 * tier3 AS DOUBLE), 3) END AS rlegal_gt FROM sc""", TRUE_SQL))
def tx_legal_score_gt(spark, d):
    # the true class is the next priority; the last one stands for a class without statutes
    after = dict(zip(B.PRIORITIES, B.PRIORITIES[1:] + B.PRIORITIES[:1]))
    table = F.create_map(*[F.lit(x) for kv in after.items() for x in kv])
    r = B.report_texts(spark, d).withColumn("true_class", table[F.col("class")])
    s = C.legal_score(r, "body", expected(spark), "true_class")
    return s.select("item_id", F.when(F.col("true_class") == "5-LOW", F.lit(0.0)).otherwise(F.col("rlegal")).alias("rlegal_gt"))


@query("agg_rubric_dynmax", B.ctes("report_texts") + ", " + CITED_SQL + """
SELECT r.item_id, coalesce(m, 4) AS q2_max FROM report_texts r LEFT JOIN (
  SELECT item_id, max(CAST(CAST(article_no AS INTEGER) % 8 * 2 + 1 AS INTEGER)) AS m FROM (SELECT item_id, unnest(nos) AS article_no FROM cited) c
  JOIN articles USING (article_no) GROUP BY item_id) x ON x.item_id = r.item_id""")
def agg_rubric_dynmax(spark, d):
    n = F.col("article_id").cast("int") % 8 * 2 + 1
    s = statutes(spark).withColumn("elements", F.transform(F.sequence(F.lit(1), n), lambda i: i.cast("string")))
    return C.dynamic_max(B.report_texts(spark, d), "item_id", "body", s)


# ---- answers of models -------------------------------------------------------------------------
ANSWER_SQL = """a AS (SELECT case_id, CASE case_id % 4 WHEN 0 THEN concat('Thoughts. CATEGORY: ', upper(predicted), chr(10), 'REASON: motion seen')
   WHEN 1 THEN concat('I believe this is ', predicted, ' or ', ground_truth, '.') WHEN 2 THEN concat('Category:', 'unknown ', predicted) ELSE 'cannot say' END AS answer,
   CASE case_id % 5 WHEN 0 THEN '"Yes", people fight' WHEN 1 THEN 'no. yes yes' WHEN 2 THEN 'maybe yes, yes, or no' WHEN 3 THEN 'yesterday no yes' ELSE '' END AS first FROM cases)"""
LABEL_SQL = """CASE WHEN case_id % 4 = 0 THEN predicted WHEN case_id % 4 = 1 THEN (SELECT l FROM (VALUES (0, 'view'), (1, 'signup'), (2, 'click'), (3, 'purchase'), (4, 'error')) v(i, l)
   WHERE l IN (predicted, ground_truth) ORDER BY i LIMIT 1) WHEN case_id % 4 = 2 THEN predicted ELSE 'view' END"""
YES_SQL = "case_id % 5 IN (0, 2)"


def answers(spark, d):
    i = F.col("case_id")
    answer = (F.when(i % 4 == 0, F.concat(F.lit("Thoughts. CATEGORY: "), F.upper("predicted"), F.lit("\nREASON: motion seen")))
              .when(i % 4 == 1, F.concat(F.lit("I believe this is "), "predicted", F.lit(" or "), "ground_truth", F.lit(".")))
              .when(i % 4 == 2, F.concat(F.lit("Category:unknown "), "predicted")).otherwise("cannot say"))
    first = (F.when(i % 5 == 0, '"Yes", people fight').when(i % 5 == 1, "no. yes yes").when(i % 5 == 2, "maybe yes, yes, or no")
             .when(i % 5 == 3, "yesterday no yes").otherwise(""))
    return B.cases(spark, d).select("case_id", answer.alias("answer"), first.alias("first"))


@query("tx_parse_label", B.ctes("cases") + f"SELECT case_id, {LABEL_SQL} AS label FROM cases")
def tx_parse_label(spark, d):
    return answers(spark, d).select("case_id", X.label(F.col("answer"), LABELS, NORMAL).alias("label"))


@query("tx_parse_yesno", B.ctes("cases") + f"SELECT case_id, {YES_SQL} AS yes FROM cases")
def tx_parse_yesno(spark, d):
    return answers(spark, d).select("case_id", X.yes_no(F.col("first")).alias("yes"))


@query("tx_two_stage", B.ctes("cases") + f"""
SELECT case_id, CASE WHEN NOT ({YES_SQL}) THEN 'view' WHEN case_id % 4 = 3 THEN 'error'
  WHEN case_id % 4 = 1 THEN coalesce((SELECT l FROM (VALUES (1, 'signup'), (2, 'click'), (3, 'purchase'), (4, 'error')) v(i, l)
       WHERE l IN (predicted, ground_truth) ORDER BY i LIMIT 1), 'error')
  WHEN predicted = 'view' THEN 'error' ELSE predicted END AS label FROM cases""")
def tx_two_stage(spark, d):
    return answers(spark, d).select("case_id", X.two_stage(F.col("first"), F.col("answer"), LABELS, "error", NORMAL).alias("label"))


@query("tx_strip_think", B.ctes("cases") + """
SELECT case_id, concat('ELEMENTS_MATCHED: ', CAST(total_turns AS STRING), '/', CAST(case_id % 5 AS STRING), chr(10), 'REASON: ', predicted) AS answer,
       CAST(total_turns AS INTEGER) AS matched, CAST(case_id % 5 AS INTEGER) AS total,
       round(total_turns / CAST(greatest(case_id % 5, 1) AS DOUBLE), 6) AS ratio, predicted AS reason FROM cases""")
def tx_strip_think(spark, d):
    c = B.cases(spark, d)
    raw = F.concat(F.lit("<think>a\nb</think> ELEMENTS_MATCHED: "), F.col("total_turns").cast("string"), F.lit("/"),
                   (F.col("case_id") % 5).cast("string"), F.lit("\nREASON: "), "predicted", F.lit("<think>x</think>"))
    a = c.select("case_id", X.without_thoughts(raw).alias("answer"))
    return rounded(a.withColumns(X.matched_ratio(F.col("answer"))), "ratio")


@query("tx_json_salvage", B.ctes("judge_scores") + """
SELECT item_id, model, judge, q_key, CAST(CASE WHEN item_id % 4 = 3 OR q_key = 'q5' THEN (max_score + 1) // 2
       WHEN q_key = 'q6' THEN max_score ELSE raw END AS BIGINT) AS score FROM judge_scores""")
def tx_json_salvage(spark, d):
    # each sheet as a model would answer it: plain, fenced, inside prose, broken; q5 is no number, q6 is too large
    j = B.judge(spark, d)
    value = (F.when(F.col("q_key") == "q5", "n/a").when(F.col("q_key") == "q6", (F.col("max_score") + 2).cast("string"))
             .otherwise(F.concat(F.col("raw").cast("string"), F.lit(".4"))))
    sheets = j.groupBy("item_id", "model", "judge").agg(
        F.map_from_entries(F.collect_list(F.struct("q_key", value))).alias("m"),
        F.map_from_entries(F.collect_list(F.struct("q_key", "max_score"))).alias("tops"))
    text = F.to_json("m")
    k = F.col("item_id") % 4
    response = (F.when(k == 0, text).when(k == 1, F.concat(F.lit("Here:\n```json\n"), text, F.lit("\n```\nDone.")))
                .when(k == 2, F.concat(F.lit("My view is "), text, F.lit(" as stated."))).otherwise(F.substring(text, F.lit(1), F.length(text) - 1)))
    parsed = sheets.select("item_id", "model", "judge", "tops", X.salvage_json(response).alias("p"))
    q = parsed.select("item_id", "model", "judge", "p", F.explode("tops").alias("q_key", "top"))
    return q.select("item_id", "model", "judge", "q_key",
                    X.clamped_score(F.col("p"), F.col("q_key"), F.col("top")).cast("long").alias("score"))


@query("tx_judge_key", B.ctes("judge_scores") + """, m AS (
SELECT 'several' AS panel, concat(model, '-', judge, '-2024') AS judge_model, model AS short, concat(model, '_', judge) AS judge_key FROM judge_scores
UNION SELECT 'single', concat(model, '-2024'), model, model FROM judge_scores) SELECT DISTINCT * FROM m""")
def tx_judge_key(spark, d):
    j = B.judge(spark, d)
    several = X.judge_key(j.select(F.concat_ws("-", "model", "judge", F.lit("2024")).alias("judge_model")))
    single = X.judge_key(j.select(F.concat_ws("-", "model", F.lit("2024")).alias("judge_model")))
    return several.withColumn("panel", F.lit("several")).unionByName(single.withColumn("panel", F.lit("single")))
