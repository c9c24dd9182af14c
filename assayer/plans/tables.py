"""Queries that compare runs or write report texts."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from assayer import bindings as B
from assayer import dims
from assayer.functions import citations as C
from assayer.functions import overlap as L
from assayer.functions.text import words
from assayer.operators import judging as J
from assayer.operators import setops as O
from assayer.operators import tables as T
from assayer.plans.metrics import POINTS_SQL, PRF_SQL, RELIABILITY_SQL, rounded
from assayer.plans.registry import query
from assayer.plans.sampling import LISTS_SQL
from assayer.plans.text import CITED_SQL, TOKENS_SQL, statutes

NORMAL = "view"
TABLE_SQL = B.ctes("cases", scored="SELECT *, CASE WHEN ground_truth <> 'view' THEN 1 ELSE 0 END AS label FROM cases WHERE score IS NOT NULL") + ", " + PRF_SQL + ", " + \
    RELIABILITY_SQL.replace("b AS (", "b AS (", 1) + ", " + POINTS_SQL.replace("c AS (SELECT h.*", "c AS (SELECT h.*") + """,
tab AS (SELECT m.run_id, m.n, m.accuracy, f.macro_f1, a.auroc, d.five AS min_ndcf_5_1, d.ten AS min_ndcf_10_1, m.mean_turns, m.mean_rcons, m.mean_rlegal, ece.ece
  FROM (SELECT run_id, count(*) AS n, avg(CASE WHEN ground_truth = predicted THEN 1.0 ELSE 0.0 END) AS accuracy, avg(total_turns) AS mean_turns,
               avg(rcons) AS mean_rcons, avg(rlegal) AS mean_rlegal FROM cases GROUP BY run_id) m
  JOIN (SELECT run_id, avg(f1) AS macro_f1 FROM prf WHERE support > 0 GROUP BY run_id) f ON f.run_id = m.run_id
  JOIN (SELECT run_id, sum(pos * (neg_upto - neg / 2.0)) / (any_value(n_pos) * any_value(n_neg)) AS auroc FROM c GROUP BY run_id) a ON a.run_id = m.run_id
  JOIN (SELECT run_id, max(ndcf) FILTER (WHERE c_miss = 5) AS five, max(ndcf) FILTER (WHERE c_miss = 10) AS ten FROM best GROUP BY run_id) d ON d.run_id = m.run_id
  JOIN ece ON ece.run_id = m.run_id)"""


@query("agg_ablation_table", TABLE_SQL + "SELECT run_id, n, " + ", ".join(f"round({m}, 6) AS {m}" for m in T.METRICS) + " FROM tab")
def agg_ablation_table(spark, d):
    return rounded(T.ablation_table(B.cases_table(spark, d), NORMAL), *T.METRICS)


@query("agg_ablation_delta", TABLE_SQL + "SELECT t.run_id, " + ", ".join(
    f"round(coalesce(t.{m}, 0) - coalesce(b.{m}, 0), 6) AS d_{m}" for m in T.METRICS) + " FROM tab t CROSS JOIN (SELECT * FROM tab WHERE run_id = 'r0') b")
def agg_ablation_delta(spark, d):
    t = T.ablation_delta(T.ablation_table(B.cases_table(spark, d), NORMAL), "r0")
    return rounded(t, *[f"d_{m}" for m in T.METRICS])


CELLS = [f"coalesce(printf('%.3f', CAST({c} AS DOUBLE)), '—')" for c in T.METRICS]


@query("snk_table_text", TABLE_SQL + "SELECT 'markdown' AS format, 2 AS part, run_id AS key, concat('| ', run_id, ' | ', CAST(n AS STRING), ' | ', " + ", ' | ', ".join(CELLS) + """, ' |') AS line FROM tab
UNION ALL SELECT 'markdown', 0, '', '| variant | n | acc | macro-F1 | AUROC | NDCF(5:1) | NDCF(10:1) | turns | Rcons | Rlegal_GT | ECE |'
UNION ALL SELECT 'markdown', 1, '', '|---|---|---|---|---|---|---|---|---|---|---|'
UNION ALL SELECT 'latex', 2, run_id, concat(run_id, """ + "".join(f"' & ', coalesce(printf('%.3f', CAST({c} AS DOUBLE)), '—'), " for c in ("accuracy", "macro_f1", "auroc", "min_ndcf_5_1", "mean_rlegal", "ece")) + """' \\\\') FROM tab
UNION ALL SELECT 'latex', 0, '', concat('\\begin{tabular}{lrrrrrr}', chr(10), '\\toprule', chr(10), 'Variant & Acc & F1 & AUROC & NDCF$_{5:1}$ & $R_{legal}^{GT}$ & ECE \\\\', chr(10), '\\midrule')
UNION ALL SELECT 'latex', 3, '', concat('\\bottomrule', chr(10), '\\end{tabular}')""")
def snk_table_text(spark, d):
    t = T.ablation_table(B.cases_table(spark, d), NORMAL)
    return T.markdown_rows(t).withColumn("format", F.lit("markdown")).unionByName(
        T.latex_rows(t).withColumn("format", F.lit("latex")))


# ---- texts -------------------------------------------------------------------------------------
@query("tx_hyde", B.ctes("cases") + ", " + LISTS_SQL + """
SELECT case_id, concat('本案涉及', predicted, '類型犯罪。', props, ' 依據', coalesce(replace(articles, '|', '、'), '相關法條'), '，構成要件包括：',
  coalesce(replace(elements, '|', '、'), '相關犯罪構成要件'), '。依現行刑事法律，行為人須具備上述要件方構成本罪。') AS passage
FROM cases LEFT JOIN lists ON class = predicted""")
def tx_hyde(spark, d):
    c = O.with_class_lists(B.cases(spark, d).select("case_id", "predicted", "props"), dims.class_articles(spark, B.EVENT_ALIAS), "predicted")
    return c.select("case_id", T.expanded_query(c, "props", "predicted").alias("passage"))


@query("tx_fallback_report", B.ctes("report_texts") + ", " + CITED_SQL + """, law AS (
SELECT item_id, string_agg(concat(article_no, '：', repeat(concat('第', article_no, '條內容。'), 30)[1:200]), chr(10) ORDER BY CAST(article_no AS INTEGER)) AS lines FROM (
  SELECT item_id, article_no FROM (SELECT item_id, unnest(nos) AS article_no FROM cited) c JOIN articles USING (article_no)
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY CAST(article_no AS INTEGER)) <= 3) x GROUP BY item_id)
SELECT r.item_id, concat('一、事實認定', chr(10), '本案經影片行為分析，判定犯罪類別為', r.class, '，信心程度', printf('%.2f', (r.item_id % 101) / 100.0), '。', chr(10),
  '行為分析摘要：', r.body, chr(10), chr(10), '二、法律適用', chr(10), '本案可能適用', a.list, '。', chr(10), coalesce(law.lines || chr(10), ''),
  chr(10), '三、初步結論', chr(10), '綜合以上分析，本案涉及', r.class, '類型犯罪之可能性為', CAST(r.item_id % 101 AS STRING), '%。') AS report
FROM report_texts r JOIN (SELECT class, string_agg(article_no, '、' ORDER BY article_no) AS list FROM articles GROUP BY class) a ON a.class = r.class
LEFT JOIN law ON law.item_id = r.item_id""")
def tx_fallback_report(spark, d):
    r = B.report_texts(spark, d).repartition(B.report_tasks(spark, d), "item_id")  # all that follows is by item
    cited = C.join_citations(r.select("item_id", "body"), "item_id", "body", statutes(spark)).withColumn("no", F.col("article_id").cast("int"))
    w = Window.partitionBy("item_id").orderBy("no")
    first = cited.withColumn("rn", F.row_number().over(w)).filter("rn <= 3").groupBy("item_id").agg(F.sort_array(F.collect_list(
        F.struct("no", F.col("article_id").alias("id")))).alias("laws"))
    lists = B.priority_articles(spark).groupBy("class").agg(F.sort_array(F.collect_list("article_no")).alias("articles"))
    none = F.array().cast("array<struct<no:int,id:string>>")

    def quoted(law):
        return F.struct(law["no"].alias("no"), law["id"].alias("id"), F.repeat(F.concat(F.lit("第"), law["id"], F.lit("條內容。")), F.lit(30)).alias("text"))
    j = r.join(first, "item_id", "left").join(F.broadcast(lists), "class").withColumns({
        "laws": F.transform(F.coalesce("laws", none), quoted), "confidence": (F.col("item_id") % 101) / 100})
    return j.select("item_id", T.fallback_report(j, "class", "confidence", "body", "laws").alias("report"))


BLEU_TOKENS = TOKENS_SQL.replace("text", "{0}")


@query("tx_bleu", B.ctes("model_reports") + f""", p AS (
SELECT a.item_id, {TOKENS_SQL.replace('text', 'b.body')} AS c, {TOKENS_SQL.replace('text', 'a.body')} AS r FROM model_reports a JOIN model_reports b
ON a.item_id = b.item_id AND a.model = 'user' AND b.model = 'assistant' WHERE length(a.body) > 0 AND length(b.body) > 0),
g AS (SELECT item_id, n, 'c' AS side, array_to_string(list_slice(c, i, i + n - 1), ' ') AS gram FROM (SELECT item_id, c, n, unnest(range(1, len(c) - n + 2)) AS i FROM p CROSS JOIN (SELECT unnest(range(1, 5)) AS n) x) y
UNION ALL SELECT item_id, n, 'r', array_to_string(list_slice(r, i, i + n - 1), ' ') FROM (SELECT item_id, r, n, unnest(range(1, len(r) - n + 2)) AS i FROM p CROSS JOIN (SELECT unnest(range(1, 5)) AS n) x) y),
k AS (SELECT item_id, n, gram, count(*) FILTER (WHERE side = 'c') AS c, count(*) FILTER (WHERE side = 'r') AS r FROM g GROUP BY ALL),
o AS (SELECT item_id, n, sum(least(c, r)) AS hit, sum(c) AS tot FROM k GROUP BY ALL),
s AS (SELECT item_id, sum(CASE WHEN n = 1 THEN CASE WHEN hit > 0 THEN ln(hit / CAST(tot AS DOUBLE)) ELSE 0 END ELSE ln((hit + 1) / CAST(tot + 1 AS DOUBLE)) END) AS logs, bool_or(n = 1 AND hit = 0) AS none FROM o GROUP BY item_id)
SELECT p.item_id, round(CASE WHEN len(c) = 0 OR coalesce(none, true) THEN 0.0 ELSE CASE WHEN len(c) >= len(r) THEN 1.0 ELSE exp(1 - len(r) / CAST(len(c) AS DOUBLE)) END * exp(logs / 4) END, 6) AS bleu
FROM p LEFT JOIN s ON s.item_id = p.item_id""")
def tx_bleu(spark, d):
    p = J.report_pairs(B.reports_by_model(spark, d), "user", "assistant")
    return rounded(L.bleu4(p, "item_id", "body_b", "body_a"), "bleu")


ROUGE_SQL = f"""WITH p AS (SELECT a.item_id, {TOKENS_SQL.replace('text', 'b.body')} AS c, {TOKENS_SQL.replace('text', 'a.body')} AS r
FROM model_reports a JOIN model_reports b ON a.item_id = b.item_id AND a.model = 'user' AND b.model = 'assistant'
WHERE length(a.body) > 0 AND length(b.body) > 0)"""


@query("tx_rouge_l", B.ctes("model_reports", p=ROUGE_SQL.removeprefix("WITH p AS (")[:-1]) + """
SELECT item_id, round(CASE WHEN n = 0 THEN 0.0 ELSE 2.0 * n / (len(c) + len(r)) END, 6) AS rouge_l FROM (
  SELECT item_id, c, r, CASE WHEN len(c) = 0 OR len(r) = 0 THEN 0 ELSE list_last(list_reduce(
    list_concat([list_transform(r, lambda x: 0)], list_transform(c, lambda x: list_transform(r, lambda y: CASE WHEN x = y THEN 1 ELSE 0 END))),
    lambda row, hit: list_transform(range(1, len(hit) + 1), lambda i: list_max(list_concat([0], list_transform(range(1, i + 1), lambda j:
      greatest(row[j], CASE WHEN hit[j] = 1 THEN 1 + CASE WHEN j > 1 THEN row[j - 1] ELSE 0 END ELSE 0 END))))))) END AS n FROM p) x""")
def tx_rouge_l(spark, d):
    p = J.report_pairs(B.reports_by_model(spark, d), "user", "assistant")
    return rounded(L.rouge_l(p.select("item_id", words(F.col("body_b")).alias("c"), words(F.col("body_a")).alias("r")), "item_id", "c", "r"), "rouge_l")
