"""Queries over the corpus, the question set and the vectors."""

from pyspark.sql import functions as F

from assayer import bindings as B
from assayer.functions import scorers, vectors as V
from assayer.operators import lsh as L
from assayer.operators import postings
from assayer.operators import retrieval as R
from assayer.plans.metrics import rounded
from assayer.plans.registry import query
from assayer.plans.text import TOKENS_SQL
from assayer.session import scratch_path

BM25_SQL = f"""tok AS (SELECT @ AS layer, doc_id, {TOKENS_SQL} AS t FROM corpus),
ds AS (SELECT layer, count(*) AS n_docs, avg(len(t)) AS avg_len FROM tok GROUP BY layer),
post AS (SELECT layer, doc_id, dl, term, count(*) AS tf FROM (SELECT layer, doc_id, len(t) AS dl, unnest(t) AS term FROM tok) x GROUP BY ALL),
dfs AS (SELECT layer, term, count(*) AS df FROM post GROUP BY ALL),
raw AS (SELECT layer, term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw_idf FROM dfs JOIN ds USING (layer)),
idf AS (SELECT layer, term, df, CASE WHEN raw_idf < 0 THEN 0.25 * avg(raw_idf) OVER (PARTITION BY layer) ELSE raw_idf END AS idf FROM raw),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({TOKENS_SQL}) AS term FROM benchmark) x GROUP BY ALL),
bs AS (SELECT p.layer, query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_len))), 9) AS score
  FROM q JOIN post p ON p.term = q.term JOIN idf i ON i.layer = p.layer AND i.term = p.term JOIN ds ON ds.layer = p.layer GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY layer, query_id ORDER BY score DESC, doc_id) AS rank FROM bs QUALIFY rank <= 5)"""
CENTROID_SQL = """dimx AS (SELECT label, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
cent AS (SELECT label, list(m ORDER BY dim) AS c FROM (SELECT label, dim, avg(x) AS m FROM dimx GROUP BY ALL) y GROUP BY label)"""
DENSE_SQL = CENTROID_SQL + """, vecs AS (SELECT @ AS layer, vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings e #),
qv AS (SELECT item_id AS query_id, c FROM benchmark JOIN cent ON label = item_id % 10),
dn AS (SELECT layer, query_id, doc_id, round(list_cosine_similarity(v, c), 9) AS score,
       row_number() OVER (PARTITION BY layer, query_id ORDER BY round(list_cosine_similarity(v, c), 9) DESC, doc_id) AS rank FROM vecs CROSS JOIN qv QUALIFY rank <= 5)"""
RRF_SQL = """f AS (SELECT layer, query_id, doc_id, round(sum(1.0 / (60 + rank)), 12) AS score, min((l, rank)) AS seen FROM (
   SELECT layer, query_id, doc_id, rank, 0 AS l FROM bm WHERE score > 0 UNION ALL SELECT layer, query_id, doc_id, rank, 1 FROM dn) u GROUP BY ALL),
rrf AS (SELECT *, row_number() OVER (PARTITION BY layer, query_id ORDER BY score DESC, seen) AS rank FROM f QUALIFY rank <= 5)"""


def one_layer(df):
    return df.withColumn("layer", F.lit("all"))


def query_vectors(spark, d):
    """Each question stands for the class vector of its number."""
    c = V.centroids(B.table(spark, d, "embeddings"))
    q = B.questions(spark, d).withColumn("label", (F.col("query_id") % 10).cast("int"))
    return q.join(c, "label").select("query_id", "text", "vector")


def doc_vectors(spark, d):
    return B.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


@query("agg_bm25_stats", B.ctes("corpus") + ", " + BM25_SQL.replace("@", "layer") + """
SELECT i.layer, term, df, round(idf, 6) AS idf, n_docs, round(avg_len, 6) AS avg_len FROM idf i JOIN ds USING (layer)""")
def agg_bm25_stats(spark, d):
    stats = R.term_statistics(R.term_index(R.tokenised(B.corpus(spark, d))))
    return rounded(stats, "idf", "avg_len")


@query("jn_postings", B.ctes("corpus") + ", " + BM25_SQL.replace("@", "'all'") + """
SELECT query_id, doc_id, term, tf FROM q JOIN post USING (term)""")
def jn_postings(spark, d):
    asked = R.query_terms(B.questions(spark, d))
    chars = B.table(spark, d, "documents").agg(F.sum(F.length("text"))).first()[0] or 0
    # taken as five characters a token; it only sets the number of tasks
    p = R.postings(one_layer(B.corpus(spark, d)), chars // 5, asked.select("term").distinct())
    return p.join(asked, "term").select("query_id", "doc_id", "term", "tf")


@query("ret_bm25", B.ctes("corpus") + ", " + BM25_SQL.replace("@", "'all'") + """
SELECT query_id, doc_id, rank, round(score, 6) AS score FROM bm WHERE score > 0""")
def ret_bm25(spark, d):
    r = R.bm25(one_layer(B.corpus(spark, d)), B.questions(spark, d))
    return r.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("ret_bm25_stored", B.ctes("corpus") + ", " + BM25_SQL.replace("@", "'all'") + """
SELECT query_id, doc_id, rank, round(score, 6) AS score FROM bm WHERE score > 0""")
def ret_bm25_stored(spark, d):
    path = scratch_path(spark, "bm25")
    postings.build(one_layer(B.corpus(spark, d)), path)
    r = postings.Search(spark, path, B.questions(spark, d)).top()
    return r.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("ret_dense", "WITH " + DENSE_SQL.replace("@", "'all'").replace("#", "") + """
SELECT query_id, doc_id, rank, round(score, 6) AS score FROM dn""")
def ret_dense(spark, d):
    r = R.dense(one_layer(doc_vectors(spark, d)), query_vectors(spark, d))
    return r.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("jn_knn_cross", f"""WITH {CENTROID_SQL}
SELECT CAST(label AS BIGINT) AS query_id, doc_id, rank, round(score, 6) AS score FROM (
  SELECT cent.label, vec_id AS doc_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), c), 9) AS score,
         row_number() OVER (PARTITION BY cent.label ORDER BY round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), c), 9) DESC, vec_id) AS rank
  FROM embeddings CROSS JOIN cent QUALIFY rank <= 10) x""")
def jn_knn_cross(spark, d):
    q = V.centroids(B.table(spark, d, "embeddings")).select(F.col("label").cast("long").alias("query_id"), "vector")
    r = R.dense(one_layer(doc_vectors(spark, d)), q, k=10)
    return r.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("jn_knn_lsh")
def jn_knn_lsh(spark, d):
    """Every vector whose id is divisible by 20 against all vectors; recall against the exact search is tested."""
    v = doc_vectors(spark, d)
    q = v.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    r = L.dense_approx(one_layer(v), q)
    return r.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


FUSED_SQL = B.ctes("corpus") + ", " + BM25_SQL.replace("@", "'all'") + ", " + DENSE_SQL.replace("@", "'all'").replace("#", "") + ", " + RRF_SQL


def fused(spark, d):
    b = R.bm25(one_layer(B.corpus(spark, d)), B.questions(spark, d))
    return R.fuse([b, R.dense(one_layer(doc_vectors(spark, d)), query_vectors(spark, d))], ["layer", "query_id"])


@query("ret_rrf", FUSED_SQL + "SELECT query_id, doc_id, rank, round(score, 9) AS score FROM rrf")
def ret_rrf(spark, d):
    return fused(spark, d).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"))


@query("jn_rrf_outer", FUSED_SQL + """
SELECT query_id, doc_id, b.rank AS bm25_rank, e.rank AS dense_rank,
       round(coalesce(1.0 / (60 + b.rank), 0) + coalesce(1.0 / (60 + e.rank), 0), 9) AS score
FROM (SELECT * FROM bm WHERE score > 0) b FULL JOIN dn e USING (query_id, doc_id)""")
def jn_rrf_outer(spark, d):
    b = R.bm25(one_layer(B.corpus(spark, d)), B.questions(spark, d)).select(
        "query_id", "doc_id", F.col("rank").cast("long").alias("bm25_rank"))
    e = R.dense(one_layer(doc_vectors(spark, d)), query_vectors(spark, d)).select(
        "query_id", "doc_id", F.col("rank").cast("long").alias("dense_rank"))
    gain = sum(F.coalesce(1.0 / (R.RRF_K + F.col(c)), F.lit(0.0)) for c in ("bm25_rank", "dense_rank"))
    return b.join(e, ["query_id", "doc_id"], "full").withColumn("score", F.round(gain, 9))


@query("ret_hybrid", B.ctes("corpus") + ", " + BM25_SQL.replace("@", "layer") + ", " + DENSE_SQL.replace("@", "c.layer").replace(
    "#", "JOIN corpus c ON c.doc_id = e.vec_id") + ", " + RRF_SQL + """
SELECT layer, query_id, doc_id, rank, round(score, 9) AS score FROM rrf""")
def ret_hybrid(spark, d):
    c = B.corpus(spark, d)
    v = doc_vectors(spark, d).join(c.select("doc_id", "layer"), "doc_id")
    r = R.hybrid(c, v, query_vectors(spark, d))
    return r.select("layer", "query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"))


@query("win_topk", B.ctes("corpus") + """
SELECT source, doc_id, rank, score FROM (SELECT source, doc_id, length(text) - 900 AS score,
  row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS rank FROM corpus QUALIFY rank <= 200) x WHERE score > 0""")
def win_topk(spark, d):
    c = B.corpus(spark, d).select("source", "doc_id", (F.length("text") - 900).cast("long").alias("score"))
    r = R.top_k(c, ["source"], "score", "doc_id", 200)
    return r.select("source", "doc_id", F.col("rank").cast("long").alias("rank"), "score")


@query("agg_corpus_counts", B.ctes("corpus") + """
SELECT coalesce(lang, 'ALL') AS lang, coalesce(source, 'ALL') AS source, CAST(grouping(lang) * 2 + grouping(source) AS INTEGER) AS level, count(*) AS n
FROM corpus GROUP BY GROUPING SETS ((lang, source), (lang), (source), ())""")
def agg_corpus_counts(spark, d):
    c = B.corpus(spark, d).groupingSets([["lang", "source"], ["lang"], ["source"], []], "lang", "source").agg(
        F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"))
    return c.select(F.coalesce("lang", F.lit("ALL")).alias("lang"), F.coalesce("source", F.lit("ALL")).alias("source"), "level", "n")


# ---- class scores -----------------------------------------------------------------------------
BIAS = {i: (i - 4) / 40.0 for i in range(10)}
PROB_SQL = "WITH " + CENTROID_SQL + """, lg AS (SELECT vec_id, cent.label AS class, list_cosine_similarity(CAST(embedding AS DOUBLE[]), c) * 10 AS z FROM embeddings CROSS JOIN cent),
sm AS (SELECT vec_id, class, exp(z - max(z) OVER w) / sum(exp(z - zmax)) OVER w AS p, exp(zb - zbmax) / sum(exp(zb - zbmax)) OVER w AS pb
  FROM (SELECT *, max(z) OVER (PARTITION BY vec_id) AS zmax, z - (class - 4) / 40.0 AS zb, max(z - (class - 4) / 40.0) OVER (PARTITION BY vec_id) AS zbmax FROM lg) a
  WINDOW w AS (PARTITION BY vec_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(p, 9) DESC, class) AS r, row_number() OVER (PARTITION BY vec_id ORDER BY round(pb, 9) DESC, class) AS rb FROM sm)"""


def logits(spark, d):
    e = B.table(spark, d, "embeddings")
    return V.class_logits(e.select("vec_id", "embedding"), V.centroids(e))


@query("fn_softmax_bias", PROB_SQL + """
SELECT vec_id, max(CASE WHEN r = 1 THEN class END) AS raw_class, max(CASE WHEN rb = 1 THEN class END) AS class, round(max(CASE WHEN rb = 1 THEN pb END), 6) AS p
FROM rk GROUP BY vec_id""")
def fn_softmax_bias(spark, d):
    bias = F.create_map(*[F.lit(x) for kv in BIAS.items() for x in kv])
    p = V.with_softmax(logits(spark, d), "logits", "raw", scale=10.0)
    p = V.with_softmax(p, "logits", "fixed", bias, scale=10.0)
    r = p.select("vec_id", V.ranked(F.col("raw")).alias("raw"), V.ranked(F.col("fixed")).alias("fixed"))
    return r.select("vec_id", F.col("raw")[0]["class"].alias("raw_class"), F.col("fixed")[0]["class"].alias("class"),
                    F.round(F.col("fixed")[0]["p"], 6).alias("p"))


@query("fn_margin_entropy", PROB_SQL + """
SELECT vec_id, round(max(CASE WHEN r = 1 THEN p END), 6) AS top1, round(max(CASE WHEN r = 2 THEN p END), 6) AS top2,
       round(max(CASE WHEN r = 1 THEN p END) - max(CASE WHEN r = 2 THEN p END), 6) AS margin,
       round(-sum(greatest(p, 1e-12) * ln(greatest(p, 1e-12))), 6) AS entropy,
       string_agg(CAST(class AS STRING), ',' ORDER BY r) FILTER (WHERE r <= 3) AS top3 FROM rk GROUP BY vec_id""")
def fn_margin_entropy(spark, d):
    p = V.with_softmax(logits(spark, d), "logits", "p", scale=10.0).select("vec_id", V.ranked(F.col("p")).alias("r"))
    p = p.withColumns({"p1": F.get("r", F.lit(0))["p"], "p2": F.get("r", F.lit(1))["p"]})
    return p.select(
        "vec_id", F.round("p1", 6).alias("top1"), F.round("p2", 6).alias("top2"), F.round(F.col("p1") - F.col("p2"), 6).alias("margin"),
        F.round(V.entropy(F.col("r")), 6).alias("entropy"),
        F.array_join(F.transform(F.slice("r", 1, 3), lambda x: x["class"].cast("string")), ",").alias("top3"))


@query("fn_geomean_prob", B.ctes("cases") + """
SELECT user_id, round(coalesce(exp(avg(ln(greatest(confidence, 1e-10)))), 0.5), 6) AS confidence FROM cases GROUP BY user_id""")
def fn_geomean_prob(spark, d):
    return B.cases(spark, d).groupBy("user_id").agg(F.round(V.geometric_mean(F.col("confidence")), 6).alias("confidence"))


@query("fn_l2_score", """
SELECT vec_id, round(least(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * 20 / 50, 1), 6) AS score FROM embeddings""")
def fn_l2_score(spark, d):
    long = F.transform("embedding", lambda x: x.cast("double") * 20)
    return B.table(spark, d, "embeddings").select("vec_id", F.round(V.l2_score(long), 6).alias("score"))


@query("fn_vec_concat_check", """
SELECT vec_id, 64 + 70 + 3 AS size, round(2 * list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) + CAST(embedding[1] AS DOUBLE) + CAST(embedding[2] AS DOUBLE)
  + CAST(embedding[3] AS DOUBLE), 6) AS total FROM embeddings""")
def fn_vec_concat_check(spark, d):
    e = B.table(spark, d, "embeddings")
    v = e.select("vec_id", V.concat_modalities([F.col("embedding")] * 3, (64, 70, 3)).alias("v"))
    v = V.right_length(v, "v", (64, 70, 3))
    total = F.aggregate(F.transform("v", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return v.select("vec_id", F.size("v").alias("size"), F.round(total, 6).alias("total"))


@query("fn_normalise_sum", "WITH " + CENTROID_SQL + """
SELECT label, CAST(dim AS INTEGER) AS dim, round(m / sum(m) OVER (PARTITION BY label), 9) AS share FROM (SELECT label, dim, avg(abs(x)) AS m FROM dimx GROUP BY ALL) a""")
def fn_normalise_sum(spark, d):
    long = B.table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    means = long.groupBy("label", "dim").agg(F.avg(F.abs(F.col("x").cast("double"))).alias("mean"))
    return V.share_of_sum(means, ["label"], "mean").select("label", "dim", F.round("share", 9).alias("share"))


@query("fn_match_ratio", B.ctes("cases") + """
SELECT case_id, round((total_turns // 2) / CAST(greatest(total_turns - 1, 1) AS DOUBLE), 6) AS ratio FROM cases""")
def fn_match_ratio(spark, d):
    matched, total = F.floor(F.col("total_turns") / 2), F.col("total_turns") - 1
    return B.cases(spark, d).select("case_id", F.round(matched / F.greatest(total, F.lit(1)), 6).alias("ratio"))


@query("fn_map_filter", """
SELECT event_id, 'k' AS keys, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def fn_map_filter(spark, d):
    e = B.table(spark, d, "events")
    m = F.map_concat(F.from_json("props", "map<string,bigint>"), F.create_map(F.lit("_comment"), F.col("event_id")))
    kept = e.select("event_id", F.map_filter(m, lambda k, _: ~k.startswith("_")).alias("m"))
    return kept.select("event_id", F.array_join(F.map_keys("m"), ",").alias("keys"), F.element_at("m", F.lit("k")).alias("k"))


@query("fn_json_field", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.a.b'), 'none') AS nested FROM events""")
def fn_json_field(spark, d):
    return B.table(spark, d, "events").select(
        "event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"),
        F.coalesce(F.get_json_object("props", "$.a.b"), F.lit("none")).alias("nested"))


@query("udf_scorer", PROB_SQL + """
SELECT r.vec_id AS id, CAST(class AS STRING) AS category, round(z / 10, 6) AS confidence, 'cosine' AS evidence
FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(z / 10, 9) DESC, class) AS n FROM lg) r WHERE n = 1""")
def udf_scorer(spark, d):
    import numpy as np
    e = B.table(spark, d, "embeddings")
    c = V.centroids(e).orderBy("label").toPandas()  # one row per class of the model
    rows = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    s = scorers.run_scorer(rows, "nearest_centroid", labels=[str(x) for x in c["label"]], matrix=np.stack(c["vector"].to_numpy()))
    return rounded(s, "confidence")
