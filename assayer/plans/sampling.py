"""Queries over samples, snippets, frames and id sets."""

from pyspark.sql import functions as F

from assayer import bindings as B
from assayer import dims
from assayer.operators import sampling as S
from assayer.operators import setops as O
from assayer.operators import prefix
from assayer.plans.metrics import rounded
from assayer.plans.registry import query
from assayer.session import values_sql

NORMAL = "view"
TOTAL, FPS = B.TOTAL_FRAMES, B.FPS


@query("win_cap_per_class", B.ctes("cases") + """, a AS (
SELECT case_id, ground_truth FROM cases WHERE ground_truth <> 'view' QUALIFY row_number() OVER (PARTITION BY ground_truth ORDER BY case_id) <= 23)
SELECT * FROM (SELECT * FROM a ORDER BY case_id LIMIT 90) x UNION ALL
SELECT case_id, ground_truth FROM cases WHERE ground_truth = 'view' QUALIFY row_number() OVER (ORDER BY case_id) <= 10""")
def win_cap_per_class(spark, d):
    c = B.cases(spark, d).select("case_id", "ground_truth")
    return S.cap_per_class(c, "ground_truth", "case_id", 90, 4, NORMAL, 10).select("case_id", "ground_truth")


@query("win_backfill", B.ctes("cases") + """, o AS (
SELECT ground_truth, user_id, min((run_id, case_id)) AS b FROM cases GROUP BY ALL)
SELECT ground_truth, user_id, b[1] AS run_id, b[2] AS case_id FROM o QUALIFY row_number() OVER (PARTITION BY ground_truth ORDER BY b) <= 60""")
def win_backfill(spark, d):
    return S.backfill(B.cases(spark, d), "ground_truth", "user_id", "run_id", "case_id", 60)


@query("win_stratified", B.ctes("cases") + """
SELECT ground_truth, case_id FROM cases WHERE case_id IN (SELECT l_orderkey FROM lineitem)
QUALIFY row_number() OVER (PARTITION BY ground_truth ORDER BY md5(concat('42:', CAST(case_id AS STRING))), case_id) <= 20""")
def win_stratified(spark, d):
    second = B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"))
    return S.stratified(B.cases(spark, d).select("ground_truth", "case_id"), "ground_truth", "case_id", 20, common=second)


@query("win_threshold_suggest", B.ctes("cases") + """, s AS (
SELECT run_id, confidence, count(*) OVER (PARTITION BY run_id) AS n, row_number() OVER w AS i, sum(CASE WHEN ground_truth = predicted THEN 1 ELSE 0 END) OVER w AS hits
FROM cases WINDOW w AS (PARTITION BY run_id ORDER BY confidence DESC, case_id ROWS UNBOUNDED PRECEDING))
SELECT run_id, any_value(n) AS n, min_by(confidence, i) FILTER (WHERE hits / CAST(i AS DOUBLE) >= 0.7 AND i >= greatest(3, n // 4)) AS hard,
       min_by(confidence, i) FILTER (WHERE hits / CAST(i AS DOUBLE) >= 0.6 AND i >= greatest(3, n // 3)) AS soft FROM s GROUP BY run_id""")
def win_threshold_suggest(spark, d):
    return S.suggest_thresholds(B.cases(spark, d), ["run_id"], "case_id", hard=0.7, soft=0.6)


@query("win_first_crossing", B.ctes("snippets") + """
SELECT video_id, min(idx) FILTER (WHERE score > 0.5) AS first_idx, min(idx) FILTER (WHERE score > 0.5) * 30 AS frame FROM snippets GROUP BY video_id""")
def win_first_crossing(spark, d):
    return S.first_crossing(B.snippets(spark, d))


@query("win_group_advantage", B.ctes("cases") + """
SELECT case_id, round((rcons - avg(rcons) OVER w) / (stddev_pop(rcons) OVER w + 1e-8), 6) AS advantage FROM cases WINDOW w AS (PARTITION BY user_id)""")
def win_group_advantage(spark, d):
    a = S.group_advantage(B.cases(spark, d).select("case_id", "user_id", "rcons"), "user_id", "rcons")
    return rounded(a.select("case_id", "advantage"), "advantage")


@query("win_transitions", B.ctes("snippets") + """
SELECT * FROM (SELECT video_id, idx, round(score, 6) AS state, CAST(CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS INTEGER) AS action,
  round(CASE WHEN score > 0.5 THEN score ELSE 1 - score END, 6) AS reward, round(lead(score) OVER w, 6) AS next_state,
  idx + 1 = max(idx) OVER (PARTITION BY video_id) AS done FROM snippets WINDOW w AS (PARTITION BY video_id ORDER BY idx)) x WHERE next_state IS NOT NULL""")
def win_transitions(spark, d):
    return rounded(S.transitions(B.snippets(spark, d)), "state", "reward", "next_state")


@query("agg_env_summary", B.ctes("snippets") + """, l AS (SELECT *, avg(illumination) OVER (PARTITION BY video_id) AS light FROM snippets),
c AS (SELECT *, least(greatest(0.6 * light + 0.4 * (1 - occlusion), 0), 1) AS cred FROM l)
SELECT video_id, round(avg(CASE WHEN score > 0.5 THEN 1.0 ELSE 0.0 END), 6) AS anomaly_ratio, round(any_value(light), 6) AS illumination,
       round(avg(cred), 6) AS credibility, round(least(greatest(avg(score) - avg(score * cred), 0), 1), 6) AS contribution FROM c GROUP BY video_id""")
def agg_env_summary(spark, d):
    return rounded(S.env_summary(B.snippets(spark, d)), "anomaly_ratio", "illumination", "credibility", "contribution")


NUMBERED_SQL = "nr AS (SELECT video_id, seg_idx, row_number() OVER (PARTITION BY video_id ORDER BY seg_idx) - 1 AS pos, count(*) OVER (PARTITION BY video_id) AS n FROM intervals)"


def numbered(spark, d):
    i = B.intervals(spark, d).select("video_id", "seg_idx")
    r = prefix.row_numbers(i, ["video_id"], [prefix.block_of("seg_idx")], ["seg_idx"], "pos")
    return r.withColumn("pos", F.col("pos") - 1)


@query("win_snippets", B.ctes("intervals") + ", " + NUMBERED_SQL + """, v AS (SELECT DISTINCT video_id, n, greatest(1, n // 32) AS size FROM nr WHERE n >= 2),
b AS (SELECT video_id, n, size, snippet, snippet * size AS start FROM v CROSS JOIN (SELECT unnest(range(32)) AS snippet) s WHERE snippet * size < n),
h AS (SELECT *, least(start + size, n) - start AS have, greatest(least(start + size, n) - start, 4) AS padded FROM b)
SELECT h.video_id, CAST(snippet AS INTEGER) AS snippet, CAST(slot AS INTEGER) AS slot, nr.seg_idx FROM h CROSS JOIN (SELECT unnest(range(4)) AS slot) s
JOIN nr ON nr.video_id = h.video_id AND nr.pos = start + least(slot * (padded - 1) // 3, have - 1)""")
def win_snippets(spark, d):
    rows = numbered(spark, d)
    return S.snippet_positions(rows).join(rows, ["video_id", "pos"]).select("video_id", "snippet", "slot", "seg_idx")


@query("win_uniform_pick", B.ctes("intervals") + ", " + NUMBERED_SQL + """, v AS (SELECT DISTINCT video_id, n FROM nr)
SELECT 'floor' AS kind, v.video_id, nr.pos, nr.seg_idx FROM v CROSS JOIN (SELECT unnest(range(8)) AS i) s JOIN nr ON nr.video_id = v.video_id AND nr.pos = i * v.n // 8
UNION ALL SELECT DISTINCT 'round', v.video_id, nr.pos, nr.seg_idx FROM v CROSS JOIN (SELECT unnest(range(8)) AS i) s JOIN nr ON nr.video_id = v.video_id
 AND i < least(8, v.n) AND nr.pos = CAST(round_even(i * (v.n - 1) / CAST(greatest(least(8, v.n) - 1, 1) AS DOUBLE), 0) AS BIGINT)""")
def win_uniform_pick(spark, d):
    rows = numbered(spark, d)
    totals = rows.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    a = S.uniform_positions(totals, "n", 8).join(rows, ["video_id", "pos"]).withColumn("kind", F.lit("floor"))
    b = S.spread_positions(totals, "n", 8).join(rows, ["video_id", "pos"]).withColumn("kind", F.lit("round"))
    cols = ["kind", "video_id", "pos", "seg_idx"]
    return a.select(cols).unionByName(b.select(cols))


COVER_SQL = f"""span AS (SELECT video_id, greatest(CAST(floor(start_s * 25) AS BIGINT), 0) AS lo, least(CAST(floor(end_s * 25) AS BIGINT) + 1, {TOTAL}) AS hi FROM intervals),
isl AS (SELECT video_id, lo, hi, CASE WHEN lo <= max(hi) OVER (PARTITION BY video_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM span WHERE lo < hi),
grp AS (SELECT *, sum(new) OVER (PARTITION BY video_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM isl),
cov AS (SELECT video_id, min(lo) AS start_frame, max(hi) - 1 AS end_frame FROM grp GROUP BY video_id, g),
frm AS (SELECT video_id, unnest(range(start_frame, end_frame + 1)) AS frame FROM cov),
num AS (SELECT video_id, frame, row_number() OVER (PARTITION BY video_id ORDER BY frame) - 1 AS j, count(*) OVER (PARTITION BY video_id) AS c FROM frm)"""


@query("jn_interval_frames", B.ctes("intervals") + ", " + COVER_SQL + "SELECT video_id, start_frame, end_frame FROM cov")
def jn_interval_frames(spark, d):
    return S.cover(B.intervals(spark, d), TOTAL, FPS)


@query("win_guided_pick", B.ctes("intervals") + ", " + COVER_SQL + f""", p AS (
SELECT video_id, frame FROM num, (SELECT unnest(range(11)) AS i) s WHERE j = i * c // 11 AND c >= 11
UNION SELECT video_id, frame FROM num WHERE c < 11
UNION SELECT v.video_id, i * {TOTAL} // 5 FROM (SELECT DISTINCT video_id FROM intervals) v, (SELECT unnest(range(5)) AS i) s)
SELECT video_id, frame FROM p QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY frame) <= 16""")
def win_guided_pick(spark, d):
    i = B.intervals(spark, d)
    return S.guided_picks(i, i, TOTAL, FPS, 16)


@query("win_mixed_pick", B.ctes("intervals", "snippets") + ", " + COVER_SQL + f""", n AS (SELECT video_id, count(*) AS n FROM snippets GROUP BY video_id),
t AS (SELECT video_id, idx FROM snippets QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY score DESC, idx) <= 4), p AS (
SELECT t.video_id, least(idx * greatest(1, {TOTAL} // n) + greatest(1, {TOTAL} // n) // 2, {TOTAL} - 1) AS frame FROM t JOIN n ON n.video_id = t.video_id
UNION SELECT video_id, frame FROM num, (SELECT unnest(range(2)) AS i) s WHERE j = i * c // 2
UNION SELECT video_id, i * {TOTAL} // 2 FROM n, (SELECT unnest(range(2)) AS i) s)
SELECT video_id, frame FROM p QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY frame) <= 8""")
def win_mixed_pick(spark, d):
    return S.mixed_picks(B.snippets(spark, d), B.intervals(spark, d), TOTAL, FPS, 8)


@query("win_keyframes", B.ctes("snippets") + f""", n AS (SELECT video_id, count(*) AS n FROM snippets GROUP BY video_id),
t AS (SELECT video_id, idx FROM snippets QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY score DESC, idx) <= 3), p AS (
SELECT t.video_id, idx * ({TOTAL} // n) AS frame, 0 AS p FROM t JOIN n ON n.video_id = t.video_id
UNION ALL SELECT video_id, i * {TOTAL // 5}, 1 FROM n, (SELECT unnest(range(5)) AS i) s),
o AS (SELECT video_id, frame, min(p) AS p FROM p GROUP BY ALL)
SELECT video_id, frame FROM o QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY p, frame) <= 8""")
def win_keyframes(spark, d):
    return S.key_frames(B.snippets(spark, d), TOTAL)


# ---- sets -----------------------------------------------------------------------------------
@query("jn_anti_exclude", B.ctes("cases") + """
SELECT case_id, user_id FROM cases WHERE user_id NOT IN (SELECT user_id FROM cases WHERE confidence > 0.99)""")
def jn_anti_exclude(spark, d):
    c = B.cases(spark, d).select("case_id", "user_id", "confidence")
    return O.exclude(c, c.filter("confidence > 0.99"), "user_id").select("case_id", "user_id")


LISTS = [(n, "|".join(dims.ELEMENTS.get(t, [])), "|".join(dims.ARTICLES.get(t, []))) for n, t in B.EVENT_ALIAS.items() if n != NORMAL]
LISTS_SQL = "lists AS (" + values_sql(LISTS, ["class", "elements", "articles"]) + ")"


@query("jn_dim_lookup", B.ctes("cases") + ", " + LISTS_SQL + """
SELECT case_id, predicted, coalesce(elements, '') AS elements, coalesce(articles, '') AS articles FROM cases LEFT JOIN lists ON class = predicted""")
def jn_dim_lookup(spark, d):
    c = O.with_class_lists(B.cases(spark, d).select("case_id", "predicted"), dims.class_articles(spark, B.EVENT_ALIAS), "predicted")
    return c.select("case_id", "predicted", F.array_join("elements", "|").alias("elements"), F.array_join("articles", "|").alias("articles"))


@query("jn_neg_pair", B.ctes("cases") + """, neg AS (SELECT case_id AS negative, row_number() OVER (ORDER BY case_id) - 1 AS no FROM cases WHERE ground_truth = 'view')
SELECT c.case_id, negative FROM cases c JOIN neg ON no = (c.case_id * 7919 + 104729) % (SELECT count(*) FROM neg) WHERE ground_truth <> 'view'""")
def jn_neg_pair(spark, d):
    c = B.cases(spark, d)
    p = c.filter(F.col("ground_truth") != NORMAL).select("case_id")
    return O.with_negatives(p, c.filter(F.col("ground_truth") == NORMAL), "case_id", pick=F.col("case_id") * 7919 + 104729)


@query("set_union_corpora", B.ctes("corpus") + """
SELECT concat('doc-', CAST(doc_id AS STRING)) AS id, lang AS category, text AS content, NULL AS url FROM corpus
UNION ALL SELECT concat('page-', CAST(page_id AS STRING)), NULL, html, url FROM pages""")
def set_union_corpora(spark, d):
    docs = B.corpus(spark, d).select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"), F.col("lang").alias("category"), F.col("text").alias("content"))
    pages = B.table(spark, d, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("id"), F.col("html").alias("content"), "url")
    return O.union_corpora(docs, pages)


@query("set_run_diff", B.ctes("cases") + """
SELECT k, 'first' AS only_in FROM (SELECT case_id // 4 AS k FROM cases WHERE run_id = 'r0' EXCEPT ALL SELECT case_id // 4 FROM cases WHERE run_id = 'r1') x
UNION ALL SELECT k, 'second' FROM (SELECT case_id // 4 AS k FROM cases WHERE run_id = 'r1' EXCEPT ALL SELECT case_id // 4 FROM cases WHERE run_id = 'r0') y""")
def set_run_diff(spark, d):
    c = B.cases(spark, d).select("run_id", F.floor(F.col("case_id") / 4).alias("k"))
    return O.run_difference(c.filter("run_id = 'r0'"), c.filter("run_id = 'r1'"), "k")


@query("set_dedup_filter", B.ctes("corpus") + """, h AS (
SELECT lang, doc_id, source, text, CASE WHEN contains(text, 'tion') THEN 0 WHEN contains(text, 'en') THEN 1 ELSE 2 END AS priority FROM corpus
WHERE contains(text, 'tion') OR contains(text, 'en') OR contains(text, 'de'))
SELECT lang, doc_id, priority FROM h WHERE length(text) >= 200 AND (contains(source, '1') OR contains(source, '2') OR contains(source, '5'))
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY priority, doc_id) <= 50""")
def set_dedup_filter(spark, d):
    # one row per matching keyword query, in query order
    asked = F.array(*[F.struct(F.lit(i).alias("priority"), F.lit(w).alias("word")) for i, w in enumerate(["tion", "en", "de"])])
    hits = B.corpus(spark, d).select("lang", "doc_id", "source", "text", F.inline(asked)).filter(F.contains("text", "word"))
    return O.dedup_hits(hits, "doc_id", "text", "source", ["1", "2", "5"], "lang", "priority", 50)


@query("set_resume_union", B.ctes("cases") + """
SELECT case_id, round(confidence, 6) AS confidence, 'old' AS origin FROM cases WHERE conflict_type = 'NONE'
UNION ALL SELECT case_id, round(confidence / 2, 6), 'new' FROM cases WHERE conflict_type <> 'NONE'""")
def set_resume_union(spark, d):
    c = B.cases(spark, d)
    old = c.filter("conflict_type = 'NONE'").select("case_id", "confidence", F.lit("old").alias("origin"))
    new = c.select("case_id", (F.col("confidence") / 2).alias("confidence"), F.lit("new").alias("origin"))
    return rounded(O.resume_union(old, new, "case_id"), "confidence")
