"""Queries over paired samples, ratings and vectors."""

from pyspark.sql import functions as F

from assayer import bindings as B
from assayer.operators import stats as S
from assayer.plans.metrics import rounded
from assayer.plans.registry import query



def _paired(spark, d):
    return B.paired(spark, d).select(F.lit("all").alias("scope"), "item_id", "a", "b")


@query("agg_paired_ttest", B.ctes("paired") + """, s AS (
SELECT count(*) AS n, avg(a - b) AS m, stddev_samp(a - b) AS sd FROM paired)
SELECT 'all' AS scope, n, round(m, 6) AS mean_diff, round(m / (sd / sqrt(n)), 4) AS t,
       round(CASE WHEN abs(m / (sd / sqrt(n))) < 10 THEN 2 * exp(-0.5 * pow(m / (sd / sqrt(n)), 2)) ELSE 0 END, 6) AS p_approx
FROM s""")
def agg_paired_ttest(spark, d):
    return rounded(S.paired_ttest(_paired(spark, d), ["scope"]), "mean_diff").drop("p_value")


@query("agg_paired_ttest_exact", B.ctes("paired") + """, s AS (
SELECT count(*) AS n, count(*) - 1 AS k, avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))) AS t FROM paired),
h AS (SELECT *, atan(abs(t) / sqrt(k)) AS th FROM s),
-- the finite series of Student's t for whole degrees of freedom
e AS (SELECT h.*, unnest(range(0, CASE WHEN k % 2 = 0 THEN k // 2 ELSE greatest((k - 1) // 2, 1) END)) AS j FROM h),
z AS (SELECT n, k, t, th, sum(CASE WHEN k % 2 = 0 THEN exp(lgamma(j + 0.5) - lgamma(j + 1) - lgamma(0.5)) * pow(cos(th), 2 * j)
       WHEN k = 1 THEN 0 ELSE exp(lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5)) * pow(cos(th), 2 * j + 1) END) AS z FROM e GROUP BY ALL)
SELECT 'all' AS scope, n, round(t, 4) AS t, round(1 - CASE WHEN k % 2 = 0 THEN sin(th) * z ELSE 2 / pi() * (th + sin(th) * z) END, 6) AS p_value FROM z""")
def agg_paired_ttest_exact(spark, d):
    return S.paired_ttest(_paired(spark, d), ["scope"]).select("scope", "n", "t", "p_value")


@query("agg_cohens_d", B.ctes("paired") + """
SELECT 'all' AS scope, count(*) AS n, round((avg(a) - avg(b)) / sqrt((var_samp(a) + var_samp(b)) / 2), 4) AS d FROM paired""")
def agg_cohens_d(spark, d):
    return S.cohens_d(_paired(spark, d), ["scope"])


@query("agg_pearson", B.ctes("paired") + "SELECT 'all' AS scope, count(*) AS n, round(corr(a, b), 6) AS r FROM paired")
def agg_pearson(spark, d):
    return rounded(S.pearson(_paired(spark, d), ["scope"]), "r")


@query("agg_spearman", B.ctes("paired") + """, r AS (
SELECT row_number() OVER (ORDER BY a, item_id) AS ra, row_number() OVER (ORDER BY b, item_id) AS rb,
       rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS sa,
       rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS sb FROM paired)
SELECT 'ordinal' AS ties, 'all' AS scope, count(*) AS n, round(corr(ra, rb), 6) AS rho FROM r
UNION ALL SELECT 'average', 'all', count(*), round(corr(sa, sb), 6) FROM r""")
def agg_spearman(spark, d):
    p = _paired(spark, d)
    return rounded(S.spearman(p, ["scope"], "item_id", ties=("ordinal", "average")), "rho")


@query("agg_icc21", B.ctes("paired") + """, l AS (
SELECT item_id, 'a' AS rater, a AS v FROM paired UNION ALL SELECT item_id, 'b', b FROM paired),
g AS (SELECT avg(v) AS gm, count(DISTINCT item_id) AS n, 2 AS k FROM l),
r AS (SELECT sum(pow(rm - gm, 2)) * 2 AS ssr FROM (SELECT avg(v) AS rm FROM l GROUP BY item_id) x, g),
c AS (SELECT sum(pow(cm - gm, 2)) * any_value(n) AS ssc FROM (SELECT avg(v) AS cm FROM l GROUP BY rater) x, g),
t AS (SELECT sum(pow(v - gm, 2)) AS sst FROM l, g),
m AS (SELECT n, k, ssr / (n - 1) AS msr, ssc / (k - 1) AS msc, (sst - ssr - ssc) / ((n - 1) * (k - 1)) AS mse FROM g, r, c, t)
SELECT 'all' AS scope, n, CAST(k AS BIGINT) AS k, round((msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n), 6) AS icc FROM m""")
def agg_icc21(spark, d):
    long = _paired(spark, d).select("scope", "item_id", F.inline(F.array(
        F.struct(F.lit("a").alias("rater"), F.col("a").alias("value")),
        F.struct(F.lit("b").alias("rater"), F.col("b").alias("value")))))
    return rounded(S.icc21(long, ["scope"]), "icc")


@query("jn_positional", """
WITH v AS (SELECT row_number() OVER (ORDER BY event_id) AS pos, value AS a FROM events WHERE event_type = 'view'),
c AS (SELECT row_number() OVER (ORDER BY event_id) AS pos, value AS b FROM events WHERE event_type = 'click')
SELECT v.pos, a, b FROM v JOIN c ON v.pos = c.pos""")
def jn_positional(spark, d):
    e = B.table(spark, d, "events")
    def side(kind):
        return e.filter(F.col("event_type") == kind).select("event_id", "value")
    return S.positional_pairs(side("view"), side("click"), "event_id", "value")


DIMS_SQL = "x AS (SELECT vec_id, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
SCALER_SQL = f"""WITH {DIMS_SQL}, s AS (SELECT dim, avg(x) AS mean,
       CASE WHEN stddev_pop(x) < 1e-6 THEN 1.0 ELSE stddev_pop(x) END AS std FROM x GROUP BY dim)"""


@query("agg_scaler", SCALER_SQL + "SELECT CAST(dim AS INTEGER) AS dim, round(mean, 6) AS mean, round(std, 6) AS std FROM s")
def agg_scaler(spark, d):
    return rounded(S.fit_scaler(B.table(spark, d, "embeddings")), "mean", "std")


@query("agg_scaler_apply", SCALER_SQL + """
SELECT vec_id, round(sum((x - mean) / std), 4) AS total, round(sqrt(sum(pow((x - mean) / std, 2))), 4) AS length
FROM x JOIN s ON s.dim = x.dim GROUP BY vec_id""")
def agg_scaler_apply(spark, d):
    v = B.table(spark, d, "embeddings").select("vec_id", "embedding")
    scaled = S.apply_scaler(v, S.fit_scaler(v))
    zero = F.lit(0.0)
    return scaled.select(
        "vec_id", F.round(F.aggregate("scaled", zero, lambda a, x: a + x), 4).alias("total"),
        F.round(F.sqrt(F.aggregate("scaled", zero, lambda a, x: a + x * x)), 4).alias("length"))
