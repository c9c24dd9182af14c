"""Paired tests, effect size, correlation, rater agreement and feature scaling."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from assayer.operators import prefix


def paired_ttest(pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """t of the differences; n < 2 gives (0, 1), equal differences give NULL.

    ``p_approx`` is the closed form used where no t distribution is at hand;
    ``p_value`` is the exact two-sided tail.
    """
    diff = F.col(a) - F.col(b)
    s = pairs.groupBy(*keys).agg(F.count(diff).alias("n"), F.avg(diff).alias("mean_diff"), F.stddev_samp(diff).alias("sd"))
    t = F.when(F.col("n") < 2, F.lit(0.0)).when(F.col("sd") > 0, F.col("mean_diff") / (F.col("sd") / F.sqrt("n")))
    approx = F.when(F.col("n") < 2, F.lit(1.0)).when(F.abs("t") < 10, 2 * F.exp(-0.5 * F.col("t") * F.col("t"))).when(
        F.col("t").isNotNull(), F.lit(0.0))
    return s.withColumn("t", t).select(
        *keys, "n", "mean_diff", F.round("t", 4).alias("t"), F.round(approx, 6).alias("p_approx"),
        F.when(F.col("n") < 2, F.lit(1.0)).otherwise(F.round(t_tail(F.col("t"), F.col("n").cast("double") - 1), 6)).alias("p_value"))


@F.pandas_udf(DoubleType())
def t_tail(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided tail of Student's t: the regularised incomplete beta at dof / (dof + t^2)."""
    import math

    def beta_fraction(x: float, p: float, q: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1.0 - (p + q) * x / (p + 1.0)
        d = 1.0 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 500):
            for num in (m * (q - m) * x / ((p + 2 * m - 1) * (p + 2 * m)),
                        -(p + m) * (p + q + m) * x / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1.0 + num * d
                d = 1.0 / (d if abs(d) > tiny else tiny)
                c = 1.0 + num / c
                c = c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1.0) < 1e-15:
                break
        return h

    def tail(value: float, k: float) -> float | None:
        if value is None or math.isnan(value) or math.isnan(k) or k <= 0:
            return None
        x, p, q = k / (k + value * value), k / 2.0, 0.5
        front = math.exp(math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q)
                         + (p * math.log(x) if x > 0 else -math.inf) + (q * math.log1p(-x) if x < 1 else -math.inf))
        if x < (p + 1) / (p + q + 2):
            return front * beta_fraction(x, p, q) / p
        return 1.0 - front * beta_fraction(1 - x, q, p) / q
    return pd.Series([tail(v, k) for v, k in zip(t, dof)], dtype="float64")


def cohens_d(pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    s = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(a).alias("ma"), F.avg(b).alias("mb"),
        F.sqrt((F.var_samp(a) + F.var_samp(b)) / 2).alias("pooled"))
    d = F.when((F.col("n") < 2) | (F.col("pooled") < 1e-8), F.lit(0.0)).otherwise((F.col("ma") - F.col("mb")) / F.col("pooled"))
    return s.select(*keys, "n", F.round(d, 4).alias("d"))


def correlation(x: str, y: str) -> Column:
    """Pearson; NULL for fewer than two rows or no variance."""
    spread = F.sqrt(F.var_pop(x) * F.var_pop(y))  # one root: equal columns give exactly 1
    return F.when((F.count(F.lit(1)) >= 2) & (spread > 0), F.covar_pop(x, y) / spread)


def pearson(df: DataFrame, keys: list[str], x: str = "a", y: str = "b") -> DataFrame:
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), correlation(x, y).alias("r"))


def spearman(df: DataFrame, keys: list[str], order: str, x: str = "a", y: str = "b", ties: str | tuple[str, ...] = "ordinal") -> DataFrame:
    """Pearson of ranks. ``ordinal`` keeps the row order inside ties; ``average`` shares them. Both from one sort: a tuple of
    names gives a row for each, told apart by a column ``ties``."""
    ranks = prefix.range_ranks(df.select(*keys, order, x, y), keys, order, [x, y])
    every = (ties,) if isinstance(ties, str) else ties
    kind = {"ordinal": "rank", "average": "mean"}
    rho = ranks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[
        correlation(f"{kind[t]}_0", f"{kind[t]}_1").alias(f"__{t}") for t in every])
    if isinstance(ties, str):
        return rho.withColumnRenamed(f"__{ties}", "rho")
    return rho.select(*keys, "n", F.inline(F.array(*[F.struct(F.lit(t).alias("ties"), F.col(f"__{t}").alias("rho")) for t in every])))


def icc21(ratings: DataFrame, keys: list[str]) -> DataFrame:
    """ICC(2,1), two-way random effects, absolute agreement, from ``item_id, rater, value``.

    Sums of squares come from item totals and rater totals; items that a rater
    left out are dropped first.
    """
    known = ratings.filter(F.col("value").isNotNull())
    raters = known.groupBy(*keys).agg(F.count_distinct("rater").alias("k"))
    items = (known.groupBy(*keys, "item_id")
             .agg(F.count(F.lit(1)).alias("have"), F.sum("value").alias("total"),
                  F.sum(F.col("value") * F.col("value")).alias("squares"))
             .join(raters, keys).filter(F.col("have") == F.col("k")))
    rows = items.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.first("k").alias("k"), F.sum("total").alias("total"),
        F.sum("squares").alias("squares"), F.sum(F.col("total") * F.col("total")).alias("row_squares"))
    columns = (known.join(items.select(*keys, "item_id"), [*keys, "item_id"], "left_semi")
               .groupBy(*keys, "rater").agg(F.sum("value").alias("c"))
               .groupBy(*keys).agg(F.sum(F.col("c") * F.col("c")).alias("col_squares")))
    n, k = F.col("n"), F.col("k")
    grand = F.col("total") * F.col("total") / (n * k)
    ss_r, ss_c = F.col("row_squares") / k - grand, F.col("col_squares") / n - grand
    ss_e = F.col("squares") - grand - ss_r - ss_c
    j = rows.join(columns, keys).withColumns({
        "ms_r": ss_r / (n - 1), "ms_c": ss_c / (k - 1), "ms_e": ss_e / ((n - 1) * (k - 1))})
    low = F.col("ms_r") + (k - 1) * F.col("ms_e") + k * (F.col("ms_c") - F.col("ms_e")) / n
    icc = F.when((n >= 2) & (k >= 2) & (low != 0), (F.col("ms_r") - F.col("ms_e")) / low)
    return j.select(*keys, "n", "k", icc.alias("icc"))


def positional_pairs(left: DataFrame, right: DataFrame, order: str, value: str, size: int = 65536) -> DataFrame:
    """Row i of one side with row i of the other, cut to the shorter side."""
    def numbered(df: DataFrame, name: str) -> DataFrame:
        one = df.select(F.lit(0).alias("__all"), order, F.col(value).alias(name))
        return prefix.row_numbers(one, ["__all"], prefix.id_levels(order, size), [order], "pos").select("pos", name)
    return numbered(left, "a").join(numbered(right, "b"), "pos")


def fit_scaler(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Mean and population deviation per dimension; a flat dimension scales by 1."""
    long = vectors.select(F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    s = long.groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    return s.withColumn("std", F.when(F.col("std") < 1e-6, F.lit(1.0)).otherwise(F.col("std")))


def apply_scaler(vectors: DataFrame, scaler: DataFrame, vector: str = "embedding") -> DataFrame:
    """(x - mean) / std with ``zip_with`` against the scaler packed to one row."""
    model = scaler.groupBy(F.lit(0).alias("__model")).agg(
        F.sort_array(F.collect_list(F.struct("dim", "mean", "std"))).alias("__s"))  # one entry per dimension
    j = vectors.withColumn("__model", F.lit(0)).join(F.broadcast(model), "__model")
    scaled = F.zip_with(vector, F.col("__s"), lambda x, m: (x.cast("double") - m["mean"]) / m["std"])
    return j.withColumn("scaled", scaled).drop("__model", "__s")
