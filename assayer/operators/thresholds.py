"""Detection metrics over every threshold, from one histogram of the scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.dims import COST_RATIOS
from assayer.operators import prefix


def labelled(cases: DataFrame, score: str = "score", normal: str = "Normal") -> DataFrame:
    """Rows that carry a score, with columns ``score`` and ``label`` (1 = the truth is an anomaly)."""
    return cases.filter(F.col(score).isNotNull()).withColumns({
        "score": F.col(score), "label": F.when(F.col("ground_truth") != normal, 1).otherwise(0)})


def cumulated(scored: DataFrame, keys: list[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Per distinct score: positives and negatives there, at or below, and in total."""
    hist = scored.groupBy(*keys, "score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    run = prefix.running_totals(hist, keys, prefix.value_levels("score", low, high), ["score"],
                                {"pos_upto": F.col("pos"), "neg_upto": F.col("neg")})
    total = hist.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return run.join(total, keys)


def auroc(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Mann-Whitney area with half credit for ties; one class only gives 0.5."""
    c = cumulated(scored, keys)
    wins = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2))
    s = c.groupBy(*keys).agg(wins.alias("wins"), F.first("n_pos").alias("n_pos"), F.first("n_neg").alias("n_neg"))
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    return s.select(*keys, "n_pos", "n_neg", F.when(pairs == 0, F.lit(0.5)).otherwise(F.col("wins") / pairs).alias("auroc"))


def cost(p_miss: Column, p_fa: Column, c_miss, c_fa, p_target: float = 0.5) -> Column:
    """Normalised detection cost; NULL when the normaliser is 0."""
    miss = (F.lit(c_miss) if not isinstance(c_miss, Column) else c_miss) * p_target
    fa = (F.lit(c_fa) if not isinstance(c_fa, Column) else c_fa) * (1.0 - p_target)
    norm = F.least(miss, fa)
    return F.when(norm > 0, (miss * p_miss + fa * p_fa) / norm)


def _share(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def ndcf_at(scored: DataFrame, keys: list[str], tau: float, c_miss: float = 5.0, c_fa: float = 1.0,
            p_target: float = 0.5) -> DataFrame:
    pos, hit = F.col("label") == 1, F.col("score") >= tau
    s = scored.groupBy(*keys).agg(
        F.count_if(pos).alias("n_pos"), F.count_if(~pos).alias("n_neg"),
        F.count_if(pos & ~hit).alias("missed"), F.count_if(~pos & hit).alias("false_alarms"))
    p_miss, p_fa = _share(F.col("missed"), F.col("n_pos")), _share(F.col("false_alarms"), F.col("n_neg"))
    return s.select(*keys, p_miss.alias("p_miss"), p_fa.alias("p_fa"),
                    cost(p_miss, p_fa, c_miss, c_fa, p_target).alias("ndcf"))


def operating_points(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Miss and false-alarm rate at each distinct score and at both infinities."""
    c = cumulated(scored, keys)
    at = c.select(
        *keys, F.col("score").alias("tau"),
        _share(F.col("pos_upto") - F.col("pos"), F.col("n_pos")).alias("p_miss"),
        _share(F.col("n_neg") - F.col("neg_upto") + F.col("neg"), F.col("n_neg")).alias("p_fa"))
    ends = c.select(*keys, "n_pos", "n_neg").distinct().select(*keys, F.inline(F.array(
        F.struct(F.lit(float("-inf")).alias("tau"), F.lit(0.0).alias("p_miss"),
                 F.when(F.col("n_neg") > 0, 1.0).otherwise(0.0).alias("p_fa")),
        F.struct(F.lit(float("inf")).alias("tau"),
                 F.when(F.col("n_pos") > 0, 1.0).otherwise(0.0).alias("p_miss"), F.lit(0.0).alias("p_fa")))))
    return at.unionByName(ends)


def threshold_text(tau: Column) -> Column:
    """Thresholds as text, so the infinities survive every engine."""
    return (F.when(tau == float("-inf"), "-inf").when(tau == float("inf"), "inf")
            .otherwise(F.format_string("%.6f", tau)))


def min_ndcf(scored: DataFrame, keys: list[str], ratios: list[tuple[float, float]] | None = None,
             p_target: float = 0.5) -> DataFrame:
    """Lowest cost over all thresholds per cost ratio; equal costs keep the lowest threshold."""
    ratios = ratios or [(5.0, 1.0)]
    choices = F.array(*[F.struct(F.lit(m).alias("c_miss"), F.lit(f).alias("c_fa")) for m, f in ratios])
    points = operating_points(scored, keys).select("*", F.inline(choices))
    priced = points.withColumn(
        "ndcf", F.round(cost(F.col("p_miss"), F.col("p_fa"), F.col("c_miss"), F.col("c_fa"), p_target), 12))
    best = priced.groupBy(*keys, "c_miss", "c_fa").agg(F.min(F.struct("ndcf", "tau")).alias("best"))
    return best.select(*keys, "c_miss", "c_fa", (F.col("c_miss") / F.col("c_fa")).alias("ratio"),
                       F.col("best.ndcf").alias("ndcf"), F.col("best.tau").alias("tau"))


def ndcf_sweep(scored: DataFrame, keys: list[str], tau: float | None = None) -> DataFrame:
    """Cost per ratio, at its own best threshold or at one fixed threshold."""
    if tau is None:
        return min_ndcf(scored, keys, COST_RATIOS).withColumn("mode", F.lit("optimal"))
    at = ndcf_at(scored, keys, tau)
    choices = F.array(*[F.struct(F.lit(m).alias("c_miss"), F.lit(f).alias("c_fa")) for m, f in COST_RATIOS])
    e = at.drop("ndcf").select("*", F.inline(choices))
    return e.select(*keys, "c_miss", "c_fa", (F.col("c_miss") / F.col("c_fa")).alias("ratio"),
                    cost(F.col("p_miss"), F.col("p_fa"), F.col("c_miss"), F.col("c_fa")).alias("ndcf"),
                    F.lit(tau).alias("tau"), F.lit("fixed").alias("mode"))


def curve_points(scored: DataFrame, keys: list[str]) -> DataFrame:
    """ROC and DET points per distinct score; nothing for a key with one class."""
    c = cumulated(scored, keys).filter("n_pos > 0 AND n_neg > 0")
    fpr = (F.col("n_neg") - F.col("neg_upto") + F.col("neg")) / F.col("n_neg")
    fnr = (F.col("pos_upto") - F.col("pos")) / F.col("n_pos")
    return c.select(*keys, F.col("score").alias("tau"), fpr.alias("fpr"), (1 - fnr).alias("tpr"), fnr.alias("fnr"))


def area_and_costs(scored: DataFrame, keys: list[str], ratios: list[tuple[float, float]], p_target: float = 0.5) -> DataFrame:
    """Area and, per cost ratio, ``best_<i>`` (lowest cost and its threshold) from one cumulative pass.

    The thresholds at both infinities follow from the totals and are compared after the aggregation.
    """
    c = cumulated(scored, keys)
    p_miss = _share(F.col("pos_upto") - F.col("pos"), F.col("n_pos"))
    p_fa = _share(F.col("n_neg") - F.col("neg_upto") + F.col("neg"), F.col("n_neg"))

    def priced(miss: Column, fa: Column, ratio: tuple[float, float], tau: Column) -> Column:
        return F.struct(F.round(cost(miss, fa, *ratio, p_target), 12).alias("ndcf"), tau.alias("tau"))
    s = c.groupBy(*keys).agg(
        F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2)).alias("wins"),
        F.first("n_pos").alias("n_pos"), F.first("n_neg").alias("n_neg"),
        *[F.min(priced(p_miss, p_fa, r, F.col("score"))).alias(f"best_{i}") for i, r in enumerate(ratios)])
    all_ = F.when(F.col("n_neg") > 0, 1.0).otherwise(0.0)
    none = F.when(F.col("n_pos") > 0, 1.0).otherwise(0.0)
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    return s.select(
        *keys, "n_pos", "n_neg", F.when(pairs == 0, F.lit(0.5)).otherwise(F.col("wins") / pairs).alias("auroc"),
        *[F.least(F.col(f"best_{i}"), priced(F.lit(0.0), all_, r, F.lit(float("-inf"))),
                  priced(none, F.lit(0.0), r, F.lit(float("inf")))).alias(f"best_{i}") for i, r in enumerate(ratios)])


def detection_summary(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Area, best cost with its threshold and the sweep, where both classes are present."""
    s = area_and_costs(scored, keys, COST_RATIOS).filter("n_pos > 0 AND n_neg > 0")
    five = next(i for i, (m, _) in enumerate(COST_RATIOS) if m == 5.0)
    return s.select(
        *keys, F.col("n_pos").alias("n_anomaly"), F.col("n_neg").alias("n_normal"), F.round("auroc", 4).alias("auroc"),
        *[F.round(F.col(f"best_{i}.ndcf"), 4).alias(f"min_ndcf_{int(m)}_1") for i, (m, _) in enumerate(COST_RATIOS)],
        F.round(F.col(f"best_{five}.tau"), 4).alias("tau_optimal"))
