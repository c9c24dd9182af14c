"""Classification metrics of runs: accuracy, confusion, F1, calibration, priors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.operators import prefix

TRUTH, PREDICTED = "ground_truth", "predicted"


def _ratio(top: Column, bottom: Column, empty: Column | None = None) -> Column:
    return F.when(bottom == 0, F.lit(0.0) if empty is None else empty).otherwise(top / bottom)


def correct() -> Column:
    return F.coalesce(F.col(TRUTH) == F.col(PREDICTED), F.lit(False))


def run_metrics(cases: DataFrame) -> DataFrame:
    """Per run: size, accuracy and means; a missing number counts as 0."""
    def mean(c: str, digits: int) -> Column:
        return F.round(F.round(F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))), 12), digits)
    return cases.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.round(F.avg(correct().cast("double")), 12), 4).alias("accuracy"),
        mean("confidence", 4).alias("mean_confidence"),
        mean("rcons", 4).alias("mean_rcons"),
        mean("rlegal", 4).alias("mean_rlegal"),
        mean("total_turns", 2).alias("mean_turns"))


def per_class_accuracy(cases: DataFrame) -> DataFrame:
    """Per run and true class, with the run and grand totals as rollup levels."""
    return cases.rollup("run_id", TRUTH).agg(
        F.grouping_id().cast("int").alias("level"),
        F.count(F.lit(1)).alias("total"),
        F.sum(correct().cast("long")).alias("n_correct"),
        F.avg(correct().cast("double")).alias("accuracy"),
    ).select(F.coalesce("run_id", F.lit("ALL")).alias("run_id"),
             F.coalesce(TRUTH, F.lit("ALL")).alias("class"), "level", "total", "n_correct", "accuracy")


def class_counts(cases: DataFrame) -> DataFrame:
    """Rows per run, true class and predicted class: the base of every class metric."""
    return cases.groupBy("run_id", TRUTH, PREDICTED).agg(F.count(F.lit(1)).alias("n"))


def subset_rates(cases: DataFrame, classes: DataFrame) -> DataFrame:
    kinds = F.broadcast(classes.select("class", "kind"))  # one row per class, fixed list
    c = class_counts(cases)
    c = c.join(kinds.withColumnsRenamed({"class": TRUTH, "kind": "gt_kind"}), TRUTH, "left")
    c = c.join(kinds.withColumnsRenamed({"class": PREDICTED, "kind": "pred_kind"}), PREDICTED, "left")
    n, right = F.col("n"), F.col(TRUTH) == F.col(PREDICTED)

    def total(*conds: Column) -> Column:
        cond = conds[0]
        for x in conds[1:]:
            cond = cond & x
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    crime, other = F.col("gt_kind") == "crime", F.col("gt_kind") == "non_crime"
    sums = c.groupBy("run_id").agg(
        total(crime).alias("n_crime"), total(other).alias("n_non_crime"),
        total(crime, right).alias("crime_hit"), total(other, right).alias("non_crime_hit"),
        total(other, F.col("pred_kind") == "crime").alias("false_crime"))
    return sums.select(
        "run_id", "n_crime", "n_non_crime",
        _ratio(F.col("crime_hit"), F.col("n_crime")).alias("crime_accuracy"),
        _ratio(F.col("false_crime"), F.col("n_non_crime")).alias("non_crime_fp_rate"),
        _ratio(F.col("non_crime_hit"), F.col("n_non_crime")).alias("non_crime_accuracy"))


def binary_prf(cases: DataFrame, normal: str = "Normal") -> DataFrame:
    """Anomaly (anything but ``normal``) against normal per run."""
    gt, pr = F.col(TRUTH) != normal, F.col(PREDICTED) != normal
    s = cases.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(gt & pr).alias("tp"), F.count_if(~gt & pr).alias("fp"),
        F.count_if(gt & ~pr).alias("fn"), F.count_if(~gt & ~pr).alias("tn"),
        F.count_if(F.col(TRUTH) == F.col(PREDICTED)).alias("same"))
    p = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return s.select(
        "run_id", "n", "tp", "fp", "fn", "tn", p.alias("precision"), r.alias("recall"),
        _ratio(2 * p * r, p + r).alias("f1"),
        _ratio(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"),
        _ratio(F.col("same"), F.col("n")).alias("class_accuracy"))


def confusion(cases: DataFrame) -> DataFrame:
    """Dense matrix in long form over the classes each run shows, raw and row-normalised."""
    counts = class_counts(cases)
    # the classes of one run: at most the class list, so the grid is (list size)^2 rows per run
    grid = (counts.groupBy("run_id")
            .agg(F.array_distinct(F.concat(F.collect_set(TRUTH), F.collect_set(PREDICTED))).alias("shown"))
            .select("run_id", "shown", F.explode("shown").alias(TRUTH))
            .select("run_id", TRUTH, F.explode("shown").alias(PREDICTED)))
    dense = grid.join(counts, ["run_id", TRUTH, PREDICTED], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    row_total = F.sum("n").over(Window.partitionBy("run_id", TRUTH))
    return dense.withColumn("row_total", row_total).select(
        "run_id", TRUTH, PREDICTED, "n", _ratio(F.col("n"), F.col("row_total")).alias("share"))


def confusion_wide(cases: DataFrame, labels: list[str]) -> DataFrame:
    """One row per run and true class, one column per predicted label."""
    wide = class_counts(cases).groupBy("run_id", TRUTH).pivot(PREDICTED, labels).agg(F.sum("n"))
    return wide.select("run_id", TRUTH, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in labels])


def per_class_prf(cases: DataFrame) -> DataFrame:
    """TP/FP/FN and P/R/F1 per run and class; one count is booked to both of its classes."""
    zero = F.lit(0).cast("long")
    same = F.col(TRUTH) == F.col(PREDICTED)
    entries = F.array(
        F.struct(F.col(TRUTH).alias("class"), F.when(same, F.col("n")).otherwise(zero).alias("tp"),
                 zero.alias("fp"), F.when(~same, F.col("n")).otherwise(zero).alias("fn")),
        F.struct(F.col(PREDICTED).alias("class"), zero.alias("tp"),
                 F.when(~same, F.col("n")).otherwise(zero).alias("fp"), zero.alias("fn")))
    booked = class_counts(cases).select("run_id", F.inline(entries))
    s = booked.groupBy("run_id", "class").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    p = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return s.select("run_id", "class", "tp", "fp", "fn", (F.col("tp") + F.col("fn")).alias("support"),
                    p.alias("precision"), r.alias("recall"), _ratio(2 * p * r, p + r).alias("f1"))


def macro_f1(cases: DataFrame) -> DataFrame:
    """Unweighted mean F1 over the true classes (classes only predicted are left out)."""
    return (per_class_prf(cases).filter("support > 0").groupBy("run_id")
            .agg(F.count(F.lit(1)).alias("n_classes"), F.avg("f1").alias("macro_f1")))


def prediction_histogram(cases: DataFrame) -> DataFrame:
    return cases.groupBy("run_id", PREDICTED).agg(F.count(F.lit(1)).alias("n"))


def filled_bins(cases: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width bins of confidence that hold rows; unknown confidences are left out."""
    index = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    return cases.filter(F.col("confidence").isNotNull()).groupBy("run_id", index.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_conf"),
        F.avg(correct().cast("double")).alias("accuracy"))


def reliability(cases: DataFrame, bins: int = 10) -> DataFrame:
    """All bins of each run; an empty bin has its centre and no accuracy."""
    filled = filled_bins(cases, bins)
    domain = filled.select("run_id").distinct().select(
        "run_id", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return domain.join(filled, ["run_id", "bin"], "left").select(
        "run_id", "bin", F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("mean_conf", (F.col("bin") + 0.5) / bins).alias("mean_conf"), "accuracy")


def calibration_error(cases: DataFrame, bins: int = 10) -> DataFrame:
    return filled_bins(cases, bins).groupBy("run_id").agg(
        (F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("mean_conf"))) / F.sum("n")).alias("ece"))


def confidence_degenerate(cases: DataFrame) -> DataFrame:
    """A run whose rounded confidences take at most two values says nothing about calibration."""
    distinct = cases.select("run_id", F.round("confidence", 3).alias("c")).distinct()
    return distinct.groupBy("run_id").agg(F.count("c").alias("n_values")).select(
        "run_id", "n_values", (F.col("n_values") <= 2).alias("degenerate"))


def index_percentiles(cases: DataFrame, value: str = "confidence") -> DataFrame:
    """Elements n//4, n//2 and 3n//4 of the sorted values; NULL unless n > 3."""
    n = F.col("n")
    q = prefix.order_statistics(cases, ["run_id"], value, prefix.value_levels(value), {
        "p25": F.floor(n / 4), "p50": F.floor(n / 2), "p75": F.floor(n * 3 / 4)})
    return q.select("run_id", "n", *[F.when(n > 3, F.col(c)).alias(c) for c in ("p25", "p50", "p75")])


def describe(cases: DataFrame, value: str = "confidence") -> DataFrame:
    """Mean, median, sample deviation (0 for one row), range, and means of right and wrong rows."""
    v = F.col(value)
    n = F.col("n")
    middle = prefix.order_statistics(cases, ["run_id"], value, prefix.value_levels(value), {
        "lower": F.floor((n - 1) / 2), "upper": F.floor(n / 2)})
    plain = cases.groupBy("run_id").agg(
        F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("stdev"),
        F.min(v).alias("min"), F.max(v).alias("max"),
        F.avg(F.when(correct(), v)).alias("mean_correct"), F.avg(F.when(~correct(), v)).alias("mean_wrong"))
    return plain.join(middle, "run_id").select(
        "run_id", "n", "mean", ((F.col("lower") + F.col("upper")) / 2).alias("median"),
        "stdev", "min", "max", "mean_correct", "mean_wrong")


def zero_filled_counts(df: DataFrame, key: str, column: str, domain: list[str], few: int | None = None) -> DataFrame:
    """Counts over a fixed domain, zeros kept; optional flag for counts below ``few``."""
    counts = df.groupBy(key, column).agg(F.count(F.lit(1)).alias("n"))
    full = counts.select(key).distinct().select(
        key, F.explode(F.array(*[F.lit(x) for x in domain])).alias(column))
    out = full.join(counts, [key, column], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out if few is None else out.withColumn("too_few", F.col("n") < few)


def bias_priors(cases: DataFrame, domain: list[str], smoothing: float = 0.5, flag: float = 0.3) -> DataFrame:
    """Log ratio of the smoothed prediction share to the uniform share, per run and class."""
    k = len(domain)
    counts = zero_filled_counts(cases.filter(F.col(PREDICTED).isin(domain)), "run_id", PREDICTED, domain)
    n = F.sum("n").over(Window.partitionBy("run_id"))  # one row per class of a run
    share = (F.col("n") + smoothing) / (F.col("total") + smoothing * k)
    bias = F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.ln(share / (1.0 / k)))
    return counts.withColumn("total", n).withColumn("bias", bias).select(
        "run_id", F.col(PREDICTED).alias("class"), "n", "bias",
        F.when(F.col("bias") > flag, "over").when(F.col("bias") < -flag, "under").otherwise("ok").alias("flag"))


def class_weights(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """total / (K * count) per class, 0 for a class without rows."""
    counts = zero_filled_counts(df, "run_id", column, domain)
    total = F.sum("n").over(Window.partitionBy("run_id"))
    return counts.select("run_id", F.col(column).alias("class"), "n",
                         _ratio(total, F.lit(len(domain)) * F.col("n")).alias("weight"))


def convergence(steps: DataFrame, keys: list[str], order: str, reward: Column, level: Column,
                target: float = 0.8) -> DataFrame:
    """First step above the target (else the length), last and mean reward."""
    ranked = prefix.row_numbers(steps.withColumn("reward", reward), keys, [level], [order], "step")
    return ranked.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(F.col("reward") > target, F.col("step") - 1)), F.count(F.lit(1))).alias("first_step"),
        F.max_by("reward", "step").alias("last_reward"), F.avg("reward").alias("mean_reward"))
