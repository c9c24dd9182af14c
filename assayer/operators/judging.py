"""Rubric scores of judges and humans: packing, summaries, agreement, preferences, cost."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.operators.stats import correlation

STABLE_BELOW = 0.29  # fixed value: largest change of a normalised score between two passes


def norm(raw: Column | None = None, top: Column | None = None) -> Column:
    raw = F.col("raw") if raw is None else raw
    top = F.col("max_score") if top is None else top
    return F.when(top > 0, raw / top).otherwise(F.lit(0.0))


def midpoint(top: Column) -> Column:
    return F.floor((top + 1) / 2)


def overall(scores: DataFrame) -> DataFrame:
    """Mean normalised score per item, model and judge."""
    return scores.groupBy("item_id", "model", "judge").agg(F.avg(norm()).alias("overall"))


def common_items(reports: DataFrame, models: list[str], first: int | None = None) -> DataFrame:
    """Items that every model has, in id order."""
    ids = (reports.filter(F.col("model").isin(models)).groupBy("item_id")
           .agg(F.count_distinct("model").alias("n")).filter(F.col("n") == len(models)).select("item_id"))
    return ids if first is None else ids.orderBy("item_id").limit(first)


def report_pairs(reports: DataFrame, a: str, b: str) -> DataFrame:
    filled = reports.filter(F.length("body") > 0)
    one = filled.filter(F.col("model") == a).select("item_id", F.col("body").alias("body_a"))
    two = filled.filter(F.col("model") == b).select("item_id", F.col("body").alias("body_b"))
    return one.join(two, "item_id")


def fully_scored(human: DataFrame, scores: DataFrame, n_questions: int = 7) -> DataFrame:
    """Item and model pairs a human scored on every question and a judge scored at all."""
    full = (human.groupBy("item_id", "model").agg(F.count("raw").alias("n"))
            .filter(F.col("n") == n_questions).select("item_id", "model"))
    return full.join(scores, ["item_id", "model"], "left_semi")


def judge_pairs(scores: DataFrame, judges: list[str]) -> DataFrame:
    """Overall scores of two judges side by side, for each pair of the given judges.

    The judges become columns in one aggregation, so no row meets another.
    """
    wide = overall(scores).groupBy("item_id", "model").agg(
        *[F.max(F.when(F.col("judge") == j, F.col("overall"))).alias(f"__{i}") for i, j in enumerate(judges)])
    pairs = F.array(*[
        F.struct(F.lit(judges[i]).alias("judge_a"), F.lit(judges[j]).alias("judge_b"),
                 F.col(f"__{i}").alias("score_a"), F.col(f"__{j}").alias("score_b"))
        for i, j in combinations(range(len(judges)), 2)])
    return wide.select("item_id", "model", F.inline(pairs)).filter(
        F.col("score_a").isNotNull() & F.col("score_b").isNotNull())


def summary(scores: DataFrame) -> DataFrame:
    """Mean, sample deviation and count per model and judge, and per model over report means."""
    o = overall(scores)
    per_report = o.groupBy("item_id", "model").agg(F.avg("overall").alias("overall")).withColumn("judge", F.lit("ALL"))
    both = o.unionByName(per_report)
    return both.groupBy("model", "judge").agg(
        F.round(F.avg("overall"), 4).alias("mean"),
        F.round(F.coalesce(F.stddev_samp("overall"), F.lit(0.0)), 4).alias("std"), F.count(F.lit(1)).alias("n"))


def agreement(scores: DataFrame, judges: list[str]) -> DataFrame:
    return judge_pairs(scores, judges).groupBy("model", "judge_a", "judge_b").agg(
        F.count(F.lit(1)).alias("n"), correlation("score_a", "score_b").alias("r"))


def model_delta(scores: DataFrame, first: str, second: str) -> DataFrame:
    """Mean of one model less mean of the other over items both have a score for."""
    per_item = overall(scores).filter(F.col("model").isin(first, second)).groupBy("item_id").agg(
        F.avg(F.when(F.col("model") == first, F.col("overall"))).alias("a"),
        F.avg(F.when(F.col("model") == second, F.col("overall"))).alias("b"))
    both = per_item.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"),
                    (F.avg("a") - F.avg("b")).alias("delta"))


def question_correlation(human: DataFrame, scores: DataFrame) -> DataFrame:
    """Human against judge per question and judge over the normalised scores."""
    h = human.filter(F.col("raw").isNotNull()).select("item_id", "model", "q_key", norm().alias("human"))
    s = scores.filter(F.col("raw").isNotNull()).select("item_id", "model", "q_key", "judge", norm().alias("judged"))
    return h.join(s, ["item_id", "model", "q_key"]).groupBy("q_key", "judge").agg(
        F.count(F.lit(1)).alias("n"), correlation("human", "judged").alias("r"))


def pack_rubric(passes: DataFrame) -> DataFrame:
    """Two passes to one score per item, model and question (long form).

    Rows: ``item_id, model, q_key, max_score, raw_1, raw_2``; a missing raw score
    is the midpoint. ``raw_2`` may be absent for single-pass results.
    """
    mid = midpoint(F.col("max_score"))
    one = F.coalesce("raw_1", mid)
    if "raw_2" in passes.columns:
        two = F.coalesce("raw_2", mid)
        raw, change = (one + two) / 2, F.abs(norm(one) - norm(two))
    else:
        raw, change = one.cast("double"), F.lit(0.0)
    return passes.select("item_id", "model", "q_key", raw.alias("raw"), norm(raw).alias("norm"), change.alias("change"))


def rubric_items(packed: DataFrame) -> DataFrame:
    return packed.groupBy("item_id", "model").agg(
        F.avg("norm").alias("overall"), F.max("change").alias("max_change"),
        (F.round(F.max("change"), 12) < STABLE_BELOW).alias("is_stable"))


def rubric_config(packed: DataFrame) -> DataFrame:
    """Per model: mean of each question, overall mean and the share of stable items."""
    per_q = packed.groupBy("model", "q_key").agg(F.avg("raw").alias("value"), F.count(F.lit(1)).alias("n"))
    items = rubric_items(packed)
    total = items.groupBy("model").agg(F.avg("overall").alias("o"), F.avg(F.col("is_stable").cast("double")).alias("s"),
                                       F.count(F.lit(1)).alias("n"))
    tail = total.select("model", "n", F.inline(F.array(
        F.struct(F.lit("overall").alias("q_key"), F.col("o").alias("value")),
        F.struct(F.lit("stable_rate").alias("q_key"), F.col("s").alias("value")))))
    return per_q.unionByName(tail)


def pairwise_outcomes(calls: DataFrame) -> DataFrame:
    """One AB and one BA call per item: agreement names the winner, else a tie; side scores are averaged.

    Rows: ``item_id, direction, score_first, score_second`` (first = shown first).
    """
    ab, ba = F.col("direction") == "AB", F.col("direction") == "BA"
    both = calls.groupBy("item_id").agg(
        F.max(F.when(ab, F.col("score_first"))).alias("ab_a"), F.max(F.when(ab, F.col("score_second"))).alias("ab_b"),
        F.max(F.when(ba, F.col("score_second"))).alias("ba_a"), F.max(F.when(ba, F.col("score_first"))).alias("ba_b"))
    both = both.dropna()

    def winner(a: Column, b: Column) -> Column:
        return F.when(F.round(a - b, 9) > 0, "A").when(F.round(a - b, 9) < 0, "B").otherwise("tie")
    w1, w2 = winner(F.col("ab_a"), F.col("ab_b")), winner(F.col("ba_a"), F.col("ba_b"))
    return both.select(
        "item_id", F.when(w1 == w2, w1).otherwise("tie").alias("winner"),
        ((F.col("ab_a") + F.col("ba_a")) / 2).alias("score_a"), ((F.col("ab_b") + F.col("ba_b")) / 2).alias("score_b"),
        (w1 == w2).alias("is_consistent"))


def pairwise_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("winner") == "A").alias("wins_a"),
        F.count_if(F.col("winner") == "B").alias("wins_b"), F.count_if(F.col("winner") == "tie").alias("ties"),
        F.avg(F.col("is_consistent").cast("double")).alias("consistency_rate"))


def preferences(outcomes: DataFrame, min_gap: float = 0.5, per_class: int = 15) -> DataFrame:
    """Consistent decided pairs with a clear gap, the first few per class (the cap is the report's own)."""
    clear = outcomes.filter(
        F.col("is_consistent") & (F.col("winner") != "tie") & (F.round(F.abs(F.col("score_a") - F.col("score_b")), 9) >= min_gap))
    rank = Window.partitionBy("class").orderBy("item_id")
    a = F.col("winner") == "A"
    return clear.withColumn("rn", F.row_number().over(rank)).filter(F.col("rn") <= per_class).select(
        "class", "item_id", F.when(a, "A").otherwise("B").alias("chosen"), F.when(a, "B").otherwise("A").alias("rejected"),
        F.greatest("score_a", "score_b").alias("score_chosen"), F.least("score_a", "score_b").alias("score_rejected"))


def call_cost() -> Column:
    """Money of some tokens, exact in ten places; a missing price list entry counts 3 and 15 a million."""
    def part(tokens: str, price: str, default: float) -> Column:
        return F.col(tokens).cast("decimal(18,0)") * F.coalesce(price, F.lit(default)).cast("decimal(8,4)")
    return ((part("input_tokens", "input_price", 3.0) + part("output_tokens", "output_price", 15.0))
            * F.lit("0.000001").cast("decimal(6,6)")).cast("decimal(38,10)")


def token_cost(calls: DataFrame, prices: DataFrame, budget: float | str) -> DataFrame:
    """Tokens and money per backend, with what is left of the budget of each; money is decimal."""
    sums = calls.groupBy("backend").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"))
    j = sums.join(F.broadcast(prices), "backend", "left")  # fixed price list
    limit = F.lit(str(budget)).cast("decimal(18,6)")
    return j.withColumn("cost", call_cost()).select(
        "backend", "calls", "input_tokens", "output_tokens", "cost", (limit - F.col("cost")).alias("remaining"), (F.col("cost") > limit).alias("over"))
