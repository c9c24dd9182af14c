"""Set work on ids and corpora: exclusion, resume, unions, differences, negatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.operators import prefix


def exclude(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")


def resume_union(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old results, then the new ones of ids that are not done."""
    return old.unionByName(exclude(new, old, key), allowMissingColumns=True)


def run_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids one run has and the other lacks, counted with repeats; empty for equal runs."""
    def side(x: DataFrame, y: DataFrame, name: str) -> DataFrame:
        return x.select(key).exceptAll(y.select(key)).withColumn("only_in", F.lit(name))
    return side(a, b, "first").unionByName(side(b, a, "second"))


def union_corpora(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def dedup_hits(hits: DataFrame, key: str, text: str, source: str, allowed: list[str], label: str, order: str, cap: int,
               min_chars: int = 200) -> DataFrame:
    """First hit per id, only from allowed sources and with enough text, at most ``cap`` per class."""
    good = hits.filter((F.length(text) >= min_chars) & F.exists(
        F.array(*[F.lit(a) for a in allowed]), lambda a: F.contains(F.col(source), a)))
    once = good.groupBy(label, key).agg(F.min(order).alias(order))
    w = Window.partitionBy(label).orderBy(order, key)
    return once.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= cap).drop("__rn")


def with_negatives(positives: DataFrame, negatives: DataFrame, key: str, seed: int = 42, pick: Column | None = None) -> DataFrame:
    """One negative per positive: negatives are numbered, a hash of the positive names the number."""
    one = negatives.select(F.lit(0).alias("__all"), F.col(key).alias("negative"))
    numbered = prefix.row_numbers(one, ["__all"], prefix.id_levels("negative"), ["negative"], "__no").withColumn(
        "__no", F.col("__no") - 1).drop("__all")
    n = one.groupBy("__all").agg(F.count(F.lit(1)).alias("__n"))
    hashed = F.xxhash64(F.col(key), F.lit(seed)) if pick is None else pick
    p = positives.withColumn("__all", F.lit(0)).join(F.broadcast(n), "__all").withColumn(  # one row
        "__no", F.pmod(hashed, F.col("__n")))
    return p.join(numbered, "__no").drop("__no", "__all", "__n")


def with_class_lists(df: DataFrame, lists: DataFrame, column: str) -> DataFrame:
    """Elements and articles of a class, empty lists for a class without."""
    dim = F.broadcast(lists.withColumnRenamed("class", column))  # fixed class list
    empty = F.array().cast("array<string>")
    return df.join(dim, column, "left").withColumns({c: F.coalesce(c, empty) for c in ("elements", "articles")})
