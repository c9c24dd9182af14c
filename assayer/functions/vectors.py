"""Vector columns and class scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------------
MODALITIES = (512, 768, 99, 7)
SCORE_SCALE = 50.0
FLOOR_P, FLOOR_LOG = 1e-12, 1e-10
# ---- end of fixed values ------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def l2_score(a: Column) -> Column:
    return F.least(norm(a) / SCORE_SCALE, F.lit(1.0))


def concat_modalities(parts: list[Column], sizes: tuple[int, ...] = MODALITIES) -> Column:
    """Parts end to end, each cut or padded with zeros to its size."""
    def fit(c: Column, n: int) -> Column:
        c = F.coalesce(c.cast("array<float>"), F.array().cast("array<float>"))
        return F.slice(F.concat(c, F.array_repeat(F.lit(0.0).cast("float"), n)), 1, n)
    return F.concat(*[fit(c, n) for c, n in zip(parts, sizes)])


def right_length(df: DataFrame, column: str, sizes: tuple[int, ...] = MODALITIES) -> DataFrame:
    return df.filter(F.size(column) == sum(sizes))


def centroids(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """Mean vector per class: one average per class and dimension, combined on the map side."""
    long = vectors.select(label, F.posexplode(vector).alias("dim", "x"))
    means = long.groupBy(label, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    return means.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("dim", "mean"))).alias("m")).select(
        label, F.col("m.mean").alias("vector"))


def class_logits(vectors: DataFrame, classes: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """Adds ``logits array<struct<class, logit>>`` in class order.

    The class vectors (one per class of a fixed list) are packed to one row, so
    each vector is scored in its own row and nothing is exploded.
    """
    packed = classes.groupBy(F.lit(0).alias("__one")).agg(
        F.sort_array(F.collect_list(F.struct(F.col(label).alias("class"), F.col("vector").alias("vector")))).alias("__c"))
    j = vectors.withColumn("__one", F.lit(0)).join(F.broadcast(packed), "__one")
    logits = F.transform("__c", lambda c: F.struct(c["class"].alias("class"), cosine(F.col(vector), c["vector"]).alias("logit")))
    return j.withColumn("logits", logits).drop("__one", "__c")


def with_softmax(df: DataFrame, logits: str, out: str, bias: Column | None = None, scale: float = 1.0) -> DataFrame:
    """Adds class probabilities; ``bias`` maps a class to what is taken off its logit.

    Highest logit and sum are columns of their own, so they are found once per row.
    """
    def off(c: Column) -> Column:
        return F.coalesce(F.try_element_at(bias, c), F.lit(0.0)) if bias is not None else F.lit(0.0)
    d = df.withColumn("__z", F.transform(logits, lambda x: x["logit"] * scale - off(x["class"])))
    d = d.withColumn("__top", F.array_max("__z"))
    d = d.withColumn("__e", F.transform("__z", lambda z: F.exp(z - F.col("__top"))))
    d = d.withColumn("__sum", F.aggregate("__e", F.lit(0.0), lambda a, x: a + x))
    return d.withColumn(out, F.zip_with(logits, "__e", lambda x, e: F.struct(
        x["class"].alias("class"), (e / F.col("__sum")).alias("p")))).drop("__z", "__top", "__e", "__sum")


def ranked(probabilities: Column) -> Column:
    """Classes by falling probability, equal ones in class order."""
    keyed = F.transform(probabilities, lambda x: F.struct((-F.round(x["p"], 9)).alias("k"), x["class"].alias("class"), x["p"].alias("p")))
    return F.transform(F.array_sort(keyed), lambda x: F.struct(x["class"].alias("class"), x["p"].alias("p")))


def entropy(probabilities: Column) -> Column:
    terms = F.transform(probabilities, lambda x: F.greatest(x["p"], F.lit(FLOOR_P)) * F.ln(F.greatest(x["p"], F.lit(FLOOR_P))))
    return -F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def geometric_mean(p: Column) -> Column:
    """Aggregate: exp of the mean log of floored probabilities; 0.5 without any."""
    return F.coalesce(F.exp(F.avg(F.ln(F.greatest(p, F.lit(FLOOR_LOG))))), F.lit(0.5))


def share_of_sum(means: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each value over the sum of its key (0 where the sum is 0)."""
    totals = means.groupBy(*keys).agg(F.sum(value).alias("__total"))
    return means.join(totals, keys).withColumn(
        "share", F.when(F.col("__total") == 0, F.lit(0.0)).otherwise(F.col(value) / F.col("__total"))).drop("__total")
