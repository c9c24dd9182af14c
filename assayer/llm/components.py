"""Connected components by joins, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.shared import release, stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root): the smallest id of the component of every linked id.

    Large-star and small-star steps in turn: each id is linked to the smallest id it knows, until nothing changes, a
    number of rounds that grows with the logarithm of the longest chain. Links are combined before every shuffle; the
    only rows of one id that meet are its distinct links. Links with a null end or to themselves are left out.
    """
    now = (links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
           .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    now = stored(now, "links")
    while True:
        # large star: the larger neighbours of u go to the smallest of all
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.filter(F.col("v") > F.col("u")).join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: u and its smaller neighbours go to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                                               F.struct(F.col("u"), F.col("m").alias("v")))).alias("p"))
                 .select("p.u", "p.v").filter(F.col("u") != F.col("v")).distinct())
        new = stored(small, "links")
        release(new)
        # a fixed point is a set of stars: no id is both a leaf and a centre, and no leaf has two centres
        inner = new.select("u").join(new.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count()
        two = 0 if inner else new.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
        now = new
        if not inner and not two:
            break
    roots = now.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(roots)
