"""Exact duplicates, combined in three stages so that no group of copies meets in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.shared import release, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: str = "text") -> Column:
    """The text with A-Z in lower case and null as the empty text; nothing else changes."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 8,
                 digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest.

    Texts are equal when they agree after lower-casing A-Z. Copies are combined inside each task, then per
    (digest, salt, text), then per (digest, text): every stage compares the full content beside the digest, and
    what a hot group sends on is at most one row per task and then one per salt. The row of the largest id stays.
    The finished groups carry no text; each row finds its group by digest, a second fingerprint and the length
    (two groups that share all three raise an error instead of being mixed).

    Null text counts as empty. Null ids sort lowest: such a row is kept only if its whole group has null ids.
    Rows that repeat id and text count in group_size and have the same ``kept``; an empty table gives no rows.
    Other columns are ignored, whatever their names.
    """
    keyed = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm")).select(
        "id", "norm", digest(F.col("norm")).alias("digest"))
    # the salt depends on the row, so a group of any size spreads over all salts
    salted = (keyed.groupBy("digest", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"), "norm")
              .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n")))
    groups = (salted.groupBy("digest", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
              .select("digest", F.xxhash64("norm").alias("check"), F.octet_length("norm").alias("bytes"),
                      "keep_id", "group_size"))
    unique = groups.groupBy("digest", "check", "bytes").agg(
        F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count(F.lit(1)).alias("clash"))
    unique = unique.withColumn("group_size", F.when(F.col("clash") == 1, F.col("group_size")).otherwise(
        F.raise_error(F.lit("two texts share digest, fingerprint and length"))))
    marked = keyed.select("id", "digest", F.xxhash64("norm").alias("check"), F.octet_length("norm").alias("bytes"))
    return (marked.join(unique, ["digest", "check", "bytes"])
            .select(F.col("id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"),
                    F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 8,
                digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The rows that stay, with all their columns, whatever these are called; of rows that repeat id and text one stays."""
    stay = exact_groups(docs, id_col, text_col, salts, digest).filter("kept").select(F.col(id_col).alias("id"), "digest")
    return matching_rows(docs, stay, {"id": F.col(id_col), "digest": digest(normalised(text_col))})


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def matching_rows(df: DataFrame, wanted: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """One row of ``df`` for each row of ``wanted`` whose columns are equal to ``keys`` over ``df``, null equal to null.

    ``wanted`` is written first, so that the shuffles behind it are gone when the rows themselves are shuffled, once,
    for the join and for dropping repeated rows alike.
    """
    names = {n: unused(df, f"__{n}") for n in keys}
    held = df.withColumns({names[n]: c for n, c in keys.items()})
    on = []
    for n, name in names.items():
        default = F.lit("").cast(held.schema[name].dataType) if held.schema[name].dataType.typeName() == "binary" else F.lit(0).cast(held.schema[name].dataType)
        for frame_name, c in ((unused(held, f"{name}_value"), F.coalesce(F.col(name), default)), (unused(held, f"{name}_none"), F.col(name).isNull())):
            held = held.withColumn(frame_name, c)
            on.append((frame_name, n, frame_name.rstrip("_").endswith("none"), default))
    found = wanted.select(*[(F.col(n).isNull() if none else F.coalesce(F.col(n), default)).alias(name) for name, n, none, default in on])
    found = stored(found.distinct(), "wanted")
    release(found)
    columns = [name for name, *_ in on]
    return held.join(found, columns, "left_semi").dropDuplicates(columns).drop(*columns, *names.values())
