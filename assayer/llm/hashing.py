"""Hashed features of words, kept per distinct word."""

from __future__ import annotations

import re
from functools import reduce

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.shared import stored

WORD = re.compile(r"\S+")


def held_out(id_col: str = "doc_id"):
    """Rows no classifier learns labels from: crc32 of the id as text is divisible by five."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, grade, sample: dict[int, int], most_chars: int,
                    id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """At most ``sample[grade]`` texts of each grade, of at most ``most_chars`` characters, none of them held out.

    Ids are chosen from the labels alone, by a hash, a quarter more than are asked for; these few ids are broadcast and
    their texts written where the documents are scanned, so no text is shuffled and one scan serves all grades. The choice does
    not depend on partitions. Labels of unknown documents or of texts that are too long use up the surplus only, null ids and
    null grades give nothing, and of a repeated id every (text, grade) is a candidate.
    """
    marked = labels.select(F.col(id_col).alias("id"), grade.alias("grade")).filter(
        F.col("id").isNotNull() & F.col("grade").isNotNull() & ~held_out("id"))
    place = F.xxhash64("id")
    some = [marked.filter(F.col("grade") == c).orderBy(place, "id").limit(n + n // 4 + 8) for c, n in sample.items()]
    chosen = reduce(DataFrame.union, some)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = stored(texts.filter(F.length("text") <= most_chars).join(F.broadcast(chosen), "id"), "sample")
    out = []
    for c, n in sample.items():
        out += [(r.text, c) for r in found.filter(F.col("grade") == c).orderBy(place, "id", "text").limit(n).select("text").collect()]
    return out


def buckets(keys: list[str], bits: int) -> list[int]:
    mask = (1 << bits) - 1
    return [xxhash.xxh3_64_intdigest(k) & mask for k in keys]
