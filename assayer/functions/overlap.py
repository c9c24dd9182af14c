"""Overlap of a candidate text with a reference text: BLEU-4 and ROUGE-L."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from assayer.functions.text import words
from assayer.session import tasks

#: Characters of both sides whose n-grams one task counts.
TASK_CHARS = 1 << 19


def _grams(tokens: Column, n: int) -> Column:
    empty = F.array().cast("array<string>")
    return F.when(F.size(tokens) >= n, F.transform(
        F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(empty)


def bleu4(pairs: DataFrame, key: str, candidate: str, reference: str) -> DataFrame:
    """BLEU-4 per pair with clipped n-gram counts; orders above 1 are smoothed by one.

    n-grams of both sides are counted together per pair, order and gram, so the
    clipped overlap is an aggregate and no join is needed. Texts are placed by
    key in as many tasks as their length asks for; their n-grams stay there.
    """
    chars = pairs.agg(F.sum(F.coalesce(F.length(candidate), F.lit(0)) + F.coalesce(F.length(reference), F.lit(0)))).first()[0]
    placed = pairs.select(key, candidate, reference).repartition(tasks(pairs.sparkSession, chars, TASK_CHARS), key)
    t = placed.select(key, words(F.col(candidate)).alias("c"), words(F.col(reference)).alias("r"))
    sides = t.select(key, F.size("c").alias("c_len"), F.size("r").alias("r_len"), F.inline(F.array(*[
        F.struct(F.lit(n).alias("n"), F.lit(side).alias("side"), _grams(F.col(side), n).alias("grams"))
        for n in range(1, 5) for side in ("c", "r")])))
    counts = sides.select(key, "c_len", "r_len", "n", "side", F.explode("grams").alias("gram")).groupBy(key, "n", "gram").agg(
        F.count_if(F.col("side") == "c").alias("c"), F.count_if(F.col("side") == "r").alias("r"))
    orders = counts.groupBy(key, "n").agg(F.sum(F.least("c", "r")).alias("hit"), F.sum("c").alias("all"))
    smooth = F.when(F.col("n") > 1, 1).otherwise(0)
    p = (F.col("hit") + smooth) / (F.col("all") + smooth)
    logs = orders.groupBy(key).agg(
        F.sum(F.when(p > 0, F.ln(p)).otherwise(F.lit(0.0))).alias("logs"),
        F.bool_or((F.col("n") == 1) & (F.col("hit") == 0)).alias("none"), F.count(F.lit(1)).alias("n_orders"))
    sizes = t.select(key, F.size("c").alias("c_len"), F.size("r").alias("r_len"))
    j = sizes.join(logs, key, "left")
    brevity = F.when(F.col("c_len") >= F.col("r_len"), F.lit(1.0)).otherwise(F.exp(1 - F.col("r_len") / F.col("c_len")))
    return j.select(key, F.when((F.col("c_len") == 0) | F.coalesce("none", F.lit(True)), F.lit(0.0)).otherwise(
        brevity * F.exp(F.col("logs") / 4)).alias("bleu"))


def common_length(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a machine word of places at a time.

    Bit j of ``row`` is 0 where the best length rises at place j of ``b``; a token of ``a`` moves such places by one addition
    over the whole row.
    """
    places: dict[int, int] = {}
    for j, token in enumerate(b):
        places[token] = places.get(token, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for token in a:
        hit = row & places.get(token, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def rouge_l(pairs: DataFrame, key: str, candidate: str, reference: str) -> DataFrame:
    """``key, rouge_l``: F-measure of the longest common subsequence of two columns of token arrays; NULL and empty give 0.

    Tokens are numbered once per Arrow batch, for all its pairs together; a pair needs one bit per token of its shorter side.
    """
    kind = to_arrow_type(pairs.schema[key].dataType)
    out = pa.schema([(key, kind), ("rouge_l", pa.float64())])

    def score(a: list[int], b: list[int]) -> float:
        n = common_length(*((a, b) if len(b) <= len(a) else (b, a))) if a and b else 0
        p, r = (n / len(a), n / len(b)) if n else (0.0, 0.0)
        return 2 * p * r / (p + r) if n else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch.column(c) for c in ("c", "r")]
            codes = pa.concat_arrays([s.flatten() for s in sides]).dictionary_encode().indices.to_pylist()
            lists, at = [], 0
            for s in sides:
                sizes = pc.fill_null(pc.list_value_length(s), 0).to_pylist()
                ends = list(accumulate(sizes, initial=at))
                lists.append([codes[i:j] for i, j in zip(ends, ends[1:])])
                at = ends[-1]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(list(map(score, *lists)), pa.float64())], schema=out)

    narrow = pairs.select(key, F.col(candidate).alias("c"), F.col(reference).alias("r"))
    return narrow.mapInArrow(run, f"`{key}` {pairs.schema[key].dataType.simpleString()}, rouge_l double")
