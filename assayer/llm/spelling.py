"""Spelling variants: words one edit apart, found as equal pairs of trie nodes."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.arrowio import bound_batches, rows, slices
from assayer.llm.shared import release, stored

LETTERS = "A-Za-zÀ-ÿ"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Characters of a text that are cut into words at once, and words that a task counts before it hands them on.
CHUNK, HELD = 1 << 20, 200_000


def chunks(text: str, breaks: re.Pattern, size: int = CHUNK) -> Iterator[str]:
    """A text in parts near ``size`` characters, cut where no word is."""
    start = 0
    while len(text) - start > size:
        end = breaks.search(text, start + size)
        if not end:
            break
        yield text[start:end.start()]
        start = end.start()
    yield text[start:] if start else text


def word_counts(docs: DataFrame, least_length: int = 6, least_count: int = 5, skip: int = 199, letters: str = LETTERS,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): how often each word of at least ``least_length`` code points occurs, if ``least_count`` times or more.

    Words are maximal runs of ``letters`` with A-Z in lower case. Where ``skip`` divides the crc32 of ``<id>:<run>`` the run
    loses one code point, at the place that number modulo its length; a null id changes no run, null text has none. Each
    task adds up its own counts and Spark adds up those of the tasks.
    """
    runs, breaks = re.compile(f"[{letters}]+"), re.compile(f"[^{letters}]")
    out = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batches):
        held: dict[str, int] = {}
        for part in slices(batches, "text"):
            for id_, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
                if not text:
                    continue
                own: dict[str, int] = {}
                for chunk in chunks(text, breaks):
                    for run in runs.findall(chunk.translate(LOWER)):
                        own[run] = own.get(run, 0) + 1
                start = None if id_ is None else zlib.crc32(f"{id_}:".encode())
                for run, n in own.items():
                    if start is not None:
                        h = zlib.crc32(run.encode(), start)
                        if h % skip == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1:]
                    if len(run) >= least_length:
                        held[run] = held.get(run, 0) + n
                if len(held) > HELD:
                    yield rows(out, list(held), list(held.values()))
                    held = {}
        if held:
            yield rows(out, list(held), list(held.values()))

    bound_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    counts = narrow.mapInArrow(count, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def merged(left: DataFrame, right: DataFrame, keys: str | list[str], how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` where both are dealt by key, whatever size Spark expects of them.

    It sizes a written table by its compressed bytes, and exploded rows by the rows before, so tables of hundreds of megabytes
    that grow with the words would go through the driver to every task.
    """
    return left.join(right.hint("merge"), keys, how)


def trie_nodes(places: DataFrame, text: str, node: str) -> DataFrame:
    """``places`` with the number of the trie node at the end of the path ``text`` as ``node``.

    Nodes of depth 0 to 2, which may stand above a third of all words, are numbered by their code points, without a look
    at any other row. A deeper node gets a number in the table of the distinct paths.
    """
    short = F.char_length(text) <= 2
    first, second = (F.ascii(F.substring(text, i, 1)).cast("long") for i in (1, 2))
    shallow = places.filter(short).withColumn(node, first * (1 << 21) + second)
    deep = places.filter(~short)
    numbers = stored(deep.select(text).distinct().withColumn(node, F.monotonically_increasing_id() + F.lit(1 << 43)), "nodes")
    return merged(deep, numbers, text).select(*places.columns, node).unionByName(shallow)


def pair_dictionary(words: DataFrame) -> DataFrame:
    """(word, n, at, skipped, prefix, suffix): pairs of a forward and a backward trie node for each place of each word.

    With ``skipped`` the nodes are those before and after the code point at ``at``; else those on both sides of the gap at ``at``.
    A code point that equals the one before it has no ``first``: leaving it out gives the same word.
    """
    size = F.char_length("word")
    gaps = words.select("word", "n", F.explode(F.sequence(F.lit(0), size)).alias("at"))
    both = gaps.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("skipped")).filter(~F.col("skipped") | (F.col("at") < size))
    here, before = (F.substring(F.col("word"), F.col("at") + k, F.lit(1)) for k in (1, 0))
    paths = both.select(
        "word", "n", "at", "skipped", (~F.col("skipped") | (F.col("at") == 0) | (here != before)).alias("first"),
        F.left("word", F.col("at")).alias("head"),
        F.reverse(F.substring(F.col("word"), F.col("at") + F.when(F.col("skipped"), 2).otherwise(1), size)).alias("tail"))
    return trie_nodes(trie_nodes(paths, "head", "prefix"), "tail", "suffix").drop("head", "tail")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near, near_n): each pair of words one inserted, deleted or replaced code point apart, in both directions.

    Words that differ in one code point have the same pair of nodes around it. A word without one of its code points is
    another word if its pair around the skipped place is the other's pair at a gap. A pair of nodes belongs to at most as many
    words as there are letters, and every match is a result.
    """
    pairs = stored(pair_dictionary(words), "pairs")
    keys = ["prefix", "suffix"]
    skip, gap = pairs.filter("skipped"), pairs.filter("not skipped")
    other = skip.select(*keys, F.col("word").alias("near"), F.col("n").alias("near_n"))
    replaced = merged(skip, other, keys).filter(F.col("word") != F.col("near")).select("word", "near", "near_n")
    whole = gap.select(*keys, F.col("word").alias("near"), F.col("n").alias("near_n"))
    edited = merged(skip.filter("first"), whole, keys).select("word", "n", "near", "near_n")
    return replaced.union(edited.select("word", "near", "near_n")).union(edited.select("near", "word", "n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form) without cycles: ``form`` followed to the last, in steps that double."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        then = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        met = merged(now, then, "root", "left")
        new = stored(met.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = new.drop("moved")
        if new.filter("moved").isEmpty():
            return now


def spelling_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for distinct words (word, n).

    The form is the near word of largest n (ties: the smallest in code-point order), if its n is at least ``ratio`` times the word's;
    as n grows from form to form, following them ends. Null words are left out; an empty table gives no rows.
    """
    words = stored(words.filter(F.col("word").isNotNull()).select("word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    near = neighbours(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    told = merged(words, near, "word", "left")
    takes = -F.col("best.less") >= F.col("n") * ratio
    told = stored(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("best.form")).alias("form"),
                              F.when(takes, -F.col("best.less")).alias("form_n")), "forms")
    release(told)
    last = roots(told.filter("form is not null").select("word", "form"))
    return merged(told, last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
