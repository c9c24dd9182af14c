"""Mixing sources to target weights: budgets fitted exactly by counts of documents of each length."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.shared import stored
from assayer.operators import prefix

WORD = r"[^\x20\x09-\x0D]+"
#: Lengths up to this one take part in the dynamic program, for a rest of up to ``TABLE`` tokens or twice the longest of them.
MOST_LENGTH, TABLE = 1 << 16, 1 << 17
#: Documents of one source and length that are ranked in one task.
CELL = 1 << 16


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take, so that their total is near ``budget`` (0 to the total of all).

    ``lengths`` are distinct and falling. First every length gives its share of the budget, rounded down. What remains is
    less than the sum of the lengths, and every length that gave less than all has a document left; single documents
    are added from the longest on while they fit with room, then a bounded-knapsack dynamic program over the
    documents that are left finds the total nearest to the rest. Its table has one cell per token of the rest, which is then below
    a constant or two of the lengths used: its size does not depend on the number of documents. If one longer document comes nearer,
    it is taken instead.
    """
    total = int(sum(int(n) * int(c) for n, c in zip(lengths, counts)))
    taken = np.array([int(c) * budget // total if total and n else 0 for n, c in zip(lengths, counts)], np.int64)
    rest = budget - int(sum(int(n) * int(t) for n, t in zip(lengths, taken)))
    used = [int(n) for n in lengths if 0 < n <= MOST_LENGTH]
    room = max(used, default=0)
    aim = max(room, TABLE)
    for i, n in enumerate(lengths):
        spare = int(counts[i] - taken[i])
        if n and spare and rest - int(n) >= aim:
            more = 1 if n > MOST_LENGTH else min(spare, (rest - aim) // int(n))
            taken[i] += more
            rest -= more * int(n)
    small = [i for i, n in enumerate(lengths) if 0 < n <= MOST_LENGTH and taken[i] < counts[i]]
    if rest and small:
        top = rest + room
        mask = (1 << (top + 1)) - 1
        reach, items = 1, []
        first = np.full(top + 1, -1, np.int64)  # the item by which a total was first reached
        for i in small:
            left, part = min(int(counts[i] - taken[i]), top // int(lengths[i])), 1
            while left and not reach >> rest & 1:
                part = min(part, left)
                new = (reach << part * int(lengths[i])) & mask & ~reach
                bits = np.unpackbits(np.frombuffer(new.to_bytes(top // 8 + 1, "little"), np.uint8), bitorder="little")
                first[np.flatnonzero(bits[:top + 1])] = len(items)
                items.append((i, part))
                reach |= new
                left, part = left - part, part * 2
            if reach >> rest & 1:
                break
        sums = np.flatnonzero(first >= 0)
        sums = np.append(sums, 0)
        at = int(sums[np.lexsort((sums, np.abs(sums - rest)))[0]])
        rest -= at
        while at:
            i, part = items[first[at]]
            taken[i] += part
            at -= part * int(lengths[i])
    single = [i for i, n in enumerate(lengths) if taken[i] < counts[i] and abs(rest - int(n)) < abs(rest)]
    if single:
        taken[min(single, key=lambda i: (abs(rest - int(lengths[i])), i))] += 1
    return taken


def ranked(sources: DataFrame) -> DataFrame:
    """Sources (``none``, ``name``, ...) with ``rank`` from 0 in code-point order, null last.

    A range partitioning sorts them; one row per partition is all that meets in one task.
    """
    order = ["none", "name"]
    placed = stored(sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    local = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return placed.withColumn("local", local).join(starts, "part").withColumn("rank", F.col("start") + F.col("local")).drop("part", "start", "local")


def targets(sources: DataFrame, pattern: tuple[int, ...] = (1, 2, 3), most: int = 3, share: float = 1.0) -> DataFrame:
    """Adds ``target``: the weighted share of all sizes, at most ``most`` times the source's own (``source_size``).

    Weights repeat ``pattern`` in the order of ``rank``. The excess of sources at their limit is reshared by weight until none is
    above; only two sums reach the driver in each round.
    """
    weight = F.element_at(F.array(*map(F.lit, pattern)), (F.col("rank") % len(pattern) + 1).cast("int"))
    weighed = stored(sources.withColumn("weight", weight.cast("double")), "weights")
    limit = F.col("source_size") * F.lit(float(most))
    all_sizes = (weighed.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = 0.0, None
    while True:
        above = F.col("weight") * F.lit(level) > limit
        held, free, n = weighed.agg(F.sum(F.when(above, limit)), F.sum(F.when(~above, F.col("weight"))), F.count_if(above)).first()
        if n == full or not free:
            break
        full, level = n, (all_sizes - (held or 0.0)) / free
    return weighed.withColumn("target", F.least(limit, F.col("weight") * F.lit(level))).drop("weight")


def budgets(lengths: DataFrame, most: int) -> DataFrame:
    """(none, name, size, epochs, extra): whole copies of every document of a source and how many of each length come once more.

    A group is the lengths of one source with their counts: at most the square root of twice its tokens, however many documents it has.
    """
    schema = "none boolean, name string, size long, n long, epochs long, extra long, source_size long, target double"
    out = pa.schema([("none", pa.bool_()), ("name", pa.string()), ("size", pa.int64()), ("n", pa.int64()), ("epochs", pa.int64()),
                     ("extra", pa.int64()), ("source_size", pa.int64()), ("target", pa.float64())])

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending")])
        sizes, counts = (table.column(c).to_numpy() for c in ("size", "n"))
        total, target = table.column("source_size")[0].as_py(), table.column("target")[0].as_py()
        wanted = round(target)
        epochs = min(most, wanted // total) if total else 0
        extra = fit_budget(sizes, counts, wanted - epochs * total) if epochs < most else np.zeros(len(sizes), np.int64)
        columns = {"epochs": pa.array([epochs] * len(sizes), pa.int64()), "extra": pa.array(extra, pa.int64())}
        return pa.table([columns.get(f.name, table.column(f.name) if f.name in table.column_names else None) for f in out], schema=out)

    return lengths.groupBy("none", "name").applyInArrow(fit, schema)


def word_count(text: str) -> Column:
    """Words of a text between the six white-space characters of ASCII; null has none."""
    return F.coalesce(F.expr(f"regexp_count({text}, r'{WORD}')"), F.lit(0)).cast("long")


def mix(docs: DataFrame, pattern: tuple[int, ...] = (1, 2, 3), most: int = 3, share: float = 1.0, seed: int = 12,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: id, source, size, source_size, target, copies (0 to ``most``).

    The copies of a source's documents have a total size near its target: all documents ``epochs`` times, and once more
    those that ``fit_budget`` counts for each length. Which documents of a length these are is decided by a seeded hash
    of id and text, so reruns agree. A source of any size is spread: lengths are counted in the tasks, and documents of one
    source and length are ranked in cells of about ``CELL`` rows.

    Null text has size 0, the null source is a source of its own (the last), null and repeated ids stay as they are; rows of
    equal id, text and source are alike, and any of them may be the one taken. An empty table gives no rows. Other columns
    are left out, whatever their names.
    """
    name = F.col(source_col).cast("string")
    id_, text = F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(id_.alias("id"), name.isNull().alias("none"), F.coalesce(name, F.lit("")).alias("name"), text.alias("text")).select(
        "id", "none", "name", word_count("text").alias("size"), F.xxhash64(F.lit(seed), "id", "text").alias("place"))
    narrow = stored(narrow, "sizes")
    lengths = stored(narrow.groupBy("none", "name", "size").agg(F.count(F.lit(1)).alias("n")), "lengths")
    sources = lengths.groupBy("none", "name").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    aimed = targets(ranked(sources), pattern, most, share).drop("rank")
    plan = stored(budgets(lengths.join(aimed, ["none", "name"]), most), "plan")
    cells = F.ceil(F.col("n") / F.lit(CELL))
    # the upper bits of the hash as a number from 0 to 1
    place = F.shiftrightunsigned("place", 11).cast("double") / F.lit(float(1 << 53))
    met = narrow.join(plan, ["none", "name", "size"]).withColumn("cell", F.floor(place * cells))
    some = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    numbered = prefix.row_numbers(met.filter(some), ["none", "name", "size"], [F.col("cell")],
                                  [F.shiftrightunsigned("place", 11), F.col("place"), F.col("id")], "number")
    rest = met.filter(~some).withColumn("number", F.lit(1).cast("long"))  # all of a length or none
    copies = F.col("epochs") + (F.col("number") <= F.col("extra")).cast("long")
    return numbered.unionByName(rest).select(
        F.col("id").alias(id_col), F.when(~F.col("none"), F.col("name")).alias(source_col), "size", "source_size", "target", copies.alias("copies"))
