"""Members of large JSON objects, read by many tasks.

A file that is one object (``{"id": {...}, "id2": {...}, ...}``) has no lines at which it could be cut. Here Spark's
text reader cuts it after every closing brace instead, so it deals out byte ranges of a file of any size on any store that it can
read. What a brace or comma means depends on all that stands before it, so the work is done in two passes:

1. Each range is summed up for both cases, that it begins outside or inside a string: does its end lie in the other of the two, and how
   many brackets more than closed does it open. These sums, one small row per range, give the true state at the start of each range.
2. Each range, knowing its state, gives the members that lie in it whole, and the pieces of those that cross its borders,
   which are then put together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.session import materialise, path_exists

BRACE = b"}"
OPEN, CLOSE, COMMA, QUOTE, BACKSLASH = (ord(c) for c in ("{", "}", ",", '"', "\\"))
SQUARE_OPEN, SQUARE_CLOSE = ord("["), ord("]")
SUMS = "path string, block long, size long, bytes long, turn int, outside long, inside long"
SUM_TYPES = pa.schema([("path", pa.string()), *[(c, pa.int32() if c == "turn" else pa.int64()) for c in ("block", "size", "bytes", "turn", "outside", "inside")]])
STARTS = "path string, block long, turn int, depth long, open boolean"
PARTS = "path string, block long, part string, value binary"


def _ranges(spark: SparkSession, path: str) -> DataFrame:
    """(value, path, block, size): the bytes up to each closing brace, in order inside a range (``block`` is where it starts)."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path, lineSep=BRACE.decode())
    meta = F.col("_metadata")
    return raw.select(F.col("value").cast("binary").alias("value"), meta["file_path"].alias("path"), meta["file_block_start"].alias("block"),
                      meta["file_size"].alias("size"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int, int], bytes]]:
    """((path, block, size), bytes) of each stretch of rows of one range: rows joined by the braces that parted them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        path = batch.column("path").dictionary_encode()
        place, block = path.indices.to_numpy(), batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(place) != 0) | (np.diff(block) != 0)) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            key = path.dictionary[int(place[i])].as_py(), int(block[i]), batch.column("size")[i].as_py()
            yield key, BRACE.join(batch.column("value").slice(i, j - i).to_pylist())


def marks(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of brackets and commas, whether an odd number of quotes stands before each, and whether it does at the end."""
    quotes = raw == QUOTE
    slashes = raw == BACKSLASH
    if slashes.any():
        place = np.arange(len(raw))
        solid = np.maximum.accumulate(np.where(slashes, -1, place))  # the last byte that is no backslash
        before = np.r_[-1, solid[:-1]]
        quotes &= (place - 1 - before) % 2 == 0
    odd = np.cumsum(quotes, dtype=np.int64) & 1
    at = np.flatnonzero((raw == OPEN) | (raw == CLOSE) | (raw == COMMA) | (raw == SQUARE_OPEN) | (raw == SQUARE_CLOSE))
    return at, odd[at], int(odd[-1]) if len(raw) else 0


def steps(kinds: np.ndarray) -> np.ndarray:
    return ((kinds == OPEN) | (kinds == SQUARE_OPEN)).astype(np.int64) - ((kinds == CLOSE) | (kinds == SQUARE_CLOSE))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, list[int]] = {}
    for key, run in _runs(batches):
        raw = np.frombuffer(run + BRACE, np.uint8)
        at, odd, turn = marks(raw)
        step = steps(raw[at])
        change = [int(step[odd == k].sum()) for k in (0, 1)]
        s = held.setdefault(key, [0, 0, 0, 0])
        s[0] += len(raw)
        s[2] += change[s[1]]
        s[3] += change[1 - s[1]]
        s[1] ^= turn
    rows = [(*key, *s) for key, s in held.items()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["path", "block", "size", "bytes", "turn", "outside", "inside"]).cast(SUM_TYPES)


def _starts(sums: DataFrame) -> DataFrame:
    """State at the start of each range of a file; ``open`` marks the last one if the file does not end with a brace."""
    names = [f.split()[0] for f in STARTS.split(", ")]

    def follow(table: pa.Table) -> pa.Table:
        rows, out, turn, depth = table.sort_by("block").to_pylist(), [], 0, 0
        extra = sum(r["bytes"] for r in rows) - rows[0]["size"]
        for r in rows:
            out.append((r["path"], r["block"], turn, depth, extra == 1 and r is rows[-1]))
            depth += r["inside"] if turn else r["outside"]
            turn ^= r["turn"]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.bool_()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return sums.groupBy("path").applyInArrow(follow, STARTS)


class Reader:
    """Members and pieces of members of one range, whose text comes in stretches."""

    def __init__(self, turn: int, depth: int):
        self.turn, self.depth = turn, depth
        self.held = [b""] if depth > 0 else None  # text since the last border, or outside of any object
        self.crossed = depth > 0  # that border lies before this range

    def take(self, run: bytes) -> Iterator[tuple[str, bytes]]:
        raw = np.frombuffer(run, np.uint8)
        at, odd, turn = marks(raw)
        out = odd == self.turn
        at = at[out]
        kinds = raw[at]
        step = steps(kinds)
        depth = self.depth + np.cumsum(step)
        border = ((kinds == OPEN) & (depth == 1)) | ((kinds == COMMA) & (depth == 1)) | ((kinds == CLOSE) & (depth == 0))
        last = 0
        for place, kind in zip(at[border].tolist(), kinds[border].tolist()):
            if kind != OPEN and self.held is not None:
                self.held.append(run[last:place])
                yield "head" if self.crossed else "whole", b"".join(self.held)
            self.held = None if kind == CLOSE else [b""]
            self.crossed, last = False, place + 1
        if self.held is not None:
            self.held.append(run[last:])
        self.turn ^= turn
        if len(depth):
            self.depth = int(depth[-1])

    def end(self) -> Iterator[tuple[str, bytes]]:
        if self.held is not None:
            yield "middle" if self.crossed else "tail", b"".join(self.held)


def members(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, complete): one row per member of the objects in the files, as its JSON text ``"key": value``.

    The last member of a file that breaks off is not ``complete``. A range is as large as ``spark.sql.files.maxPartitionBytes``; a task
    holds a few of its members at a time, and the driver one row of some hundred bytes per range. Several objects in one file
    are read one after the other. A compressed file is one range. A missing path gives no rows.
    """
    empty = "path string, text string, complete boolean"
    if not path_exists(spark, path):
        return spark.createDataFrame([], empty)
    ranges = _ranges(spark, path)
    sums = materialise(ranges.mapInArrow(_sums, SUMS), "json-sums")
    known = {(r.path, r.block): (r.turn, r.depth, r.open) for r in _starts(sums).collect()}
    shared = spark.sparkContext.broadcast(known)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers: dict[tuple, Reader] = {}
        found: list[tuple] = []

        def batch() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.string(), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["path", "block", "part", "value"])
            found.clear()
            return out

        for (path_, block, _), run in _runs(batches):
            reader = readers.get((path_, block))
            if reader is None:
                reader = readers[path_, block] = Reader(*shared.value[path_, block][:2])
            else:
                run = BRACE + run  # the one that ended the stretch before
            found += [(path_, block, *x) for x in reader.take(run)]
            if found:
                yield batch()
        for (path_, block), reader in readers.items():
            if not shared.value[path_, block][2]:
                found += [(path_, block, *x) for x in reader.take(BRACE)]
            found += [(path_, block, *x) for x in reader.end()]
        if found:
            yield batch()

    parts = materialise(ranges.mapInArrow(cut, PARTS), "json-parts")
    whole = parts.filter("part = 'whole'").select("path", F.col("value").cast("string").alias("text"), F.lit(True).alias("complete"))
    # a member that crosses borders: a tail, perhaps whole ranges, a head; only names and places pass the window
    broken = parts.filter("part <> 'whole'").withColumn("late", (F.col("part") == "tail").cast("int"))
    order = Window.partitionBy("path").orderBy("block", "late").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owners = broken.select("path", "block", "late", F.last(F.when(F.col("late") == 1, F.col("block")), ignorenulls=True).over(order).alias("owner"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "late", F.col("value").cast("string").alias("value")))),
                                    lambda x: x["value"]), "")
    joined = broken.join(owners, ["path", "block", "late"]).groupBy("path", "owner").agg(
        text.alias("text"), F.max(F.col("part") == "head").alias("complete")).select("path", "text", "complete")
    return whole.unionByName(joined).filter(F.trim("text") != "").withColumn("text", F.make_valid_utf8("text"))
