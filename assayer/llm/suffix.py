"""Repeated passages removed: suffixes sorted into buckets that are refined by bucket identifiers of later offsets.

A bucket identifier names the suffixes that agree in their first q bytes. The initial buckets have q = 24; an
identifier of 32 bytes is made from the identifiers at an offset and 8 bytes later, one of 50 bytes from those of 32
bytes at an offset and 18 bytes later, and so on, down to single bytes. Identifiers are fingerprints of content, so that
they are the same in every task, and a sort on them brings a bucket together.

Only suffixes that some window of the length sought picks (its smallest identifier) enter the sort, about one in
fourteen; equal windows pick equal suffixes at equal places. What a block of documents knows of a bucket is combined
before the sort, so a passage in every document is one row per block, not one per document.
"""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.arrowio import bound_batches
from assayer.llm.shared import release, stored

LENGTH, GRAM = 50, 24
REACH = LENGTH - GRAM + 1  # suffixes among which a window picks
RIGHT = LENGTH - 33  # windows that begin up to this far before the pick hold the 33 bytes from it on
PIECE = 1 << 17  # arrays of a piece stay in a core's cache
BLOCK_BYTES = 4 << 20
PRIME = np.uint64(0x9E3779B97F4A7C15)
BYTES = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)
LOW = np.uint64((1 << 24) - 1)


def pair(a: np.ndarray, b) -> np.ndarray:
    """Identifier of a bucket from two identifiers of its parts, in order."""
    x = (a * PRIME) ^ (b + (b >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Piece:
    """Some whole documents (or a part of a very long one) as one run of bytes with their picked suffixes.

    ``first``, ``last`` are the first and last start of the windows that pick the suffix at ``pick``.
    """

    def __init__(self, data: np.ndarray, owner: np.ndarray):
        self.data, self.owner = data, owner
        n = len(data) - LENGTH + 1
        none = np.zeros(0, np.int64)
        self.first = self.last = self.pick = none
        self.gram = np.zeros(0, np.uint64)
        if n <= 0:
            return
        ids, size = BYTES[data], 1
        while 2 * size <= GRAM:
            ids = pair(ids[:-size], ids[size:])
            size *= 2
        if size < GRAM:
            ids = pair(ids[:size - GRAM], ids[GRAM - size:])
        self.gram = ids
        least = (ids & ~LOW) | np.arange(len(ids), dtype=np.uint64)
        size = 1
        while 2 * size <= REACH:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < REACH:
            least = np.minimum(least[:size - REACH], least[REACH - size:])
        least = least[:n]
        whole = owner[:n] == owner[LENGTH - 1:]
        change = least[1:] != least[:-1]
        begin = whole & np.r_[True, change | ~whole[:-1]]
        end = whole & np.r_[change | ~whole[1:], True]
        self.first, self.last = np.flatnonzero(begin), np.flatnonzero(end)
        self.pick = (least[self.first] & LOW).astype(np.int64)

    def id32(self, at):
        return pair(self.gram[at], self.gram[at + 32 - GRAM])

    def id50(self, at):
        return pair(self.id32(at), self.id32(at + 18))

    def other50(self, at: np.ndarray) -> np.ndarray:
        """A second fingerprint of 32 bits, straight from the bytes of the windows."""
        out = np.zeros(len(at), np.uint64)
        view = sliding_window_view(self.data, LENGTH)
        for i in range(0, len(at), 100_000):
            wide = np.zeros((len(at[i:i + 100_000]), 56), np.uint8)
            wide[:, :LENGTH] = view[at[i:i + 100_000]]
            for column in wide.view("<u8").T:
                out[i:i + 100_000] = pair(out[i:i + 100_000] + PRIME, column)
        return out >> np.uint64(32)

    def halves(self, chosen):
        """(name, first, last, suffix) of the two kinds of windows around each chosen suffix.

        Windows that begin near the suffix share the 33 bytes from it on, those that begin earlier the 42 bytes
        that end with its gram: the name is the identifier of these bytes.
        """
        p, first, last = self.pick[chosen], self.first[chosen], self.last[chosen]
        out = []
        for near in (True, False):
            a = np.maximum(first, p - RIGHT) if near else first
            b = last if near else np.minimum(last, p - RIGHT - 1)
            some = a <= b
            a, b, at = a[some], b[some], p[some]
            name = pair(self.id32(at), self.id32(at + 1)) if near else ~pair(self.id32(at - RIGHT - 1), self.id32(at + GRAM - 32))
            out.append((name, a, b, at))
        return [np.concatenate(x) for x in zip(*out)]

    def contexts(self, a, b, at):
        """Identifiers of all bytes of the windows from a to b and of the place of the suffix in them."""
        place = ((at - a) * 64 + (b - a)).astype(np.uint64)
        return pair(pair(self.id50(a), self.id50(b)), place)


def pieces(table: pa.Table):
    """(first row, offset in it, piece) over the rows of a block, a few megabytes at a time."""
    texts = [(t or "").encode("utf-8", "surrogatepass") for t in table.column("text").to_pylist()]
    held, start, size = [], 0, 0

    def made():
        data = np.frombuffer(b"".join(held), np.uint8)
        return Piece(data, np.repeat(np.arange(len(held)), [len(x) for x in held]))

    for i, text in enumerate(texts):
        if len(text) > PIECE:
            if held:
                yield start, 0, made()
            for offset in range(0, len(text) - LENGTH + 1, PIECE):
                part = np.frombuffer(text[offset:offset + PIECE + LENGTH - 1], np.uint8)
                yield i, offset, Piece(part, np.zeros(len(part), np.int64))
            held, start, size = [], i + 1, 0
            continue
        if size + len(text) > PIECE and held:
            yield start, 0, made()
            held, start, size = [], i, 0
        held.append(text)
        size += len(text)
    if held:
        yield start, 0, made()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _unsigned(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).to_numpy().astype(np.int64, copy=False).view(np.uint64)


def _groups(*keys: np.ndarray):
    """Order by keys and the starts of runs of equal keys in it."""
    order = np.lexsort(keys[::-1])
    if not len(order):
        return order, np.zeros(0, np.int64)
    change = np.zeros(len(order), bool)
    change[0] = True
    for k in keys:
        k = k[order]
        change[1:] |= k[1:] != k[:-1]
    return order, np.flatnonzero(change)


def _held(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in sorted distinct keys, -1 if absent."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def _table(schema: pa.Schema, *columns) -> pa.Table:
    return pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)],
                                schema=schema)


def _schema(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[t]) for n, t in (x.split(" ") for x in text.split(", "))])


GRAMS = "block long, gram long, several boolean"
NAMES = "block long, name long, low long, several boolean, context long, mixed boolean"
WINDOWS = "block long, one long, two long, low long, several boolean"
RESULT = "id long, key binary, n_bytes long, starts array<long>, ends array<long>, kept binary"


def _block_of(table: pa.Table) -> int:
    return table.column("block")[0].as_py()


def _grams(table: pa.Table) -> pa.Table:
    """The buckets of a block, and whether more than one of its documents is in each."""
    ids = table.column("id").to_numpy()
    found = [(p.gram[p.pick], ids[row + p.owner[p.pick]]) for row, _, p in pieces(table)]
    gram, doc = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    order, runs = _groups(gram)
    several = np.minimum.reduceat(doc[order], runs) != np.maximum.reduceat(doc[order], runs) if len(runs) else np.zeros(0, bool)
    return _table(_schema(GRAMS), np.full(len(runs), _block_of(table)), _signed(gram[order][runs]), several)


def _names(docs: pa.Table, grams: pa.Table) -> pa.Table:
    """Refined buckets of the suffixes whose gram is shared: smallest document, and whether it is one of several; the
    context, and whether it is one of several."""
    schema = _schema(NAMES)
    if not docs.num_rows or not grams.num_rows:
        return schema.empty_table()
    ids, shared = docs.column("id").to_numpy(), np.unique(_unsigned(grams, "gram"))
    parts = []
    for row, _, p in pieces(docs):
        name, a, b, at = p.halves(_held(shared, p.gram[p.pick]) >= 0)
        parts.append((name, p.contexts(a, b, at), ids[row + p.owner[a]]))
    name, context, doc = (np.concatenate(x) for x in zip(*parts))
    order, runs = _groups(name)
    if not len(runs):
        return schema.empty_table()
    doc, context = doc[order], context[order]
    least, most = np.minimum.reduceat(context, runs), np.maximum.reduceat(context, runs)
    low = np.minimum.reduceat(doc, runs)
    return _table(schema, np.full(len(runs), _block_of(docs)), _signed(name[order][runs]), low,
                  low != np.maximum.reduceat(doc, runs), _signed(least), least != most)


def _windows(docs: pa.Table, names: pa.Table) -> pa.Table:
    """Every window of the refined buckets whose contexts differ, once per block."""
    schema = _schema(WINDOWS)
    if not docs.num_rows or not names.num_rows:
        return schema.empty_table()
    ids, mixed = docs.column("id").to_numpy(), np.unique(_unsigned(names, "name"))
    grams = []
    for row, _, p in pieces(docs):
        name, a, b, _ = p.halves(slice(None))
        in_ = _held(mixed, name) >= 0
        at = _spread(a[in_], b[in_])
        grams.append((p.id50(at), p.other50(at), ids[row + p.owner[at]]))
    one, two, doc = (np.concatenate(x) for x in zip(*grams))
    order, runs = _groups(one, two)
    if not len(runs):
        return schema.empty_table()
    low = np.minimum.reduceat(doc[order], runs)
    return _table(schema, np.full(len(runs), _block_of(docs)), _signed(one[order][runs]), _signed(two[order][runs]), low,
                  low != np.maximum.reduceat(doc[order], runs))


def _spread(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All integers of the ranges a..b."""
    n = b - a + 1
    return np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(a) else np.zeros(0, np.int64)


def _removed(docs: pa.Table, told: pa.Table) -> pa.Table:
    """Bytes to remove: ranges of whole buckets and single windows whose smallest document is a smaller one."""
    schema = _schema(RESULT)
    if not docs.num_rows:
        return schema.empty_table()
    kind = told.column("kind").to_numpy()
    one, two, low = _unsigned(told, "one"), _unsigned(told, "two"), told.column("low").to_numpy()

    def sorted_by(k):
        order = np.lexsort((two[kind == k], one[kind == k]))
        return one[kind == k][order], two[kind == k][order], low[kind == k][order]

    (name, _, name_low), (mixed, _, _), (w1, w2, w_low) = sorted_by(0), sorted_by(1), sorted_by(2)
    ids = docs.column("id").to_numpy()
    texts = docs.column("text").to_pylist()
    texts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    edges: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for row, offset, p in pieces(docs) if len(kind) else ():
        if not len(p.pick):
            continue
        found, a, b, _ = p.halves(slice(None))
        doc = ids[row + p.owner[a]]
        at = _held(name, found)
        hit = (at >= 0) & (name_low[at] < doc) if len(name) else np.zeros(len(a), bool)
        starts, ends = [a[hit]], [b[hit] + LENGTH]
        if len(mixed) and len(w1):
            in_ = _held(mixed, found) >= 0
            spot = np.unique(_spread(a[in_], b[in_]))
            k1, k2 = p.id50(spot), p.other50(spot)
            at = np.searchsorted(w1, k1)
            hit = np.zeros(len(spot), bool)
            open_ = np.arange(len(spot))
            while len(open_):  # windows may share the first fingerprint
                here = at[open_]
                open_ = open_[here < len(w1)]
                open_ = open_[w1[at[open_]] == k1[open_]]
                same = w2[at[open_]] == k2[open_]
                hit[open_[same]] = w_low[at[open_[same]]] < ids[row + p.owner[spot[open_[same]]]]
                open_ = open_[~same]
                at[open_] += 1
            starts.append(spot[hit])
            ends.append(spot[hit] + LENGTH)
        start, end = np.concatenate(starts), np.concatenate(ends)
        owner = p.owner[start]
        base = np.r_[0, np.cumsum(np.bincount(p.owner))]
        order = np.argsort(owner, kind="stable")
        cut = np.flatnonzero(np.r_[True, np.diff(owner[order]) != 0]) if len(order) else []
        for i, j in zip(cut, [*cut[1:], len(order)]):
            o = owner[order[i]]
            edges.setdefault(row + int(o), []).append((start[order[i:j]] - base[o] + offset, end[order[i:j]] - base[o] + offset))
    out: list[list] = [[], [], [], [], []]
    for i, text in enumerate(texts):
        starts, ends = [], []
        if i in edges:
            s, e = (np.concatenate(x) for x in zip(*edges[i]))
            depth = np.zeros(len(text) + 1, np.int64)
            np.add.at(depth, s, 1)
            np.add.at(depth, e, -1)
            gone = np.r_[0, (np.cumsum(depth[:-1]) > 0).astype(np.int8), 0]
            turn = np.diff(gone)
            starts, ends = np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist()
            kept = b"".join(text[x:y] for x, y in zip([0, *ends], [*starts, len(text)]))
        else:
            kept = text
        for c, v in zip(out, (hashlib.sha256(text).digest()[:16], len(text), starts, ends, kept)):
            c.append(v)
    return _table(schema, ids, *out)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, key (128 bits of the SHA-256 of its text), n_bytes, starts and ends of the removed runs,
    and the kept bytes.

    A byte is removed if a string of 50 bytes over it also starts in a document of a smaller id; matches never cross
    documents and are judged on the texts as given. Four passes over the documents, grouped by a hash of the id into blocks of a
    few megabytes, and three sorts of what the blocks report: which grams lie in two documents; what the refined buckets
    of these hold (smallest document, and whether all their contexts are equal: then all their windows are decided at
    once); and the single windows of the other buckets.

    Ids are integers. Null text is empty; a row with a null id is in no order with others, so it loses nothing and
    takes nothing; rows that repeat an id are one document as far as matches go. An empty table gives no rows; other
    columns are left out.
    """
    bound_batches(docs.sparkSession)
    flat = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = flat.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = total // BLOCK_BYTES + 1
    block = F.pmod(F.xxhash64("id"), F.lit(n_blocks)).alias("block")
    some = flat.filter(F.col("id").isNotNull()).select("id", "text", block)

    grams = some.groupBy("block").applyInArrow(_grams, GRAMS)
    by = Window.partitionBy("gram")
    shared = grams.select("block", "gram", F.count(F.lit(1)).over(by).alias("n"), F.max("several").over(by).alias("several"))
    shared = stored(shared.filter((F.col("n") > 1) | F.col("several")).select("block", "gram"), "grams")
    release(shared)

    names = some.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_names, NAMES)
    by = Window.partitionBy("name")
    least = F.min("low").over(by)
    names = names.select(
        "block", "name", least.alias("low"), (F.col("several") | (least < F.col("low"))).alias("later"),
        (F.max("several").over(by) | (F.min("low").over(by) < F.max("low").over(by))).alias("shared"),
        (F.max("mixed").over(by) | (F.min("context").over(by) != F.max("context").over(by))).alias("mixed"))
    # a block in which no document comes later only matters as the source of single windows
    names = stored(names.filter("shared AND (later OR mixed)").select("block", "name", "low", "mixed"), "names")
    release(names)

    windows = some.groupBy("block").cogroup(names.filter("mixed").select("block", "name").groupBy("block")).applyInArrow(
        _windows, WINDOWS)
    by = Window.partitionBy("one", "two")
    least = F.min("low").over(by)
    windows = windows.select("block", "one", "two", least.alias("low"), (F.col("several") | (least < F.col("low"))).alias("later"))
    windows = stored(windows.filter("later").select("block", "one", "two", "low"), "windows")
    release(windows)

    zero = F.lit(0).cast("long")
    told = names.select("block", F.when(F.col("mixed"), 1).otherwise(0).cast("long").alias("kind"),
                        F.col("name").alias("one"), zero.alias("two"), "low").union(
        windows.select("block", F.lit(2).cast("long").alias("kind"), "one", "two", "low"))
    done = some.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_removed, RESULT)
    none = F.array().cast("array<long>")
    free = flat.filter(F.col("id").isNull()).select(
        "id", F.unhex(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32)).alias("key"),
        F.octet_length("text").cast("long").alias("n_bytes"), none.alias("starts"), none.alias("ends"),
        F.col("text").cast("binary").alias("kept"))
    return done.union(free).withColumnRenamed("id", id_col)


def kept_text(kept: str) -> Column:
    """Kept bytes as text; parts of a character cut in two are left out."""
    @F.pandas_udf("string")
    def decoded(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: bytes(b or b"").decode("utf-8", "ignore"))

    return decoded(kept)
