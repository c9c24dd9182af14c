"""Near duplicates by weighted Jaccard similarity of word shingles: BagMinHash signatures, bands, exact overlap."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.arrowio import bound_batches, give_back, map_slices, rows, slices, texts_of
from assayer.llm.components import components
from assayer.llm.exact import matching_rows
from assayer.llm.shared import release, stored

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
WIDTH = 5
#: Bytes of text or of lists that a step takes at once; what it makes of a text can be some times larger.
PIECE = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Hashes of words, forgotten when many are held."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def shingles(text: str, words: Words, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of ``width`` lower-case words and how often each occurs; a shorter text is one shingle."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    n = max(1, len(h) - width + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(width, len(h))):
        out = _mix(out * GOLDEN ^ h[i:i + n])
    return np.unique(out, return_counts=True)


def bag_minhash(elements: np.ndarray, weights: np.ndarray, m: int) -> np.ndarray:
    """``m`` values; two multisets agree in each with a chance equal to their weighted Jaccard similarity.

    The weight axis is cut into [0,1), [1,2), [2,4), ... Every element drives a Poisson process on each of these
    intervals that begins below its weight, at the rate of its length. A point of an interval is passed to one half of it at a
    time, by the bits of its hash, until it lies in a unit cell, and counts if that cell lies below the weight; so the points of
    a smaller weight are among those of a larger one. A point falls to a random component, and each component keeps
    its earliest point. Points later than a common bound are not made; the bound is doubled if a component has none.
    """
    if not len(elements):
        return np.zeros(m, np.uint64)
    level = np.zeros(len(elements), np.int64)
    seeds, lows, rates, tops = [elements], [level], [level + 1], [weights]
    k = 0
    more = weights > 1
    while more.any():  # interval [2^k, 2^(k+1))
        e, w = elements[more], weights[more]
        seeds.append(_mix(e + np.uint64(int(GOLDEN) * (k + 1) % 2**64)))
        lows.append(np.full(len(e), 1 << k))
        rates.append(np.full(len(e), 1 << k))
        tops.append(w)
        k += 1
        more = weights > (1 << k)
    seed, low, rate, top = (np.concatenate(x) for x in (seeds, lows, rates, tops))
    total = float(weights.sum())
    bound = m * (np.log(m) + 3) / total

    def arrivals(s: np.ndarray, r: np.ndarray, first: int, n: int):
        h = _mix(_mix(s)[:, None] + GOLDEN * np.arange(first, first + n, dtype=np.uint64))
        u = ((h >> np.uint64(11)).astype(np.float64) + 1) * 2.0 ** -53
        return h, -np.log(u) / r[:, None]

    while True:
        best = np.full(m, np.inf)
        _, gap = arrivals(seed, rate, 1, 1)
        live = np.flatnonzero(gap[:, 0] < bound)
        s, r, lo, hi = seed[live], rate[live], low[live], top[live]
        at, step = np.zeros(len(live)), 1
        while len(s):
            most = int(min(256, 4 + 1.5 * bound * float(r.mean())))
            h, gap = arrivals(s, r, step, most)
            x = np.cumsum(np.c_[at, gap], axis=1)[:, 1:]
            draw = _mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            cell = lo[:, None] + ((draw >> np.uint64(20)).astype(np.int64) & (r[:, None] - 1))
            ok = (x < bound) & (cell < hi[:, None])
            np.minimum.at(best, ((draw & np.uint64(0xFFFFF)) % np.uint64(m)).astype(np.int64)[ok], x[ok])
            on = x[:, -1] < bound
            s, r, lo, hi, at, step = s[on], r[on], lo[on], hi[on], x[on, -1], step + most
        if np.isfinite(best).all():
            return best.view(np.uint64)
        bound *= 2


def weighted_jaccard(a: tuple, b: tuple) -> tuple[int, int]:
    """Sums of the smaller and of the larger weights."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = int(np.minimum(a[1][i], b[1][j]).sum())
    return low, int(a[1].sum() + b[1].sum()) - low


def text_key(text_col: str = "text") -> Column:
    """128 bits of the SHA-256 of a text, null as the empty one: the name of all its copies."""
    return F.unhex(F.substring(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256), 1, 32))


def signatures(docs: DataFrame, bands: int, per_band: int, text_col: str = "text") -> DataFrame:
    """(key, bands, sig) per row with words: band hashes and one byte of each signature value."""
    m = bands * per_band
    out = pa.schema([("key", pa.binary()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])
    words = Words()

    def run(batch):
        keys, buckets, sigs = [], [], []
        for key, text in zip(batch.column("key").to_pylist(), texts_of(batch)):
            e, w = shingles(text, words)
            if not len(e):
                continue
            sig = _mix(bag_minhash(e, w, m))
            fold = np.arange(1, bands + 1, dtype=np.uint64)
            for column in sig.reshape(bands, per_band).T:
                fold = _mix(fold * GOLDEN ^ column)
            keys.append(key)
            buckets.append(fold.view(np.int64).tolist())
            sigs.append((sig & np.uint64(255)).astype(np.uint8).tobytes())
        return keys, buckets, sigs

    narrow = docs.select(text_key(text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return map_slices(narrow, "text", run, "key binary, bands array<long>, sig binary", out, PIECE)


#: Values of the longer signatures by which texts of crowded groups are told apart, and of those for texts of hot tokens.
SHARP, SHARPEST = 256, 2048


def screen_level(threshold: float, values: int) -> float:
    """The share of ``values`` in which a pair at the threshold agrees but for one case in a million."""
    return threshold - 4.8 * (threshold * (1 - threshold) / values) ** 0.5


def sharp_signatures(keys: DataFrame, docs: DataFrame, text_col: str = "text", values: int = SHARP) -> DataFrame:
    """(key, sig) of so many ``values`` for the texts of ``keys``."""
    texts = (docs.select(text_key(text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
             .join(keys.select("key"), "key", "left_semi").dropDuplicates(["key"]))
    out = pa.schema([("key", pa.binary()), ("sig", pa.binary())])
    words = Words()

    def run(batch):
        found = [_mix(bag_minhash(*shingles(text, words), values)) for text in texts_of(batch)]
        return batch.column("key"), [(x & np.uint64(255)).astype(np.uint8).tobytes() for x in found]

    return map_slices(texts, "text", run, "key binary, sig binary", out, PIECE)


def screened(pairs: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose signatures agree in at least the share ``least`` of their values."""
    both = (pairs.join(sigs.select(F.col("key").alias("a"), F.col("sig").alias("sa")), "a")
            .join(sigs.select(F.col("key").alias("b"), F.col("sig").alias("sb")), "b"))
    out = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if n:
                sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(n, -1) for c in ("sa", "sb"))
                keep = pa.array((sa == sb).mean(1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], schema=out)

    bound_batches(pairs.sparkSession)
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def verified(pairs: DataFrame, docs: DataFrame, threshold: float, text_col: str = "text") -> DataFrame:
    """Pairs whose exact weighted Jaccard similarity is at least ``threshold``, with it.

    The shingles of each text of a pair are counted once and written; a pair brings two sorted lists of hashes and counts,
    and a worker holds a few megabytes of them.
    """
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    texts = (docs.select(text_key(text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
             .join(wanted, "key", "left_semi").dropDuplicates(["key"]))
    words = Words()

    def count(batch):
        found = [shingles(text, words) for text in texts_of(batch)]
        return batch.column("key"), [e.tobytes() for e, _ in found], [w.astype("<u4").tobytes() for _, w in found]

    held = pa.schema([("key", pa.binary()), ("hashes", pa.binary()), ("counts", pa.binary())])
    bags = stored(map_slices(texts, "text", count, "key binary, hashes binary, counts binary", held, PIECE), "bags")
    release(bags)
    first, second = (bags.select(F.col("key").alias(side), F.col("hashes").alias(f"h{side}"), F.col("counts").alias(f"c{side}")) for side in "ab")
    both = pairs.join(first, "a").join(second, "b")
    out = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("similarity", pa.float64())])

    def run(batches):
        for batch in slices(slices(batches, "ha", PIECE), "hb", PIECE):
            kept = []
            for a, b, ha, ca, hb, cb in zip(*(batch.column(c) for c in ("a", "b", "ha", "ca", "hb", "cb"))):
                bag_a, bag_b = ((np.frombuffer(h.as_buffer(), np.uint64), np.frombuffer(c.as_buffer(), "<u4").astype(np.int64))
                                for h, c in ((ha, ca), (hb, cb)))
                low, high = weighted_jaccard(bag_a, bag_b)
                if high and low >= threshold * high - 1e-9:
                    kept.append((a.as_py(), b.as_py(), low / high))
            if kept:
                yield rows(out, *map(list, zip(*kept)))
        give_back()

    bound_batches(pairs.sparkSession)
    return both.select("a", "b", "ha", "ca", "hb", "cb").mapInArrow(run, "a binary, b binary, similarity double")


def _pairs(rows: DataFrame, bucket: str, small: int, fits: Column | None = None) -> DataFrame:
    """Pairs (a, b) inside buckets of ``bucket, key, n, lead`` that meet ``fits``.

    Up to ``small`` texts meet each other, which is at most half as many pairs per text; in a larger bucket every text meets
    the bucket's leader. With ``fits``, a condition on the columns of two such texts (``size_1``, ``size_2``, ...), rows also
    have ``root`` and ``lead_root``, and only texts of different components meet.
    """
    few = rows.filter(F.col("n") <= small)
    left, right = (few.select(bucket, *[F.col(c).alias(f"{c}_{s}") for c in few.columns if c != bucket]) for s in "12")
    met = left.join(right, bucket).filter(F.col("key_1") < F.col("key_2"))
    star = rows.filter((F.col("n") > small) & (F.col("key") != F.col("lead")))
    if fits is not None:
        met, star = met.filter("root_1 != root_2").filter(fits), star.filter("root != lead_root")
    return met.select(F.col("key_1").alias("a"), F.col("key_2").alias("b")).union(star.select(
        F.least("key", "lead").alias("a"), F.greatest("key", "lead").alias("b"))).distinct()


def tokens(elements: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A multiset as a set: one token for the first, second, ... copy of each element."""
    first = np.repeat(np.cumsum(weights) - weights, weights)
    return _mix(np.repeat(elements, weights) ^ _mix((np.arange(len(first)) - first).astype(np.uint64)))


def rare_tokens(hard: DataFrame, docs: DataFrame, threshold: float, text_col: str = "text") -> DataFrame:
    """(token, key, root, size, pos): the rarest tokens of each text of ``hard`` (key, root) that others of these share.

    Tokens are ordered by the number of texts that have them. Two texts of a similarity of at least ``threshold`` share a token
    among the first size - ceil(threshold * size) + 1 of either, so texts that meet in none of these need no look. ``pos`` is
    the number of tokens of the text before this one.
    """
    texts = (docs.select(text_key(text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
             .join(hard.select("key"), "key", "left_semi").dropDuplicates(["key"]))
    out = pa.schema([("key", pa.binary()), ("size", pa.int64()), ("token", pa.int64())])
    words = Words()

    def run(batch):
        found = [tokens(*shingles(text, words)) for text in texts_of(batch)]
        sizes = np.array([len(t) for t in found], np.int64)
        return (batch.column("key").take(pa.array(np.repeat(np.arange(len(found)), sizes))), np.repeat(sizes, sizes),
                np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))

    every = stored(map_slices(texts, "text", run, "key binary, size long, token long", out, PIECE), "tokens")
    often = every.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    lists = every.join(often, "token").groupBy("key").agg(
        F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("n", "token"))).alias("l"))
    alone = F.col("size") - F.size("l")  # tokens of no other text come first
    first = F.col("size") - F.ceil(F.col("size") * F.lit(threshold) - F.lit(1e-9)) + 1
    return (lists.withColumn("alone", alone).select("key", "size", "alone", F.posexplode(F.slice(
        "l", F.lit(1), F.greatest(F.lit(0), first - F.col("alone")).cast("int"))).alias("at", "t"))
            .join(hard, "key").select("t.token", "key", "root", "size", (F.col("alone") + F.col("at")).alias("pos")))


#: Texts of a hot token that meet those of another part in one task.
PART = 2048


def hot_pairs(hot: DataFrame, sigs: DataFrame, threshold: float, least: float) -> DataFrame:
    """Pairs (a, b) of different components among all texts of each ``token`` (``token, key, root, size, pos, n``).

    The texts of a token are dealt into parts, and every two parts meet in one row, so that all pairs are looked at however many
    texts there are. A pair whose sizes and places leave no room for ``threshold`` if this is its first common token
    is passed over without a look at the signatures, which must agree in the share ``least`` of their first ``SHARP`` values and,
    if they are longer, in all as a pair at the threshold does: of texts just below it a short signature leaves most pairs in.
    """
    parts = F.ceil(F.col("n") / F.lit(PART))
    dealt = (hot.join(sigs.select("key", "sig"), "key").withColumn("own", F.pmod(F.xxhash64("key"), parts))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))))
    both = dealt.groupBy("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(
        F.collect_list(F.struct("key", "root", "size", "pos", "own", "sig")).alias("l"))
    out = pa.schema([("a", pa.binary()), ("b", pa.binary())])
    share = threshold / (1 + threshold)

    def run(batches):
        for batch in batches:
            for i, j, found in zip(*(batch.column(c) for c in ("i", "j", "l"))):
                key, root, size, pos, own, sig = (found.values.field(c) for c in range(6))
                key = key.to_pylist()
                root = np.unique(np.array(root.to_pylist(), object), return_inverse=True)[1]
                size, pos, own = (c.to_numpy() for c in (size, pos, own))
                sig = np.frombuffer(b"".join(sig.to_pylist()), np.uint8).reshape(len(key), -1)
                rest, within, pairs = size - pos, i.as_py() == j.as_py(), []
                for x in range(len(key) - 1):
                    y = slice(x + 1, None)
                    fit = (root[y] != root[x]) & (np.minimum(rest[y], rest[x]) >= share * (size[y] + size[x]) - 1e-6)
                    if not within:
                        fit &= own[y] != own[x]
                    near = np.flatnonzero(fit) + x + 1
                    near = near[(sig[near, :SHARP] == sig[x, :SHARP]).mean(1) >= least] if len(near) else near
                    if sig.shape[1] > SHARP and len(near):
                        near = near[(sig[near] == sig[x]).mean(1) >= screen_level(threshold, sig.shape[1])]
                    pairs += [(min(key[x], key[k]), max(key[x], key[k])) for k in near]
                if pairs:
                    yield rows(out, *map(list, zip(*pairs)))

    bound_batches(hot.sparkSession)
    return both.mapInArrow(run, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = 24, per_band: int = 4, screen: float = 0.6,
                    small: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, class_id (the smallest id of its class) and class_size.

    Classes are the connected components of texts whose multisets of five-word shingles have a weighted Jaccard
    similarity of at least ``threshold``. Copies count as one text. A pair is looked at if its signatures agree in a
    whole band (at 0.8 and 24 bands of 4 all but one in ten million) and in the share ``screen`` of their values, and
    is linked only by its exact overlap.

    In a bucket of up to ``small`` texts all meet. In a larger one each text meets a leader, another one in each half
    of the bands, which joins a large group in linear work. The texts of large buckets that still hold several components
    are joined on their rarest shingles (``rare_tokens``), which finds every pair of different components: up to
    ``small`` texts that share such a shingle all meet, more meet a leader first, and where components are still
    several after that all pairs are looked at in parts (``hot_pairs``). So no pair of a shared bucket goes unseen.

    Null text counts as empty; texts without words are copies of each other only if they are equal. Null ids sort
    last for class_id. An empty table gives an empty result; other columns are left out.
    """
    named, roots = _named(docs, threshold, bands, per_band, screen, small, id_col, text_col)
    named = _rooted(named, roots)
    classes = named.groupBy("root").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return named.join(classes, "root").select(F.col("id").alias(id_col), "class_id", "class_size")


def _rooted(named: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows with the key of their class as ``root``: their own where no link leads elsewhere."""
    return named.join(roots.select(F.col("id").alias("key"), "root"), "key", "left").select("id", "key", F.coalesce("root", "key").alias("root"))


def _named(docs: DataFrame, threshold: float = 0.8, bands: int = 24, per_band: int = 4, screen: float = 0.6, small: int = 16,
           id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, key) of every row and (id, root) of the linked keys."""
    sigs = stored(signatures(docs, bands, per_band, text_col).dropDuplicates(["key"]), "signatures")
    members = sigs.select("key", F.posexplode("bands").alias("band", "bucket"))
    turn = F.floor(F.col("band") / F.lit(max(1, bands // 2)))
    leader = members.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("key", turn).alias("h"), "key")).alias("lead")).filter("n > 1")
    crowded = stored(members.select("bucket", "key").join(leader.select("bucket", "n", F.col("lead.key").alias("lead")), "bucket"),
                     "buckets")
    release(crowded)

    def linked(pairs: DataFrame) -> DataFrame:
        return stored(verified(stored(pairs, "pairs"), docs, threshold, text_col), "verified")

    links = linked(screened(_pairs(crowded, "bucket", small), sigs, screen))
    release(links)
    roots = stored(components(links), "roots")

    placed = (crowded.filter(F.col("n") > small).join(roots.withColumnRenamed("id", "key"), "key", "left")
              .select("bucket", "key", F.coalesce("root", "key").alias("root")))
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 != r1").select("bucket")
    hard = stored(placed.join(mixed, "bucket", "left_semi").select("key", "root").distinct(), "hard")
    release(hard)
    all_roots = roots
    if not hard.isEmpty():
        sharp, level = stored(sharp_signatures(hard, docs, text_col), "sharp"), screen_level(threshold, SHARP)
        rare = stored(rare_tokens(hard, docs, threshold, text_col), "rare")
        release(rare)
        leader = rare.groupBy("token").agg(
            F.count(F.lit(1)).alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1"),
            F.min(F.struct(F.xxhash64("key", "token").alias("h"), "key", "root")).alias("lead")).filter("r0 != r1")
        rare = stored(rare.join(leader.select("token", "n", F.col("lead.key").alias("lead"), F.col("lead.root").alias("lead_root")),
                                "token"), "rare")
        fits = (F.least(F.col("size_1") - F.col("pos_1"), F.col("size_2") - F.col("pos_2"))
                >= (F.col("size_1") + F.col("size_2")) * F.lit(threshold / (1 + threshold)) - F.lit(1e-6))
        more = linked(screened(_pairs(rare, "token", small, fits), sharp, level))
        release(more)
        links = links.select("a", "b").union(more.select("a", "b"))
        all_roots = stored(components(links), "roots")
        hot = rare.filter(F.col("n") > small).drop("root", "lead", "lead_root").join(
            all_roots.withColumnRenamed("id", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
        mixed = hot.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 != r1").select("token")
        hot = stored(hot.join(mixed, "token", "left_semi"), "hot")
        if not hot.isEmpty():
            sharp = stored(sharp_signatures(hot.select("key").distinct(), docs, text_col, SHARPEST), "sharpest")
            release(sharp)
            more = linked(hot_pairs(hot, sharp, threshold, level))
            release(more)
            all_roots = stored(components(links.union(more.select("a", "b"))), "roots")

    return docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key")), all_roots


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each class, with all its columns: that of the smallest id (null last; of one id, of the smallest text key).

    Rows that repeat both id and text become one; other texts of the same id are judged by their own classes, and so are the
    texts of null ids.
    """
    named, roots = _named(docs, id_col=id_col, text_col=text_col, **options)
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("best")
    stay = _rooted(named, roots).groupBy("root").agg(best).select("best.id", "best.key")
    return matching_rows(docs, stay, {"id": F.col(id_col), "key": text_key(text_col)})
