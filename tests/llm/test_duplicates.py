"""Exact, near and passage duplicates against brute force."""

import hashlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.llm import bagminhash, components, exact, suffix

SCHEMA = "doc_id long, text string, keep_id long, digest string, key string, id long, root string, block long"
EXTRA = (1, "d", "k", 2, "r", 3)


def frame(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


def weak(text):
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 1)


@pytest.mark.parametrize("digest", [exact.sha256, weak])
def test_exact_groups(spark, digest):
    rows = [(i, ["Same", "sAME", "other", None, "", "É", "é", "x" * 50_000][i % 8]) for i in range(64)] + [
        (None, "same"), (None, "only null"), (3, "other"), (2, "other")]
    got = exact.exact_groups(frame(spark, rows), digest=digest).collect()
    low = [(i, (t or "").translate(str.maketrans(exact.UPPER, exact.LOWER))) for i, t in rows]
    groups = {}
    for i, t in low:
        groups.setdefault(t, []).append(i)
    want = []
    for i, t in low:
        ids = [x for x in groups[t] if x is not None]
        keep = max(ids) if ids else None
        want.append((i, keep, len(groups[t]), i == keep))
    assert sorted(map(str, [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got])) == sorted(map(str, want))
    kept = exact.exact_dedup(frame(spark, rows), digest=digest)
    assert sorted((r.text or "").lower() for r in kept.collect()) == sorted(t.lower() for t in groups)
    assert kept.columns == frame(spark, rows).columns
    assert exact.exact_groups(frame(spark, [])).count() == 0


def test_components(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(None, 3), (7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.id: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    for low, high in ((1, 2), (1, 5), (1, 200)):
        w = rng.integers(low, high, 40)
        v = np.maximum(0, w - rng.integers(0, 2, 40) * rng.integers(0, high, 40))
        truth = np.minimum(w, v).sum() / np.maximum(w, v).sum()
        agree = []
        for _ in range(60):
            e = rng.integers(0, 2**64, 40, dtype=np.uint64)
            a, b = (bagminhash.bag_minhash(e[x > 0], x[x > 0], 96) for x in (w, v))
            agree.append((a == b).mean())
        assert abs(np.mean(agree) - truth) < 4 * np.sqrt(truth * (1 - truth) / (96 * 60)) + 1e-9


def near_truth(rows, threshold=0.8):
    words = bagminhash.Words()
    bags = [bagminhash.shingles(t or "", words) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        same = (rows[i][1] or "") == (rows[j][1] or "")
        if not same and len(bags[i][0]) and len(bags[j][0]):
            low, high = bagminhash.weighted_jaccard(bags[i], bags[j])
            same = low >= threshold * high
        if same:
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    classes = {}
    for i, r in enumerate(rows):
        classes.setdefault(find(i), []).append(r[0])
    out = []
    for i, r in enumerate(rows):
        ids = [x for x in classes[find(i)] if x is not None]
        out.append((r[0], min(ids) if ids else None, len(classes[find(i)])))
    return sorted(map(str, out))


def test_near_duplicates(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(25):
        base = list(rng.choice(vocabulary, int(rng.integers(30, 200))))
        for c in range(int(rng.integers(1, 9))):
            words = list(base)
            for _ in range(int(rng.integers(0, max(2, len(base) // 40)))):
                words[int(rng.integers(len(words)))] = "edit"
            rows.append((len(rows), " ".join(words)))
    base = list(rng.choice(vocabulary, 120))
    for c in range(60):  # a large group whose members differ from each other more than from the base
        words = list(base)
        words[int(rng.integers(len(words)))] = f"n{c}"
        rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + i, t) for i, t in enumerate(["a a a a a a a a", "a a a a a a a", "", None, "short", "short", "Short", "one two"])]
    rows += [(None, rows[0][1]), (None, "nobody else"), (5, rows[5][1])]
    got = bagminhash.near_duplicates(frame(spark, rows)).collect()
    assert sorted(map(str, [(r.doc_id, r.class_id, r.class_size) for r in got])) == near_truth(rows)
    kept = bagminhash.near_dedup(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted({str(eval(x)[1]) for x in near_truth(rows)})
    assert bagminhash.near_duplicates(frame(spark, [])).count() == 0


def template_rows(rng, n, fixed, own, planted):
    """Texts of one template and own words each, about 0.6 alike, and pairs that are nearer to each other only."""
    template = [f"t{i}" for i in range(fixed)]
    rows = []
    for g in range(n):
        words = template + [f"o{g}x{i}" for i in range(own)]
        rows.append((len(rows), " ".join(words)))
        if g < planted:
            words[-int(rng.integers(3, 9))] = f"p{g}"
            rows.append((len(rows), " ".join(words)))
    return rows


def test_pairs_inside_a_large_group(spark):
    rows = template_rows(np.random.default_rng(8), 2500, 78, 24, 60)
    got = bagminhash.near_duplicates(frame(spark, rows)).collect()
    assert sum(r.class_size == 2 for r in got) == 120
    text = dict(rows)
    words = bagminhash.Words()
    for r in got:
        if r.class_id != r.doc_id:
            low, high = bagminhash.weighted_jaccard(*(bagminhash.shingles(text[i], words) for i in (r.doc_id, r.class_id)))
            assert low >= 0.8 * high
    few = rows[:160]
    got = bagminhash.near_duplicates(frame(spark, few)).collect()
    assert sorted(map(str, map(tuple, [(r.doc_id, r.class_id, r.class_size) for r in got]))) == near_truth(few)


def test_hot_tokens_meet_in_parts(spark, monkeypatch):
    monkeypatch.setattr(bagminhash, "PART", 7)
    rng = np.random.default_rng(9)
    rows = []
    for i in range(40):
        rows.append((f"k{i:02}".encode(), f"k{i:02}".encode(), 100, int(rng.integers(0, 20)), bytes(rng.integers(0, 2, 96, dtype=np.uint8))))
    rows.append((b"z", b"k03", *rows[5][2:]))
    hot = spark.createDataFrame([(1, *r[:4], len(rows)) for r in rows], "token long, key binary, root binary, size long, pos long, n long")
    sigs = spark.createDataFrame([(r[0], bytearray(r[4])) for r in rows], "key binary, sig binary")
    want = set()
    for x, y in combinations(rows, 2):
        same = (np.frombuffer(x[4], np.uint8) == np.frombuffer(y[4], np.uint8)).mean()
        if x[1] != y[1] and min(100 - x[3], 100 - y[3]) >= 200 * 0.8 / 1.8 and same >= 0.5:
            want.add((x[0], y[0]))
    got = [(bytes(r.a), bytes(r.b)) for r in bagminhash.hot_pairs(hot, sigs, 0.8, 0.5).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_long_signatures_part_texts_just_below_the_threshold(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, bagminhash.SHARPEST, dtype=np.uint8)
    sigs = {}
    for key, share in ((b"a", 1.0), (b"b", 0.8), (b"c", 0.72)):  # shares of the values that agree with those of a
        other = base.copy()
        for part in (slice(0, bagminhash.SHARP), slice(bagminhash.SHARP, None)):  # in the short signature and in the rest alike
            other[part][:round((1 - share) * len(other[part]))] += 1
        sigs[key] = other
    hot = spark.createDataFrame([(1, k, k, 100, 0, 3) for k in sigs], "token long, key binary, root binary, size long, pos long, n long")

    def met(n):
        frame = spark.createDataFrame([(k, bytearray(x[:n].tobytes())) for k, x in sigs.items()], "key binary, sig binary")
        found = bagminhash.hot_pairs(hot, frame, 0.8, bagminhash.screen_level(0.8, bagminhash.SHARP)).collect()
        return {(bytes(r.a), bytes(r.b)) for r in found}
    assert met(bagminhash.SHARP) >= {(b"a", b"b"), (b"a", b"c")}
    assert (b"a", b"b") in met(bagminhash.SHARPEST) and (b"a", b"c") not in met(bagminhash.SHARPEST)


def spans_truth(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            if i is not None:
                first[b[k:k + 50]] = min(first.get(b[k:k + 50], i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if i is not None and first[b[k:k + 50]] < i:
                gone[k:k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for j in range(len(gone)) if gone[j] and (not j or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("small", [False, True])
def test_repeated_spans(spark, monkeypatch, small):
    if small:  # several blocks; the workers keep their own piece size
        monkeypatch.setattr(suffix, "BLOCK_BYTES", 3000)
    rng = np.random.default_rng(4)

    def noise(n, letters="abcdefgh é"):
        return "".join(rng.choice(list(letters), n))

    shared = [noise(n) for n in (49, 50, 51, 80, 300, 1000)]
    rows = []
    for i in range(60):
        parts = [noise(int(rng.integers(0, 200)))]
        for _ in range(int(rng.integers(0, 4))):
            s = shared[int(rng.integers(len(shared)))]
            a = int(rng.integers(0, 20))
            parts += [s[a:], noise(int(rng.integers(0, 30)))]
        rows.append((int(rng.permutation(1000)[0]) * 100 + i, "".join(parts)))
    rows += [(200_000, "ab" * 400), (200_001, "ba" * 300), (200_002, "a" * 500), (200_003, "a" * 60), (200_004, "x" + "a" * 49),
             (200_005, None), (200_006, ""), (200_007, rows[0][1]), (-5, rows[1][1]), (None, rows[2][1]), (None, None),
             (200_009, noise(120) + "same id twice " * 10), (200_009, "same id twice " * 10)]
    got = suffix.repeated_spans(frame(spark, rows)).collect()
    assert sorted(map(str, [(r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.starts),
                             hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got])) == spans_truth(rows)
    assert suffix.repeated_spans(frame(spark, [])).count() == 0


def test_very_long_text_in_pieces(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(suffix, "PIECE", 700)
    rng = np.random.default_rng(6)
    text = "".join(rng.choice(list("abcdef"), 5000))
    table = pa.table({"text": [text, "short", None], "id": [1, 2, 3]})
    covered = np.zeros(5000, int)
    for row, offset, p in suffix.pieces(table):
        if row == 0 and len(p.data) > 49 and len(set(p.owner)) == 1:
            for a, b in zip(p.first, p.last):
                covered[offset + a:offset + b + 1] += 1
    assert (covered[:4951] == 1).all() and not covered[4951:].any()
