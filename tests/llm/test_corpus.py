"""Spelling variants, mixing and alignment against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from assayer.llm import alignment, mixing, queries, spelling

FOLDER = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").collect()


# spelling variants

def counted(docs):
    found = Counter()
    for r in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{r[0]}:{run}".encode())
            if r[0] is not None and h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def one_edit(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    if abs(len(u) - len(v)) != 1:
        return False
    if len(u) > len(v):
        u, v = v, u
    return any(v[:i] + v[i + 1:] == u for i in range(len(v)))


def variants(words):
    out, form = [], {}
    for w, n in words.items():
        near = [v for v in words if v != w and abs(len(v) - len(w)) < 2 and one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
        out.append((w, n, len(near)))
    rows = []
    for w, n, k in out:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n, k, words[form[w]] if form[w] is not None else None))
    return sorted(rows)


def test_spelling_on_documents(spark):
    got = sorted(map(tuple, queries.op11_spelling_variants(spark, FOLDER).collect()))
    assert got == variants(counted(documents(spark))) and any(r[1] for r in got)


def test_spelling_of_close_words(spark):
    rng = np.random.default_rng(3)
    words = {"".join(rng.choice(list("abé"), rng.integers(6, 9))): int(5 * 6 ** rng.integers(0, 4)) for _ in range(300)}
    words |= {"aaaaaa": 5, "aaaaaaa": 40, "aaaaaaaa": 400, "aaabaaa": 5, "a\U00020000bcdefg": 50, "abcdefg": 5, "a": 7, "": 3, "ab": 50}
    df = spark.createDataFrame(list(words.items()) + [(None, 9)], "word string, n long")
    got = sorted(map(tuple, spelling.spelling_variants(df).collect()))
    assert got == variants(words)
    assert spelling.spelling_variants(df.limit(0)).count() == 0


def test_spelling_sends_no_table_through_the_driver(spark, monkeypatch):
    plans, write = [], spelling.stored

    def ran(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(spelling, "stored", lambda df, name: write(ran(df), name))
    words = spark.createDataFrame([("abcdefg", 900), ("abcdefh", 90), ("abcdeh", 9), ("xyzxyz", 5)], "word string, n long")
    got = sorted(map(tuple, ran(spelling.spelling_variants(words)).collect()))
    assert got == variants({"abcdefg": 900, "abcdefh": 90, "abcdeh": 9, "xyzxyz": 5})
    assert sum("SortMergeJoin" in p for p in plans) >= 4 and not any("Broadcast" in p for p in plans)


def test_word_counts_on_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 3)
    odd = [(None, None), (1, ""), (None, "Strasse strasse " * 5), (2, "ÀÉÎÕÜß ÀÉÎÕÜß " * 4), (2, "ÀÉÎÕÜß ÀÉÎÕÜß " * 4), (3, "x" * 3_000_000), (4, "wordage, " * 400_000)]
    odd += [(i, "different words standing in many documents, Different WORDS") for i in range(300)]
    df = spark.createDataFrame(odd, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS n", "3 AS word")
    assert {r.word: r.n for r in spelling.word_counts(df).collect()} == counted(odd)
    assert spelling.word_counts(df.limit(0)).count() == 0


# mixing

def shares(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: float(i % 3 + 1) for i, s in enumerate(names)}
    total, held = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in held]
        level = (total - sum(held.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level > 3 * sizes[s]]
        if not over:
            return {s: held.get(s, weight[s] * level) for s in names}
        held |= {s: 3.0 * sizes[s] for s in over}


def check_mix(docs, rows):
    size = {}
    for id_, text, source in docs:
        size.setdefault(source, []).append((id_, len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))))
    totals = {s: sum(n for _, n in x) for s, x in size.items()}
    want, taken = shares(totals), defaultdict(int)
    assert Counter((r.doc_id, r.size, r.source) for r in rows) == Counter((i, n, s) for s, x in size.items() for i, n in x)
    for r in rows:
        assert r.source_size == totals[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    return want, taken


def test_mixing_on_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = mixing.mix(docs).collect()
    want, taken = check_mix([(r.doc_id, r.text, r.source) for r in docs.collect()], rows)
    for s in want:  # as near as any choice of whole documents comes
        sizes = [r.size for r in rows if r.source == s]
        totals = {0}
        for n in sizes:
            totals |= {t + n for t in totals}
        whole = int(want[s] // sum(sizes)) * sum(sizes)
        assert abs(taken[s] - want[s]) <= min(abs(whole + t - want[s]) for t in totals) + 1
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    told = queries.op12_mixing(spark, FOLDER).collect()
    assert Counter((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in told) == Counter(
        (r.doc_id, r.size, r.source_size, r.target, r.copies * r.size) for r in rows)


def test_mixing_on_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL", 4)
    docs = [(None, None, None), (1, "", "a"), (2, "x y", "a"), (2, "x y", "a"), (3, "w " * 3000, "b"), (4, " ", ""), (5, "one", "é"), (6, None, "z")]
    docs += [(10 + i, "word " * (1 + i % 3), "hot") for i in range(300)] + [(None, "same text here", "hot")] * 40
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS none", "3 AS name", "4 AS cell")
    rows = mixing.mix(df).collect()
    want, taken = check_mix(docs, rows)
    assert abs(taken["hot"] - want["hot"]) <= 0.5
    assert mixing.mix(df.limit(0)).count() == 0
    nothing = mixing.mix(df.filter("text is null or trim(text) = ''")).collect()
    assert [r.target for r in nothing] == [0.0] * len(nothing)


def test_budget_is_met(monkeypatch):
    rng = np.random.default_rng(5)
    for n in range(200):
        lengths = np.sort(rng.choice(np.arange(0, 40 if n % 2 else 4000), rng.integers(1, 12), replace=False))[::-1].astype(np.int64)
        counts = rng.integers(1, 6, len(lengths))
        total = int((lengths * counts).sum())
        if not total:
            continue
        budget = int(rng.integers(0, total))
        got = mixing.fit_budget(lengths, counts, budget)
        assert (got >= 0).all() and (got <= counts).all()
        # as near as the best choice around the shares, which the longest documents bound
        assert abs(int((got * lengths).sum()) - budget) <= lengths.max()
        if n % 2 and counts.sum() > 20 and 1 in lengths:
            assert abs(int((got * lengths).sum()) - budget) <= 1
    assert mixing.fit_budget(np.array([7, 5, 3]), np.array([1, 1, 1]), 8).tolist() == [0, 1, 1]
    monkeypatch.setattr(mixing, "TABLE", 50)
    lengths, counts = np.arange(400, 0, -1), np.full(400, 30)
    assert all(mixing.fit_budget(lengths, counts, b) @ lengths == b for b in (1, 399, 12_345, 1_000_001, 30 * 80_200 - 1))
    monkeypatch.setattr(mixing, "MOST_LENGTH", 10)
    got = mixing.fit_budget(np.array([500, 90, 4]), np.array([3, 2, 5]), 800)
    assert got @ np.array([500, 90, 4]) == 700  # no choice comes nearer


# alignment

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def letters():
    prints = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    table, k = {}, 0
    for b in range(256):
        table[chr(b) if b in prints else chr(256 + k)] = b
        k += b not in prints
    return table


@pytest.fixture(scope="module")
def truth():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    code = letters()

    def tokens(text):
        e = a.encode(" " + text, add_special_tokens=False)
        first = [(i, bytes(code[c] for c in a.id_to_token(i))) for i in e.ids]
        second = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            second.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
        return first, second

    def rows(docs):
        kept, counts = [], Counter()
        for id_, text in docs:
            first, second = tokens(text) if text else ([], [])
            raw = (" " + (text or "")).encode()
            if not text or b"".join(x for _, x in first) != raw or b"".join(x for _, x in second) != raw:
                kept.append((id_, 0, 0, [], []))
                continue
            groups, links, x, y, at_a, at_b, ga, gb = [], [], 0, 0, 0, 0, [], []
            while x < len(first):
                ga.append(first[x][0])
                at_a += len(first[x][1])
                x += 1
                while at_b < at_a and at_b + len(second[y][1]) <= at_a:
                    gb.append(second[y][0])
                    at_b += len(second[y][1])
                    y += 1
                if at_b == at_a:
                    links.append((ga[-1], gb[-1]))
                    groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
                    ga, gb = [], []
            counts.update(links)
            kept.append((id_, len(first), len(second), groups, links))
        best = defaultdict(int)
        for (_, j), n in counts.items():
            best[j] = max(best[j], n)
        return sorted(map(str, [(i, n, m, len(g), len(k), sum(counts[p] == best[p[1]] for p in k), sum(counts[p] for p in k),
                                 hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, n, m, g, k in kept]))
    return rows


def test_alignment_on_documents(spark, truth):
    got = queries.op13_token_alignment(spark, FOLDER).collect()
    assert sorted(str(tuple(r)) for r in got) == truth([(r.doc_id, r.text) for r in documents(spark)])


def test_alignment_on_odd_texts(spark, truth, monkeypatch):
    odd = ["", " ", "  ", "a  b", "▁", "a▁b", "<|endoftext|> <s> </s> <unk>", "<0x41>", "é 日本語 🙂 x", "\n\n \t a", " lead", "trail ", "\x00", "\x1c",
           "ab" * 5000, "word " * 9000, "don't stop", "ﬁ ligature Å", "<0x0A>\n", None]
    docs = [(i, t) for i, t in enumerate(odd)] + [(None, "null id"), (3, "again"), (3, "again")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS links", "3 AS n_a")
    got = alignment.align_tokens(df, A, B).collect()
    assert sorted(str(tuple(r)) for r in got) == truth(docs)
    assert alignment.align_tokens(df.limit(0), A, B).count() == 0


def test_a_part_is_aligned_once(monkeypatch):
    own, asked = alignment.Aligner(A, B), []
    learn = own._learned
    monkeypatch.setattr(own, "_learned", lambda some: asked.extend(some) or learn(some))
    first, second = own.align(["the fox  the fox.", "the fox. the "]), own.align(["the fox.", "the  fox.", "the \u2581 fox"])
    assert sorted(asked) == sorted({*asked, "the \u2581 fox"}) and "the" in asked  # no part twice; only a text that fails is looked at whole
    assert [t and t[:2] for t in second][2] is None and first[1][0] == second[0][0] + len(np.frombuffer(own.a.ids("the "), "<u4"))
    assert alignment.units(" a  b c ") == [" a  b", "c "] and alignment.units("a \n b") == ["a", "\n b"]


def test_windows_give_what_the_whole_gives():
    own = alignment.Aligner(A, B)
    texts = ["The  quick brown fox, jumping over\n the lazy dogs' tails.", "", "naïve  café — 12,345 tokens ", "a▁b", "x" * 300 + " y" * 300, "the fox the fox the fox"]
    for text, told in zip(texts, own.align(texts)):
        if not text or "▁" in text:
            assert told is None
            continue
        ids = [np.array(x) for x in (np.frombuffer(own.a.ids(" " + text), "<u4").astype(np.int64), own.b.encode(text))]
        (groups, pairs), = own._aligned(*ids, *(np.array([x]) for x in (0, len(ids[0]), 0, len(ids[1]))))  # the text as one window
        assert told == (len(ids[0]), len(ids[1]), len(pairs) // 4, pairs, hashlib.sha256(groups.encode()).hexdigest())
        assert own.align([text]) == [told]
    assert len(own.memo) > 5 and len(own.pairs.keys) < own.va.sizes.sum() + own.vb.sizes.sum()
    assert own.align([]) == [] and own.align([""]) == [None]
