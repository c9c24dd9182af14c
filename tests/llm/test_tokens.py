"""Encoding, packing and their round trips."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from assayer.llm import bpe, packing

ODD = ["", " ", "  ", "a  b", "a \n b", "\n \n b", "a\n  b \n\n c", " x", "x ", "x  ", "don't  we'll 'tis", "日本 語　 x  y", "a\t b\t  c",
       "🙂🙂 é́", "<|endoftext|> <|x|>", "a <|endoftext|>", "a  <|endoftext|>b <|endoftext|><|endoftext|> ", "\n <|endoftext|>.", "\x1c \x1d x", "a\x85 b   c", "x" * 3000, " " * 500, "\n " * 50 + "z", "a \t\n b", "ab" * 2000]
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, start long, ids string, sequence_id long"


@pytest.fixture(scope="module")
def code():
    return bpe.encoder(RANKS, P.PATTERN)


@pytest.fixture(scope="module")
def library(code):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=code.ranks, special_tokens={})


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))  # as the library has it


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_perfect_hash_is_minimal_and_perfect(code):
    table = code.whole
    assert len(table.slots) == len(code.ranks) == len({s[1] for s in table.slots})
    assert all(table.get(k) == r for k, r in code.ranks.items())
    assert table.get(b"no such token at all") is None
    assert bpe.PerfectHash({}).get(b"x") is None


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(code, library, plain, text):
    assert ids(code.encode(text)) == library.encode_ordinary(text)
    assert code.decode(code.encode(text)) == text.encode()
    assert ids(packing.tokens(P.path("byte_bpe_50k.json")).ids(text)) == plain.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab '\n\t é語  .1s", max_size=30))
def test_parts_do_not_change_ids(text):
    code = bpe.encoder(RANKS, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=code.ranks, special_tokens={})
    assert ids(code.encode(text)) == library.encode_ordinary(text)


def test_memo_forgets():
    memo = packing.Memo(lambda texts: [t.encode() for t in texts], limit=3)
    assert memo.ids("a b c d e f") == b"a b c d e f"
    assert memo.ids("a g h i") == b"a g h i" and len(memo) <= 5


def test_encode_and_decode_frames(spark, library):
    rows = [(i, t, 1, "x", 2) for i, t in enumerate(ODD)] + [(None, None, 1, "x", 2), (0, "", 1, "x", 2), (0, "again", 1, "x", 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = bpe.decode(bpe.encode(df, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, bytes(r.decoded)) for r in got) == sorted(
        (r[0] is None, r[0] or 0, (r[1] or "").encode()) for r in rows)
    assert bpe.decode(bpe.encode(df.limit(0), RANKS, P.PATTERN), RANKS, P.PATTERN).columns == ["doc_id", "ids", "decoded"]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10_000))
def test_cuts_cover_and_fit(length):
    found = packing.cuts(length, 2048, 32)
    assert sum(n for _, n in found) == length
    assert all(2048 - max(32, k - 1) <= k * n <= 2048 for k, n in found)


def test_packing(spark, plain):
    rng = np.random.default_rng(3)
    texts = [" ".join(["word"] * int(n)) for n in rng.integers(0, 4000, 150)] + ODD
    rows = [(i, t, 7, "x", 9) for i, t in enumerate(texts)] + [(None, None, 7, "x", 9)]
    pieces = packing.harmonic_pack(spark.createDataFrame(rows, SCHEMA).repartition(3), P.path("byte_bpe_50k.json")).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append((p.offset, len(p.ids) // 4))
    for i, t in [*enumerate(texts), (None, "")]:
        whole = b"".join(bytes(p.ids) for p in sorted(by_doc[i], key=lambda p: p.start))
        assert ids(whole) == plain.encode(t, add_special_tokens=False).ids + [1]
        assert {p.doc_tokens for p in by_doc[i]} == {len(whole) // 4}
    used = 0
    for spans in by_sequence.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert 0 < at <= 2048
        used += at if at & (at - 1) == 0 else 2048
    assert sum(len(p.ids) // 4 for p in pieces) > 0.97 * used
    assert packing.harmonic_pack(spark.createDataFrame([], SCHEMA), P.path("byte_bpe_50k.json")).count() == 0


def test_crc_is_unsigned(spark):
    row = spark.createDataFrame([(bytearray(b"\x01\x00\x00\x00"),)], "ids binary").selectExpr("crc32(ids) AS c").first()
    assert row.c == zlib.crc32(b"\x01\x00\x00\x00")


def test_memo_that_forgets(plain, monkeypatch):
    memo = packing.tokens(P.path("byte_bpe_50k.json"))
    monkeypatch.setattr(memo, "limit", 40)
    for text in ODD + [f"some words, number {i}. the end, the end." for i in range(60)]:
        assert ids(memo.ids(text)) == plain.encode(text, add_special_tokens=False).ids
        assert len(memo) <= max(40, 2 * len(set(text.split(" "))))


def test_known_characters_take_the_short_way(plain, monkeypatch):
    own = packing.tokens(P.path("byte_bpe_50k.json"))
    texts = [" eare.\nAtenan", " don't,\n\nwe'll", " naïve$$$", " 12ab#", "\nX", " a \n b", " x  ", " mail1@ex.com", " <|endoftext|>", " a\x85b", " é\u0301 \u00ad"]
    whole = []
    kept = packing.KNOWN.fullmatch
    monkeypatch.setattr(packing, "KNOWN", type("Known", (), {"fullmatch": staticmethod(lambda t: kept(t) or whole.append(t))}))
    assert [ids(x) for x in own.compute(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert whole == texts[-2:]  # these alone go through the whole tokenizer for their characters


def test_memo_asks_once_for_a_part():
    asked = []
    memo = packing.Memo(lambda texts: asked.extend(texts) or [t.encode() for t in texts])
    assert memo.ids("a b. b a a, c") == b"a b. b a a, c"
    assert sorted(asked) == sorted([",", ".", "a", " b", " a", " c"])


def test_a_word_that_comes_often_is_asked_once():
    asked = []
    memo = packing.Memo(lambda texts: asked.extend(texts) or [t.encode() for t in texts], limit=10)
    for i in range(50):
        memo.ids(f"- often w{i}")
        assert len(memo) + len(memo.old) <= 11
    assert asked.count(" often") == 1


def test_words_with_symbols_go_straight_to_the_model(plain, monkeypatch):
    memo = packing.tokens(P.path("byte_bpe_50k.json"))
    whole = []
    monkeypatch.setattr(memo, "compute", lambda texts: whole.extend(texts) or [b"" for _ in texts])
    texts = [f"{w}{tail}" for w in ("zuQß", "Zaqw", "é") for tail in ("", "!!", "###", "'", "'!", ",,", "_", "|>", "<|", "\"\"", ".", "~^`")]
    for text in texts:
        assert ids(memo[text]) == plain.encode(" " + text, add_special_tokens=False).ids
    assert not whole
    monkeypatch.undo()
    for text in ("a<|endoftext|>", "x's", "x\u0301!", "x\u00ad.", "x1!", "!x", "\u65e5!", "q<|endoftext|>!"):
        assert ids(memo[text]) == plain.encode(" " + text, add_special_tokens=False).ids
