"""Tokens of two tokenizers aligned on one text, in parts cut before spaces, where tokens of both end."""

from __future__ import annotations

import hashlib
import os
import re
import struct
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.arrowio import arrow_type, bound_batches, map_slices, rows, slices
from assayer.llm.chunks import parts
from assayer.llm.packing import byte_letters, tokens
from assayer.llm.shared import stored

#: Parts whose alignments a worker keeps, those whose ids of A alone it keeps, and the characters of a part that is worth keeping.
PARTS, FIRST, WORTH = 400_000, 40_000, 64
SLICE = 1 << 20
#: Parts that are aligned as one run.
BATCH = 20_000
BYTE = re.compile(r"<0x([0-9A-F]{2})>")


@dataclass
class Vocabulary:
    """Bytes of every token id and their lengths."""

    tokens: list[bytes]

    def __post_init__(self):
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.names = [str(i) for i in range(len(self.tokens))]


@lru_cache(maxsize=2)
def byte_level(path: str):
    """(tokenizer, vocabulary) of a byte-level file of the tokenizers library; special tokens in a text are plain text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    raw = {c: bytes([b]) for b, c in byte_letters().items()}
    names = [b""] * (max(tokenizer.get_vocab(True).values(), default=-1) + 1)
    for token, i in tokenizer.get_vocab(True).items():
        names[i] = b"".join(raw.get(c, c.encode()) for c in token)
    return tokenizer, Vocabulary(names)


@lru_cache(maxsize=2)
def pieces(path: str):
    """(processor, vocabulary) of a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        byte = BYTE.fullmatch(piece) if model.is_byte(i) else None
        names.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())
    return model, Vocabulary(names)


class LinkPairs:
    """Numbers for the id pairs (a, b) that can be linked.

    The bytes of two tokens that end together are a tail of one another, so a pair is a token and one of its tails. There are
    no more than the bytes of both vocabularies together (times the ids of equal bytes): the bound of every table by pair.
    """

    def __init__(self, a: Vocabulary, b: Vocabulary):
        found = set()
        for one, two, turn in ((a, b, False), (b, a, True)):
            ids: dict[bytes, list[int]] = {}
            for i, token in enumerate(two.tokens):
                ids.setdefault(token, []).append(i)
            for i, token in enumerate(one.tokens):
                for at in range(len(token)):
                    for j in ids.get(token[at:], ()):
                        found.add((j, i) if turn else (i, j))
        both = np.array(sorted(found), np.int64).reshape(-1, 2)
        self.base = len(b.tokens)
        self.keys = both[:, 0] * self.base + both[:, 1]
        self.b = both[:, 1]

    def number(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, a * self.base + b).astype("<i4")


@lru_cache(maxsize=2)
def link_pairs(path_a: str, path_b: str) -> LinkPairs:
    return LinkPairs(byte_level(path_a)[1], pieces(path_b)[1])


def units(text: str) -> list[str]:
    """Parts of a text (``chunks``) that each lost the space before them, that before the text included."""
    first, *rest = parts(" " + text)
    out = [first[1:], *rest] if first else rest
    if len(out) > 1 and not out[-1]:  # a space at the end is no part of its own
        out[-2:] = [out[-2] + " "]
    return out


class Aligner:
    """Both tokenizers, and the alignments of the parts that were met before.

    A cuts its pre-tokens before the space that begins a part (``chunks``), and no token of B holds a space mark after another
    character, so the ids of a text are those of its parts, and tokens of both end with every part. ``Aligner`` refuses a
    vocabulary of which this is not true.
    """

    def __init__(self, path_a: str, path_b: str):
        (_, self.va), (self.b, self.vb) = byte_level(path_a), pieces(path_b)
        if any(b" " in t.lstrip(b" ") for t in self.vb.tokens):
            raise ValueError("a token of the second tokenizer holds a space after another character")
        self.a = tokens(path_a, plain=True, limit=FIRST)
        self.pairs = link_pairs(path_a, path_b)
        # ids with what follows them in the text of the groups: a comma inside a side, | after the first, ; after the second
        self.names = [name + mark for v, marks in ((self.va, ",|"), (self.vb, ",;")) for mark in marks for name in v.names]
        #: Of a part: tokens of A times 2^32 and of B, text of the groups, numbers of the linked pairs.
        self.memo: dict[str, tuple[int, bytes, bytes] | None] = {}

    def align(self, texts: list[str]) -> list[tuple[int, int, int, bytes, str] | None]:
        """Of each text (tokens of A, tokens of B, groups, linked pairs, digest of the groups), or none if a tokenizer does not
        give its bytes back.
        """
        cut = [units(t) if t else [] for t in texts]
        wanted = set().union(*cut)
        new = wanted.difference(self.memo)
        if len(self.memo) + len(new) > PARTS:
            self.memo = {p: self.memo[p] for p in wanted.difference(new)}
        new = list(new)
        for at in range(0, len(new), BATCH):
            some = new[at:at + BATCH]
            self.memo.update(zip(some, self._learned(some)))
        out: list = []
        for text, own in zip(texts, cut):
            found = [*map(self.memo.__getitem__, own)]
            if None in found:  # then the bytes of the whole text decide
                found = self._learned([text])
            if not found or found[0] is None:
                out.append(None)
                continue
            n, groups, links = zip(*found)
            n, links = sum(n), b"".join(links)
            out.append((n >> 32, n & 0xFFFFFFFF, len(links) // 4, links, hashlib.sha256(b";".join(groups)).hexdigest()))
        for p in new:
            if len(p) > WORTH:
                del self.memo[p]
        return out

    def _learned(self, some: list[str]) -> list[tuple[int, bytes, bytes] | None]:
        """What the memo holds, of each of some parts; none where the bytes of a tokenizer are others than those of the part."""
        all_a = [struct.unpack(f"<{len(x) // 4}I", x) for x in map(self.a.__getitem__, some)]
        all_b = self.b.encode(some, num_threads=1)
        token_a, token_b = self.va.tokens.__getitem__, self.vb.tokens.__getitem__
        good = [n for n, (p, x, y) in enumerate(zip(some, all_a, all_b))
                if b"".join(map(token_a, x)) == (raw := b" " + p.encode()) == b"".join(map(token_b, y))]
        out: list = [None] * len(some)
        if not good:
            return out
        sizes_a, sizes_b = (np.array([len(x[n]) for n in good]) for x in (all_a, all_b))
        a, b = (np.fromiter(chain.from_iterable(x[n] for n in good), np.int64, int(size.sum())) for x, size in ((all_a, sizes_a), (all_b, sizes_b)))
        ends_a, ends_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
        told = self._aligned(a, b, ends_a - sizes_a, ends_a, ends_b - sizes_b, ends_b)
        for n, size, (groups, links) in zip(good, (sizes_a << 32 | sizes_b).tolist(), told):
            out[n] = size, groups.encode(), links
        return out

    def _aligned(self, a: np.ndarray, b: np.ndarray, from_a: np.ndarray, to_a: np.ndarray, from_b: np.ndarray, to_b: np.ndarray):
        """(text of the groups, numbers of the linked pairs) of each stretch of ids; both sides of a stretch have equal bytes.

        The stretches follow each other as one run, so both sides end together after each.
        """
        a, b = (ids[np.repeat(i - np.r_[0, np.cumsum(j - i)[:-1]], j - i) + np.arange((j - i).sum())] for ids, i, j in (
            (a, from_a, to_a), (b, from_b, to_b)))
        _, last_a, last_b = np.intersect1d(np.cumsum(self.va.sizes[a]), np.cumsum(self.vb.sizes[b]), assume_unique=True, return_indices=True)
        group_a, group_b = (np.searchsorted(last, np.arange(len(ids))) for last, ids in ((last_a, a), (last_b, b)))
        n_a, n_b = len(self.va.tokens), len(self.vb.tokens)
        codes = np.concatenate([a, 2 * n_a + b]).astype(np.int64)
        codes[last_a] += n_a
        codes[len(a) + last_b] += n_b
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        words = [*map(self.names.__getitem__, codes[order].tolist())]
        numbers = self.pairs.number(a[last_a].astype(np.int64), b[last_b].astype(np.int64)).tobytes()
        ends = np.cumsum(to_a - from_a)
        words_to = np.cumsum(to_a - from_a + to_b - from_b).tolist()
        links_to = (4 * np.searchsorted(last_a, ends)).tolist()  # groups that end before the next stretch
        i = g = 0
        for j, h in zip(words_to, links_to):
            yield "".join(words[i:j])[:-1], numbers[g:h]
            i, g = j, h


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each worker process."""
    return Aligner(path_a, path_b)


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, links, groups_sha256) of every whole text; ``links`` are numbers of ``link_pairs`` as 32-bit integers.

    A encodes the text after a space and B the text, by their libraries, in parts whose alignments are kept (``Aligner`` says why the
    ids are those of the whole text). Null and empty texts, and those that either
    tokenizer does not give back byte by byte, have no tokens and the digest ''. Ids may be null or repeat; an empty
    table gives no rows; other columns are left out.
    """
    out = pa.schema([("id", arrow_type(docs, id_col)), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                     ("links", pa.binary()), ("groups_sha256", pa.string())])

    def run(batches):
        own = aligner(path_a, path_b)
        for part in slices(batches, "text", SLICE):
            told = [t or (0, 0, 0, b"", "") for t in own.align([t or "" for t in part.column("text").to_pylist()])]
            yield rows(out, part.column("id"), *zip(*told))

    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, n_a long, n_b long, n_groups long, links binary, groups_sha256 string").withColumnRenamed("id", id_col)


def link_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): how many links of the corpus hold each id pair, added up in the tasks first."""
    out = pa.schema([("pair", pa.int32()), ("n", pa.int64())])

    def count(batches):
        held = np.zeros(0, np.int64)
        for part in slices(batches, "links"):
            for links in part.column("links"):
                found = np.bincount(np.frombuffer(links.as_buffer(), "<i4"))
                if len(found) > len(held):
                    held = np.concatenate([held, np.zeros(len(found) - len(held), np.int64)])
                held[:len(found)] += found
        at = np.flatnonzero(held)
        if len(at):
            yield rows(out, pa.array(at, pa.int32()), pa.array(held[at], pa.int64()))

    return aligned.select("links").mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align_tokens(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every whole text.

    A link is a token of each side that end at the same byte; an id pair's count is the number of links of the whole corpus that
    hold it. ``n_best`` counts the links whose pair has the highest count of all pairs of its B id, ``count_sum`` adds up
    the counts. The table of counts goes to every task: it has at most the rows of ``LinkPairs``, whatever the corpus.
    Odd rows are as in ``align``.
    """
    aligned = stored(align(docs, path_a, path_b, id_col, text_col), "aligned")
    spark = docs.sparkSession
    pairs = link_pairs(path_a, path_b)
    count = np.zeros(len(pairs.keys), np.int64)
    for r in link_counts(aligned).collect():
        count[r.pair] = r.n
    highest = np.zeros(pairs.base, np.int64)
    np.maximum.at(highest, pairs.b, count)
    shared = spark.sparkContext.broadcast((count, count == highest[pairs.b]))
    out = pa.schema([("id", arrow_type(docs, id_col)), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")],
                     ("groups_sha256", pa.string())])

    def score(part):
        counts, best = shared.value
        links = [np.frombuffer(x.as_buffer(), "<i4") for x in part.column("links")]
        return (*(part.column(c) for c in ("id", "n_a", "n_b", "n_groups")), [len(x) for x in links], [int(best[x].sum()) for x in links],
                [int(counts[x].sum()) for x in links], part.column("groups_sha256"))

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return map_slices(aligned.withColumnRenamed(id_col, "id"), "links", score, schema, out).withColumnRenamed("id", id_col)
