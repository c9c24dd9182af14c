"""Harmonic packing of token sequences."""

from __future__ import annotations

import json
import os
import re
import string
from array import array
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.arrowio import bound_batches, collector_off, give_back, rows, slices, texts_of
from assayer.llm.chunks import Memo

SCHEMA = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
                   ("sequence_id", pa.int64()), ("offset", pa.int64())])


def byte_letters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself if it prints, else the next from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return {b: chr(b if b in prints else next(rest)) for b in range(256)}


#: Texts whose characters are of the same kind (letter, digit, other) in every version of Unicode, with no white space but space and \n.
KNOWN = re.compile("[ \n!-~\u00a1-\u00ac\u00ae-\u024f]*")
#: Neither letters nor digits nor white space.
SYMBOLS = string.punctuation
#: How byte-level vocabularies with ``use_regex`` cut a text into pre-tokens.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Pretokens(dict):
    """Ids of pre-tokens by the library's model, forgotten when many are held."""

    def __init__(self, model):
        super().__init__()
        self.tokenize, self.letters = model.tokenize, byte_letters()
        self.space = self.letters[ord(" ")]

    def spelled(self, word: str) -> str:
        return word.encode().decode("latin-1").translate(self.letters)

    def model(self, spelled: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(spelled)]).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= 50_000:
            self.clear()
        self[word] = found = self.model(word if word.isascii() and word.isalpha() else self.spelled(word))
        return found


class Words(Memo):
    """A memo whose misses go straight to the library's model where the part is a word, or a word and then symbols.

    A run of symbols after a letter is a pre-token of its own. The word before it is looked up but not held: most such words come once.
    """

    def __init__(self, compute, limit: int, known: Pretokens, added: list[str]):
        super().__init__(compute, limit)
        self.known, self.added = known, added

    def asked(self, part: str) -> bytes:
        if part.isalpha():
            if part.isascii():
                return self.known.model(self.known.space + part)
            if KNOWN.fullmatch(part):
                return self.known.model(self.known.spelled(" " + part))
        else:
            word = part.rstrip(SYMBOLS)
            if word.isalpha() and KNOWN.fullmatch(word) and not any(t in part for t in self.added):
                return (self.get(word) or self.old.get(word) or self.asked(word)) + self.known[part[len(word):]]
        return self.compute([" " + part])[0]


@lru_cache(maxsize=2)
def tokens(path: str, plain: bool = False, limit: int = 600_000) -> Memo:
    """Ids by the tokenizers library, one memo per worker process; with ``plain`` no string of a text is a special token.

    Pre-tokens of common characters go straight to the library's model; all else takes its whole way, so the
    string of a special token in a text gives that token, as the library does.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = plain
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    with open(path, encoding="utf-8") as lines:
        kind = json.load(lines)
    cut = kind["pre_tokenizer"] or {}
    direct = (kind["normalizer"] is None and cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"])
    known = Pretokens(tokenizer.model)
    find = regex.compile(BYTE_LEVEL).findall

    def compute(texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if direct and KNOWN.fullmatch(text) and not any(t in text for t in added):
                out.append(b"".join(map(known.__getitem__, find(text))))
            else:
                out.append(array("I", tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes())
        return out

    return Words(compute, limit, known, added) if direct else Memo(compute, limit)


def cuts(length: int, capacity: int, slack: int) -> list[tuple[int, int]]:
    """(class, length) of the pieces of a document, in order.

    Class k holds lengths from (capacity - slack) / k to capacity / k, so k of them fill a bin. A rest that would
    leave more than ``slack`` unused in its class is cut at the next smaller reciprocal of the capacity.
    """
    out = [(1, capacity)] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        if k * rest < capacity - slack:
            k += 1
            out.append((k, capacity // k))
            rest -= capacity // k
        else:
            out.append((k, rest))
            rest = 0
    return out


class Packer:
    """Bins of one worker: class k closes a bin with its k-th piece; what is left over at the end is laid end to end."""

    def __init__(self, capacity: int, slack: int, first_sequence: int):
        self.capacity, self.slack, self.sequence = capacity, slack, first_sequence
        self.open: dict[int, list[tuple]] = {}

    def add(self, doc, ids: bytes) -> list[tuple]:
        done, start, length = [], 0, len(ids) // 4
        for k, size in cuts(length, self.capacity, self.slack):
            bin_ = self.open.setdefault(k, [])
            bin_.append((doc, start, ids[4 * start:4 * (start + size)], length))
            start += size
            if len(bin_) == k:
                done += self._close(bin_)
                del self.open[k]
        return done

    def _close(self, pieces: list[tuple]) -> list[tuple]:
        out, offset = [], 0
        for doc, start, ids, length in pieces:
            out.append((doc, start, ids, length, self.sequence, offset))
            offset += len(ids) // 4
        self.sequence += 1
        return out

    def finish(self) -> list[tuple]:
        """The open bins in one row, cut into full sequences and at last into powers of two (which need no padding)."""
        left = [p for k in sorted(self.open) for p in self.open[k]]
        total = sum(len(p[2]) // 4 for p in left)
        self.open, out, held, room = {}, [], [], 0
        for doc, start, ids, length in left:
            while ids:
                room = room or min(self.capacity, 1 << (total.bit_length() - 1))
                take = min(room, len(ids) // 4)
                held.append((doc, start, ids[:4 * take], length))
                ids, start, room, total_left = ids[4 * take:], start + take, room - take, total
                if not room:
                    out += self._close(held)
                    total = total_left - sum(len(p[2]) // 4 for p in held)
                    held = []
        return out


def harmonic_pack(docs: DataFrame, path: str, capacity: int = 2048, slack: int = 32, end_id: int = 1,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents in sequences of at most ``capacity`` tokens: (doc_id, start, ids, doc_tokens, sequence_id, offset).

    A document is its ids by the tokenizers file at ``path`` and then ``end_id``. Pieces are cut so that class k of
    the reciprocal capacities loses at most ``slack`` tokens a bin (or k - 1 where k does not divide the capacity); each worker fills its bins alone, k pieces each, and
    lays the pieces of its unfinished bins end to end, the last ones in sequences of a power of two. No shuffle; the
    state of a worker is below one bin per class. ``capacity`` should be a power of two.

    Null or empty text is a document of one token; null and repeated ids are kept as they are; an empty table gives no
    pieces; other columns are left out. Sequence ids are unique and not gapless.
    """
    bound_batches(docs.sparkSession)

    def run(batches):
        memo = tokens(path)
        packer = Packer(capacity, slack, TaskContext.get().partitionId() << 40)
        end = end_id.to_bytes(4, "little")
        with collector_off():  # the memo holds nothing that it could free, and it walks over all of it
            for part in slices(batches, "text"):
                done = []
                for doc, text in zip(part.column("doc_id").to_pylist(), texts_of(part)):
                    done += packer.add(doc, memo.ids(text) + end)
                if done:
                    yield rows(ARROW, *map(list, zip(*done)))
            done = packer.finish()
            if done:
                yield rows(ARROW, *map(list, zip(*done)))
        give_back()

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, SCHEMA)
