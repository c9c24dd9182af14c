"""Byte-level BPE: whole pre-tokens by a minimal perfect hash, the rest by a heap over linked bytes."""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.arrowio import arrow_type, map_slices, texts_of
from assayer.llm.chunks import Memo


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


class PerfectHash:
    """Token bytes to rank through a minimal perfect hash: n keys, n slots, one seed per bucket of keys.

    Buckets are placed from the largest on; a seed is tried until all keys of its bucket fall on free slots.
    Buckets of one key store the slot itself. A stored key tells a miss.
    """

    def __init__(self, ranks: dict[bytes, int], per_bucket: int = 3):
        self.n = len(ranks)
        self.buckets = max(1, self.n // per_bucket)
        self.seeds = [0] * self.buckets
        self.slots: list[tuple[bytes, int] | None] = [None] * self.n
        members: dict[int, list[tuple[int, bytes]]] = {}
        for key in ranks:
            h = xxhash.xxh3_64_intdigest(key)
            members.setdefault(h % self.buckets, []).append((h, key))
        taken = bytearray(self.n)
        single = []
        for bucket, keys in sorted(members.items(), key=lambda x: -len(x[1])):
            if len(keys) == 1:
                single.append((bucket, keys[0][1]))
                continue
            seed = 1
            while True:
                spots = [self._spot(h, seed) for h, _ in keys]
                if len(set(spots)) == len(spots) and not any(taken[s] for s in spots):
                    break
                seed += 1
            self.seeds[bucket] = seed
            for s, (_, key) in zip(spots, keys):
                taken[s] = 1
                self.slots[s] = (key, ranks[key])
        free = (i for i in range(self.n) if not taken[i])
        for bucket, key in single:
            s = next(free)
            self.seeds[bucket] = -s - 1
            self.slots[s] = (key, ranks[key])

    def _spot(self, h: int, seed: int) -> int:
        x = (h ^ (seed * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
        return (x ^ (x >> 32)) % self.n

    def get(self, key: bytes) -> int | None:
        if not self.n:
            return None
        h = xxhash.xxh3_64_intdigest(key)
        seed = self.seeds[h % self.buckets]
        held = self.slots[-seed - 1 if seed < 0 else self._spot(h, seed)]
        return held[1] if held is not None and held[0] == key else None


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: adjacent parts of the lowest rank are joined, the leftmost first.

    Parts are linked by their ends; the heap holds (rank, start, end) of adjacent pairs, and an entry counts only
    while a part still starts there and its pair still ends there. n bytes take n log n steps.
    """
    n = len(piece)
    after = list(range(1, n + 1))  # end of the part that starts here
    before = list(range(-1, n - 1))  # start of the part that ends here
    alive = bytearray(b"\x01") * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or after[after[i]] != end:
            continue
        alive[after[i]] = 0
        after[i] = end
        if end < n:
            before[end] = i
            if (r := ranks.get(piece[i:after[end]])) is not None:
                heapq.heappush(heap, (r, i, after[end]))
        left = before[i]
        if left >= 0 and (r := ranks.get(piece[left:end])) is not None:
            heapq.heappush(heap, (r, left, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:after[i]]])
        i = after[i]
    return out


class Encoder:
    """Ids of texts by ranks and a pre-token pattern, without special tokens."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.whole = PerfectHash(self.ranks)
        self.find = regex.compile(pattern).findall
        self.memo = Memo(self.encode_parts)
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token

    def encode_parts(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            ids: list[int] = []
            for word in self.find(text):
                piece = word.encode()
                rank = self.whole.get(piece)
                if rank is None:
                    ids += merge(piece, self.ranks)
                else:
                    ids.append(rank)
            out.append(np.array(ids, "<u4").tobytes())
        return out

    def encode(self, text: str) -> bytes:
        return self.memo.ids(text)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per worker process, made from the vocabulary file that every machine has."""
    return Encoder(path, pattern)



def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", id_col: str = "doc_id",
           ids_col: str = "ids") -> DataFrame:
    """(id, ids): the ids of every whole text as little-endian unsigned 32-bit integers; null counts as empty.

    ``pattern`` must be one whose pre-tokens do not run over a single space (``chunks``). Ids may be null or repeat;
    an empty table gives an empty result; other columns are left out.
    """
    kind = df.schema[id_col].dataType.simpleString()
    out = pa.schema([("id", arrow_type(df, id_col)), ("ids", pa.binary())])

    def run(batch):
        code = encoder(path, pattern)
        return batch.column("id"), [code.encode(t) for t in texts_of(batch)]

    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_slices(narrow, "text", run, f"id {kind}, ids binary", out).toDF(id_col, ids_col)


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", id_col: str = "doc_id",
           bytes_col: str = "decoded") -> DataFrame:
    """(id, ids, decoded): the bytes that ids stand for; null ids decode to nothing."""
    kind = df.schema[id_col].dataType.simpleString()
    out = pa.schema([("id", arrow_type(df, id_col)), ("ids", pa.binary()), ("decoded", pa.binary())])

    def run(batch):
        code = encoder(path, pattern)
        return batch.column("id"), batch.column("ids"), [code.decode(x or b"") for x in batch.column("ids").to_pylist()]

    narrow = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return map_slices(narrow, "ids", run, f"id {kind}, ids binary, decoded binary", out).toDF(id_col, ids_col, bytes_col)

