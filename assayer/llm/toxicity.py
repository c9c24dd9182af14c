"""A linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.arrowio import arrow_type, map_slices, texts_of
from assayer.llm.hashing import WORD

BITS = 20
#: Words whose n-grams are worked on at once while learning.
BLOCK = 20_000


def word_grams(words: list[str], low: int = 2, high: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, bucket) of every character n-gram inside lower-case words with their borders marked."""
    points = np.frombuffer("".join([f"\x02{w}\x03" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    owners, found = [], []
    rolling = np.zeros(len(points), np.uint64)
    for n in range(1, high + 1):
        m = len(points) - n + 1
        if m <= 0:
            break
        rolling = (rolling[:m] ^ points[n - 1:].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        rolling ^= rolling >> np.uint64(31)
        inside = owner[:m] == owner[n - 1:]
        if n >= low:
            owners.append(owner[:m][inside])
            found.append((rolling[inside] >> np.uint64(64 - BITS - 3) & np.uint64((1 << BITS) - 1)).astype(np.int64))
    return np.concatenate(owners or [owner[:0]]), np.concatenate(found or [owner[:0]])


def distinct_words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


@dataclass
class NaiveBayesLinear:
    """``weight`` is what is learned over the features scaled by their log-count ratio, times that ratio."""

    weight: np.ndarray
    bias: float
    memo: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        at = np.flatnonzero(self.weight)
        return at.astype(np.int32), self.weight[at].astype(np.float32), self.bias

    def __setstate__(self, state):
        at, values, self.bias = state
        self.weight = np.zeros(1 << BITS, np.float32)
        self.weight[at] = values
        self.memo = {}

    def scores(self, texts: list[str]) -> list[float]:
        """The sum over the distinct words of a text; words seen before are kept per worker."""
        bags = [distinct_words(t) for t in texts]
        new = sorted({w for bag in bags for w in bag if w not in self.memo})
        if len(self.memo) + len(new) > 400_000:
            self.memo.clear()
            new = sorted({w for bag in bags for w in bag})
        if new:
            at, grams = word_grams(new)
            self.memo.update(zip(new, np.bincount(at, weights=self.weight[grams], minlength=len(new)).tolist()))
        z = np.array([self.bias + math.fsum(map(self.memo.__getitem__, bag)) for bag in bags])
        return (1 / (1 + np.exp(-np.clip(z, -40, 40)))).tolist()


def fit(examples: list[tuple[str, int]], smooth: float = 1.0, rounds: int = 100, rate: float = 0.5,
        ridge: float = 3e-3) -> NaiveBayesLinear:
    """Log-count ratios from documents that hold a feature, then logistic regression over the scaled features.

    A document is its distinct words and a word its n-grams, so that the (document, n-gram) pairs are never listed: scores
    go from n-grams to words to documents and gradients the other way. All n-grams of the examples take part; the ratios
    and ``ridge`` shrink those that tell little. Without examples of both classes every score is one half.
    """
    size = 1 << BITS
    y = np.array([c for _, c in examples], float)
    model = NaiveBayesLinear(np.zeros(size, np.float32), 0.0)
    if not len(y) or y.min() == y.max() or not any(map(distinct_words, (t for t, _ in examples))):
        return model
    place: dict[str, int] = {}
    word, ends = [], [0]
    for text, _ in examples:
        ids = [place.setdefault(w, len(place)) for w in sorted(distinct_words(text))]
        word.append(np.array(ids, np.int32))
        ends.append(ends[-1] + len(ids))
    names, word = list(place), np.concatenate(word)
    del place
    doc = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(ends))
    # the n-grams of each word, a block of words at a time
    blocks, sizes = [], []
    for i in range(0, len(names), BLOCK):
        of, grams = word_grams(names[i:i + BLOCK])
        order = np.argsort(of, kind="stable")
        blocks.append(grams[order].astype(np.int32))
        sizes.append(np.bincount(of, minlength=len(names[i:i + BLOCK])))
    grams = np.concatenate(blocks or [np.zeros(0, np.int32)])
    begins = np.r_[0, np.cumsum(np.concatenate(sizes or [np.zeros(0, np.int64)]))]
    held = np.full((2, size), smooth)
    for i, c in enumerate(y.astype(int)):
        words = word[ends[i]:ends[i + 1]]
        if len(words):
            held[c, np.unique(np.concatenate([grams[begins[w]:begins[w + 1]] for w in words]))] += 1
    n = [np.sum(y == c) + 2 * smooth for c in (0, 1)]
    used = np.unique(grams)
    index = np.zeros(size, np.int32)
    index[used] = np.arange(len(used))
    stretch = [(i, min(i + BLOCK, len(names))) for i in range(0, len(names), BLOCK)]
    blocks = [index[grams[begins[i]:begins[j]]] for i, j in stretch]
    del grams
    owners = [np.repeat(np.arange(j - i, dtype=np.int32), np.diff(begins[i:j + 1])) for i, j in stretch]
    ratio = (np.log(held[1] / n[1]) - np.log(held[0] / n[0]))[used]
    share = 1 / len(y)
    w, b = np.zeros(len(used)), 0.0
    sq_w, sq_b = np.full(len(used), 1e-8), 1e-8
    for _ in range(rounds):
        scaled = w * ratio
        told = np.concatenate([np.bincount(of, weights=scaled[at], minlength=j - i) for (i, j), at, of in zip(stretch, blocks, owners)])
        z = b + np.bincount(doc, weights=told[word], minlength=len(y))
        off = share * (y - 1 / (1 + np.exp(-np.clip(z, -40, 40))))
        back = np.bincount(word, weights=off[doc], minlength=len(names))
        grad = np.zeros(len(used))
        for (i, j), at, of in zip(stretch, blocks, owners):
            grad += np.bincount(at, weights=back[i:j][of], minlength=len(used))
        grad = grad * ratio - ridge * w
        sq_w += grad ** 2
        w += rate * grad / np.sqrt(sq_w)
        sq_b += off.sum() ** 2
        b += rate * off.sum() / np.sqrt(sq_b)
    model.weight[used] = w * ratio
    model.bias = float(b)
    return model


def toxicity(docs: DataFrame, model: NaiveBayesLinear, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every whole text; the empty and the null text get the score of the bias.

    Ids may be null or repeat; an empty table gives an empty result; other columns are left out.
    """
    out = pa.schema([("id", arrow_type(docs, id_col)), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batch):
        scores = model.scores(texts_of(batch))
        return batch.column("id"), scores, [int(s >= 0.5) for s in scores]

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return map_slices(narrow, "text", run, f"id {kind}, score double, predicted int", out).withColumnRenamed("id", id_col)
