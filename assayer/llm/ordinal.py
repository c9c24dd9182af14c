"""Cumulative-link regression on graded ratings over hashed text."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.arrowio import arrow_type, map_slices, texts_of
from assayer.llm.hashing import WORD, buckets

BITS = 18


def shape(word: str) -> str:
    """The kinds of characters of a word, runs taken together: ``Abc...`` and ``ABC!!`` differ, ``abc`` and ``xy`` do not."""
    out = []
    for c in word:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out)


def word_features(word: str) -> list[int]:
    """Buckets of a word: itself in lower case, its shape, its first and last letters."""
    low = word.lower()
    return buckets([f"w{low}", f"s{shape(word)}", f"p{low[:3]}", f"q{low[-3:]}"], BITS)


PAIR = [f"r{i}" for i in (0, 1)]


@dataclass
class Ordinal:
    """P(grade > k) = sigmoid(x . weight - cut[k]) with rising cuts; x is the mean of the features of the words."""

    weight: np.ndarray
    cuts: np.ndarray
    memo: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        at = np.flatnonzero(self.weight)
        return at.astype(np.int32), self.weight[at].astype(np.float32), self.cuts

    def __setstate__(self, state):
        at, values, self.cuts = state
        self.weight = np.zeros(1 << BITS, np.float32)
        self.weight[at] = values
        self.memo = {}

    def of_word(self, word: str) -> float:
        held = self.memo.get(word)
        if held is None:
            held = float(self.weight[word_features(word)].sum())
            if len(self.memo) > 300_000:
                self.memo.clear()
            self.memo[word] = held
        return held

    def tails(self, text: str) -> np.ndarray:
        """P(grade > k) for each cut; a text without words has the score zero."""
        words = WORD.findall(text)
        z = 0.0
        if words:
            same = sum(a == b for a, b in zip(words, words[1:]))
            low, high = buckets(PAIR, BITS)
            z = (sum(map(self.of_word, words)) + same * float(self.weight[high])
                 + (len(words) - same) * float(self.weight[low])) / len(words)
        return 1 / (1 + np.exp(-np.clip(z - self.cuts, -40, 40)))


def _matrix(texts: list[str]):
    rows, cols, values = [], [], []
    low, high = buckets(PAIR, BITS)
    for i, text in enumerate(texts):
        words = WORD.findall(text)
        if not words:
            continue
        count: dict[int, float] = {}
        for w in words:
            for f in word_features(w):
                count[f] = count.get(f, 0) + 1
        same = sum(a == b for a, b in zip(words, words[1:]))
        count[high] = count.get(high, 0) + same
        count[low] = count.get(low, 0) + len(words) - same
        rows += [i] * len(count)
        cols += list(count)
        values += [v / len(words) for v in count.values()]
    return np.array(rows, np.int64), np.array(cols, np.int64), np.array(values)


def fit(examples: list[tuple[str, int]], grades: int, rounds: int = 200, rate: float = 0.3, ridge: float = 1e-4) -> Ordinal:
    """Maximum likelihood by gradient steps; every grade weighs the same.

    The cuts stay in order because each is the one before plus the exponential of a free value. Without
    examples the weights are zero and the cuts spread the grades evenly.
    """
    model = Ordinal(np.zeros(1 << BITS, np.float32),
                    np.array([np.log((k + 1) / (grades - k - 1)) for k in range(grades - 1)]))
    if not examples:
        return model
    y = np.array([g for _, g in examples])
    rows, cols, value = _matrix([t for t, _ in examples])
    used, at = np.unique(cols, return_inverse=True)
    per = np.array([1 / max(1, np.sum(y == g)) for g in range(grades)]) / len(np.unique(y))
    share = per[y]
    w = np.zeros(len(used))
    free = np.r_[model.cuts[0], np.log(np.diff(model.cuts))]
    sq_w, sq_f = np.full(len(used), 1e-8), np.full(len(free), 1e-8)
    for _ in range(rounds):
        cut = np.cumsum(np.r_[free[0], np.exp(free[1:])])
        z = np.bincount(rows, weights=value * w[at], minlength=len(y))
        above = 1 / (1 + np.exp(-np.clip(z[:, None] - cut, -30, 30)))  # P(grade > k)
        edge = np.c_[np.ones(len(y)), above, np.zeros(len(y))]
        slope = np.c_[np.zeros(len(y)), above * (1 - above), np.zeros(len(y))]
        i = np.arange(len(y))
        mass = np.maximum(edge[i, y] - edge[i, y + 1], 1e-12)
        dz = share * (slope[i, y] - slope[i, y + 1]) / mass
        dcut = np.zeros(grades + 1)
        np.add.at(dcut, y, -share * slope[i, y] / mass)
        np.add.at(dcut, y + 1, share * slope[i, y + 1] / mass)
        dcut = dcut[1:-1]
        later = np.cumsum(dcut[::-1])[::-1]
        grad_f = np.r_[later[0], later[1:] * np.exp(free[1:])]
        grad_w = np.bincount(at, weights=value * dz[rows], minlength=len(used)) - ridge * w
        sq_w += grad_w ** 2
        w += rate * grad_w / np.sqrt(sq_w)
        sq_f += grad_f ** 2
        free += rate * grad_f / np.sqrt(sq_f)
    model.weight[used] = w
    model.cuts = np.cumsum(np.r_[free[0], np.exp(free[1:])])
    return model


def grade(docs: DataFrame, model: Ordinal, tail: int, min_tail: float = 0.5, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(id, expected_grade, tail_probability, selected) of every whole text.

    ``tail_probability`` is P(grade >= tail); a row is selected from ``min_tail`` on. Null counts as empty; a text
    without words gets the prior of the cuts. Ids may be null or repeat; an empty table gives an empty result.
    """
    out = pa.schema([("id", arrow_type(docs, id_col)), ("expected_grade", pa.float64()), ("tail_probability", pa.float64()),
                     ("selected", pa.bool_())])

    def run(batch):
        all_ = [model.tails(t) for t in texts_of(batch)]
        top = [float(x[tail - 1]) for x in all_]
        return batch.column("id"), [float(x.sum()) for x in all_], top, [t >= min_tail for t in top]

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return map_slices(narrow, "text", run, f"id {kind}, expected_grade double, tail_probability double, selected boolean",
                      out).withColumnRenamed("id", id_col)
