"""Lines of a text labelled content or boilerplate by a linear-chain conditional random field."""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.arrowio import arrow_type, give_back, map_slices, texts_of

SPACES = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = 18
MARKS = re.compile(rb"[.!?:,;]+$")


def _hash_words(words: list[bytes]) -> np.ndarray:
    memo: dict[bytes, int] = {}
    out = np.empty(len(words), np.uint64)
    digest = xxhash.xxh3_64_intdigest
    for i, w in enumerate(words):
        h = memo.get(w)
        if h is None:
            h = memo[w] = digest(w)
        out[i] = h
    return out


def repeated(words: list[bytes], width: int = 5) -> np.ndarray:
    """Whether each word lies in a window of ``width`` words that is found twice or more in the text."""
    n = len(words)
    mask = np.zeros(n, bool)
    if n <= width:
        return mask
    h = _hash_words(words)
    window = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        window = (window * np.uint64(0x9E3779B97F4A7C15)) ^ h[i:n - width + 1 + i]
        window ^= window >> np.uint64(29)
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    twice = np.zeros(len(window), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: str) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Base counts of a text, and per line with a word its features and its number of words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    mask = repeated(words)
    chars = len(text) - (len(raw) - len(raw.translate(None, SPACES)))
    base = {"n_words": len(words), "word_chars": chars, "n_symbols": len(raw) - len(raw.translate(None, SYMBOLS)),
            "n_dup_lines": 0, "n_repeat_words": int(mask.sum())}
    seen: set[bytes] = set()
    found, sizes, at = [], [], 0
    for line in raw.split(b"\n"):
        parts = line.split()
        if not parts:
            continue
        dup = line in seen
        base["n_dup_lines"] += dup
        seen.add(line)
        n = len(parts)
        again = float(mask[at:at + n].mean())
        at += n
        found.append(_line(line, parts, n, dup, again))
        sizes.append(n)
    return base, np.array(found, float).reshape(-1, FEATURES), np.array(sizes, float)


def _line(line: bytes, parts: list[bytes], n: int, dup: bool, again: float) -> list[float]:
    size = sum(map(len, parts))
    symbols = len(line) - len(line.translate(None, SYMBOLS))
    text = line.decode("utf-8", "replace")
    letters = max(1, sum(map(str.isalpha, text)) if n < 4 else len(text) - n)
    upper = sum(map(str.isupper, text)) / letters
    digits = sum(map(line.count, (b"0", b"1", b"2", b"3", b"4", b"5", b"6", b"7", b"8", b"9"))) / size
    bang = line.count(b"!") / n
    ended = parts[-1][-1:] in (b".", b"!", b"?", b":")
    alike = sum(a == b for a, b in zip(parts, parts[1:])) / n
    return [1.0, symbols / n > 0.02, symbols / n > 0.2, symbols / n > 0.6, upper > 0.25, upper > 0.6, digits > 0.1,
            digits > 0.3, bang > 0.1, bang > 0.5, ended, n <= 2, n <= 8, n > 40, dup, again > 0.2, alike > 0.1,
            alike > 0.4]


@dataclass
class LineCRF:
    """Weights of two states (0 content, 1 boilerplate): ``emit[state, feature]``, ``step[from, to]``."""

    emit: np.ndarray
    step: np.ndarray

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        """The most likely states; content wins a tie."""
        if not len(x):
            return np.zeros(0, int)
        score = x @ self.emit.T
        best = score[0]
        back = np.zeros((len(x), 2), int)
        for i in range(1, len(x)):
            ways = best[:, None] + self.step
            back[i] = ways.argmax(0)
            best = ways.max(0) + score[i]
        out = np.zeros(len(x), int)
        out[-1] = best.argmax()
        for i in range(len(x) - 1, 0, -1):
            out[i - 1] = back[i, out[i]]
        return out

    def content_share(self, x: np.ndarray, sizes: np.ndarray) -> float:
        """Share of the words that lie in content lines; 0 without words."""
        return float(sizes[self.viterbi(x) == 0].sum() / sizes.sum()) if len(x) else 0.0


def _forward_backward(model: LineCRF, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    score = x @ model.emit.T
    n = len(x)
    a, b = np.zeros((n, 2)), np.zeros((n, 2))
    a[0] = score[0]
    for i in range(1, n):
        a[i] = np.logaddexp(a[i - 1, 0] + model.step[0], a[i - 1, 1] + model.step[1]) + score[i]
    for i in range(n - 2, -1, -1):
        ways = model.step + score[i + 1] + b[i + 1]
        b[i] = np.logaddexp(ways[:, 0], ways[:, 1])
    total = np.logaddexp(*a[-1])
    state = np.exp(a + b - total)
    pair = np.zeros((2, 2))
    for i in range(n - 1):
        pair += np.exp(a[i][:, None] + model.step + score[i + 1] + b[i + 1] - total)
    return state, pair


def fit_crf(examples: list[tuple[np.ndarray, np.ndarray]], rounds: int = 40, rate: float = 0.5,
            ridge: float = 1e-3) -> LineCRF:
    """Conditional log-likelihood by gradient steps over (features, states) of labelled texts.

    A text's gradient is divided by its number of lines, so long texts do not outweigh the others.
    """
    model = LineCRF(np.zeros((2, FEATURES)), np.zeros((2, 2)))
    data = [(x, y) for x, y in examples if len(x)]
    if not data:
        return model
    grads = [np.zeros_like(model.emit), np.zeros_like(model.step)]
    seen = [np.full_like(g, 1e-8) for g in grads]
    for _ in range(rounds):
        grads = [-ridge * model.emit, -ridge * model.step]
        for x, y in data:
            state, pair = _forward_backward(model, x)
            gold = np.eye(2)[y]
            grads[0] = grads[0] + (gold - state).T @ x / len(x) / len(data)
            if len(y) > 1:
                told = np.zeros((2, 2))
                np.add.at(told, (y[:-1], y[1:]), 1)
                grads[1] = grads[1] + (told - pair) / len(x) / len(data)
        for part, grad, sq in zip((model.emit, model.step), grads, seen):
            sq += grad ** 2
            part += rate * grad / np.sqrt(sq)
    return model


def weak_crf(examples: list[tuple[str, int]]) -> LineCRF:
    """A field from document grades: in good texts every line is content; in bad ones the lines with a trace of noise."""
    data = []
    for text, good in examples:
        _, x, _ = measure(text)
        if len(x):
            data.append((x, np.zeros(len(x), int) if good else np.ones(len(x), int)))
    return fit_crf(data)


def verdict(text: str, model: LineCRF, min_words: int = 10, most_repeat: float = 20, min_share: float = 0.5) -> dict:
    """Base counts, whether they fail, the number of lines, the content share and whether the text stays."""
    base, x, sizes = measure(text)
    failed = base["n_words"] < min_words or 100 * base["n_repeat_words"] > most_repeat * base["n_words"]
    share = model.content_share(x, sizes)
    return {**base, "base_failed": failed, "kept": bool(not failed and share >= min_share), "n_lines": len(x), "content_share": share}


NAMES = [*BASE, "base_failed", "kept", "n_lines", "content_share"]
KINDS = ["long"] * 5 + ["boolean", "boolean", "long", "double"]


def line_labels(docs: DataFrame, model: LineCRF, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """Base counts of every whole text, whether the base rules fail, the content share and the verdict.

    Words are runs without ASCII white space. A text fails the base rules with fewer than ``min_words`` words or more than
    ``most_repeat`` per cent of its words in repeated five-word windows. Others stay if at least ``min_share`` of their
    words lie in lines that Viterbi decoding marks as content. Null text has no words and fails. Ids may be null or
    repeat; an empty table gives an empty result; other columns are left out.
    """
    arrow = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    out = pa.schema([("id", arrow_type(docs, id_col)), *[(n, arrow[k]) for n, k in zip(NAMES, KINDS)]])

    def run(batch):
        found = [verdict(t, model, **limits) for t in texts_of(batch)]
        return [batch.column("id"), *[[f[n] for f in found] for n in NAMES]]

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"id {kind}", *[f"{n} {k}" for n, k in zip(NAMES, KINDS)]])
    return map_slices(narrow, "text", run, schema, out).withColumnRenamed("id", id_col)


def kept_text(model: LineCRF, **limits):
    """The verdict as a column function of a text, for filters that need no other column and no shuffle."""
    @F.pandas_udf("boolean")
    def kept(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in texts:
            yield text.map(lambda t: verdict(t or "", model, **limits)["kept"]).astype(bool)
        give_back()

    return kept
