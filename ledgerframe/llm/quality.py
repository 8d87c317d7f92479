"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from whole texts: lengths, character classes, repetition of words and lines. Trees are grown on
binned values with logistic loss; the fitted forest is flattened into arrays (feature, threshold,
children, value) that numpy walks for all rows at once, a level at a time.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, map_arrow, process_cache, scored

NAMES = (
    "log_bytes", "log_words", "log_lines", "mean_word", "max_word", "upper", "lower", "digit", "space", "symbol", "high", "stops",
    "commas", "bangs", "pipes", "hashes", "caps_words", "symbol_words", "short_words", "distinct", "top_word", "repeats", "pair_repeats",
    "line_repeats", "line_mean", "letter_entropy", "packed", "ends_well", "sentence_len", "word_var",
)
_ASCII = np.arange(256)
_CLASSES = np.stack(
    [
        (_ASCII >= 65) & (_ASCII <= 90), (_ASCII >= 97) & (_ASCII <= 122), (_ASCII >= 48) & (_ASCII <= 57), np.isin(_ASCII, [9, 10, 11, 12, 13, 32]),
        ((_ASCII >= 33) & (_ASCII <= 47)) | ((_ASCII >= 58) & (_ASCII <= 64)) | ((_ASCII >= 91) & (_ASCII <= 96)) | ((_ASCII >= 123) & (_ASCII <= 126)), _ASCII >= 128,
        _ASCII == 46, _ASCII == 44, _ASCII == 33, _ASCII == 124, np.isin(_ASCII, [35, 36, 37, 38, 42]),
    ]
).astype(np.float64)


def statistics(text: str | None) -> np.ndarray:
    """The document statistics of a whole text, in the order of ``NAMES``; all zero for null and blank texts."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return np.zeros(len(NAMES))
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(np.float64)
    n, m = len(data), len(words)
    upper, lower, digit, space, symbol, high, stops, commas, bangs, pipes, hashes = (_CLASSES @ counts) / n
    size = np.fromiter(map(len, words), np.int64, m)
    kinds = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    same = sum(map(bytes.__eq__, words[1:], words[:-1])) if m > 1 else 0
    pairs = len(set(zip(words, words[1:]))) / max(1, m - 1)
    share = counts[counts > 0] / n
    tails = Counter(w[-1] for w in words)
    return np.array([
        np.log1p(n), np.log1p(m), np.log1p(len(lines)), size.mean(), size.max(), upper, lower, digit, space, symbol, high, stops,
        commas, bangs, pipes, hashes, sum(map(bytes.isupper, words)) / m, sum(c for b, c in tails.items() if b < 128 and _CLASSES[4, b]) / m, (size <= 2).mean(), len(kinds) / m, kinds.most_common(1)[0][1] / m, same / m, 1 - pairs,
        1 - len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))), -(share * np.log2(share)).sum(), len(zlib.compress(data, 1)) / n, float(data.rstrip()[-1:] in b".!?"), m / max(1.0, stops * n), size.std(),
    ])


@dataclass
class Forest:
    """Trees flattened into arrays; node 0 of each tree is its root, a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                go = x[rows, self.feature[t, at]] <= self.threshold[t, at]
                at = np.where(go, self.left[t, at], self.right[t, at])
            out += self.value[t, at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 10, ridge: float = 1.0) -> Forest:
    """Histogram gradient boosting with logistic loss. With no rows, or one class, the score is the base rate."""
    width = 2 ** (depth + 1) - 1
    shape = (trees, width)
    base_rate = (y.sum() + 1) / (len(y) + 2)
    itself = np.tile(np.arange(width), (trees, 1))
    out = Forest(np.zeros(shape, np.int64), np.full(shape, np.inf), itself, itself.copy(), np.zeros(shape), depth, float(np.log(base_rate / (1 - base_rate))))
    if len(y) < 2 * least or y.min() == y.max():
        return out
    d = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    flat = code + np.arange(d) * bins
    margin = np.full(len(y), out.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node, free = np.zeros(len(y), np.int64), 1
        level = [0]
        for step in range(depth):
            split = []
            for k in level:
                rows = np.nonzero(node == k)[0]
                if len(rows) < 2 * least:
                    continue
                cell = flat[rows].ravel()
                hist = lambda w: np.bincount(cell, np.repeat(w, d), minlength=d * bins).reshape(d, bins).cumsum(1)
                gl, hl, nl = hist(g[rows]), hist(h[rows]), hist(np.ones(len(rows)))
                gt, ht = g[rows].sum(), h[rows].sum()
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(nl < least) | (len(rows) - nl < least)] = -1
                j, b = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[j, b] <= 1e-6 or b >= len(cuts[j]):
                    continue
                out.feature[t, k], out.threshold[t, k] = j, cuts[j][b]
                out.left[t, k], out.right[t, k] = free, free + 1
                node[rows] = np.where(code[rows, j] <= b, free, free + 1)
                split += [free, free + 1]
                free += 2
            level = split
        gs, hs = np.bincount(node, g, minlength=width), np.bincount(node, h, minlength=width)
        out.value[t] = -rate * gs / (hs + ridge)
        margin += out.value[t][node]
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: int, held: int, limit: int) -> DataFrame:
    """Whole texts and labels of at most ``limit`` labelled documents outside the held-out fold.

    The fold is crc32(doc_id as text) mod ``fold``; ids are taken in order of a hash, so the sample is the same each time.
    ``limit`` also bounds what is broadcast and collected. A document labelled more than once gets its largest
    label; null labels and ids are left out.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(F.pmod(crc_of_id(F.col("doc_id")), F.lit(fold)) != held)
    ids = ids.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "label")


def train_quality(docs: DataFrame, labels: DataFrame, fold: int = 3, held: int = 1, limit: int = 20_000, label: str = "quality") -> Forest:
    """Fit the forest on a bounded sample of labelled documents (``limit`` rows of statistics reach the driver)."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        return {"doc_id": cols["doc_id"], "label": cols["label"], "x": [statistics(t).tolist() for t in cols["text"]]}

    rows = map_arrow(labelled_sample(docs, labels, label, fold, held, limit), run, "doc_id long, label int, x array<double>").toArrow()
    x = np.array(rows.column("x").to_pylist(), np.float64).reshape(-1, len(NAMES))
    y = rows.column("label").to_numpy().astype(np.float64)
    order = np.lexsort((y, rows.column("doc_id").to_numpy()))
    return fit_forest(x[order], y[order])


def quality_scores(docs: DataFrame, forest: Forest, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and score (0 to 1, higher: better) of every whole text; null and empty texts are scored too.

    Null and repeated ids give a row each. ``carry`` names further columns of ``docs`` that pass through unchanged; where one of
    them is called score, the score's own name gets an underscore more.
    """

    def score(texts: list[str | None]) -> list[float]:
        process_cache("quality", bool, keep=1)  # nothing is remembered here, but what a worker remembers of another stage goes
        return forest.score(np.stack([statistics(t) for t in texts])).tolist()

    return scored(docs, score, carry)
