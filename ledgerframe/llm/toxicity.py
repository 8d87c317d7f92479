"""Toxicity: a convolutional text classifier in numpy.

Words (letters, digits and non-ASCII bytes; A-Z in lower case) have hashed embeddings: the sum over the word itself and
its beginnings, so that inflected forms share what is learnt of a stem. Every word enters one table of fixed size. Each of its
features has two rows there, under independent hashes, and counts with what the two agree on (the smaller
value where the signs are the same, else zero), so a word that shares a row with another one by chance takes nothing from it. Rows
start at what their documents' labels say, shrunk towards zero, and are trained on with the rest. Filters of several widths
slide over the whole sequence; each keeps its maximum; a linear layer gives the margin. Decision thresholds are calibrated
for each language, which is told from the text's own function words, and the margin is shifted so that the threshold of every
language lies at the same score.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, process_cache, scored
from .quality import labelled_sample

# Frequent function words of the four languages.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was with as on be at by are from this an or not",
    "de": "der die das und ist von mit den dem nicht auf für im ein eine zu sich als auch des",
    "fr": "le la les et des est un une du qui dans pour pas sur au avec par ce il ne",
    "es": "el los las y en una por con para del se no su al lo como más de que la",
}
LANGUAGES = (*FUNCTION_WORDS, "other")
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+").findall
_VOTES: dict[bytes, tuple[int, ...]] = {}
for _i, _words in enumerate(FUNCTION_WORDS.values()):
    for _w in _words.split():
        _VOTES[_w.encode()] = (*_VOTES.get(_w.encode(), ()), _i)


def words_of(text: str | None) -> list[bytes]:
    return _WORD((text or "").encode("utf-8", "surrogatepass").lower())


def hashes_of(word: bytes) -> list[int]:
    """Hashes of a word's features: its own, then those of its proper beginnings of 4 to 10 bytes."""
    return [zlib.crc32(word), *(zlib.crc32(word[:k]) ^ 0x9E3779B9 for k in range(4, min(11, len(word))))]


def rows_of(hashes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The two rows of each feature in a table of ``rows`` (a power of two)."""
    bits = int(rows).bit_length() - 1
    h = hashes.astype(np.uint64)
    return (h & np.uint64(rows - 1)).astype(np.int64), ((h * np.uint64(2654435761) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - bits)).astype(np.int64)


def features_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all features of ``words``, one after the other, and how many each word has."""
    sizes, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    for s in range(0, len(words), 16_384):  # blocks, so that few numbers are Python objects at a time
        found = list(map(hashes_of, words[s : s + 16_384]))
        sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
        hashes.append(np.fromiter((h for f in found for h in f), np.uint32, int(sizes[-1].sum())))
    return np.concatenate(hashes), np.concatenate(sizes)


def agreed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What two rows agree on: the smaller value where signs are the same, else zero."""
    return np.where(a * b > 0, np.where(np.abs(a) < np.abs(b), a, b), 0)


def language_of(words: list[bytes]) -> int:
    """Index into ``LANGUAGES`` by function words; 'other' if none occurs."""
    votes = [0] * len(FUNCTION_WORDS)
    for w in words:
        for i in _VOTES.get(w, ()):
            votes[i] += 1
    best = max(votes)
    return votes.index(best) if best else len(FUNCTION_WORDS)


class SparseRows:
    """A table of which most rows are zero, to be read by row numbers: a worker holds no more than the other rows."""

    def __init__(self, table: np.ndarray):
        self.shape, self.dtype = table.shape, table.dtype
        self.some = np.nonzero(table.any(1))[0]
        self.values = np.concatenate([table[self.some], np.zeros((1, table.shape[1]), table.dtype)])

    def __len__(self) -> int:
        return self.shape[0]

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.some, rows)
        found = np.append(self.some, -1)[at] == rows
        return self.values[np.where(found, at, len(self.some))]


@dataclass
class TextConvNet:
    """The embedding table, filters by width, linear layer, and what is taken off the margin by language."""

    table: np.ndarray | SparseRows
    filters: list[np.ndarray]  # of width w: (w, embedding size, filters)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    shift: np.ndarray

    def __getstate__(self) -> dict:
        """Only rows that aren't zero travel."""
        return self.__dict__ | {"table": self.table if isinstance(self.table, SparseRows) else SparseRows(self.table)}

    def arrays(self) -> dict:
        """The net as numpy arrays in a dict, rows that are zero left out."""
        state = self.__getstate__()
        return state | {"table": state["table"].__dict__}

    @classmethod
    def of_arrays(cls, arrays: dict) -> TextConvNet:
        table = SparseRows.__new__(SparseRows)
        table.__dict__.update(arrays["table"])
        return cls(**arrays | {"table": table})

    @property
    def reach(self) -> int:
        """The width of the widest filter."""
        return max(map(len, self.filters))

    def embed(self, hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Embeddings of words given the hashes of their features, one word after the other."""
        out, ends = np.zeros((len(size), self.table.shape[1]), self.table.dtype), np.cumsum(size)
        for s in range(0, len(size), 32_768):
            part = size[s : s + 32_768]
            first = int(ends[s] - size[s])
            a, b = rows_of(hashes[first : first + int(part.sum())], len(self.table))
            out[s : s + 32_768] = np.add.reduceat(agreed(self.table[a], self.table[b]), np.cumsum(part) - part, axis=0)
        return out

    def project(self, embedded: np.ndarray) -> list[list[np.ndarray]]:
        """Each filter position applied to each embedding, so a convolution is a sum of look-ups."""
        return [[embedded @ w[j] for j in range(len(w))] for w in self.filters]

    def pooled(self, rows: np.ndarray, tables) -> tuple[np.ndarray, list[np.ndarray]]:
        """Maxima of all filters over the whole sequence (padded with words of embedding zero, number 0), and where they are."""
        top, where = [], []
        padded = np.concatenate([rows, np.zeros(self.reach, np.int64)])
        for table, b in zip(tables, self.bias):
            n = len(rows) + 1
            act = table[0][padded[:n]]
            for j in range(1, len(table)):
                act = act + table[j][padded[j : j + n]]
            at = act.argmax(0)
            top.append(act[at, np.arange(act.shape[1])] + b)
            where.append(at)
        return np.concatenate(top), where

    def margin(self, rows: np.ndarray, tables) -> float:
        return float(np.maximum(self.pooled(rows, tables)[0], 0) @ self.out + self.out_bias)


class Scorer:
    """A net with the words it has met: number 0 stands for all of embedding zero, others have rows of look-up tables, which grow.

    Past ``limit`` words the memory is dropped, which costs time and changes no score.
    """

    def __init__(self, net: TextConvNet, limit: int = 100_000):
        self.net, self.limit = net, limit
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.tables = self.net.project(np.zeros((1, self.net.table.shape[1]), self.net.table.dtype))

    def _learn(self, words: set[bytes]) -> None:
        new = sorted(words.difference(self.known))
        if not new:
            return
        found = self.net.embed(*features_of(new))
        live = found.any(1)
        number = np.where(live, np.cumsum(live) + len(self.tables[0][0]) - 1, 0)
        self.known.update(zip(new, number.tolist()))
        if live.any():
            more = self.net.project(found[live])
            self.tables = [[np.concatenate([a, b]) for a, b in zip(old, add)] for old, add in zip(self.tables, more)]

    def score(self, texts: list[str | None]) -> list[float]:
        words = [words_of(t) for t in texts]
        if len(self.known) > self.limit:
            self._forget()
        self._learn(set().union(*words))
        margin = np.zeros(len(words))
        for i, w in enumerate(words):
            rows = np.fromiter(map(self.known.__getitem__, w), np.int64, len(w))
            margin[i] = self.net.margin(_short(rows, self.net.reach), self.tables) - self.net.shift[language_of(w)]
        return (1 / (1 + np.exp(-np.clip(margin, -30, 30)))).tolist()


def evidence(docs: Iterable[np.ndarray], y: np.ndarray, rows: int, shrink: float = 4.0) -> np.ndarray:
    """How many standard deviations, less ``shrink``, each table row's share of positive documents lies over the base rate (0 at least).

    ``docs`` holds the feature hashes of each document. Both rows of every feature are counted, once a document.
    """
    n, t = np.zeros(rows, np.float32), np.zeros(rows, np.float32)
    for h, label in zip(docs, y):
        at = np.unique(np.concatenate(rows_of(h, rows)))
        n[at] += 1
        t[at] += label
    rate = y.mean()
    return np.maximum((t - n * rate) / np.sqrt(np.maximum(n, 1) * rate * (1 - rate)) - shrink, 0)


def fit(texts: list[str | None], y: np.ndarray, rows: int = 2**20, size: int = 8, each: int = 8, widths: tuple[int, ...] = (1, 2, 3), steps: int = 600, epochs: tuple[int, int] = (4, 30), batch: int = 32, rate: float = 0.02, cut: float = 0.3, seed: int = 7) -> TextConvNet:
    """Train on log loss (Adam; for the table's rows Adagrad, as few change in a step), then calibrate on every fifth document, which training doesn't see.

    ``epochs`` are the fewest and most that ``steps`` batches may take. With no rows or a single class the net keeps its prior.
    """
    rng = np.random.default_rng(seed)
    held = np.arange(len(y)) % 5 == 4
    train = np.nonzero(~held)[0]
    prior = (y.sum() + 1) / (len(y) + 2)
    net = TextConvNet(
        np.zeros((rows, size), np.float32), [rng.normal(0, 1 / np.sqrt(size * w), (w, size, each)).astype(np.float32) for w in widths], [np.zeros(each, np.float32) for _ in widths],
        np.abs(rng.normal(0, 0.1, each * len(widths))).astype(np.float32), float(np.log(prior / (1 - prior))), np.zeros(len(LANGUAGES)),
    )
    if not len(y) or y.min() == y.max():
        return net
    number: dict[bytes, int] = {}
    seqs, language = [], []
    for t in texts:
        ws = words_of(t)
        seqs.append(np.fromiter((number.setdefault(w, len(number)) for w in ws), np.int32, len(ws)))
        language.append(language_of(ws))
    hashes, count = features_of(list(number))
    del number
    first = np.cumsum(count) - count
    of_words = lambda ids: np.repeat(first[ids] - (np.cumsum(count[ids]) - count[ids]), count[ids]) + np.arange(count[ids].sum())
    start = evidence((hashes[of_words(np.unique(seqs[i]))] for i in train), y[train], rows)
    way = np.abs(rng.normal(1, 0.3, size)).astype(np.float32)
    net.table += 0.1 * np.log1p(start)[:, None].astype(np.float32) * way
    squares = np.full(rows, 0.01, np.float32)
    params = [*net.filters, *net.bias, net.out]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, k = 0, len(widths)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3)) ** 0.5
    for _ in range(min(epochs[1], max(epochs[0], -(-steps * batch // len(train))))):
        # All windows over words of embedding zero are alike and stand for padding; only words beside others are told apart.
        live = net.embed(hashes, count).any(1)
        short = {i: _short(seqs[i], net.reach, live) for i in train}
        order = rng.permutation(train)
        for s in range(0, len(order), batch):
            part = order[s : s + batch]
            ids = np.unique(np.concatenate([short[i] for i in part]))
            at = of_words(ids)
            total = np.concatenate([np.zeros((1, size), np.float32), net.embed(hashes[at], count[ids])])
            tables, grads, bias_grad, into = net.project(total), [np.zeros_like(p) for p in params], 0.0, np.zeros_like(total)
            for i in part:
                own = np.searchsorted(ids, short[i]) + 1
                top, where = net.pooled(own, tables)
                lit = np.maximum(top, 0)
                d = weight[i] * (1 / (1 + np.exp(-np.clip(lit @ net.out + net.out_bias, -30, 30))) - y[i]) / len(part)
                bias_grad += d
                grads[-1] += d * lit
                back = d * net.out * (top > 0)
                padded = np.concatenate([own, np.zeros(net.reach, np.int64)])
                for w in range(k):
                    g = back[w * each : (w + 1) * each]
                    grads[k + w] += g
                    for j in range(widths[w]):
                        here = padded[where[w] + j]
                        grads[w][j] += total[here].T * g
                        np.add.at(into, here, (net.filters[w][j] * g).T)
            step += 1
            net.out_bias -= rate * bias_grad
            for p, g, a, b in zip(params, grads, m1, m2):
                a *= 0.9
                a += 0.1 * g
                b *= 0.999
                b += 0.001 * g * g
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
            moved = np.repeat(into[1:], count[ids], axis=0)
            some = np.nonzero(moved.any(1))[0]
            for r in rows_of(hashes[at[some]], rows):
                np.add.at(squares, r, (moved[some] ** 2).mean(1))
                np.add.at(net.table, r, -rate * moved[some] / np.sqrt(squares[r])[:, None])
    margins = []
    for i in np.nonzero(held)[0]:
        ids = np.unique(seqs[i])
        at = of_words(ids)
        found = np.concatenate([np.zeros((1, size), np.float32), net.embed(hashes[at], count[ids])])
        live = np.concatenate([[False], found[1:].any(1)])
        own = np.searchsorted(ids, seqs[i]) + 1
        margins.append(net.margin(_short(own, net.reach, live), net.project(found)))
    calibrate(net, np.array(margins), y[held], np.array(language, int)[held], cut)
    return net


def _short(rows: np.ndarray, keep: int, live: np.ndarray | None = None) -> np.ndarray:
    """Runs of words of embedding zero cut to what the filters of width ``keep`` see beside others: the windows within are all alike."""
    known = np.nonzero(rows if live is None else live[rows])[0]
    near = np.unique((known[:, None] + np.arange(1 - keep, keep)).ravel()) if len(known) else known
    return rows[near[(near >= 0) & (near < len(rows))]]


def calibrate(net: TextConvNet, margins: np.ndarray, y: np.ndarray, language: np.ndarray, cut: float, least: int = 12) -> None:
    """Set each language's margin shift so that its threshold lies at score ``cut``.

    A threshold is the best by F1, three tenths up the gap. A language's own is averaged with the one over all languages, which has the
    weight of ``least`` documents against those of the language's rarer label, so few documents move it little.
    """
    if not len(y) or y.min() == y.max():
        return

    margins = np.clip(margins, -6, 6)  # far from the boundary, so that no single document moves a threshold between the labels far

    def best(m: np.ndarray, t: np.ndarray) -> float:
        order = np.argsort(-m, kind="stable")
        m, t = m[order], t[order]
        hit = np.cumsum(t)
        f1 = 2 * hit / (np.arange(1, len(t) + 1) + t.sum())
        f1[:-1][m[:-1] == m[1:]] = -1
        i = int(np.argmax(f1))
        return float(0.3 * m[i] + 0.7 * m[i + 1]) if i + 1 < len(m) else float(m[i]) - 1

    overall, at = best(margins, y), np.log(cut / (1 - cut))
    for code in range(len(LANGUAGES)):
        own = language == code
        n = min((y[own] == 1).sum(), (y[own] == 0).sum())
        net.shift[code] = ((n * best(margins[own], y[own]) if n else 0) + least * overall) / (n + least) - at


def train_toxicity(docs: DataFrame, labels: DataFrame, fold: int = 4, held: int = 2, limit: int = 6_000, limit_bytes: int = 64_000_000, label: str = "toxic", **how) -> TextConvNet:
    """Fit on a bounded sample of labelled documents outside the held-out fold: at most ``limit`` of them and ``limit_bytes`` bytes of text.

    The driver trains and holds no more than that. Ids are taken in order of a hash of the id; one whose text doesn't fit into
    what is left of the bytes is passed over.
    """
    sample = materialize(labelled_sample(docs, labels, label, fold, held, limit))
    sizes = sample.groupBy("doc_id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n"))
    kept, room = [], limit_bytes
    for r in sorted(sizes.collect(), key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id)):  # at most ``limit`` ids
        if r.n <= room:
            kept.append(r.doc_id)
            room -= r.n
    chosen = sample.sparkSession.createDataFrame([(i,) for i in kept], "doc_id long")
    rows = sample.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label").toArrow()
    ids, y = rows.column("doc_id").to_numpy(), rows.column("label").to_numpy().astype(np.float64)
    texts = rows.column("text").to_pylist()
    del rows
    order = sorted(range(len(ids)), key=lambda i: (zlib.crc32(str(ids[i]).encode()), ids[i], texts[i] or ""))
    return fit([texts[i] for i in order], y[order] if len(order) else np.zeros(0), **how)


def toxicity_scores(docs: DataFrame, net: TextConvNet, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and score (0 to 1, higher: more toxic; decisions at the calibrated cut) of every whole text.

    Null and empty texts count as no words and are scored. Null and repeated ids give a row each. ``carry`` names further columns
    that pass through; where one of them is called score, the score's own name gets an underscore more.
    """
    # As a broadcast value a worker holds the net once, not once in each task's function beside the remembered one. Broadcast
    # values are read by plain pickle, and workers may not have this package, so only arrays are sent.
    stamp, sent = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(net.arrays())
    return scored(docs, lambda texts: process_cache(("toxicity", stamp), lambda: Scorer(TextConvNet.of_arrays(sent.value)), keep=1).score(texts), carry)
