"""Best-fit packing of documents into fixed-length sequences by bin completion.

Only the number of pieces of each length matters to a packing, and there are at most ``capacity``
lengths, so the search runs on a histogram of bounded size whatever the corpus. It branches around the largest length left:
undominated fillings of the space beside it, each as often as the histogram allows, then half as often and so on down to once. Fillings come
one by one as branches ask for them, and none is left out: of one and of two items by least waste, then of three and more.
A branch is cut when the bins used so far and the waste bounds of what is left (total length over capacity, and the bounds that count lengths
too large to share a bin) reach the incumbent; best-fit decreasing gives the first incumbent. Branches are taken by their discrepancies, that is by how
far their choices lie from the first of each list: those of none, of one, of two. What ends the search is the bound, the end of all
branches, or the number of nodes; the last makes it a heuristic on large histograms.

The plan is a list of patterns with multiplicities. Pieces are dealt to it by their rank among all pieces of
their length, found from counts per writing task; no group of pieces meets in one task.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import OTHER_SPACE, SegmentEncoder
from .common import BROADCAST_ROWS, give_back, materialize, process_cache

# Letters and numbers of Latin text (below U+0180), and the matches of the word tokenizer's pattern in it.
_L, _N = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe"
_latin = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_L}]+|[{_N}]|[^ \t-\r\x85\xa0{_L}{_N}]+")
_latin_words, _latin_word = _latin.findall, _latin.fullmatch
_not_latin, _other_space = re.compile("[^\x00-\u017f]|\u0130").search, re.compile(OTHER_SPACE).search


def lower_words(text: str) -> list[str] | None:
    """Segments for a lower-casing tokenizer that drops white space.

    Latin text is put in lower case and cut at every match of the tokenizer's pattern, so that case and punctuation don't
    multiply the segments; other text is cut at white space, or (None) not at all.
    """
    try:
        text.encode("latin-1")  # far faster than the search, which only decides what this doesn't
    except UnicodeEncodeError:
        if _not_latin(text):
            return None if _other_space(text) else text.split()
    return _latin_words(text.lower())


def single_word(segment: str) -> bool:
    """Whether a segment is Latin, in lower case and one match of the tokenizer's pattern, so that it is one word beside any others."""
    return not _not_latin(segment) and segment == segment.lower() and _latin_word(segment) is not None


Plan = list[tuple[tuple[int, ...], int]]


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Fewest bins that any packing of the histogram needs: the best of the waste bounds over a threshold.

    For a threshold t, lengths over capacity - t take a bin each that nothing of t or more can join, and the
    rest of at least t needs its total length, less the room beside lengths over half the capacity.
    """
    number = np.append(np.cumsum(counts[::-1])[::-1], 0)
    total = np.append(np.cumsum((counts * np.arange(capacity + 1))[::-1])[::-1], 0)
    half, t = capacity // 2 + 1, np.arange(1, capacity // 2 + 1)
    alone = number[capacity - t + 1]
    large, rest = number[half] - alone, total[t] - total[half]
    rest = rest - (large * capacity - (total[half] - total[capacity - t + 1]))
    bounds = alone + large + np.maximum(0, -(-rest // capacity))
    return max(-(-int(total[0]) // capacity), int(bounds.max(initial=0)))


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> Plan:
    """The incumbent: longest first, each into the open bin it fits most tightly, bins of one kind together."""
    left = {}  # room -> Counter of patterns
    rooms = np.zeros(capacity + 1, bool)
    for length in range(capacity, 0, -1):
        n = int(counts[length])
        while n:
            fit = length + int(np.argmax(rooms[length:])) if rooms[length:].any() else 0
            if not fit:
                each = capacity // length
                bins, n_in = (n // each, each) if n >= each else (1, n)
                room = capacity - length * n_in
                left.setdefault(room, Counter())[(length,) * n_in] += bins
                rooms[room] = room > 0
                n -= bins * n_in
                continue
            pattern, have = next(iter(left[fit].items()))
            take = min(n, have)
            if take == have:
                del left[fit][pattern]
            else:
                left[fit][pattern] = have - take
            if not left[fit]:
                del left[fit]
                rooms[fit] = False
            room = fit - length
            left.setdefault(room, Counter())[(*pattern, length)] += take
            rooms[room] = room > 0
            n -= take
    return [(p, m) for bins in left.values() for p, m in bins.items()]


def _covers(big: tuple[int, ...], small: tuple[int, ...]) -> bool:
    """Whether the items of ``small`` can be put into those of ``big``, each taken as a bin (greedily tested)."""
    room = sorted(big, reverse=True)
    for x in sorted(small, reverse=True):
        fit = [i for i, r in enumerate(room) if r >= x]
        if not fit:
            return False
        room[min(fit, key=lambda i: room[i])] -= x
    return True


def _larger_first(counts: np.ndarray, room: int, items: int, largest: int) -> Iterator[tuple[int, ...]]:
    """Fillings of ``room`` with exactly ``items`` items in falling order, none over ``largest``, the last one the largest that fits."""
    top = min(room, largest)
    if items == 1:
        have = np.nonzero(counts[1 : top + 1])[0]
        if len(have):
            yield (int(have[-1]) + 1,)
        return
    for first in np.nonzero(counts[1 : top + 1])[0][::-1].tolist():
        first += 1
        if first * items < room and not counts[1 : room - first + 1].any():
            continue
        counts[first] -= 1
        rest = list(_larger_first(counts, room - first, items - 1, first)) if items == 2 else _larger_first(counts, room - first, items - 1, first)
        counts[first] += 1
        it = iter(rest)
        while True:
            counts[first] -= 1
            got = next(it, None)
            counts[first] += 1
            if got is None:
                break
            yield (first, *got)


def completions(counts: np.ndarray, room: int, budget: list[float] | None = None) -> Iterator[tuple[int, ...]]:
    """All undominated fillings of ``room``, one by one; of ``budget`` (a list of one number) each filling looked at takes a fiftieth, and none is left at 0.

    One and two items come first, least waste first and larger items first on ties, then three items, four and so on. The last item is
    always the largest that fits. A filling whose items fit into those of an earlier one is dominated by it, and dropped.
    """
    counts = counts[: max(room, 0) + 1].copy()
    counts[0] = 0
    sizes = np.nonzero(counts)[0]
    if not len(sizes):
        yield ()
        return
    under = np.maximum.accumulate(np.where(counts > 0, np.arange(room + 1), 0))
    second = under[room - sizes]
    second = np.where((second == sizes) & (counts[sizes] < 2), under[sizes - 1], second)
    fits = second <= sizes
    pairs = [(int(a), int(b)) for a, b in zip(sizes[fits], second[fits]) if b]
    small = sorted([(int(under[room]),), *pairs], key=lambda f: (room - sum(f), len(f), tuple(-x for x in f)))
    more = (f for items in range(3, room // int(sizes[0]) + 1) for f in _larger_first(counts, room, items, room))
    kept: list[tuple[int, ...]] = []
    for f in itertools.chain(small, more):
        if budget is not None:
            budget[0] -= 0.02
            if budget[0] <= 0:
                return
        if kept and kept[0] == (room,):  # it dominates all others
            return
        if not any(_covers(g, f) for g in kept):
            kept.append(f)
            yield f


class _Node:
    """A place in the search: the choices around the largest length, made as they are asked for, and those made."""

    def __init__(self, counts: np.ndarray, capacity: int, budget: list[float]):
        self.large = int(np.nonzero(counts)[0][-1])
        beside = counts.copy()
        beside[self.large] -= 1
        self.counts, self.fills = counts.copy(), completions(beside, capacity - self.large, budget)
        self.made: list[tuple[tuple[int, ...], int]] = []
        self.halves: list[tuple[tuple[int, ...], int]] = []

    def choice(self, i: int) -> tuple[tuple[int, ...], int] | None:
        """The i-th choice: a pattern and how often. Smaller multiplicities of a filling alternate with further fillings."""
        while len(self.made) <= i:
            fill = next(self.fills, None) if len(self.made) % 2 == 0 or not self.halves else None
            if fill is not None:
                pattern = (self.large, *fill)
                m = min(int(self.counts[x]) // k for x, k in Counter(pattern).items())
            elif self.halves:
                pattern, m = self.halves.pop(0)
            else:
                return None
            self.made.append((pattern, m))
            if m > 1:
                self.halves.append((pattern, m // 2))
        return self.made[i]


def bin_completion(counts: np.ndarray, capacity: int, nodes: int = 3_000) -> Plan:
    """Patterns and multiplicities that pack the histogram ``counts[length]`` into as few bins as were found.

    Stops when the lower bound is met, no branch is left, or ``nodes`` search nodes are spent; the node limit bounds search
    effort only, every piece is packed either way.
    """
    counts = counts.astype(np.int64).copy()
    least, best = lower_bound(counts, capacity), best_fit_decreasing(counts, capacity)
    fewest, budget, allowed = sum(m for _, m in best), [float(nodes)], 0
    while fewest > least and budget[0] > 0:
        # One pass takes all branches with at most ``allowed`` discrepancies.
        stack: list[list] = []  # node, next choice, pattern, multiplicity
        used, deviated, cut = 0, 0, False
        while budget[0] > 0 and fewest > least:
            open_here = not stack or stack[-1][3]
            if open_here and not counts.any():
                if used < fewest:
                    fewest, best = used, [(p, m) for _, _, p, m in stack]
                open_here = False
            if open_here and used + lower_bound(counts, capacity) < fewest:
                stack.append([_Node(counts, capacity, budget), 0, (), 0])
                budget[0] -= 1
            elif not stack:
                break
            node, i, pattern, m = stack[-1]
            if m:
                for x in pattern:
                    counts[x] += m
                used, deviated = used - m, deviated - (i - 1)
            found = node.choice(i) if deviated + i <= allowed else None
            if found is None:
                cut = cut or (deviated + i > allowed and node.choice(i) is not None)
                stack.pop()
                if not stack:
                    break
                continue
            pattern, m = found
            for x in pattern:
                counts[x] -= m
            used, deviated = used + m, deviated + i
            stack[-1][1:] = [i + 1, pattern, m]
        for _, _, pattern, m in stack:
            for x in pattern:
                counts[x] += m
        if not cut:
            break
        allowed += 1
    return best


def deal(plan: Plan, first: int = 0) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, as runs sorted by (length, rank).

    A run covers ranks ``start`` onward; rank r sits in sequence base + (r - start) // each at offset
    offset + (r - start) % each * length.
    """
    taken: Counter = Counter()
    rows, base = [], first
    for pattern, m in plan:
        offset = 0
        for length, each in sorted(Counter(pattern).items(), reverse=True):
            rows.append((length, taken[length], base, each, offset))
            taken[length] += m * each
            offset += length * each
        base += m
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "start", "base", "each", "offset"), cols.T.copy()))


def _tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, with_ids: bool, remember: int = 300_000) -> DataFrame:
    """Tokenise whole texts and cut only what is longer than a sequence.

    Besides the piece, each row has the writing task's number and the piece's rank among that task's
    pieces of its length.
    """
    definition = _tokenizer(tokenizer_path)
    key = "pack", hashlib.sha256(definition.encode()).hexdigest()
    end = np.array([end_id], "<u4").tobytes()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, chunk long, nth long" + ", ids binary" * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = process_cache(key, lambda: SegmentEncoder(definition, lower_words, limit=remember, added=True, single=single_word), keep=1)
        chunk, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part, rows = batch.slice(s, 256), []
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc, ids in zip(part.column(0).to_pylist(), coder.encode(texts)):
                    ids += end
                    for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                        body = ids[at : at + 4 * capacity]
                        n = len(body) // 4
                        rows.append((doc, i, at // 4, n, zlib.crc32(body), chunk, seen[n], *([body] if with_ids else [])))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, nodes: int = 3_000, with_ids: bool = False, remember: int = 300_000) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    A document's ids are those of the library's plain call without special tokens; strings of added tokens in a text become their ids.
    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with ``with_ids`` the
    ids (little-endian unsigned 32-bit). Each document is its tokens and ``end_id``, so null and empty texts
    are one token long. A worker remembers ``remember`` words, which changes its time and memory only. Null and repeated doc_ids and repeated rows are documents of their own; other columns are
    ignored; an empty table gives no rows. A document of several sequences gives full pieces and one rest.
    """
    pieces = materialize(pieces_of(docs, tokenizer_path, capacity, end_id, with_ids, remember))
    per_task = materialize(pieces.groupBy("length", "chunk").agg(F.count("*").alias("n")))
    small = per_task.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    # At most one row a length: bounded by the capacity.
    found = per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(capacity + 1, np.int64)
    for r in found:
        counts[r["length"]] = r["n"]
    full = int(counts[capacity])
    counts[capacity] = 0
    plan = bin_completion(counts, capacity, nodes) if counts.any() else []
    runs = deal([((capacity,), full)] * bool(full) + plan)

    before = F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_task.select("length", "chunk", F.coalesce(before, F.lit(0)).alias("before"))
    # Beyond a counted size the look-up is a shuffle of the short rows; a key has no more of them than one task wrote.
    ranked = pieces.join(F.broadcast(offsets) if small else offsets.hint("merge"), ["length", "chunk"]).withColumn("rank", F.col("before") + F.col("nth"))
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    low = {int(x): (int(a), int(b)) for x, a, b in zip(*(lambda u, i, c: (u, i, i + c))(*np.unique(runs["length"], return_index=True, return_counts=True)))} if len(runs["length"]) else {}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                rows, (a, b) = np.nonzero(length == x)[0], low[int(x)]
                at = a + np.searchsorted(runs["start"][a:b], rank[rows], side="right") - 1
                step, each = rank[rows] - runs["start"][at], runs["each"][at]
                sequence[rows] = runs["base"][at] + step // each
                offset[rows] = runs["offset"][at] + step % each * x
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in cols), pa.array(sequence), pa.array(offset)], names=[*cols, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids + ", sequence_id long, offset long"
    return ranked.select(*cols, "rank").mapInArrow(place, schema)
