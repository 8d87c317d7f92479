"""Exact top-k inner-product search by no-random-access aggregation.

Each cell of candidate rows holds one sorted list per vector component, whose entries are (row, value, length of the row's vector). For
a query, the list of a component is read from its best end (descending values where the query is positive, ascending
where it is negative), in rounds of growing depth, deeper where the query weighs more. What has been
read gives every row a lower and an upper score bound. The components still unread add at most each list's frontier, and at most, or
at least minus, the product of what is left of the two lengths (Cauchy-Schwarz), so bounds shrink row by row. Reading
stops when no more than k rows, or none but ties of the last one, can qualify; only their final scores are resolved.

Work is dealt as a grid of (query block, candidate slot) cells of bounded size. The first slot's cells come first; the k-th best score that
they find for a query is a lower bound that all other cells start from. Each cell emits at most k rows a query, and a
windowed merge keeps the k best of all cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

EXACT = float(2**53)
#: Shares of all list entries at which a query's reading pauses to compare bounds.
PAUSES = (0.5, 0.6, 0.68, 0.75, 0.81, 0.86, 0.91, 0.95, 0.98)


def quantize(vectors: np.ndarray, scale: int = 1024) -> np.ndarray:
    """floor(scale * x) with x as double; whole numbers kept as float64."""
    return np.floor(scale * vectors.astype(np.float64))


def _bigint_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer scores of one query beyond 2**53, saturated to the range of a long."""
    other = [int(v) for v in q]
    return np.array([max(-(2**63), min(2**63 - 1, sum(int(a) * b for a, b in zip(row, other)))) for row in x.astype(object)], np.int64)


class SortedLists:
    """The lists of one cell: ``x`` holds whole numbers as float64, a row each.

    ``place`` is the position of each entry in its list read in descending order. ``opened`` and ``resolved`` count the entries
    that queries have read and the rows whose final scores they have resolved; ``asked`` counts rows times queries.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        order = np.argsort(-x, axis=0, kind="stable")
        self.place = np.empty(x.shape, np.int32)
        np.put_along_axis(self.place, order.astype(np.int32), np.arange(len(x), dtype=np.int32)[:, None], axis=0)
        self.lists = np.take_along_axis(x, order, axis=0)
        self.length = (x * x).sum(1)
        self.largest = float(np.abs(x).max()) if x.size else 0.0
        self.opened = self.resolved = self.asked = 0

    def search(self, qid: int, q: np.ndarray, k: int, floor: float = -np.inf) -> list[tuple[int, int]]:
        """The k best (row id, score) of a query, best first, without rows of id ``qid``; rows scoring under ``floor`` may be left out.

        All sums stay under 2**53 and are exact, or else whole-number arithmetic without bounds is used.
        """
        n, d = self.x.shape
        own = self.ids == qid
        self.asked += n
        if max(self.largest, np.abs(q).max(initial=0)) ** 2 * max(d, 1) >= EXACT:
            rows = np.nonzero(~own)[0]
            return self._best(rows, _bigint_scores(self.x[rows], q), k)
        rows = self._qualifying(own, q, k, floor) if q.any() and n > k else np.nonzero(~own)[0]
        self.resolved += len(rows)
        scores = (self.x[rows] @ q).astype(np.int64)
        return self._best(rows[scores >= floor], scores[scores >= floor], k)

    def _qualifying(self, own: np.ndarray, q: np.ndarray, k: int, floor: float) -> np.ndarray:
        """Rows that may be among the k best, when reading stops."""
        n, flip, q2, weight = len(self.x), q < 0, q * q, np.abs(q) / np.abs(q).mean()
        rows = np.nonzero(~own)[0]
        for share in PAUSES:
            depth = _depths(weight, share, n)
            at, comps = np.minimum(depth, n - 1), np.arange(len(q))
            front = np.where(depth < n, q * np.where(flip, self.lists[n - 1 - at, comps], self.lists[at, comps]), 0.0)
            seen, square, weights, fronts = self._read(rows, q, np.where(flip, n - depth, 0), depth, np.stack([q2, front], axis=1))
            # Sums are exact; roots and their product are rounded, so they get a little room.
            room = np.sqrt((self.length[rows] - square) * (q2.sum() - weights)) * (1 + 1e-12) + 1e-6
            lower, upper = seen - room, seen + np.minimum(room, front.sum() - fronts)
            kth = max(floor, np.partition(lower, len(lower) - k)[len(lower) - k] if len(lower) >= k else -np.inf)
            rows = rows[upper >= kth]
            if len(rows) <= k:
                break
        return rows

    def _read(self, rows: np.ndarray, q: np.ndarray, start: np.ndarray, depth: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each row, over the components read (places from ``start``, ``depth`` of them): its score, its squares, and both columns of ``sums``."""
        start, depth, out = start.astype(np.int32), depth.astype(np.uint32), np.empty((4, len(rows)))
        for s in range(0, len(rows), 1024):  # blocks that stay in the processor's cache
            part = rows[s : s + 1024]
            x, place = self.x[part], self.place[part]
            place -= start
            known = (place.view(np.uint32) < depth).astype(np.float64)
            out[2:, s : s + 1024] = (known @ sums).T
            self.opened += int(known.sum())
            known *= x
            out[0, s : s + 1024] = known @ q
            out[1, s : s + 1024] = np.einsum("nd,nd->n", known, x)
        return tuple(out)

    def _best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, int]]:
        best = np.lexsort((self.ids[rows], ~scores))[:k]
        return [(int(self.ids[rows[i]]), int(scores[i])) for i in best]


def _depths(weight: np.ndarray, share: float, n: int) -> np.ndarray:
    """How deep each list is read when ``share`` of all entries are: in proportion to the query's weights, none beyond its end."""
    order = np.sort(weight)
    # With the i largest weights read to the end, the others share the rest in proportion.
    total, size = np.cumsum(order), len(order)
    full = np.arange(size)[::-1]
    scale = (share * size - full) / np.maximum(total, 1e-300)
    fits = np.nonzero((scale * order <= 1) & (scale >= 0))[0]
    best = scale[fits[-1]] if len(fits) else np.inf
    return np.minimum(n, np.ceil(n * np.minimum(1.0, best * weight))).astype(np.int64)


def _finite(df: DataFrame, vec: str) -> DataFrame:
    bad = F.exists(F.col(vec), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return df.where(F.col(vec).isNotNull() & ~bad)


def _by_length(t: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, whole-number vectors and floors of a cell's side, by vector length."""
    ids, col = t.column("id").to_numpy().astype(np.int64), t.column("v").combine_chunks()
    col = col if isinstance(col, pa.Array) else pa.concat_arrays(col.chunks)
    floor = t.column("floor").to_numpy().astype(np.float64) if "floor" in t.column_names else np.full(len(ids), -np.inf)
    start, size = (col.offsets.to_numpy()[:-1], np.diff(col.offsets.to_numpy())) if len(col) else (np.zeros(0, int), np.zeros(0, int))
    flat, found = col.values.to_numpy(zero_copy_only=False), {}
    for d in np.unique(size):
        rows = np.nonzero(size == d)[0]
        found[int(d)] = ids[rows], quantize(flat[start[rows][:, None] + np.arange(d)[None, :]].reshape(len(rows), d)), floor[rows]
    return found


def topk_search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", cell_values: int = 2**20, least_rows: int = 4096) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the largest integer inner product for each row of ``queries``.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller id; fewer than
    ``k`` rows where there are fewer candidates. Null ids, and vectors that are null or hold
    null or non-finite components, take no part. Only vectors of equal length are compared;
    empty vectors score 0 with each other. Rows that carry the query's id are its own and are left
    out; an id that occurs in several rows is a candidate once a row, and as a query stands for its
    smallest vector. Scores beyond a long saturate. Other columns are ignored; empty inputs
    give no rows. A cell holds about ``cell_values`` numbers a side; small tables are dealt to as many cells as there are cores, of
    ``least_rows`` rows or more.
    """
    base = _finite(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")), "v").where("id is not null")
    asked = _finite(queries.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")), "v").where("id is not null")
    asked = materialize(asked.groupBy("id").agg(F.min("v").alias("v")))
    size = base.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("d")).first()
    n, m, each = size.n, asked.count(), max(1, cell_values // max(1, size.d))
    slots = max(1, -(-n // each), min(base.sparkSession.sparkContext.defaultParallelism, n // least_rows))
    blocks = max(1, -(-m // each))
    left = base.withColumn("slot", F.pmod(F.monotonically_increasing_id(), F.lit(slots))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    right = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("long"))

    def cell(rows: pa.Table, asks: pa.Table) -> pa.Table:
        out, cands = [], _by_length(rows)
        for d, (qids, q, floors) in _by_length(asks).items():
            if d in cands:
                lists = SortedLists(*cands[d][:2])
                for qid, query, floor in zip(qids.tolist(), q, floors.tolist()):
                    out += [(qid, i, s) for i, s in lists.search(qid, query, k, floor)]
        cols = list(zip(*out)) if out else [[], [], []]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.int64())})

    def found(rows: DataFrame, asks: DataFrame) -> DataFrame:
        return rows.groupBy("block", "slot").cogroup(asks.groupBy("block", "slot")).applyInArrow(cell, "query_id long, vec_id long, score long")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found(left.where("slot = 0"), right.withColumn("slot", F.lit(0).cast("long")))
    if slots > 1:
        best = materialize(best)
        kth = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor"))
        started = materialize(right.join(kth, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))))
        others = started.withColumn("slot", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(slots - 1).cast("long"))))
        best = best.unionByName(found(left.where("slot > 0"), others))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
