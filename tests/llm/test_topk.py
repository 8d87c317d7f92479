"""Exact top-k search against brute force."""

import math
import random

import numpy as np
import pytest

from ledgerframe.llm.topk import SortedLists, _depths, topk_search

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, asked, k):
    ok = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = lambda v: [math.floor(1024.0 * np.float64(np.float32(x))) for x in v]
    out = []
    for q in sorted({i for i, _ in ok if i in asked}):
        mine = min(v for i, v in ok if i == q)
        scores = [(-sum(a * b for a, b in zip(whole(mine), whole(v))), i) for i, v in ok if i != q and len(v) == len(mine)]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def check(spark, rows, k=3, **cells):
    df = spark.createDataFrame(rows, SCHEMA)
    got = topk_search(df, df.where("vec_id % 5 = 0"), k, **cells)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, {i for i, _ in rows if i is not None and i % 5 == 0}, k)


@pytest.mark.parametrize("cells", [{}, {"cell_values": 240}, {"cell_values": 42}, {"least_rows": 20}])
def test_random_vectors_ties_and_repeats(spark, cells):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(150)]
    rows += [(200 + i, [0.5] * 6) for i in range(30)] + [rows[0], rows[7], (300, []), (305, []), (310, [1.0])]
    rows += [(401, None), (402, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (403, [float("nan")] * 6), (404, [float("inf")] * 6), (None, [1.0] * 6), (405, [-x for x in rows[3][1]])]
    check(spark, rows, **cells)


def test_empty_and_few(spark):
    check(spark, [])
    check(spark, [(0, [1.0]), (1, [2.0])], k=10)


def best_of(ids, x, qid, q, k):
    scores = (x @ q).astype(int)
    return [(int(ids[j]), int(scores[j])) for j in np.lexsort((ids, -scores)) if ids[j] != qid][:k]


def test_reading_stops_early_and_stays_exact():
    """Of 2,000 random unit vectors, at most a hundredth are resolved for a query, after less than nine tenths of the entries."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 64))
    x = np.floor(1024 * x / np.linalg.norm(x, axis=1)[:, None])
    lists = SortedLists(np.arange(2000), x)
    for qid in range(0, 2000, 100):
        assert lists.search(qid, x[qid], 10) == best_of(lists.ids, x, qid, x[qid], 10)
    assert lists.asked == 20 * 2000 and lists.resolved <= 0.01 * lists.asked
    lists.opened = 0
    lists._qualifying(lists.ids == 5, x[5], 10, -np.inf)
    assert lists.opened < 2.5 * 2000 * 64


def test_a_floor_from_other_cells_leaves_less_to_resolve():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(0, 100, (1500, 24)))
    ids, q = np.arange(1500), np.floor(rng.normal(0, 100, 24))
    free, bound = SortedLists(ids, x), SortedLists(ids, x)
    want = free.search(-1, q, 10)
    assert bound.search(-1, q, 10, floor=float(want[4][1])) == want[:5] and bound.resolved <= free.resolved


@pytest.mark.parametrize("kind", ["equal", "zero", "sparse", "signs", "repeated"])
def test_ties_and_odd_vectors(kind):
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(0, 5, (300, 8)))
    ids, q = rng.permutation(300), x[7].copy()
    if kind == "equal":
        x[:] = 3.0
    elif kind == "zero":
        q[:] = 0
    elif kind == "sparse":
        q[1:] = 0
    elif kind == "signs":
        q = -np.abs(q)
    else:
        ids = ids // 10
    for k in (1, 10, 400):
        assert [s for _, s in SortedLists(ids, x).search(5, q, k)] == [s for _, s in best_of(ids, x, 5, q, k)]
        if kind != "repeated":
            assert SortedLists(ids, x).search(5, q, k) == best_of(ids, x, 5, q, k)


def test_depths_read_the_share_asked_for():
    rng = np.random.default_rng(5)
    for weight in (rng.random(16), np.ones(5), np.array([1.0, 0, 0, 0]), np.array([9.0, 1, 1])):
        for share in (0.1, 0.5, 0.9, 1.0):
            got = _depths(weight, share, 1000)
            assert got.max() <= 1000 and (weight > 0).sum() * 1000 <= got.sum() or abs(got.mean() - 1000 * share) <= 1


def test_scores_beyond_doubles_are_exact():
    x, q = np.array([[2.0**40, 1.0], [2.0**40, 2.0]]), np.array([2.0**20, 1.0])
    assert SortedLists(np.array([1, 2]), x).search(9, q, 1) == [(2, 2**60 + 2)]
