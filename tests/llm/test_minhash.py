"""Near-duplicate groups against brute force over all pairs."""

import random

import numpy as np

from ledgerframe.llm import minhash
from ledgerframe.llm.minhash import near_duplicates

SCHEMA = "doc_id long, text string"


def brute(rows):
    """doc_id -> (set size, component) by comparing all pairs of shingle sets."""
    texts = {}
    for d, t in rows:
        if d is not None:
            texts[d] = min(texts.get(d, t), t, key=lambda x: (x is None, x)) if d in texts else t
    sets = {}
    for d, t in texts.items():
        w = "".join(c.lower() if c.isascii() else c for c in (t or "")).replace("\n", " ").replace("\t", " ").split(" ")
        w = [x for x in w if x]
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    comp = {d: d for d in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                comp[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def check(spark, rows, **how):
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), **how).collect()
    want = brute(rows)
    assert len(got) == len(want)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def variants(rng, base, n, changes):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(changes + 1)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_copies_chains_and_strangers(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(3000)}"
    base = [word() for _ in range(120)]
    rows = [t for t in variants(rng, base, 40, 6)] + [" ".join(word() for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    passage = " ".join(word() for _ in range(60))
    rows += [passage + " " + " ".join(word() for _ in range(50)) for _ in range(30)]
    rows += ["", None, "  \n ", "one two", "ONE two", "one Two", "É a b c d", "é a b c d", rows[0], rows[0]]
    rng.shuffle(rows)
    check(spark, [(i * 7 % 1009, t) for i, t in enumerate(rows)])


def test_blocks_of_any_size_find_the_same(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    rows = list(enumerate(variants(rng, base, 60, 9)))
    check(spark, rows, block=7)


def test_edges(spark):
    check(spark, [])
    check(spark, [(1, None), (2, "")])
    check(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f")])
    long = " ".join(f"w{i}" for i in range(60_000))
    check(spark, [(5, long), (3, long + " end"), (4, "short")])


def test_extra_columns_do_not_clash(spark):
    rows = [(1, "a b c d e f", 9, "k"), (2, "a b c d e f", 8, "k")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, comp int, key string")).collect()
    assert {r.component_id for r in got} == {1}


def test_estimate_is_corrected_for_chance():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 2**32, (400, 160), dtype=np.uint64), rng.integers(0, 2**32, (400, 160), dtype=np.uint64)
    half = x.copy()
    half[:, :80] = y[:, :80]
    pack = lambda m: np.frombuffer(b"".join(minhash.pack_bits(r, 4) for r in m), np.uint8).reshape(len(m), -1)
    assert abs(minhash.estimate(pack(x), pack(y), 160, 4).mean()) < 0.01
    assert abs(minhash.estimate(pack(x), pack(half), 160, 4).mean() - 0.5) < 0.01
