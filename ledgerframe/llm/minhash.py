"""Near-duplicate groups by b-bit MinHash.

Each distinct shingle set gets ``bands * rows`` minima. Whole minima make the band keys, so candidates come
from exact band collisions; of each minimum only the low ``bits`` bits are kept, packed, and a candidate
pair's similarity is estimated from equal low bits, corrected for chance collisions. Only pairs far under the
threshold by that estimate are dropped (six standard errors); the rest are confirmed on full sets.

Equal sets are folded first: one representative each takes part. Every bucket has a hub, its member that lies in the
largest buckets; near copies of one text so share the text as hub. All members are tested against their hubs, which is linear.
Then each hub's group (the members of all its buckets, which holds every candidate pair) is compared where it still has
several components: the members outside the main component against the group, in blocks of bounded size. A block
drops pairs by estimate, counts the full intersections of the rest by matrix products over shared shingles and emits
links only. No pair is skipped, no bucket is capped.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_heads, map_arrow, materialize, process_cache, release

MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), so that close inputs get unrelated outputs."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHashes:
    """64-bit hashes of words, remembered; the memory is dropped past ``limit`` words."""

    def __init__(self, limit: int = 150_000):
        self.known, self.limit = {}, limit

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        for w in set(words).difference(known):
            known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        out = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if len(known) > self.limit:
            known.clear()
        return out


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; fewer words than ``size`` make one shingle."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = process_cache("minhash-words", WordHashes, keep=1)(words)
    n = max(1, len(h) - size + 1)
    width = min(size, len(h))
    out = np.full(n, np.uint64(width))
    for i in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return np.unique(_mix(out))


def signature(sets: np.ndarray, count: int) -> np.ndarray:
    """``count`` minima of a set under independent 32-bit hash functions."""
    rng = np.random.default_rng(20240501)
    a, b = rng.integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, count, dtype=np.uint64)
    out = np.full(count, np.uint64(MASK))
    for s in range(0, len(sets), 512):
        part = sets[s : s + 512]
        np.minimum(out, (part[None, :] * a[:, None] + b[:, None]).min(axis=1), out=out)
    return out >> np.uint64(32)


def pack_bits(minima: np.ndarray, bits: int) -> bytes:
    """The low ``bits`` bits of all minima, bit plane by bit plane."""
    planes = [((minima >> np.uint64(i)) & np.uint64(1)).astype(np.uint8) for i in range(bits)]
    return np.packbits(np.concatenate(planes)).tobytes()


def estimate(x: np.ndarray, y: np.ndarray, count: int, bits: int) -> np.ndarray:
    """Similarity of packed signatures (arrays of bytes, last axis), corrected for chance collisions of low bits."""
    step = count // 8
    differ = np.bitwise_xor(x, y)
    any_bit = differ[..., :step]
    for i in range(1, bits):
        any_bit = any_bit | differ[..., i * step : (i + 1) * step]
    same = 1 - np.bitwise_count(any_bit).sum(axis=-1, dtype=np.int64) / count
    chance = 2.0**-bits
    return (same - chance) / (1 - chance)


def keep_over(threshold: float, count: int, bits: int) -> float:
    """Estimates below this are dropped: six standard errors under the threshold."""
    chance = 2.0**-bits
    p = chance + (1 - chance) * threshold
    return threshold - 6 * math.sqrt(p * (1 - p) / count) / (1 - chance)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct hashes; empty sets link with nothing."""
    if not len(a) or not len(b):
        return False
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def signatures(docs: DataFrame, size: int, bands: int, rows: int, bits: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, band keys (bands * 8 bytes) and packed low bits; null keys for empty sets."""
    count = bands * rows

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": cols["doc_id"], "n_shingles": [], "digest": [], "keys": [], "low": []}
        for text in cols["text"]:
            s = shingles(text, size)
            out["n_shingles"].append(len(s))
            if not len(s):
                for c in ("digest", "keys", "low"):
                    out[c].append(None)
                continue
            minima = signature(s, count)
            key = np.zeros(bands, np.uint64)
            for i in range(rows):
                key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + minima.reshape(bands, rows)[:, i] + np.uint64(1))
            out["digest"].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            out["keys"].append(key.astype(np.int64).tolist())
            out["low"].append(pack_bits(minima, bits))
        return out

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_shingles long, digest binary, keys array<long>, low binary", rows=128)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest id reachable over ``edges`` (a, b) from each id that an edge touches.

    Minimum labels spread over the edges and are then short-cut through their own label, so the rounds
    grow with the logarithm of the longest path. ``nodes`` is (id, comp), the labels to start from.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = last = nodes
    while True:
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        step = label.join(near, label.id == near.a, "left").select("id", F.least("comp", F.coalesce("near", "comp")).alias("comp"), F.col("comp").alias("old"))
        via = step.select(F.col("id").alias("comp"), F.col("comp").alias("next"))
        new = materialize(step.join(via, "comp", "left").select("id", F.least("comp", F.coalesce("next", "comp")).alias("comp"), "old"))
        release(last)
        if new.where("comp <> old").isEmpty():
            release(both)
            return new.select("id", "comp")
        label, last = new.select("id", "comp"), new


class _Links:
    """Tests pairs of documents: first on packed bits, then on full sets rebuilt from the texts."""

    def __init__(self, texts: DataFrame, reps: DataFrame, size: int, count: int, bits: int, percent: int):
        self.texts, self.reps, self.size, self.percent = texts, reps, size, percent
        self.count, self.bits, self.floor = count, bits, keep_over(percent / 100, count, bits)

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose size ratio and estimate allow a link."""
        side = lambda c: self.reps.select(F.col("doc_id").alias(c), F.col("low").alias(f"{c}_low"), F.col("n_shingles").alias(f"{c}_n"))
        rows = pairs.join(side("a"), "a").join(side("b"), "b").where(F.lit(100) * F.least("a_n", "b_n") >= F.lit(self.percent) * F.greatest("a_n", "b_n"))
        count, bits, floor = self.count, self.bits, self.floor

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("a_low", "b_low"))
                yield batch.select(["a", "b"]).filter(pa.array(estimate(x, y, count, bits) >= floor))

        return rows.select("a", "b", "a_low", "b_low").mapInArrow(run, "a long, b long")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are linked on full sets. ``pairs`` must be distinct."""
        side = lambda c: self.texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"{c}_text"))
        rows = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "a_text", "b_text")
        size, percent = self.size, self.percent

        def run(batches):
            last, known = None, None
            for batch in batches:
                for s in range(0, batch.num_rows, 128):
                    part, keep = batch.slice(s, 128), []
                    for a, x, y in zip(part.column("a").to_pylist(), part.column("a_text").to_pylist(), part.column("b_text").to_pylist()):
                        if a != last:
                            last, known = a, shingles(x, size)
                        keep.append(linked(known, shingles(y, size), percent))
                    yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75, bands: int = 40, rows: int = 4, bits: int = 4, block: int = 512) -> DataFrame:
    """Group documents whose word shingle sets have a similarity of ``percent`` / 100 or more.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable over links, itself included), kept.
    Null and blank texts have no shingles and stand alone. Rows of one doc_id are taken as one document with its
    smallest text; rows without doc_id are left out. Extra columns are ignored; an empty table gives no rows.
    A pair of similarity s shares a band with probability 1 - (1 - s^rows)^bands: 0.9999997 at 0.75 as
    set, more above.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    count = bands * rows
    sigs = materialize(signatures(docs, size, bands, rows, bits))
    if sigs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        docs = docs.groupBy("doc_id").agg(F.min("text").alias("text"))
        sigs = materialize(signatures(docs, size, bands, rows, bits))
    # Classes of equal sets; the smallest id stands for each.
    classes = sigs.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    members = materialize(sigs.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")))
    reps = materialize(sigs.where("digest is not null").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "n_shingles", "keys", "low"))

    banded = reps.select("doc_id", F.posexplode("keys").alias("band", "key")).select("doc_id", F.xxhash64("band", "key").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = materialize(banded.join(shared, "key"))
    if buckets.isEmpty():
        return members.select("doc_id", "n_shingles", F.col("rep").alias("component_id"), (F.col("doc_id") == F.col("rep")).alias("kept"))
    weight = buckets.groupBy("doc_id").agg(F.sum("n").alias("w"))
    hubs = buckets.join(weight, "doc_id").groupBy("key").agg(F.max(F.struct("w", (-F.col("doc_id")).alias("d"))).alias("h")).select("key", (-F.col("h.d")).alias("hub"))
    groups = materialize(buckets.select("key", "doc_id").join(hubs, "key").select("hub", "doc_id").distinct())
    # The corpus is shuffled once, by a merge join at every size; all comparing reads the candidates' texts only.
    candidates = groups.select("doc_id").distinct()
    texts = materialize(docs.join(candidates.hint("merge"), "doc_id", "left_semi"))
    test = _Links(texts, reps.select("doc_id", "n_shingles", "low"), size, count, bits, percent)
    stars = materialize(test.likely(groups.where("hub <> doc_id").select(F.col("hub").alias("a"), F.col("doc_id").alias("b"))))
    links = materialize(test.confirmed(stars))
    start = groups.select(F.col("doc_id").alias("id")).distinct().withColumn("comp", F.col("id"))
    label = components(start, links)
    more = materialize(_across(groups, label, reps, test, block))
    if not more.isEmpty():
        label = components(label, links.union(more))
    out = members.join(label.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("comp", "rep").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def intersections(xs: list[np.ndarray], ys: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted distinct hash arrays, by products of 0/1 matrices over shared hashes."""
    out = np.zeros((len(xs), len(ys)), np.float32)
    if not xs or not ys:
        return out
    fx, fy = np.concatenate(xs), np.concatenate(ys)
    both = np.intersect1d(fx, fy)
    ix, iy = (np.repeat(np.arange(len(v)), list(map(len, v))) for v in (xs, ys))
    px, py = np.searchsorted(both, fx), np.searchsorted(both, fy)
    keep = lambda f, pos: (pos < len(both)) & (both[np.minimum(pos, len(both) - 1)] == f) if len(both) else np.zeros(len(f), bool)
    kx, ky = keep(fx, px), keep(fy, py)
    ix, px, iy, py = ix[kx], px[kx], iy[ky], py[ky]
    for s in range(0, len(both), width):
        a, b = np.zeros((len(xs), width), np.float32), np.zeros((len(ys), width), np.float32)
        for m, i, p in ((a, ix, px), (b, iy, py)):
            own = (p >= s) & (p < s + width)
            m[i[own], p[own] - s] = 1
        out += a @ b.T
    return out


def _across(groups: DataFrame, label: DataFrame, reps: DataFrame, test: _Links, block: int) -> DataFrame:
    """Links (a, b) between different components of a hub's group.

    Members of the group's most frequent component (m) meet only the others (o). Each side is dealt into parts of about ``block``
    members and a bounded number of shingles; a cell compares two parts and holds nothing else. Of a document's links to one
    component, a cell emits one.
    """
    here = groups.join(label.withColumnRenamed("id", "doc_id"), "doc_id").join(reps.select("doc_id", "n_shingles", "low"), "doc_id")
    sizes = here.groupBy("hub", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    most = F.max(F.struct("n", "comp", "s"))
    heads = sizes.groupBy("hub").agg(most.alias("m"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("c")).where("c > 1")
    heap = lambda n, s: F.greatest(F.ceil(n / block), F.ceil(s / (1000 * block))).cast("long")
    heads = heads.select("hub", "n", F.col("m.comp").alias("main"), heap(F.col("m.n"), F.col("m.s")).alias("mains"), heap(F.col("n") - F.col("m.n"), F.col("s") - F.col("m.s")).alias("others"))
    # A hub may hold a large part of all rows, so its row of heads comes by broadcast or spread join, never by a shuffle on the hub.
    rows = join_heads(here, materialize(heads), ["hub"], how="inner").withColumn("side", F.when(F.col("comp") == F.col("main"), "m").otherwise("o"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.when(F.col("side") == "m", F.col("mains")).otherwise(F.col("others"))))
    rows = materialize(rows.select("hub", "doc_id", "comp", "n_shingles", "low", "side", "part", "others", "mains"))
    rows = rows.join(test.texts, "doc_id")
    cols = ["hub", "x", "y", "doc_id", "comp", "n_shingles", "low", "text"]
    first = rows.where("side = 'o'").withColumn("x", F.col("part")).withColumn("y", F.explode(F.expr("sequence(-mains, others - 1)"))).where("y < 0 or y >= x").select(*cols)
    own = rows.where("side = 'o'").withColumn("y", F.col("part")).withColumn("x", F.explode(F.expr("sequence(0L, part)"))).select(*cols)
    other = rows.where("side = 'm'").withColumn("y", -F.col("part") - 1).withColumn("x", F.explode(F.expr("sequence(0L, others - 1)"))).select(*cols)
    count, bits, floor, size, percent = test.count, test.bits, test.floor, test.size, test.percent

    def cell(xs: pa.Table, ys: pa.Table) -> pa.Table:
        out_a: list[int] = []
        out_b: list[int] = []
        if xs.num_rows and ys.num_rows:
            (ia, ca, na), (ib, cb, nb) = ([t.column(c).to_numpy() for c in ("doc_id", "comp", "n_shingles")] for t in (xs, ys))
            la, lb = (np.frombuffer(b"".join(t.column("low").to_pylist()), np.uint8).reshape(t.num_rows, -1) for t in (xs, ys))
            maybe = np.zeros((len(ia), len(ib)), bool)
            for i in range(len(ia)):
                fits = (cb != ca[i]) & (100 * np.minimum(nb, na[i]) >= percent * np.maximum(nb, na[i]))
                maybe[i] = fits & (estimate(la[i][None, :], lb, count, bits) >= floor)
            rx, ry = np.nonzero(maybe.any(1))[0], np.nonzero(maybe.any(0))[0]
            if len(rx):
                sets = [[shingles(t, size) for t in table.column("text").take(pa.array(r)).to_pylist()] for table, r in ((xs, rx), (ys, ry))]
                both = intersections(*sets).astype(np.int64)
                union = na[rx][:, None] + nb[ry][None, :] - both
                hit = maybe[np.ix_(rx, ry)] & (100 * both >= percent * union)
                for i in np.nonzero(hit.any(1))[0]:
                    js = ry[np.nonzero(hit[i])[0]]
                    _, once = np.unique(cb[js], return_index=True)
                    out_a += [int(ia[rx[i]])] * len(once)
                    out_b += ib[js[once]].tolist()
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    key = ["hub", "x", "y"]
    left, right = first.toDF(*(f"{c}_" for c in cols)).toDF(*cols), own.unionByName(other)
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(cell, "a long, b long")

