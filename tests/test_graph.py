"""Graph operators against plain Python on small graphs."""

import random
import zlib

from pyspark.sql import functions as F

from ledgerframe.functions.lineage import settle
from ledgerframe.operators import graph as G


def frame(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string")


def seeds(spark, *nodes):
    return spark.createDataFrame([(n, n) for n in nodes], "root string, node string")


def test_bfs_takes_the_smallest_shortest_path(spark):
    e = spark.createDataFrame([("a", "c", "Z", "1"), ("a", "b", "Y", "2"), ("a", "b", "X", "9"), ("b", "d", "X", "3"), ("c", "d", "A", "4"), ("d", "a", "X", "5")], "src string, dst string, relation string, link string")
    got = {r.node: r for r in G.bfs(e, seeds(spark, "a")).collect()}
    assert got["d"].path == ["a", "b", "d"] and got["d"].relations == ["X", "X"] and got["d"].links == ["9", "3"] and got["d"].depth == 2
    assert {r.node for r in G.bfs(e, seeds(spark, "a"), 1).collect()} == {"a", "b", "c"}


def test_cycles(spark):
    assert G.dfs_cycles(frame(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "x")])) == [["a", "b", "c", "a"]]
    assert G.dfs_cycles(frame(spark, [("a", "b"), ("b", "d"), ("d", "a"), ("a", "c"), ("c", "d")])) == [["a", "b", "d", "a"]]
    assert not G.has_cycle(frame(spark, [("a", "b"), ("a", "c"), ("b", "c")]))


def plain_cycles(edges):
    """A search with a stack of its own over sorted nodes and neighbours."""
    out, found, state = {}, [], {}
    for a, b in sorted(set(edges)):
        out.setdefault(a, []).append(b)
    for start in sorted(out):
        if start in state:
            continue
        trail, todo = [start], [iter(out[start])]
        state[start] = 0
        while trail:
            nxt = next(todo[-1], None)
            if nxt is None:
                state[trail.pop()] = None
                todo.pop()
            elif nxt not in state:
                state[nxt] = len(trail)
                trail.append(nxt)
                todo.append(iter(out.get(nxt, ())))
            elif state[nxt] is not None:
                ring = trail[state[nxt] :]
                low = ring.index(min(ring))
                found.append(ring[low:] + ring[: low + 1])
    return sorted(found)


def test_cycles_of_random_graphs(spark):
    rng = random.Random(7)
    for nodes, n in ((6, 12), (30, 45), (60, 200)):
        edges = [(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}") for _ in range(n)]
        assert G.dfs_cycles(frame(spark, edges)) == plain_cycles(edges)
    assert G.dfs_cycles(frame(spark, [("a", "b"), ("b", "c")])) == []


def test_cycles_have_no_edge_limit(spark):
    n = 105_000
    e = spark.range(n).selectExpr("id src", "explode(array((7 * id + 3) % 105000, (3 * id + 1) % 105000)) dst").where("src <> dst")
    want = plain_cycles([(k, d) for k in range(n) for d in ((7 * k + 3) % n, (3 * k + 1) % n) if d != k])
    rows = G.cycles(e).selectExpr("size(cycle) n", "crc32(array_join(cast(cycle as array<string>), '-')) h").collect()
    assert sorted((r.n, r.h) for r in rows) == sorted((len(c), zlib.crc32("-".join(map(str, c)).encode())) for c in want)


def test_components_and_reach(spark):
    rng = random.Random(1)
    nodes = [f"n{i:02d}" for i in range(40)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(25)]
    comp = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    got = G.components(frame(spark, edges), spark.createDataFrame([(n,) for n in nodes], "node string"))
    assert {r.node: r.component for r in got.collect()} == comp
    out = {}
    for start in nodes[:5]:
        seen, todo = {start}, [start]
        while todo:
            todo = [b for a, b in edges if a in todo and b not in seen]
            seen.update(todo)
        out[start] = seen
    got = G.reach(frame(spark, edges), seeds(spark, *nodes[:5])).collect()
    assert {s: {r.node for r in got if r.root == s} for s in nodes[:5]} == out


def digits(df):
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()


def test_size_estimates_stay_bounded_over_rounds(spark):
    n = 200  # a path in mixed order takes many rounds
    order = list(range(n))
    random.Random(3).shuffle(order)
    edges = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:]) if a != 100], "src long, dst long")
    got = G.components(edges, spark.range(n).withColumnRenamed("id", "node"))
    assert digits(got) < 400
    cut = order.index(100) + 1
    want = {x: min(part) for part in (order[:cut], order[cut:]) for x in part}
    assert {r.node: r.component for r in got.collect()} == want
    one = settle(spark.range(3).toDF("k"))
    for _ in range(6):
        one = settle(one.join(one.toDF("j"), F.col("j") == F.col("k")).join(one, "k").select("k"))
    assert digits(one) < 64 and sorted(r.k for r in one.collect()) == [0, 1, 2]


def test_simple_paths_keep_parallel_edges(spark):
    e = spark.createDataFrame([("t", "u", "A", "1"), ("t", "u", "B", "2"), ("u", "t", "A", "3")], "src string, dst string, relation string, link string")
    got = sorted(tuple(r.relations) for r in G.simple_paths(e, spark.createDataFrame([("t",)], "node string")).collect())
    assert got == [(), ("A",), ("B",)]
