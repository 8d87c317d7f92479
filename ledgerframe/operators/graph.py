"""Graph operators over edge DataFrames: (src, dst) and, where paths name them, (relation, link).

Traversals advance a frontier level by level: one join with the edges, one aggregation, one anti-join with what was reached,
then a checkpoint. All roots advance together. The bounds are those of the graph: a level costs the frontier's edges.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import settle


def labelled(edges: DataFrame) -> DataFrame:
    """Edges with relation and link columns, null where there were none."""
    out = edges
    for c in ("relation", "link"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    return out.select("src", "dst", "relation", "link")


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """root, node, depth, path, relations, links: one shortest path from each root to each node it reaches.

    ``seeds`` is (root, node); seeds have depth 0. Among equally short paths the smallest
    node path wins, then the smallest relation and link of parallel edges.
    """
    kind = seeds.schema["node"].dataType.simpleString()
    step_edges = settle(labelled(edges).distinct())
    empty = F.array().cast("array<string>")
    front = settle(seeds.select("root", "node").distinct().select("root", "node", F.lit(0).alias("depth"), F.array(F.col("node")).cast(f"array<{kind}>").alias("path"), empty.alias("relations"), empty.alias("links")))
    reached, depth = front, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        grown = front.join(step_edges, front.node == step_edges.src).select(
            "root", F.col("dst").alias("node"),
            F.struct(F.concat("path", F.array("dst")).alias("path"), F.concat("relations", F.array(F.coalesce("relation", F.lit("")))).alias("relations"), F.concat("links", F.array(F.coalesce("link", F.lit("")))).alias("links")).alias("way"),
        )
        best = grown.join(reached.select("root", "node"), ["root", "node"], "left_anti").groupBy("root", "node").agg(F.min("way").alias("way"))
        front = settle(best.select("root", "node", F.lit(depth).alias("depth"), "way.path", "way.relations", "way.links"))
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
    return reached


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """root, node, depth without paths."""
    step_edges = settle(edges.select("src", "dst").distinct())
    front = settle(seeds.select("root", "node").distinct().withColumn("depth", F.lit(0)))
    reached, depth = front, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        grown = front.join(step_edges, front.node == step_edges.src).select("root", F.col("dst").alias("node")).distinct()
        front = settle(grown.join(reached.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
    return reached


def cyclic_core(edges: DataFrame) -> DataFrame:
    """The edges whose ends both lie on or lead to a cycle: nodes without out-edges are pruned until none is left."""
    core, n = settle(edges), None
    while True:
        kept = settle(core.join(core.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select(*edges.columns))
        m = kept.count()
        if m == n or not m:
            return kept
        core, n = kept, m


def has_cycle(edges: DataFrame) -> bool:
    return not cyclic_core(edges).isEmpty()


def cycles(edges: DataFrame) -> DataFrame:
    """cycle: the cycles closed by back edges of a depth-first search over sorted nodes and neighbours, each from its smallest node.

    The order of the search is sequential, so one task walks the cyclic core. Spark sorts its edges, spilling where it must; the
    task holds each node once and four bytes an edge while it walks, and cycles leave it in batches. There is no limit on edges.
    """
    kind = edges.schema["src"].dataType.simpleString()
    core = cyclic_core(edges.select("src", F.col("dst").cast(kind).alias("dst")).where("src is not null and dst is not null").distinct())
    return settle(core.repartition(1).sortWithinPartitions("src", "dst").mapInArrow(_walk, f"cycle array<{kind}>"))


def _walk(batches: Iterator[pa.RecordBatch], flush: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Cycles of a graph whose edges come sorted by (src, dst) and whose nodes all have out-edges."""
    whole = list(batches)
    if not sum(b.num_rows for b in whole):
        return
    table = pa.Table.from_batches(whole)
    del whole
    kind = table.schema.field("src").type
    wide = pa.large_string() if pa.types.is_string(kind) else kind
    names = pc.unique(table["src"].cast(wide))
    ends, to = (pc.index_in(table[c].cast(wide), value_set=names).to_numpy().astype(np.int32) for c in ("src", "dst"))
    del table
    n = len(names)
    stop = np.bincount(ends, minlength=n).cumsum()
    nxt_edge, stop, to = array("q", np.concatenate(([0], stop[:-1])).astype(np.int64).tobytes()), array("q", stop.astype(np.int64).tobytes()), array("i", to.tobytes())
    state, at = bytearray(n), array("q", bytes(8 * n))  # 1: on the trail, 2: done
    rings: list[np.ndarray] = []
    held = 0

    def out() -> pa.RecordBatch:
        offsets = np.concatenate(([0], np.cumsum([len(r) for r in rings]))).astype(np.int32)
        flat = names.take(pa.array(np.concatenate(rings))).cast(kind)
        rings.clear()
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["cycle"])

    for start in range(n):
        if state[start]:
            continue
        trail, state[start], at[start] = array("i", [start]), 1, 0
        while trail:
            node = trail[-1]
            k = nxt_edge[node]
            if k == stop[node]:
                state[trail.pop()] = 2
                continue
            nxt_edge[node] = k + 1
            nxt = to[k]
            if not state[nxt]:
                state[nxt], at[nxt] = 1, len(trail)
                trail.append(nxt)
            elif state[nxt] == 1:
                ring = np.array(trail[at[nxt] :], np.int32)
                ring = np.roll(ring, -int(ring.argmin()))
                rings.append(np.append(ring, ring[0]))
                held += len(ring)
                if held >= flush:
                    held = 0
                    yield out()
    if rings:
        yield out()


def dfs_cycles(edges: DataFrame) -> list[list]:
    """The rows of ``cycles`` in order, on the driver: for graphs whose cycles fit there."""
    return sorted(list(r["cycle"]) for r in cycles(edges).collect())


def simple_paths(edges: DataFrame, targets: DataFrame, max_depth: int | None = None) -> DataFrame:
    """target, node, path, relations: every simple path from each target along the edges, parallel edges apart.

    Their number may grow exponentially with the graph's width, by definition; ``max_depth`` bounds it.
    """
    step_edges = settle(labelled(edges))
    front = settle(targets.select(F.col("node").alias("target"), "node", F.array("node").alias("path"), F.array().cast("array<string>").alias("relations")))
    out, depth = front, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        grown = front.join(step_edges, front.node == step_edges.src).where(~F.array_contains("path", F.col("dst")))
        front = settle(grown.select("target", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), F.concat("relations", F.array(F.coalesce("relation", F.lit("")))).alias("relations")))
        if front.isEmpty():
            break
        out = out.unionByName(front)
    return out


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, component: the smallest node of each connected component, direction ignored.

    Labels take their neighbours' minimum and then their own label's label, so long chains halve each round.
    """
    both = settle(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    label = settle(nodes.select("node").distinct().withColumn("component", F.col("node")))
    while True:
        near = both.join(label, both.dst == label.node).groupBy("src").agg(F.min("component").alias("near"))
        step = label.join(near, label.node == near.src, "left").select("node", F.least("component", F.coalesce("near", "component")).alias("c"), F.col("component").alias("old"))
        via = step.select(F.col("node").alias("c"), F.col("c").alias("next"))
        new = settle(step.join(via, "c", "left").select("node", F.least("c", F.coalesce("next", "c")).alias("component"), "old"))
        label = new.select("node", "component")
        if new.where("component <> old").isEmpty():
            return label
