"""Analyses of the version graph: downstream impact, provenance closure, impact dossier, lineage evolution.

Each takes the registry's tables (see ``provenance``) and returns its parts as DataFrames with a one-row summary, so parts of any size
stay distributed. Requested ids are few, by contract. ``contents`` may be a function of a frame of version_ids: then only the versions that an
analysis reaches are hashed again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import content_hash
from ..functions.lineage import settle
from ..functions.rules import verdict
from . import graph
from .provenance import descriptor_integrity, link_integrity, version_integrity

# The relation types.
RELATIONS = ("DERIVED_FROM", "TRANSFORMED_FROM", "FILTERED_FROM", "AGGREGATED_FROM", "JOINED_FROM", "COPIED_FROM")
RULES_VERSION = "1.0.0"
# Thresholds of the qualifications, weights of a transition's severity.
PROPAGATED_VERSIONS, WIDESPREAD_VERSIONS, WIDESPREAD_DATASETS, WIDESPREAD_DEPTH = 3, 5, 3, 4
NEW_BREAK, NEW_ORPHAN, REMOVAL, ADDITION = 100, 50, 10, 1


@dataclass
class Report:
    """A one-row summary, and the parts it summarises by name."""

    summary: DataFrame
    parts: dict[str, DataFrame]


def _seeds(spark: SparkSession, ids: Sequence[str], root: str | None = None) -> DataFrame:
    return spark.createDataFrame([(root if root is not None else i, i) for i in sorted(set(ids))], "root string, node string")


def _edges(links: DataFrame, prefix: str = "", with_id: bool = False) -> DataFrame:
    relation = F.concat(F.lit(prefix), "relation_type")
    return links.select(F.col("upstream_version_id").alias("src"), F.col("downstream_version_id").alias("dst"), (F.concat(relation, F.lit(":"), "id") if with_id else relation).alias("relation"), F.col("id").alias("link"))


def _previous(versions: DataFrame, name: str) -> DataFrame:
    return versions.where("previous_version_id is not null").select(F.col("previous_version_id").alias("src"), F.col("version_id").alias("dst"), F.lit(name).alias("relation"), F.lit(None).cast("string").alias("link"))


def _within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges between ``nodes`` (one column, node)."""
    return edges.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi")


def _cycles(edges: DataFrame) -> DataFrame:
    return graph.cycles(edges)


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias(name))


def _row(*ones: DataFrame) -> DataFrame:
    """One-row frames side by side."""
    out = ones[0]
    for one in ones[1:]:
        out = out.crossJoin(one)  # one row each
    return out


def compliance_of(versions: DataFrame, contract_reports: DataFrame, contracts: DataFrame) -> DataFrame:
    """version_id, status, contract_version, verdict: the report under the highest contract version, then the newest.

    ``contract_reports`` is (version_id, contract_id, verdict, created_at), ``contracts`` (contract_id, version_number).
    """
    r = contract_reports.join(contracts.select("contract_id", F.col("version_number").alias("contract_version")), "contract_id")
    best = r.groupBy("version_id").agg(F.max_by(F.struct("contract_version", "verdict"), F.struct("contract_version", "created_at", "contract_id")).alias("b"))
    out = versions.select("version_id").join(best, "version_id", "left")
    return out.select("version_id", F.when(F.col("b").isNull(), "NOT_AVAILABLE").otherwise("AVAILABLE").alias("status"), F.col("b.contract_version").alias("contract_version"), F.col("b.verdict").alias("verdict"))


def impact_report(versions: DataFrame, links: DataFrame, version_id: str, max_depth: int = 3, compliance: DataFrame | None = None) -> Report:
    """What lies downstream of a version over lineage links, ``max_depth`` levels deep.

    Parts: affected (version, dataset, depth, paths, compliance), datasets, orphans, cycles. A link to a version that isn't registered is an orphan.
    """
    spark = versions.sparkSession
    edges = _edges(links)
    found = settle(graph.bfs(edges, _seeds(spark, [version_id]), max_depth).where(F.col("node") != version_id))
    known = versions.select(F.col("version_id").alias("node"), "dataset_id", "version_number", "content_hash")
    affected = found.join(known, "node").select(F.col("node").alias("version_id"), "dataset_id", "version_number", "content_hash", "depth", F.col("path").alias("version_path"), F.col("relations").alias("relation_path"), F.col("links").alias("link_path"))
    status = compliance if compliance is not None else versions.select("version_id", F.lit("NOT_AVAILABLE").alias("status"))
    affected = settle(affected.join(status.select("version_id", F.col("status").alias("compliance")), "version_id", "left").withColumn("compliance", F.coalesce("compliance", F.lit("NOT_AVAILABLE"))))
    orphans = found.join(known, "node", "left_anti").select(F.col("node").alias("version_id"), "depth")
    datasets = affected.groupBy("dataset_id").agg(F.count("*").alias("affected_version_count"), F.min("depth").alias("min_depth"))
    cycles = _cycles(_within(edges, found.select("node").union(_seeds(spark, [version_id]).select("node"))))
    whole = affected.agg(F.count("*").alias("affected_version_count"), F.countDistinct("dataset_id").alias("affected_dataset_count"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth_reached"))
    summary = _row(whole, _count(cycles, "cycle_count"), _count(orphans, "orphan_count"))
    q = verdict((F.col("cycle_count") > 0, "CYCLE_DETECTED"), (F.col("affected_version_count") == 0, "ISOLATED"), (F.col("affected_version_count") >= PROPAGATED_VERSIONS, "PROPAGATED"), otherwise="CONTAINED")
    return Report(summary.withColumn("max_depth_requested", F.lit(max_depth)).withColumn("qualification", q), {"affected": affected, "datasets": datasets, "orphans": orphans, "cycles": cycles})


def _issue(code: Column | str, kind: str, resource: Column, reference: Column | None = None) -> list[Column]:
    return [(F.lit(code) if isinstance(code, str) else code).alias("code"), F.lit(kind).alias("resource_type"), resource.alias("resource_id"), (reference if reference is not None else F.lit(None)).cast("string").alias("reference_id")]


def _checked(versions, datasets, sources, contents: DataFrame | Callable[[DataFrame], DataFrame], nodes: DataFrame) -> DataFrame:
    ids = nodes.select(F.col("node").alias("version_id"))
    return version_integrity(versions, datasets, sources, contents(ids) if callable(contents) else contents, ids)


def _integrity(versions, datasets, sources, contents, links, nodes) -> DataFrame:
    """resource_type, resource_id, issues of the versions in ``nodes``, what they reference and ``links``; references that are missing are left to the caller."""
    mine = versions.join(nodes.withColumnRenamed("node", "version_id"), "version_id", "left_semi")
    own = _checked(versions, datasets, sources, contents, nodes)
    gone = F.array(F.lit("dataset_reference_missing"), F.lit("source_reference_missing"), F.lit("previous_version_reference_missing"))
    v = own.select(F.lit("dataset_version").alias("resource_type"), F.col("version_id").alias("resource_id"), F.array_except("issues", gone).alias("issues"))
    d = descriptor_integrity(datasets.join(mine.select("dataset_id"), "dataset_id", "left_semi"), "dataset_id", "dataset_hash", "dataset")
    s = descriptor_integrity(sources.join(mine.select("source_id"), "source_id", "left_semi"), "source_id", "source_hash", "source")
    return settle(v.unionByName(d).unionByName(s).unionByName(link_integrity(links, versions)))


def _breaks(integrity: DataFrame) -> DataFrame:
    return integrity.select("resource_type", "resource_id", F.explode("issues").alias("code"))


def provenance_closure(versions, datasets, sources, contents, links, requested: Sequence[str], chains: bool = True) -> Report:
    """Everything upstream of the requested versions, over lineage links and predecessors, verified.

    Parts: closure, missing_references, cycles, integrity, breaks, unused (versions of involved datasets outside the closure) and, unless
    ``chains`` is off, chains: all simple upstream paths, whose number may grow exponentially with the graph's width. The
    snapshot hash covers integrity and unused versions too, so a later append or tampering gives a new report.
    """
    spark = versions.sparkSession
    edges = settle(_edges(links, "lineage:", with_id=True).unionByName(_previous(versions, "previous_version")).select(F.col("src").alias("dst"), F.col("dst").alias("src"), "relation", "link"))
    asked = _seeds(spark, requested, root="")
    known = versions.select(F.col("version_id").alias("node"))
    found = graph.reach(edges.join(known.withColumnRenamed("node", "dst"), "dst", "left_semi"), asked.join(known, "node", "left_semi"))
    closure = settle(found.select("node").distinct())
    mine = settle(versions.join(closure.withColumnRenamed("node", "version_id"), "version_id", "left_semi").select("version_id", "dataset_id", "source_id", "content_hash", "provenance_hash"))
    missing = asked.join(known, "node", "left_anti").select(*_issue("requested_version_missing", "dataset_version", F.col("node")))
    missing = missing.unionByName(mine.join(datasets, "dataset_id", "left_anti").select(*_issue("dataset_reference_missing", "dataset_version", F.col("version_id"), F.col("dataset_id"))))
    missing = missing.unionByName(mine.join(sources, "source_id", "left_anti").select(*_issue("source_reference_missing", "dataset_version", F.col("version_id"), F.col("source_id"))))
    up = edges.join(closure.withColumnRenamed("node", "src"), "src", "left_semi")
    missing = settle(missing.unionByName(up.join(known.withColumnRenamed("node", "dst"), "dst", "left_anti").select(*_issue("upstream_version_missing", "dataset_version", F.col("src"), F.col("dst")))))
    involved = links.join(closure.withColumnRenamed("node", "downstream_version_id"), "downstream_version_id", "left_semi")
    integrity = _integrity(versions, datasets, sources, contents, involved, closure)
    cycles = _cycles(_within(edges, closure))
    unused = settle(versions.join(mine.select("dataset_id"), "dataset_id", "left_semi").select(F.col("version_id").alias("node")).join(closure, "node", "left_anti"))
    labels = graph.components(_within(edges, closure).select("src", "dst"), closure)
    requested_here = asked.select("node").join(labels, "node")
    summary = _row(
        closure.agg(F.count("*").alias("closure_version_count")), mine.agg(F.countDistinct("dataset_id").alias("dataset_count"), F.countDistinct("source_id").alias("source_count")),
        _count(involved, "lineage_link_count"), requested_here.agg(F.countDistinct("component").alias("connected_component_count")), _count(missing, "missing_count"),
        _count(cycles, "cycle_count"), _count(_breaks(integrity), "break_count"), _count(unused, "unused_count"), _count(up.limit(1), "_ancestry"),
        _digest(mine.select(F.concat_ws(":", "version_id", "content_hash", "provenance_hash").alias("x")).union(unused.select(F.concat(F.lit("unused:"), "node"))).union(integrity.select(F.to_json(F.struct("resource_type", "resource_id", "issues")))).union(asked.select(F.concat(F.lit("requested:"), "node")))),
    )
    n = len(set(requested))
    q = verdict(
        (F.col("missing_count") + F.col("break_count") + F.col("cycle_count") > 0, "BROKEN"), (F.lit(n > 1) & (F.col("connected_component_count") > 1), "INCOMPATIBLE"),
        (F.lit(n == 1) & (F.col("_ancestry") == 0), "INSUFFICIENT"), (F.col("unused_count") > 0, "PARTIAL"), otherwise="COMPLETE",
    )
    summary = summary.withColumn("requested_version_count", F.lit(n)).withColumn("qualification", q).drop("_ancestry")
    parts = {"closure": closure, "missing_references": missing, "cycles": cycles, "integrity": integrity, "breaks": _breaks(integrity), "unused": unused}
    if chains:
        parts["chains"] = closure_chains(versions, sources, links, requested)
    return Report(summary, parts)


def closure_chains(versions, sources, links, requested: Sequence[str], max_depth: int | None = None) -> DataFrame:
    """target_version_id, version_path, edge_path, source_id, complete: all simple upstream paths of the requested versions."""
    spark = versions.sparkSession
    known = versions.select(F.col("version_id").alias("dst"))
    edges = _edges(links, "lineage:", with_id=True).unionByName(_previous(versions, "previous_version")).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation", "link")
    targets = _seeds(spark, requested).select("node").join(known.withColumnRenamed("dst", "node"), "node", "left_semi")
    paths = graph.simple_paths(edges.join(known, "dst", "left_semi"), targets, max_depth)
    at = paths.join(versions.select(F.col("version_id").alias("node"), "source_id"), "node").join(sources.select("source_id", F.lit(True).alias("_has")), "source_id", "left")
    return at.select(F.col("target").alias("target_version_id"), F.col("path").alias("version_path"), F.col("relations").alias("edge_path"), F.when(F.col("_has"), F.col("source_id")).alias("source_id"), F.coalesce("_has", F.lit(False)).alias("complete"))


def _digest(lines: DataFrame) -> DataFrame:
    """One row, snapshot_hash: order-insensitive, by a tree of row hashes."""
    hashed = lines.select(F.lit("").alias("k"), F.sha2(lines.columns[0], 256).alias("h"))
    return content_hash(hashed, ["k"], "h").agg(F.coalesce(F.max("content_hash"), F.sha2(F.lit(""), 256)).alias("snapshot_hash"))


def impact_dossier(versions, datasets, sources, contents, links, version_ids: Sequence[str] = (), dataset_ids: Sequence[str] = ()) -> Report:
    """Everything downstream of the selected versions and of all versions of the selected datasets, verified.

    Parts: affected, orphan_references, cycles, integrity, breaks, worst_branch (deepest, ties by smallest path).
    """
    spark = versions.sparkSession
    chosen = spark.createDataFrame([(d,) for d in sorted(set(dataset_ids))], "dataset_id string")
    seeds = settle(_seeds(spark, version_ids, root="").unionByName(versions.join(chosen, "dataset_id", "left_semi").select(F.lit("").alias("root"), F.col("version_id").alias("node"))).distinct())
    edges = settle(_edges(links, "LINEAGE:").unionByName(_previous(versions, "NEXT_VERSION")))
    known = versions.select(F.col("version_id").alias("node"), "dataset_id", "source_id")
    inner = edges.join(known.select(F.col("node").alias("dst")), "dst", "left_semi")
    found = settle(graph.bfs(inner, seeds))
    nodes = settle(found.select("node").distinct())
    affected = settle(found.join(seeds.select("node"), "node", "left_anti").join(known, "node").select(F.col("node").alias("version_id"), "dataset_id", "depth", F.col("path").alias("version_path"), F.col("relations").alias("edge_path"), F.filter("links", lambda x: x != "").alias("lineage_link_path")))
    mine = known.join(nodes, "node", "left_semi")
    out = edges.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi")
    orphans = out.join(known.select(F.col("node").alias("dst")), "dst", "left_anti").select(*_issue("downstream_version_missing", "dataset_version", F.col("src"), F.col("dst")))
    lost_d, lost_s = mine.join(datasets, "dataset_id", "left_anti"), mine.join(sources, "source_id", "left_anti")
    gone = versions.join(nodes.withColumnRenamed("node", "version_id"), "version_id", "left_semi").where("previous_version_id is not null").join(versions.select(F.col("version_id").alias("previous_version_id")), "previous_version_id", "left_anti")
    for part in (
        lost_d.select("dataset_id").distinct().select(*_issue("dataset_missing", "dataset", F.col("dataset_id"))), lost_s.select("source_id").distinct().select(*_issue("source_missing", "source", F.col("source_id"))),
        lost_d.select(*_issue("dataset_reference_missing", "dataset_version", F.col("node"), F.col("dataset_id"))), lost_s.select(*_issue("source_reference_missing", "dataset_version", F.col("node"), F.col("source_id"))),
        gone.select(*_issue("previous_version_missing", "dataset_version", F.col("version_id"), F.col("previous_version_id"))),
    ):
        orphans = orphans.unionByName(part)
    orphans = settle(orphans)
    involved = links.join(nodes.withColumnRenamed("node", "upstream_version_id"), "upstream_version_id", "left_semi")
    integrity = _integrity(versions, datasets, sources, contents, involved, nodes)
    cycles = _cycles(_within(edges, nodes))
    worst = affected.orderBy(F.desc("depth"), "version_path").limit(1)
    empty = chosen.join(versions, "dataset_id", "left_anti").select(F.concat(F.lit("dataset_without_versions:"), "dataset_id").alias("r"))
    summary = _row(
        _count(seeds, "seed_version_count"), affected.agg(F.count("*").alias("affected_version_count"), F.countDistinct("dataset_id").alias("affected_dataset_count"), F.coalesce(F.max("depth"), F.lit(0)).alias("maximum_depth")),
        _count(orphans, "orphan_count"), _count(_breaks(integrity), "break_count"), _count(cycles, "cycle_count"), empty.agg(F.array_sort(F.collect_list("r")).alias("_r")),
        _digest(nodes.join(versions.select(F.col("version_id").alias("node"), "content_hash", "provenance_hash"), "node").select(F.concat_ws(":", "node", "content_hash", "provenance_hash").alias("x")).union(integrity.select(F.to_json(F.struct("resource_type", "resource_id", "issues")))).union(seeds.select(F.concat(F.lit("seed:"), "node")))),
    )
    none = F.col("affected_version_count") == 0
    q = verdict(
        (F.col("orphan_count") + F.col("break_count") + F.col("cycle_count") > 0, "INCOMPATIBLE"), ((F.size("_r") > 0) | none, "INSUFFICIENT"),
        ((F.col("affected_version_count") >= WIDESPREAD_VERSIONS) | (F.col("affected_dataset_count") >= WIDESPREAD_DATASETS) | (F.col("maximum_depth") >= WIDESPREAD_DEPTH), "WIDESPREAD"), otherwise="CONTAINED",
    )
    summary = summary.withColumn("qualification", q)
    why = F.when(none & (F.col("qualification") == "INSUFFICIENT"), F.concat("_r", F.array(F.lit("no_downstream_impact_observed")))).otherwise(F.col("_r"))
    return Report(summary.withColumn("insufficient_reasons", F.array_sort(why)).drop("_r"), {"affected": affected, "orphan_references": orphans, "cycles": cycles, "integrity": integrity, "breaks": _breaks(integrity), "worst_branch": worst})


def transitions(states: DataFrame) -> DataFrame:
    """Changes between neighbouring states: ord, root, downstream, breaks, orphans (arrays of strings) per state.

    Returns ord, from_root, to_root, added, removed, new_breaks, resolved_breaks, new_orphans, resolved_orphans, severity.
    """
    order = Window.orderBy("ord")  # a selection of at most 100 roots
    prev = states.select("ord", "root", "downstream", "breaks", "orphans", *(F.lag(c).over(order).alias(f"_{c}") for c in ("root", "downstream", "breaks", "orphans"))).where("_root is not null")
    less = lambda a, b: F.array_sort(F.array_except(a, b))
    out = prev.select(
        "ord", F.col("_root").alias("from_root"), F.col("root").alias("to_root"), less("downstream", "_downstream").alias("added"), less("_downstream", "downstream").alias("removed"), less("breaks", "_breaks").alias("new_breaks"),
        less("_breaks", "breaks").alias("resolved_breaks"), less("orphans", "_orphans").alias("new_orphans"), less("_orphans", "orphans").alias("resolved_orphans"),
    )
    severity = F.size("new_breaks") * NEW_BREAK + F.size("new_orphans") * NEW_ORPHAN + F.size("removed") * REMOVAL + F.size("added") * ADDITION
    return out.withColumn("severity", severity)


def worst_transition(changes: DataFrame) -> DataFrame:
    """The transition of the largest severity; the latest on ties."""
    return changes.orderBy(F.desc("severity"), F.desc("ord")).limit(1)


def lineage_evolution(versions, datasets, sources, contents, links, version_ids: Sequence[str]) -> Report:
    """How the downstream of a dataset's versions changes from one to the next, in order of (version_number, created_at, id).

    Parts: states, affected, transitions, worst_transition, cycles. An orphan link counts as orphan and as break.
    """
    spark = versions.sparkSession
    ids = _seeds(spark, version_ids)
    roots = settle(versions.join(ids.select(F.col("node").alias("version_id")), "version_id", "left_semi").withColumn("ord", F.row_number().over(Window.orderBy("version_number", "created_at", "version_id"))))
    edges = settle(_edges(links))
    known = versions.select(F.col("version_id").alias("node"), "dataset_id")
    inner = edges.join(known.select(F.col("node").alias("dst")), "dst", "left_semi")
    found = settle(graph.bfs(inner, roots.select(F.col("version_id").alias("root"), F.col("version_id").alias("node"))))
    all_issues = settle(_checked(versions, datasets, sources, contents, settle(found.select("node").distinct())).where(F.size("issues") > 0))
    link_issues = settle(link_integrity(links, versions).where(F.size("issues") > 0))
    affected = found.where("root <> node").join(known, "node").select("root", F.col("node").alias("version_id"), "dataset_id", "depth", F.col("path").alias("version_path"), F.col("links").alias("lineage_link_path"))
    used = found.select("root", F.col("node").alias("src")).join(edges, "src")
    orphan = used.join(known.select(F.col("node").alias("dst")), "dst", "left_anti").select("root", F.concat_ws(":", F.lit("downstream_version_missing"), "link", "dst").alias("o")).distinct()
    broken = found.select("root", F.col("node").alias("version_id")).join(all_issues, "version_id").select("root", F.explode(F.transform("issues", lambda c: F.concat_ws(":", c, "version_id"))).alias("b"))
    broken = broken.union(used.select("root", F.col("link").alias("resource_id")).distinct().join(link_issues, "resource_id").select("root", F.explode(F.transform("issues", lambda c: F.concat_ws(":", c, "resource_id"))))).distinct()
    none = F.array().cast("array<string>")
    down = affected.groupBy("root").agg(F.array_sort(F.collect_set("version_id")).alias("downstream"), F.array_sort(F.collect_set("dataset_id")).alias("downstream_datasets"), F.max("depth").alias("maximum_depth"))
    states = roots.select(F.col("version_id").alias("root"), "ord", "version_number", "content_hash", "provenance_hash").join(down, "root", "left")
    states = states.join(orphan.groupBy("root").agg(F.array_sort(F.collect_set("o")).alias("orphans")), "root", "left").join(broken.groupBy("root").agg(F.array_sort(F.collect_set("b")).alias("breaks")), "root", "left")
    states = states.join(all_issues.select(F.col("version_id").alias("root"), F.col("issues").alias("root_issues")), "root", "left")
    states = settle(states.withColumns({c: F.coalesce(c, none) for c in ("downstream", "downstream_datasets", "orphans", "breaks", "root_issues")} | {"maximum_depth": F.coalesce("maximum_depth", F.lit(0))}).withColumn("proof_valid", F.size("root_issues") == 0))
    cycles = _cycles(_within(edges, found.select("node").distinct()))
    changes = settle(transitions(states))
    whole = states.agg(F.count("*").alias("state_count"), F.max(F.size("downstream")).alias("_down"), F.max(F.size("orphans") + F.size("breaks")).alias("_signals"), F.array_sort(F.flatten(F.collect_list(F.transform("root_issues", lambda c: F.concat_ws(":", "root", c))))).alias("_proof"))
    sums = changes.agg(F.count("*").alias("transition_count"), *(F.coalesce(F.sum(F.size(c)), F.lit(0)).alias(n) for c, n in (("added", "added_dependency_count"), ("removed", "removed_dependency_count"), ("new_breaks", "new_break_count"), ("new_orphans", "new_orphan_count"))))
    one = roots.agg(F.countDistinct("dataset_id").alias("_d"), F.min("dataset_id").alias("_dataset"))
    summary = _row(whole, sums, one, _count(cycles, "cycle_count"), _digest(states.select(F.to_json(F.struct("ord", "root", "content_hash", "provenance_hash", "downstream", "orphans", "breaks")))))
    q = verdict((F.col("_d") != 1, "INCOMPATIBLE"), ((F.size("_proof") > 0) | (F.col("_down") == 0), "INSUFFICIENT"), ((F.col("_signals") > 0) | (F.col("cycle_count") > 0), "PARTIAL"), otherwise="EXPLAINED")
    summary = summary.withColumn("qualification", q)
    why = F.when((F.col("qualification") == "INSUFFICIENT") & (F.size("_proof") == 0), F.array(F.lit("no_downstream_lineage_evidence"))).otherwise(F.col("_proof"))
    issues = F.when(F.col("_d") != 1, F.array(F.lit("selected_versions_belong_to_different_datasets"))).otherwise(none)
    summary = summary.select("qualification", F.when(F.col("_d") == 1, F.col("_dataset")).alias("dataset_id"), issues.alias("compatibility_issues"), why.alias("insufficient_reasons"), "state_count", "transition_count", "added_dependency_count", "removed_dependency_count", "new_break_count", "new_orphan_count", "cycle_count", "snapshot_hash")
    return Report(summary, {"states": states, "affected": affected, "transitions": changes, "worst_transition": worst_transition(changes), "cycles": cycles})
