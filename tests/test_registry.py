"""The registry's verbs end to end: versions, verification, reports, idempotency, lineage analyses, audit."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerframe.operators import lineage as L
from ledgerframe.operators.provenance import verify_version
from ledgerframe.plans import registry
from ledgerframe.plans.errors import ConflictError, NotFoundError, ValidationError
from ledgerframe.plans.registry import Registry
from ledgerframe.streaming.audit import action_counts, audit_stream

SCHEMA = {"fields": {"id": {"type": "integer"}, "name": {"type": "string", "required": False}}, "allow_extra": True}
CONTRACT = {"fields": {"id": {"types": ["integer"], "unique": True}, "name": {"types": ["string"], "required": False, "nullable": True, "max_missing_rate": 1.0}}}


@pytest.fixture(scope="module")
def reg(spark, tmp_path_factory):
    r = Registry(spark, str(tmp_path_factory.mktemp("registry")))
    r.create_source("s", "manual")
    return r


@pytest.fixture(scope="module")
def chain(reg):
    """A dataset of three versions, and downstream of the second three single-version datasets, one of them two steps away as well."""
    src = reg.list("sources").first().source_id
    main = reg.create_dataset("main", schema=SCHEMA).dataset_id
    v = [reg.create_version(main, src, [{"id": i, "name": "a"} for i in range(n)]).version_id for n in (3, 3, 5)]
    leaves = [reg.create_version(reg.create_dataset(f"leaf{i}").dataset_id, src, [{"id": i}]).version_id for i in range(3)]
    for leaf in leaves:
        reg.create_lineage_link(v[1], leaf, "DERIVED_FROM")
    reg.create_lineage_link(leaves[0], leaves[1], "JOINED_FROM")
    return src, main, v, leaves


def test_versions_are_chained_and_verified(reg, chain):
    _, main, v, _ = chain
    rows = [reg.get("versions", version_id=x) for x in v]
    assert [r.version_number for r in rows] == [1, 2, 3] and rows[2].previous_version_id == v[1]
    assert rows[0].content_hash == rows[1].content_hash != rows[2].content_hash
    got = reg.verify_provenance(v[2])
    assert got.valid and got.checked_versions == 3 and got.issues == []
    assert reg.get_latest_quality(v[0]).verdict == "VERIFIED"
    assert reg.run_quality_checks(v[0]).sequence > 1
    assert reg.get_dataset(main)["version_count"] == 3


def test_refusals(reg, chain):
    src, main, v, leaves = chain
    with pytest.raises(ConflictError):
        reg.create_source("s", "manual")
    with pytest.raises(ConflictError):
        reg.create_dataset("main")
    with pytest.raises(NotFoundError):
        reg.create_version("nope", src, [])
    with pytest.raises(ValidationError):
        reg.create_version(main, src, [3])
    with pytest.raises(ValidationError):
        reg.create_drift_report(v[1], v[0])
    with pytest.raises(ValidationError):
        reg.create_lineage_link(v[0], v[0], "DERIVED_FROM")
    with pytest.raises(ValidationError):
        reg.create_lineage_link(v[0], leaves[0], "LIKES")
    with pytest.raises(ValidationError):
        reg.create_impact_report(v[0], 11)
    with pytest.raises(NotFoundError):
        reg.create_provenance_closure_report(["nope"])
    with pytest.raises(ValidationError):
        reg.create_lineage_evolution_dossier([v[0]])


def test_reports_are_idempotent(reg, chain):
    _, main, v, _ = chain
    a, b = reg.create_drift_report(v[0], v[2]), reg.create_drift_report(v[0], v[2])
    assert a == b and a.verdict == "DRIFTED" and a.triggers == ["row_count_change_exceeds_threshold"]
    assert reg.list_audit(action="DRIFT_REPORT_CREATED").count() == 1
    c1 = reg.create_data_contract(main, "one", CONTRACT)
    c2 = reg.create_data_contract(main, "two", CONTRACT)
    assert c2.version_number == 2 and c2.previous_contract_hash == c1.contract_hash
    assert reg.create_contract_report(c1.contract_id, v[2]) == reg.create_contract_report(c1.contract_id, v[2])
    assert reg.create_contract_report(c2.contract_id, v[1]).verdict == "COMPATIBLE"
    assert reg.create_contract_compatibility_report(c1.contract_id, c2.contract_id).qualification == "FULLY_COMPATIBLE"


def test_lineage_reports(reg, chain):
    _, _, v, leaves = chain
    r = reg.create_impact_report(v[1], 1)
    assert r.qualification == "PROPAGATED" and json.loads(r.summary)["affected_version_count"] == 3
    assert reg.create_impact_report(v[1], 1) == r and reg.create_impact_report(v[2], 3).qualification == "ISOLATED"
    assert reg.create_provenance_closure_report([v[2]]).qualification == "COMPLETE"
    assert reg.create_provenance_closure_report([v[1]]).qualification == "PARTIAL"
    assert reg.create_provenance_closure_report([v[0]]).qualification == "INSUFFICIENT"
    d = reg.create_provenance_impact_dossier([v[0]])
    assert d.qualification == "WIDESPREAD" and json.loads(d.summary)["affected_version_count"] == 5
    assert reg.report_part(d.report_id, "worst_branch").count() == 1
    c = reg.create_provenance_closure_report([leaves[1]])
    paths = sorted((json.loads(r.item)["version_path"], json.loads(r.item)["complete"]) for r in reg.report_part(c.report_id, "chains").collect())
    up = v[1::-1]
    assert paths == sorted(([leaves[1], *p], True) for p in ([], up[:1], up, [leaves[0]], [leaves[0], up[0]], [leaves[0], *up]))
    e = reg.create_lineage_evolution_dossier([v[0], v[1]])
    s = json.loads(e.summary)
    assert e.qualification == "EXPLAINED" and s["added_dependency_count"] == 3 and s["removed_dependency_count"] == 0


def test_tampering_and_orphans_are_found(reg, chain, spark):
    _, _, v, leaves = chain
    versions, datasets, sources, contents, links = reg._graph()
    forged = versions.withColumn("content_hash", F.when(F.col("version_id") == v[1], "0").otherwise(F.col("content_hash")))
    assert L.provenance_closure(forged, datasets, sources, contents, links, [v[2]]).summary.first().qualification == "BROKEN"
    assert L.impact_dossier(forged, datasets, sources, contents, links, [v[1]]).summary.first().qualification == "INCOMPATIBLE"
    orphan = links.unionByName(spark.createDataFrame([("x", v[0], "gone", "DERIVED_FROM", "0", "")], links.schema))
    assert L.impact_report(versions, orphan, v[0]).parts["orphans"].count() == 1
    r = L.lineage_evolution(versions, datasets, sources, contents, orphan, [v[0], v[1]])
    assert r.summary.first().qualification == "PARTIAL"
    t = r.parts["transitions"].first()
    assert t.resolved_orphans and not t.new_breaks
    ring = links.unionByName(spark.createDataFrame([("y", leaves[0], v[1], "DERIVED_FROM", "0", "")], links.schema))
    assert L.impact_report(versions, ring, v[1]).summary.first().qualification == "CYCLE_DETECTED"


@pytest.mark.parametrize("dies_at", [2, 3, 4, 5])
def test_a_version_whose_write_died_is_made_once(reg, monkeypatch, dies_at):
    """create_version appends records, the version, its audit event, the evaluation and its event; each may be the one that fails."""
    src = reg.list("sources").first().source_id
    data = reg.create_dataset(f"dies at {dies_at}", schema=SCHEMA).dataset_id
    calls = []
    append = reg.tables.append

    def fails(name, rows):
        calls.append(name)
        if len(calls) == dies_at:
            raise OSError("gone")
        append(name, rows)

    monkeypatch.setattr(reg.tables, "append", fails)
    with pytest.raises(OSError):
        reg.create_version(data, src, [{"id": 7}, {"id": 8}])
    monkeypatch.undo()
    got = reg.create_version(data, src, [{"id": 7}, {"id": 8}])
    mine = reg.list("versions", dataset_id=data).collect()
    assert mine == [got] and got.record_count == 2 and reg.records(got.version_id).count() == 2 and reg.verify_provenance(got.version_id).valid
    assert reg.tables.read("evaluations").where(F.col("version_id") == got.version_id).count() == 1
    assert sorted(r.action for r in reg.list_audit(resource_id=got.version_id).collect()) == ["QUALITY_EVALUATED", "VERSION_CREATED"]
    assert reg.get_latest_quality(got.version_id).verdict == "VERIFIED"


def test_other_records_after_a_write_that_died(reg, monkeypatch):
    src = reg.list("sources").first().source_id
    data = reg.create_dataset("other records").dataset_id
    monkeypatch.setattr(reg, "_finish", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        reg.create_version(data, src, [{"id": 1}])
    monkeypatch.undo()
    two = reg.create_version(data, src, [])
    assert two.version_number == 2 and two.record_count == 0 and reg.get_latest_quality(two.previous_version_id).verdict == "INSUFFICIENT"
    with pytest.raises(ValidationError):
        reg.create_version(data, src, reg.spark.createDataFrame([(0, "[1]")], "row_index long, record string"))
    assert reg.create_version(data, src, [{"id": 1}, {"id": 1}]).version_number == 3 and reg.records(two.version_id).count() == 0


def test_a_report_whose_write_died_is_stored_once(reg, chain, monkeypatch):
    _, _, v, leaves = chain
    append = reg.tables.append
    for table in ("graph_reports", "audit"):
        monkeypatch.setattr(reg.tables, "append", lambda name, rows, t=table: 1 / 0 if name == t else append(name, rows))
        with pytest.raises(ZeroDivisionError):
            reg.create_provenance_impact_dossier([leaves[0]])
        monkeypatch.undo()
    d = reg.create_provenance_impact_dossier([leaves[0]])
    assert reg.report_part(d.report_id, "affected").count() == 1 and reg.list_audit(resource_id=d.report_id).count() == 1


@pytest.mark.parametrize("column, code", [
    ("source_id", "manifest_source_id_mismatch"), ("created_at", "manifest_created_at_mismatch"), ("record_count", "record_count_mismatch"), ("content_hash", "content_hash_mismatch"),
    ("previous_version_id", "previous_version_mismatch"), ("provenance_hash", "provenance_hash_mismatch"), ("manifest", "invalid_stored_json"),
])
def test_verification_sees_every_exchanged_field(reg, chain, column, code):
    _, main, v, _ = chain
    versions, datasets, sources, _, _ = reg._graph()
    contents = versions.select("version_id", "record_count", "content_hash")  # as stored: test_tampering_and_orphans_are_found hashes records again
    other = {"record_count": F.lit(99).cast("long"), "manifest": F.lit("{")}.get(column, F.lit("x"))
    forged = versions.withColumn(column, F.when(F.col("version_id") == v[1], other).otherwise(F.col(column)))
    got = verify_version(forged, datasets, sources, contents, v[2]).first()
    assert not got.valid and f"{v[1]}:{code}" in got.issues and got.checked_versions == 3


def test_listing_order_and_pages(reg, chain):
    _, main, v, _ = chain
    assert [r.version_id for r in reg.list("versions", dataset_id=main).collect()] == v[::-1]
    assert [r.version_id for r in reg.list("versions", limit=1, offset=1, dataset_id=main).collect()] == [v[1]]
    names = [r.name for r in reg.list("datasets", limit=500).collect()]
    assert names[:4] == ["main", "leaf0", "leaf1", "leaf2"]
    assert reg.list("versions", limit=0, offset=-3, dataset_id=main).count() == 1
    assert [r.sequence for r in reg.list_audit(limit=3).collect()] == sorted((r.sequence for r in reg.list_audit(limit=3).collect()), reverse=True)
    assert reg.list_lineage_links(upstream=v[1]).count() == 3 and reg.list_lineage_links(upstream=v[1], downstream=v[0]).count() == 0


def test_contents_reads_only_what_is_asked(reg, chain, spark, monkeypatch):
    _, _, v, _ = chain
    want = {r.version_id: r.content_hash for r in reg.tables.read("versions").collect()}
    ids = spark.createDataFrame([(v[0],), (v[2],)], "version_id string")
    for named in (1_000, 0):
        monkeypatch.setattr(registry, "NAMED_FOLDERS", named)
        assert {r.version_id: r.content_hash for r in reg.contents(ids).collect()} == {x: want[x] for x in (v[0], v[2])}
    assert {r.version_id: r.content_hash for r in reg.contents().collect()} == want


def test_audit_stream(reg, chain, spark, tmp_path):
    n = reg.tables.read("audit").count()
    q = action_counts(audit_stream(spark, reg.tables.root)).writeStream.outputMode("complete").format("memory").queryName("audit_counts").option("checkpointLocation", str(tmp_path)).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM audit_counts").first()[0] == n
