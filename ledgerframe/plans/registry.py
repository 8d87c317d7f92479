"""The registry's verbs over a SparkSession.

Ids are derived from content, so replays give the same ids. Reports are idempotent on their key: asking again
returns the stored row and writes no audit event. Nothing visible is ever updated or deleted; tampering is found by verification.

A call that dies leaves nothing wrong behind. What it wrote before the row that makes a version or report visible is replaced when the call
is repeated; what should have followed that row (audit events, the first evaluation) is made up for by the repeated call, or by
the next version of the dataset.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import canonical_json, content_hash, hash_json, row_hash, sha256_text
from ..functions.jsontypes import is_object
from ..functions.lineage import settle
from ..operators import contracts as contract_ops
from ..operators import drift as drift_ops
from ..operators import lineage as lineage_ops
from ..operators import quality as quality_ops
from ..operators.profile import cell_profile, cells
from ..operators.provenance import LINK_RULES, chain_upto, link_hash, verify_version
from ..sources.records import from_objects, from_rows
from ..sources.tables import Tables
from .errors import ConflictError, NotFoundError, ValidationError

FORMAT = "ledgerframe.version/1.0"
# Bounds of requests.
#: Up to so many versions the folders of their records are named in the scan; beyond, records are joined with the versions.
NAMED_FOLDERS = 1_000
PAGE, PAGE_DEFAULT, CLOSURE_IDS, DOSSIER_IDS, EVOLUTION_IDS, DEPTHS = (1, 500), 100, (1, 50), (1, 50), (2, 100), (1, 10)
ORDERS = {
    "sources": ("created_at", "source_id"), "datasets": ("created_at", "dataset_id"), "versions": ("-version_number",), "contracts": ("-version_number",),
    "links": ("created_at", "id"), "audit": ("-sequence",), "graph_reports": ("-created_at", "-report_id"),
    "evaluations": ("-sequence",), "records": ("version_id", "row_index"), "report_parts": ("report_id", "part", "item"),
}


def _now() -> str:
    return dt.datetime.now(dt.timezone.utc).isoformat()


def _text(value: Any, name: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ValidationError(f"{name} is required")
    return value.strip()


def _ids(values: Sequence[str], low: int, high: int, name: str) -> list[str]:
    if isinstance(values, str) or not low <= len(values) <= high or len(set(values)) != len(values) or not all(isinstance(v, str) and v for v in values):
        raise ValidationError(f"{name}: {low} to {high} different ids")
    return sorted(values)


class Registry:
    """A dataset registry in Parquet tables under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.tables = spark, Tables(spark, root)

    # Audit and look-ups

    def _audit(self, action: str, kind: str, resource: str, actor: str, details: Mapping[str, Any] | None = None) -> None:
        last = self.tables.read("audit").agg(F.max("sequence")).first()[0] or 0
        self.tables.append("audit", [(last + 1, action, kind, resource, actor, canonical_json(dict(details or {})), dt.datetime.now(dt.timezone.utc))])

    def _log_once(self, action: str, kind: str, resource: str, actor: str, details: Mapping[str, Any] | None = None) -> None:
        """The audit event of a creation, unless it is there."""
        if self.tables.one("audit", action=action, resource_id=resource) is None:
            self._audit(action, kind, resource, actor, details)

    def get(self, table: str, /, **key: str) -> Row:
        row = self.tables.one(table, **key)
        if row is None:
            raise NotFoundError(f"no such row in {table}: {key}")
        return row

    def list(self, table: str, /, limit: int = PAGE_DEFAULT, offset: int = 0, **where: Any) -> DataFrame:
        """A page of a table in its listing order, filtered by equality on the given columns (None: no filter)."""
        df = self.tables.read(table)
        for c, v in where.items():
            if v is not None:
                df = df.where(F.col(c) == v)
        order = ORDERS.get(table, ("-created_at", f"-{df.columns[0]}"))
        keys = [F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in order]
        return df.orderBy(*keys).offset(max(0, offset)).limit(min(PAGE[1], max(PAGE[0], limit)))

    def list_audit(self, action: str | None = None, resource_type: str | None = None, resource_id: str | None = None, limit: int = PAGE_DEFAULT, offset: int = 0) -> DataFrame:
        """Audit events, newest first."""
        return self.list("audit", limit, offset, action=action, resource_type=resource_type, resource_id=resource_id)

    # Sources and datasets

    def create_source(self, name: str, kind: str, uri: str | None = None, description: str | None = None, metadata: Mapping[str, Any] | None = None, actor: str = "system") -> Row:
        d = {"name": _text(name, "name"), "kind": _text(kind, "kind"), "uri": uri, "description": description, "metadata": dict(metadata or {})}
        text = canonical_json(d)
        digest = sha256_text(text)
        if old := self.tables.one("sources", source_hash=digest):
            self._log_once("SOURCE_CREATED", "source", old.source_id, actor)
            raise ConflictError("this source exists")
        key = f"src-{digest[:24]}"
        self.tables.append("sources", [(key, d["name"], d["kind"], text, digest, _now())])
        self._audit("SOURCE_CREATED", "source", key, actor)
        return self.get("sources", source_id=key)

    def create_dataset(self, name: str, description: str | None = None, schema: Mapping[str, Any] | None = None, actor: str = "system") -> Row:
        spec = contract_ops.normalise_schema(schema)
        d = {"name": _text(name, "name"), "description": description, "schema": spec}
        text = canonical_json(d)
        digest = sha256_text(text)
        if old := self.tables.one("datasets", name=d["name"]) or self.tables.one("datasets", dataset_hash=digest):
            self._log_once("DATASET_CREATED", "dataset", old.dataset_id, actor)
            raise ConflictError("a dataset of this name exists")
        key = f"ds-{digest[:24]}"
        self.tables.append("datasets", [(key, d["name"], text, canonical_json(spec) if spec else None, digest, _now())])
        self._audit("DATASET_CREATED", "dataset", key, actor)
        return self.get("datasets", dataset_id=key)

    def get_dataset(self, dataset_id: str) -> dict[str, Any]:
        row = self.get("datasets", dataset_id=dataset_id).asDict()
        return row | {"version_count": self.tables.read("versions").where(F.col("dataset_id") == dataset_id).count()}

    # Versions

    def create_version(self, dataset_id: str, source_id: str, records: DataFrame | Iterable[Mapping[str, Any]], actor: str = "system", index_col: str | None = None) -> Row:
        """Store a record set as the dataset's next version and evaluate its quality.

        ``records`` are objects, or a DataFrame: of row_index and record (JSON text), or of typed rows.
        """
        dataset, source = self.get("datasets", dataset_id=dataset_id), self.get("sources", source_id=source_id)
        if not isinstance(records, DataFrame):
            rows = from_objects(self.spark, records)
        else:
            rows = records if set(records.columns) == {"row_index", "record"} else from_rows(records, index_col)
        previous = self.tables.read("versions").where(F.col("dataset_id") == dataset_id).orderBy(F.desc("version_number")).first()
        died = previous is not None and self.tables.one("audit", action="QUALITY_EVALUATED", resource_id=previous.version_id) is None
        if died:
            self._finish(previous, dataset, actor)
        number = previous.version_number + 1 if previous else 1
        key = f"v-{hash_json([dataset_id, number, previous.provenance_hash if previous else None])[:24]}"
        # One pass over the input. The folder is this version's alone, so what a call that died left there goes first.
        self.tables.clear("records", key)
        self.tables.append("records", rows.select(F.lit(key).alias("version_id"), "row_index", "record", row_hash(F.col("record")).alias("record_hash"), is_object(F.col("record")).alias("valid")))
        stored = self.tables.read("records").where(F.col("version_id") == key)
        if not stored.where("not valid").isEmpty():
            self.tables.clear("records", key)
            raise ValidationError("every record must be a JSON object")
        content = content_hash(stored.select("version_id", "record_hash"), ["version_id"], "record_hash").first()
        count, digest = (content.record_count, content.content_hash) if content else (0, sha256_text(""))
        if died and (previous.source_id, previous.record_count, previous.content_hash) == (source_id, count, digest):
            # The call that died is being repeated: its version was there already.
            self.tables.clear("records", key)
            return previous
        at = _now()
        manifest = canonical_json({
            "format": FORMAT, "version_id": key, "dataset_id": dataset_id, "dataset_hash": dataset.dataset_hash, "source_id": source_id, "source_hash": source.source_hash, "version_number": number, "record_count": count,
            "content_hash": digest, "previous_version_id": previous.version_id if previous else None, "previous_provenance_hash": previous.provenance_hash if previous else None, "created_at": at,
        })
        self.tables.append("versions", [(key, dataset_id, source_id, number, previous.version_id if previous else None, count, digest, manifest, sha256_text(manifest), at)])
        version = self.get("versions", version_id=key)
        self._finish(version, dataset, actor)
        return version

    def _finish(self, version: Row, dataset: Row, actor: str) -> None:
        """What follows a version's row: its audit event, its first evaluation and that one's event, each unless it is there."""
        self._log_once("VERSION_CREATED", "dataset_version", version.version_id, actor, {"record_count": version.record_count})
        found = self.tables.one("evaluations", version_id=version.version_id)
        if found is None:
            self._evaluate(version.version_id, dataset, True, actor)
        else:
            self._log_once("QUALITY_EVALUATED", "dataset_version", version.version_id, actor, {"verdict": found.verdict, "recheck": False})

    def contents(self, nodes: DataFrame | None = None) -> DataFrame:
        """version_id, record_count, content_hash recomputed from the stored records, of the versions in ``nodes`` (version_id) or all; versions without rows included."""
        records, ids = self.tables.read("records"), self.tables.read("versions").select("version_id")
        if nodes is not None:
            ids = ids.join(nodes.select("version_id"), "version_id", "left_semi")
            few = [r.version_id for r in ids.limit(NAMED_FOLDERS + 1).collect()]
            records = records.where(F.col("version_id").isin(*few)) if len(few) <= NAMED_FOLDERS else records.join(ids, "version_id", "left_semi")
        found = content_hash(records.select("version_id", row_hash(F.col("record")).alias("h")), ["version_id"], "h")
        return ids.join(found, "version_id", "left").select("version_id", F.coalesce("record_count", F.lit(0)).alias("record_count"), F.coalesce("content_hash", F.sha2(F.lit(""), 256)).alias("content_hash"))

    def get_version(self, version_id: str, include_records: bool = False) -> dict[str, Any]:
        out = self.get("versions", version_id=version_id).asDict()
        out["quality"] = (lambda r: r.asDict() if r else None)(quality_ops.latest(self.tables.read("evaluations").where(F.col("version_id") == version_id), ["version_id"], ["sequence"]).first())
        if include_records:
            out["records"] = self.records(version_id)
        return out

    def records(self, version_id: str) -> DataFrame:
        self.get("versions", version_id=version_id)
        return self.tables.read("records").where(F.col("version_id") == version_id).select("version_id", "row_index", "record")

    def profile(self, version_ids: Sequence[str], unique: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
        """Table and field profiles (version_id key) of stored versions, computed once; distinct values of the fields in ``unique`` only."""
        ids = self.spark.createDataFrame([(v,) for v in version_ids], "version_id string")
        rows = self.tables.read("records").where(F.col("version_id").isin(*version_ids)).select("version_id", "row_index", "record")
        folded = rows.groupBy("version_id", row_hash(F.col("record")).alias("h")).agg(F.count("*").alias("n")).groupBy("version_id").agg(F.sum("n").alias("rows"), F.count("*").alias("unique_rows"))
        tables = ids.join(folded, "version_id", "left").fillna(0, ["rows", "unique_rows"])
        tables = tables.withColumn("duplicate_rows", F.col("rows") - F.col("unique_rows")).withColumn("duplicate_rate", F.try_divide(F.col("duplicate_rows").cast("double"), F.col("rows")))
        return settle(tables), settle(cell_profile(rows, cells(rows, ["version_id"]), ["version_id"], unique))

    # Quality

    def _evaluate(self, version_id: str, dataset: Row, valid: bool, actor: str, recheck: bool = False) -> Row:
        tables, fields = self.profile([version_id])
        spec = json.loads(dataset.schema_json) if dataset.schema_json else None
        declared = (spec or {}).get("fields") or {}
        found = quality_ops.violations(self.records(version_id), ["version_id"], declared, spec["allow_extra"]) if declared else None
        proof = self.spark.createDataFrame([(version_id, valid)], "version_id string, valid boolean")
        keys = ["version_id"]
        v = quality_ops.quality_verdict(quality_ops.missing_check(tables, fields, keys, declared or None), quality_ops.duplicate_check(tables, keys), quality_ops.schema_check(tables, found, keys), proof, keys).first()
        n = (self.tables.read("evaluations").agg(F.max("sequence")).first()[0] or 0) + 1
        key = f"ev-{hash_json([version_id, n])[:24]}"
        self.tables.append("evaluations", [(key, version_id, n, v.missing, v.duplicates, v.schema, v.provenance, v.verdict, _now())])
        self._audit("QUALITY_EVALUATED", "dataset_version", version_id, actor, {"verdict": v.verdict, "recheck": recheck})
        return self.get("evaluations", evaluation_id=key)

    def run_quality_checks(self, version_id: str, actor: str = "system") -> Row:
        """Verify the version's chain, evaluate again and append the evaluation."""
        version = self.get("versions", version_id=version_id)
        return self._evaluate(version_id, self.get("datasets", dataset_id=version.dataset_id), self.verify_provenance(version_id).valid, actor, recheck=True)

    def get_latest_quality(self, version_id: str) -> Row:
        row = quality_ops.latest(self.tables.read("evaluations").where(F.col("version_id") == version_id), ["version_id"], ["sequence"]).first()
        if row is None:
            raise NotFoundError(f"no evaluation of {version_id}")
        return row

    def schema_violations(self, version_id: str) -> DataFrame:
        """The first violations of the declared schema, in order."""
        version = self.get("versions", version_id=version_id)
        spec = json.loads(self.get("datasets", dataset_id=version.dataset_id).schema_json or "{}")
        return quality_ops.shown(quality_ops.violations(self.records(version_id), ["version_id"], spec.get("fields") or {}, spec.get("allow_extra", True)), ["version_id"])

    def verify_provenance(self, version_id: str) -> Row:
        """version_id, valid, checked_versions, issues of the version and all before it in its dataset."""
        version = self.get("versions", version_id=version_id)
        mine = self.tables.read("versions").where(F.col("dataset_id") == version.dataset_id)
        contents = self.contents(chain_upto(mine, version_id).select("version_id"))
        return verify_version(mine, self.tables.read("datasets"), self.tables.read("sources"), contents, version_id).first()

    # Drift and contracts

    def _logged(self, report: Row, action: str, kind: str, actor: str) -> Row:
        """A stored report, with the audit event of its creation written if it isn't there."""
        said = "verdict" if "verdict" in report else "qualification"
        self._log_once(action, kind, report.report_id, actor, {said: report[said]})
        return report

    def create_drift_report(self, baseline: str, candidate: str, actor: str = "system") -> Row:
        b, c = self.get("versions", version_id=baseline), self.get("versions", version_id=candidate)
        if b.dataset_id != c.dataset_id or b.version_number >= c.version_number:
            raise ValidationError("the baseline must be an earlier version of the same dataset")
        key = {"baseline": baseline, "candidate": candidate, "rules_version": drift_ops.RULES_VERSION}
        if found := self.tables.one("drift_reports", **key):
            return self._logged(found, "DRIFT_REPORT_CREATED", "drift_report", actor)
        tables, fields = self.profile([baseline, candidate])
        row = drift_ops.drift_report(self.spark.createDataFrame([(baseline, candidate)], "baseline string, candidate string"), tables, fields).first().asDict()
        metrics = canonical_json({k: v for k, v in row.items() if k not in ("triggers", "insufficient_reasons", "verdict")})
        digest = hash_json([b.dataset_id, baseline, candidate, b.content_hash, c.content_hash, row["verdict"], metrics, drift_ops.RULES_VERSION])
        self.tables.append("drift_reports", [(f"dr-{digest[:24]}", b.dataset_id, baseline, candidate, row["verdict"], row["triggers"], row["insufficient_reasons"], metrics, digest, drift_ops.RULES_VERSION, _now())])
        return self._logged(self.tables.one("drift_reports", **key), "DRIFT_REPORT_CREATED", "drift_report", actor)

    def create_data_contract(self, dataset_id: str, name: str, definition: Mapping[str, Any], actor: str = "system", description: str | None = None) -> Row:
        self.get("datasets", dataset_id=dataset_id)
        name, description = contract_ops.contract_title(name, description)
        d = contract_ops.normalise_contract(definition)
        last = self.tables.read("contracts").where(F.col("dataset_id") == dataset_id).orderBy(F.desc("version_number")).first()
        number, before = (last.version_number + 1, last.contract_hash) if last else (1, None)
        digest = hash_json({"format": "ledgerframe.contract/1.0", "dataset_id": dataset_id, "version_number": number, "previous_contract_hash": before, "name": name, "description": description, "definition": d})
        key = f"ct-{digest[:24]}"
        self.tables.append("contracts", [(key, dataset_id, name, number, before, digest, canonical_json(d), _now())])
        self._audit("DATA_CONTRACT_CREATED", "data_contract", key, actor)
        return self.get("contracts", contract_id=key)

    def _contract_frames(self, *rows: Row) -> tuple[DataFrame, DataFrame]:
        return contract_ops.contract_frames(self.spark, [(r.contract_id, r.dataset_id, json.loads(r.definition)) for r in {r.contract_id: r for r in rows}.values()])

    def create_contract_report(self, contract_id: str, version_id: str, actor: str = "system") -> Row:
        contract, version = self.get("contracts", contract_id=contract_id), self.get("versions", version_id=version_id)
        if contract.dataset_id != version.dataset_id:
            raise ValidationError("contract and version belong to different datasets")
        key = {"contract_id": contract_id, "version_id": version_id, "rules_version": contract_ops.RULES_VERSION}
        if found := self.tables.one("contract_reports", **key):
            return self._logged(found, "CONTRACT_REPORT_CREATED", "contract_report", actor)
        heads, rules = self._contract_frames(contract)
        unique = [f for f, r in json.loads(contract.definition)["fields"].items() if r["unique"]]
        tables, fields = self.profile([version_id], unique)
        checks = self.spark.createDataFrame([(contract_id, version_id)], "contract_id string, version_id string")
        found = contract_ops.contract_violations(checks, heads, rules, tables, fields)
        v = contract_ops.contract_verdict(checks, found, tables).first()
        listed = [(r.code, r.field, r.observed, r.expected) for r in found.orderBy("field", "code").collect()]  # by fields: bounded by the contract and the version's fields
        digest = hash_json([contract_id, contract.contract_hash, version_id, version.content_hash, v.verdict, listed, list(v.insufficient_reasons), contract_ops.RULES_VERSION])
        self.tables.append("contract_reports", [(f"cr-{digest[:24]}", contract_id, version_id, v.verdict, listed, list(v.insufficient_reasons), digest, contract_ops.RULES_VERSION, _now())])
        return self._logged(self.tables.one("contract_reports", **key), "CONTRACT_REPORT_CREATED", "contract_report", actor)

    def create_contract_compatibility_report(self, baseline: str, candidate: str, actor: str = "system") -> Row:
        b, c = self.get("contracts", contract_id=baseline), self.get("contracts", contract_id=candidate)
        evidence = hash_json([b.contract_hash, c.contract_hash])
        key = {"baseline": baseline, "candidate": candidate, "evidence_hash": evidence, "rules_version": contract_ops.COMPATIBILITY_RULES_VERSION}
        if found := self.tables.one("compatibility_reports", **key):
            return self._logged(found, "CONTRACT_COMPATIBILITY_REPORT_CREATED", "contract_compatibility_report", actor)
        heads, rules = self._contract_frames(b, c)
        pair = self.spark.createDataFrame([(baseline, candidate)], "baseline string, candidate string")
        v = contract_ops.compatibility(pair, heads, rules).first()
        reasons = []
        if v.backward is not None:
            ways = self.spark.createDataFrame([(baseline, candidate), (candidate, baseline)], "source string, target string").distinct()
            reasons = sorted((tuple(r) for r in contract_ops.compatibility_reasons(ways, heads, rules).collect()), key=str)
        changes = sorted(((r.scope, r.constraint, r.field, r.direction) for r in contract_ops.compatibility_changes(pair, heads, rules).collect()), key=str)
        digest = hash_json([evidence, v.qualification, v.backward, v.forward, reasons, changes, list(v.insufficient_reasons)])
        self.tables.append("compatibility_reports", [(f"cc-{digest[:24]}", baseline, candidate, v.qualification, v.backward, v.forward, reasons, changes, list(v.insufficient_reasons), evidence, digest, contract_ops.COMPATIBILITY_RULES_VERSION, _now())])
        return self._logged(self.tables.one("compatibility_reports", **key), "CONTRACT_COMPATIBILITY_REPORT_CREATED", "contract_compatibility_report", actor)

    # Lineage

    def create_lineage_link(self, upstream: str, downstream: str, relation: str, actor: str = "system") -> Row:
        if upstream == downstream:
            raise ValidationError("a version can't be its own upstream")
        if relation not in lineage_ops.RELATIONS:
            raise ValidationError(f"relation must be one of {', '.join(lineage_ops.RELATIONS)}")
        u, d = self.get("versions", version_id=upstream), self.get("versions", version_id=downstream)
        key = {"upstream_version_id": upstream, "downstream_version_id": downstream, "relation_type": relation}
        if found := self.tables.one("links", **key):
            self._log_once("LINEAGE_LINK_CREATED", "lineage_link", found.id, actor)
            return found
        digest = self.spark.range(1).select(link_hash(*map(F.lit, (upstream, u.content_hash, downstream, d.content_hash, relation)))).first()[0]
        self.tables.append("links", [(f"ln-{digest[:24]}", upstream, downstream, relation, digest, _now())])
        self._audit("LINEAGE_LINK_CREATED", "lineage_link", f"ln-{digest[:24]}", actor)
        return self.tables.one("links", **key)

    def list_lineage_links(self, upstream: str | None = None, downstream: str | None = None, limit: int = PAGE_DEFAULT, offset: int = 0) -> DataFrame:
        return self.list("links", limit, offset, upstream_version_id=upstream, downstream_version_id=downstream)

    def _graph(self) -> tuple[Any, ...]:
        """versions, datasets, sources, a function that hashes the contents of given versions, links."""
        return tuple(self.tables.read(n) for n in ("versions", "datasets", "sources")) + (self.contents, self.tables.read("links"))

    def _store(self, kind: str, action: str, request: Mapping[str, Any], report: lineage_ops.Report, snapshot: str | None, actor: str) -> Row:
        """Append a report of the lineage analyses with its parts, unless (kind, request, snapshot, rules) is there."""
        s = report.summary.first().asDict(recursive=True)
        snapshot = snapshot or s["snapshot_hash"]
        key = {"kind": kind, "request": canonical_json(request), "snapshot_hash": snapshot, "rules_version": lineage_ops.RULES_VERSION}
        if found := self.tables.one("graph_reports", **key):
            return self._logged(found, action, kind, actor)
        text = canonical_json(s)
        digest = hash_json([key, text])
        report_id = f"{kind[:2]}-{digest[:24]}"
        self.tables.clear("report_parts", report_id)
        for name, part in report.parts.items():
            self.tables.append("report_parts", part.select(F.lit(report_id).alias("report_id"), F.lit(name).alias("part"), F.to_json(F.struct("*")).alias("item")))
        self.tables.append("graph_reports", [(report_id, kind, key["request"], snapshot, s["qualification"], text, digest, lineage_ops.RULES_VERSION, _now())])
        return self._logged(self.tables.one("graph_reports", **key), action, kind, actor)

    def report_part(self, report_id: str, part: str) -> DataFrame:
        """The JSON items of one part of a stored lineage report."""
        self.get("graph_reports", report_id=report_id)
        return self.tables.read("report_parts").where((F.col("report_id") == report_id) & (F.col("part") == part)).select("item")

    def _existing(self, ids: Sequence[str], table: str, column: str) -> None:
        have = {r[0] for r in self.tables.read(table).where(F.col(column).isin(*ids)).select(column).collect()} if ids else set()
        if lost := sorted(set(ids) - have):
            raise NotFoundError(f"no such {column}: {', '.join(lost)}")

    def create_impact_report(self, version_id: str, max_depth: int = 3, actor: str = "system") -> Row:
        if not isinstance(max_depth, int) or isinstance(max_depth, bool) or not DEPTHS[0] <= max_depth <= DEPTHS[1]:
            raise ValidationError("max_depth must lie between 1 and 10")
        self.get("versions", version_id=version_id)
        versions, links = self.tables.read("versions"), self.tables.read("links")
        compliance = lineage_ops.compliance_of(versions, self.tables.read("contract_reports"), self.tables.read("contracts"))
        report = lineage_ops.impact_report(versions, links, version_id, max_depth, compliance)
        seen = report.parts["affected"].select("version_id", "compliance").orderBy("version_id")
        evidence = lineage_ops._digest(links.select(F.col("link_hash").alias("x")).union(seen.select(F.concat_ws(":", "version_id", "compliance")))).first()[0]
        return self._store("impact_report", "IMPACT_REPORT_CREATED", {"version_id": version_id, "max_depth": max_depth}, report, evidence, actor)

    def create_provenance_closure_report(self, version_ids: Sequence[str], actor: str = "system") -> Row:
        ids = _ids(version_ids, *CLOSURE_IDS, "version_ids")
        self._existing(ids, "versions", "version_id")
        return self._store("provenance_closure_report", "PROVENANCE_CLOSURE_REPORT_CREATED", {"version_ids": ids}, lineage_ops.provenance_closure(*self._graph(), ids), None, actor)

    def create_provenance_impact_dossier(self, version_ids: Sequence[str] = (), dataset_ids: Sequence[str] = (), actor: str = "system") -> Row:
        if not DOSSIER_IDS[0] <= len(version_ids) + len(dataset_ids) <= DOSSIER_IDS[1]:
            raise ValidationError("select 1 to 50 versions and datasets")
        v, d = _ids(version_ids, 0, DOSSIER_IDS[1], "version_ids"), _ids(dataset_ids, 0, DOSSIER_IDS[1], "dataset_ids")
        self._existing(v, "versions", "version_id")
        self._existing(d, "datasets", "dataset_id")
        return self._store("provenance_impact_dossier", "PROVENANCE_IMPACT_DOSSIER_CREATED", {"version_ids": v, "dataset_ids": d}, lineage_ops.impact_dossier(*self._graph(), v, d), None, actor)

    def create_lineage_evolution_dossier(self, version_ids: Sequence[str], actor: str = "system") -> Row:
        ids = _ids(version_ids, *EVOLUTION_IDS, "version_ids")
        self._existing(ids, "versions", "version_id")
        return self._store("lineage_evolution_dossier", "LINEAGE_EVOLUTION_DOSSIER_CREATED", {"version_ids": ids}, lineage_ops.lineage_evolution(*self._graph(), ids), None, actor)

    def info(self) -> dict[str, Any]:
        """What this registry is and by which rules it judges."""
        return {"format": FORMAT, "quality": quality_ops.RULES_VERSION, "drift": drift_ops.RULES_VERSION, "contract": contract_ops.RULES_VERSION, "compatibility": contract_ops.COMPATIBILITY_RULES_VERSION, "lineage": LINK_RULES}

    def health(self) -> dict[str, str]:
        self.tables.read("audit").limit(1).collect()
        return {"status": "ok"}
