"""Quality, drift, contract and compatibility verdicts on small record sets."""

import hashlib
import itertools
import random

import pytest

from ledgerframe.functions.hashing import canonical_json, content_hash
from ledgerframe.operators import contracts as C
from ledgerframe.operators import drift as D
from ledgerframe.operators import quality as Q
from ledgerframe.operators.profile import bad_records, cell_profile, cells, table_profile
from ledgerframe.plans.errors import ValidationError
from ledgerframe.sources.records import from_objects, from_rows

KEY = ["version_id"]
SCHEMA = {"sku": {"type": "integer", "required": True}, "city": {"type": "string", "required": True}, "weight": {"type": "number", "required": False}}


def versions(spark, sets):
    rows = [(v, i, canonical_json(r)) for v, rs in sets.items() for i, r in enumerate(rs)]
    records = spark.createDataFrame(rows, "version_id string, row_index long, record string")
    ids = spark.createDataFrame([(v,) for v in sets], "version_id string")
    tables = ids.join(table_profile(records.select("version_id", "record"), KEY), KEY, "left").fillna(0, ["rows", "unique_rows", "duplicate_rows"])
    return records, tables, cell_profile(records, cells(records, KEY), KEY)


def quality(spark, sets, schema, valid=True):
    records, tables, fields = versions(spark, sets)
    found = Q.violations(records, KEY, schema, False) if schema else None
    proof = tables.selectExpr("version_id", f"{str(valid).lower()} AS valid")
    v = Q.quality_verdict(Q.missing_check(tables, fields, KEY, schema), Q.duplicate_check(tables, KEY), Q.schema_check(tables, found, KEY), proof, KEY)
    return {r.version_id: r.asDict() for r in v.collect()}


def test_quality_verdicts(spark):
    oslo = {"sku": 40, "city": "Oslo"}
    sets = {
        "clean": [oslo, {"sku": 41, "city": "Lima", "weight": 0.25}, {"sku": 42, "city": "Bern"}], "null": [oslo, {"sku": 41, "city": None}], "gap": [{"city": "Oslo"}], "twice": [oslo, {"sku": 41, "city": "Lima"}, oslo],
        "types": [{"sku": 4.5, "city": "Oslo"}], "more": [oslo | {"colour": "red"}], "whole": [oslo | {"weight": 3}], "empty": [],
    }
    got = quality(spark, sets, SCHEMA)
    want = {"clean": "VERIFIED", "null": "REJECTED", "gap": "REJECTED", "twice": "REJECTED", "types": "REJECTED", "more": "REJECTED", "whole": "VERIFIED", "empty": "INSUFFICIENT"}
    assert {k: v["verdict"] for k, v in got.items()} == want
    assert got["null"]["missing"] == got["gap"]["missing"] == "FAIL" and got["twice"]["duplicates"] == "FAIL" and got["types"]["schema"] == got["more"]["schema"] == "FAIL"
    bare = quality(spark, {"v": [oslo], "dup": [oslo, oslo]}, None)
    assert bare["v"]["verdict"] == "INSUFFICIENT" and bare["dup"]["verdict"] == "REJECTED"
    assert quality(spark, {"v": [oslo]}, SCHEMA, valid=False)["v"]["verdict"] == "REJECTED"


def test_violations_in_order(spark):
    records, _, _ = versions(spark, {"v": [{"sku": True, "z": 1, "b": 2}, {"sku": 1, "city": ["x"], "weight": "1"}]})
    got = [tuple(r)[1:] for r in Q.violations(records, KEY, SCHEMA, False).orderBy("row", "ord").collect()]
    assert got == [(0, 0, "sku", "type_mismatch", "integer", "boolean"), (0, 1, "city", "required_value_missing", None, None), (0, 2, "b", "extra_field", None, None), (0, 3, "z", "extra_field", None, None), (1, 0, "city", "type_mismatch", "string", "array"), (1, 1, "weight", "type_mismatch", "number", "string")]


def drift(spark, b, c):
    _, tables, fields = versions(spark, {"b": b, "c": c})
    return D.drift_report(spark.createDataFrame([("b", "c")], "baseline string, candidate string"), tables, fields).first()


def test_drift(spark):
    rows = [{"sku": i, "city": "Oslo" if i % 2 else "Lima"} for i in range(24)]
    turned = sorted(rows, key=lambda r: (r["city"], -r["sku"]))
    assert drift(spark, rows, turned).verdict == "STABLE"
    r = drift(spark, rows, [{"sku": i / 2 + 0.25, "weight": 1.5} for i in range(24)])
    assert r.verdict == "DRIFTED" and (r.added_fields, r.removed_fields, r.type_changes) == (["weight"], ["city"], ["sku"])
    assert r.triggers == ["fields_added", "fields_removed", "observed_types_changed", "missing_rate_change_exceeds_threshold"]
    gaps = lambda n: [x | {"city": None} if i < n else x for i, x in enumerate(rows)]
    assert drift(spark, rows, gaps(1)).verdict == "STABLE" and drift(spark, rows, gaps(2)).triggers == ["missing_rate_change_exceeds_threshold"]
    assert drift(spark, rows, rows[:22] + rows[:2]).triggers == ["duplicate_rate_change_exceeds_threshold"]
    assert drift(spark, rows, rows[:22]).verdict == "STABLE" and drift(spark, rows, rows[:21]).triggers == ["row_count_change_exceeds_threshold"]
    r = drift(spark, rows, [])
    assert r.verdict == "INSUFFICIENT" and r.insufficient_reasons == ["candidate_has_no_rows", "candidate_has_no_observable_fields"]
    assert drift(spark, [{}], [{}]).insufficient_reasons == ["baseline_has_no_observable_fields", "candidate_has_no_observable_fields"]


CONTRACT = {"fields": {"sku": {"types": ["integer"], "unique": True}, "city": {"types": ["string", "array"], "max_missing_rate": 0.25}, "zone": {"types": ["string"], "required": False, "nullable": True, "max_missing_rate": 1.0}}, "min_rows": 2, "max_rows": 6, "max_duplicate_rate": 0.2}


def contract(spark, rows, definition=CONTRACT):
    records, tables, _ = versions(spark, {"v": rows})
    heads, rules = C.contract_frames(spark, [("c", "d", definition)])
    checks = spark.createDataFrame([("c", "v")], "contract_id string, version_id string")
    found = C.contract_violations(checks, heads, rules, tables, cell_profile(records, cells(records, KEY), KEY, ("sku",)))
    return C.contract_verdict(checks, found, tables).first(), {(r.code, r.field) for r in found.collect()}


def test_contract(spark):
    rows = [{"sku": 1, "city": "Oslo"}, {"sku": 2, "city": ["Lima", "Bern"]}, {"sku": 3, "city": "Rome", "zone": None}, {"sku": 4}]
    v, found = contract(spark, rows)
    assert v.verdict == "COMPATIBLE" and not found
    v, found = contract(spark, [{"sku": 1.5, "city": None, "note": ""}] * 2 + [{"sku": 9, "city": 7}])
    assert v.verdict == "VIOLATION"
    assert found == {("duplicate_rate_exceeded", None), ("extra_field", "note"), ("null_not_allowed", "city"), ("missing_rate_exceeded", "city"), ("type_not_allowed", "sku"), ("type_not_allowed", "city"), ("uniqueness_violated", "sku")}
    assert contract(spark, [{"city": "Oslo"}])[1] == {("row_count_below_minimum", None), ("required_field_unobserved", "sku"), ("missing_rate_exceeded", "sku")}
    assert contract(spark, [{"sku": i, "city": "x"} for i in range(7)])[1] == {("row_count_above_maximum", None)}
    v, found = contract(spark, [], CONTRACT | {"min_rows": 0})
    assert v.verdict == "INSUFFICIENT" and v.insufficient_reasons == ["no_rows_to_evaluate"] and not found


@pytest.mark.parametrize("bad", [{}, {"fields": {}}, {"fields": {"a": {"types": []}}}, {"fields": {"a": {"types": ["null"]}}}, CONTRACT | {"max_rows": 0}, CONTRACT | {"min_rows": True}, CONTRACT | {"max_duplicate_rate": 2}, CONTRACT | {"other": 1}, {"fields": {"a": {"types": ["string"], "x": 1}}}, {"fields": {"a": {"types": ["string"]}, " a ": {"types": ["string"]}}}, {"fields": {"a" * 201: {"types": ["string"]}}}, {"fields": {"a": {"types": "string"}}}, {"fields": {" ": {"types": ["string"]}}}])
def test_contract_definitions_are_strict(bad):
    with pytest.raises(ValidationError):
        C.normalise_contract(bad)


def test_contract_names(spark):
    assert list(C.normalise_contract({"fields": {" b ": {"types": ["string"]}, "a": {"types": ["string", "integer", "string"]}}})["fields"]) == ["a", "b"]
    assert C.contract_title("  x ", None) == ("x", None)
    for bad in (("", None), (" ", None), ("x" * 201, None), (None, None), ("x", "y" * 4001), ("x", 3)):
        with pytest.raises(ValidationError):
            C.contract_title(*bad)


def test_content_hashes_are_trees_of_any_order(spark):
    rows = [(f"v{i % 3}", hashlib.sha256(str(i // 2).encode()).hexdigest()) for i in range(3000)]
    want = {}
    for v in ("v0", "v1", "v2"):
        mine = sorted(h for k, h in rows if k == v)
        sha = lambda xs: hashlib.sha256("".join(xs).encode()).hexdigest()
        low = {p: sha(g) for p, g in itertools.groupby(mine, key=lambda h: h[:6])}
        mid = {p: sha(low[x] for x in g) for p, g in itertools.groupby(sorted(low), key=lambda h: h[:3])}
        want[v] = (len(mine), sha(mid[x] for x in sorted(mid)))
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        got = content_hash(spark.createDataFrame(rows, "v string, h string").repartition(5), ["v"], "h")
        assert {r.v: (r.record_count, r.content_hash) for r in got.collect()} == want


def test_records_must_be_objects(spark):
    for bad in ([1], [{"a": float("nan")}]):
        with pytest.raises(ValidationError):
            from_objects(spark, bad)
    rows = spark.createDataFrame([(0, "[1]"), (1, "{}"), (2, "x"), (3, '{"a":1,"a":2}')], "row_index long, record string")
    assert {r.row_index for r in bad_records(rows).collect()} == {0, 2, 3}
    typed = from_rows(spark.createDataFrame([(1, 2, None)], "i int, b int, a string"), "i").first()
    assert typed.record == '{"a":null,"b":2}'
