"""Data contracts: definitions, their checks against versions, and compatibility between contracts.

A definition becomes one row of ``contracts`` (contract_id, dataset_id, allow_extra, min_rows, max_rows,
max_duplicate_rate) and a row of ``contract_fields`` (contract_id, field, types, required, nullable, max_missing_rate, unique) per field.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsontypes import DECLARABLE, OBSERVABLE
from ..functions.rules import verdict
from ..plans.errors import ValidationError

RULES_VERSION, COMPATIBILITY_RULES_VERSION = "1.0.0", "1.0.0"
# Bounds of a definition.
MAX_FIELDS, MAX_ROWS, MAX_NAME, MAX_DESCRIPTION, MAX_TYPES = 200, 10_000_000, 200, 4_000, 6
CONTRACTS = "contract_id string, dataset_id string, allow_extra boolean, min_rows long, max_rows long, max_duplicate_rate double"
FIELDS = "contract_id string, field string, types array<string>, required boolean, nullable boolean, max_missing_rate double, unique boolean"


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ValidationError(message)


def _whole(x: Any) -> bool:
    return isinstance(x, int) and not isinstance(x, bool)


def _rate(x: Any, name: str) -> float:
    _require(isinstance(x, (int, float)) and not isinstance(x, bool) and 0 <= x <= 1, f"{name} must lie between 0 and 1")
    return float(x)


def contract_title(name: Any, description: Any = None) -> tuple[str, str | None]:
    """A contract's checked name, without white space around it, and description."""
    _require(isinstance(name, str) and len(name) <= MAX_NAME and bool(name.strip()), f"name must have 1 to {MAX_NAME} characters")
    _require(description is None or (isinstance(description, str) and len(description) <= MAX_DESCRIPTION), f"description must have at most {MAX_DESCRIPTION} characters")
    return name.strip(), description


def normalise_contract(definition: Mapping[str, Any]) -> dict[str, Any]:
    """A checked definition with sorted fields and types and all defaults filled in. Names of fields lose white space around them and must then differ."""
    _require(isinstance(definition, Mapping), "a contract is an object")
    known = {"fields", "allow_extra", "min_rows", "max_rows", "max_duplicate_rate"}
    _require(not set(definition) - known, f"unknown keys: {sorted(set(definition) - known)}")
    fields = definition.get("fields")
    _require(isinstance(fields, Mapping) and 1 <= len(fields) <= MAX_FIELDS, f"a contract has 1 to {MAX_FIELDS} fields")
    out: dict[str, Any] = {}
    _require(all(isinstance(f, str) and 1 <= len(f.strip()) <= MAX_NAME for f in fields), f"names of fields must have 1 to {MAX_NAME} characters")
    _require(len({f.strip() for f in fields}) == len(fields), "two fields have the same name")
    for name, rule in sorted(((f.strip(), rule) for f, rule in fields.items()), key=lambda x: x[0]):
        _require(isinstance(rule, Mapping) and not set(rule) - {"types", "required", "nullable", "max_missing_rate", "unique"}, f"bad rule of {name}")
        types = rule.get("types")
        _require(isinstance(types, (list, tuple)) and 1 <= len(types) <= MAX_TYPES and all(isinstance(x, str) for x in types), f"types of {name} must be a list of 1 to {MAX_TYPES}")
        types = sorted(set(types))
        _require( set(types) <= set(OBSERVABLE), f"types of {name} must come from {', '.join(OBSERVABLE)}")
        flags = {k: rule.get(k, default) for k, default in (("required", True), ("nullable", False), ("unique", False))}
        _require(all(isinstance(v, bool) for v in flags.values()), f"flags of {name} must be boolean")
        out[name] = {"types": types, **flags, "max_missing_rate": _rate(rule.get("max_missing_rate", 0.0), f"max_missing_rate of {name}")}
    extra, low, high = definition.get("allow_extra", False), definition.get("min_rows", 1), definition.get("max_rows")
    _require(isinstance(extra, bool), "allow_extra must be boolean")
    _require(_whole(low) and 0 <= low <= MAX_ROWS, "min_rows out of bounds")
    _require(high is None or (_whole(high) and 1 <= high <= MAX_ROWS and high >= low), "max_rows out of bounds")
    return {"fields": out, "allow_extra": extra, "min_rows": low, "max_rows": high, "max_duplicate_rate": _rate(definition.get("max_duplicate_rate", 0.0), "max_duplicate_rate")}


def normalise_schema(spec: Mapping[str, Any] | None) -> dict[str, Any] | None:
    """A checked declared schema: fields {name: {type, required}} in order of name, allow_extra."""
    if spec is None:
        return None
    _require(isinstance(spec, Mapping) and not set(spec) - {"fields", "allow_extra"}, "bad schema")
    fields = spec.get("fields") or {}
    _require(isinstance(fields, Mapping) and isinstance(spec.get("allow_extra", False), bool), "bad schema")
    out = {}
    for name in sorted(fields):
        d = fields[name]
        _require(isinstance(d, Mapping) and not set(d) - {"type", "required"} and d.get("type") in DECLARABLE and isinstance(d.get("required", True), bool), f"bad schema of {name}")
        out[name] = {"type": d["type"], "required": d.get("required", True)}
    return {"fields": out, "allow_extra": spec.get("allow_extra", False)}


def contract_frames(spark: SparkSession, definitions: Iterable[tuple[str, str, Mapping[str, Any]]]) -> tuple[DataFrame, DataFrame]:
    """The two tables of (contract_id, dataset_id, definition) triples."""
    heads, rows = [], []
    for contract_id, dataset_id, raw in definitions:
        d = normalise_contract(raw)
        heads.append((contract_id, dataset_id, d["allow_extra"], d["min_rows"], d["max_rows"], d["max_duplicate_rate"]))
        rows += [(contract_id, f, r["types"], r["required"], r["nullable"], r["max_missing_rate"], r["unique"]) for f, r in d["fields"].items()]
    return spark.createDataFrame(heads, CONTRACTS), spark.createDataFrame(rows, FIELDS)


def _item(code: str, cond: Column, field: Column | None = None, observed: Column | None = None, expected: Column | None = None) -> Column:
    text = lambda c: F.lit(None).cast("string") if c is None else c.cast("string")
    return F.when(cond, F.struct(F.lit(code).alias("code"), text(field).alias("field"), text(observed).alias("observed"), text(expected).alias("expected")))


def _listed(df: DataFrame, keys: list[str], *items: Column) -> DataFrame:
    return df.select(*keys, F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("x")).select(*keys, "x.*")


def contract_metrics(checks: DataFrame, contract_fields: DataFrame, tables: DataFrame, fields: DataFrame) -> DataFrame:
    """Per (contract_id, version_id, field) of the contract: what the version shows, beside the rule."""
    grid = checks.join(contract_fields, "contract_id").join(tables.select("version_id", F.col("rows").alias("_rows")), "version_id", "left")
    got = grid.join(fields.drop("rows").withColumnRenamed("types", "observed_types"), ["version_id", "field"], "left")
    zero = F.lit(0).cast("long")
    got = got.withColumns({c: F.coalesce(c, zero) for c in ("present", "nulls", "non_null")} | {"rows": F.coalesce("_rows", zero), "observed_types": F.coalesce("observed_types", F.array().cast("array<string>"))})
    got = got.withColumn("absent", F.col("rows") - F.col("present")).withColumn("missing_rate", F.try_divide((F.col("rows") - F.col("non_null")).cast("double"), F.col("rows")))
    return got.withColumn("duplicate_values", F.when(F.col("unique"), F.col("non_null") - F.coalesce("distinct_values", zero))).drop("_rows")


def contract_violations(checks: DataFrame, contracts: DataFrame, contract_fields: DataFrame, tables: DataFrame, fields: DataFrame) -> DataFrame:
    """contract_id, version_id, code, field, observed, expected for ``checks`` (contract_id, version_id).

    Versions without rows have none. Fields in ``contract_fields`` marked unique need distinct_values in the profile.
    """
    keys = ["contract_id", "version_id"]
    whole = checks.join(contracts, "contract_id").join(tables, "version_id").where("rows > 0")
    out = _listed(
        whole, keys,
        _item("row_count_below_minimum", F.col("rows") < F.col("min_rows"), None, F.col("rows"), F.col("min_rows")),
        _item("row_count_above_maximum", F.col("rows") > F.col("max_rows"), None, F.col("rows"), F.col("max_rows")),
        _item("duplicate_rate_exceeded", F.col("duplicate_rate") > F.col("max_duplicate_rate"), None, F.col("duplicate_rate"), F.col("max_duplicate_rate")),
    )
    strict = checks.join(contracts.where("not allow_extra").select("contract_id"), "contract_id")
    seen = strict.join(fields.where("rows > 0").select("version_id", "field"), "version_id")
    extra = seen.join(contract_fields.select("contract_id", "field"), ["contract_id", "field"], "left_anti")
    out = out.unionByName(_listed(extra, keys, _item("extra_field", F.lit(True), F.col("field"), F.lit("true"), F.lit("false"))))
    m = contract_metrics(checks, contract_fields, tables, fields).where("rows > 0")
    invalid = F.array_except("observed_types", "types")
    return out.unionByName(_listed(
        m, keys,
        _item("required_field_unobserved", F.col("required") & (F.col("present") == 0), F.col("field"), F.lit("false"), F.lit("true")),
        _item("null_not_allowed", (F.col("nulls") > 0) & ~F.col("nullable"), F.col("field"), F.col("nulls"), F.lit("0")),
        _item("missing_rate_exceeded", F.col("missing_rate") > F.col("max_missing_rate"), F.col("field"), F.col("missing_rate"), F.col("max_missing_rate")),
        _item("type_not_allowed", F.size(invalid) > 0, F.col("field"), F.array_join(F.array_sort(invalid), ","), F.array_join("types", ",")),
        _item("uniqueness_violated", F.col("duplicate_values") > 0, F.col("field"), F.col("duplicate_values"), F.lit("0")),
    ))


def contract_verdict(checks: DataFrame, found: DataFrame, tables: DataFrame) -> DataFrame:
    """contract_id, version_id, violation_count, insufficient_reasons, verdict; a version without rows is INSUFFICIENT."""
    counted = found.groupBy("contract_id", "version_id").agg(F.count("*").alias("violation_count"))
    out = checks.join(counted, ["contract_id", "version_id"], "left").join(tables.select("version_id", "rows"), "version_id", "left")
    out = out.withColumn("violation_count", F.coalesce("violation_count", F.lit(0)))
    empty = F.coalesce(F.col("rows"), F.lit(0)) == 0
    reasons = F.when(empty, F.array(F.lit("no_rows_to_evaluate"))).otherwise(F.array().cast("array<string>"))
    return out.select("contract_id", "version_id", "violation_count", reasons.alias("insufficient_reasons"), verdict((empty, "INSUFFICIENT"), (F.col("violation_count") > 0, "VIOLATION"), otherwise="COMPATIBLE").alias("verdict"))


def _absence_allowed(side: str) -> Column:
    return ~F.col(f"{side}.required") & (F.col(f"{side}.max_missing_rate") >= 1.0)


def _limit(side: str) -> Column:
    return F.coalesce(F.col(f"{side}.max_rows").cast("double"), F.lit(float("inf")))


def compatibility_reasons(pairs: DataFrame, contracts: DataFrame, contract_fields: DataFrame) -> DataFrame:
    """Why a contract's accepted data may break another: source, target, code, field.

    ``pairs`` is (source, target), contract ids. One full join of the field lists, then rules per row.
    """
    s, t = contracts.alias("s"), contracts.alias("t")
    heads = pairs.join(s, F.col("source") == F.col("s.contract_id")).join(t, F.col("target") == F.col("t.contract_id"))
    keys = ["source", "target"]
    whole = _listed(
        heads, keys,
        _item("extra_fields_newly_forbidden", F.col("s.allow_extra") & ~F.col("t.allow_extra")),
        _item("minimum_rows_increased", F.col("t.min_rows") > F.col("s.min_rows")),
        _item("maximum_rows_decreased", _limit("t") < _limit("s")),
        _item("maximum_duplicate_rate_decreased", F.col("t.max_duplicate_rate") < F.col("s.max_duplicate_rate")),
    )
    both = _joined_fields(pairs, contract_fields, "source", "target")
    flags = heads.select(*keys, F.col("s.allow_extra").alias("s_extra"), F.col("t.allow_extra").alias("t_extra"))
    both = both.join(flags, keys)
    only_s, only_t, common = F.col("t").isNull(), F.col("s").isNull(), F.col("s").isNotNull() & F.col("t").isNotNull()
    per = _listed(
        both, keys,
        *(
            _item(code, cond, F.col("field"))
            for code, cond in (
                ("source_field_forbidden_by_target", only_s & ~F.col("t_extra")),
                ("target_requires_source_absent_field", only_t & ~_absence_allowed("t")),
                ("source_unconstrained_field_restricted_by_target", only_t & F.col("s_extra")),
                ("allowed_types_narrowed", common & (F.size(F.array_except("s.types", "t.types")) > 0)),
                ("nullability_removed", common & F.col("s.nullable") & ~F.col("t.nullable")),
                ("maximum_missing_rate_decreased", common & (F.col("t.max_missing_rate") < F.col("s.max_missing_rate"))),
                ("field_became_required", common & ~F.col("s.required") & F.col("t.required")),
                ("uniqueness_added", common & ~F.col("s.unique") & F.col("t.unique")),
            )
        ),
    )
    return whole.unionByName(per).select("source", "target", "code", "field")


def _joined_fields(pairs: DataFrame, contract_fields: DataFrame, left: str, right: str) -> DataFrame:
    rule = F.struct("types", "required", "nullable", "max_missing_rate", "unique")
    side = lambda end, name: pairs.join(contract_fields.withColumnRenamed("contract_id", end), end).select(left, right, "field", rule.alias(name))
    return side(left, "s").join(side(right, "t"), [left, right, "field"], "full")


def compatibility_changes(pairs: DataFrame, contracts: DataFrame, contract_fields: DataFrame) -> DataFrame:
    """baseline, candidate, scope, constraint, field, direction (TIGHTENED, RELAXED) of all changed constraints.

    ``pairs`` is (baseline, candidate). A type set that gains and loses members is listed in both directions.
    """
    keys = ["baseline", "candidate"]
    heads = pairs.join(contracts.alias("s"), F.col("baseline") == F.col("s.contract_id")).join(contracts.alias("t"), F.col("candidate") == F.col("t.contract_id"))

    def change(scope: str, constraint: str, cond: Column, tight: Column, field: Column | None = None) -> Column:
        return F.when(cond, F.struct(F.lit(scope).alias("scope"), F.lit(constraint).alias("constraint"), (F.lit(None).cast("string") if field is None else field).alias("field"), F.when(tight, "TIGHTENED").otherwise("RELAXED").alias("direction")))

    whole = _listed(
        heads, keys,
        change("contract", "allow_extra", F.col("s.allow_extra") != F.col("t.allow_extra"), ~F.col("t.allow_extra")),
        change("contract", "min_rows", F.col("s.min_rows") != F.col("t.min_rows"), F.col("t.min_rows") > F.col("s.min_rows")),
        change("contract", "max_rows", _limit("s") != _limit("t"), _limit("t") < _limit("s")),
        change("contract", "max_duplicate_rate", F.col("s.max_duplicate_rate") != F.col("t.max_duplicate_rate"), F.col("t.max_duplicate_rate") < F.col("s.max_duplicate_rate")),
    )
    both, name = _joined_fields(pairs, contract_fields, "baseline", "candidate"), F.col("field")
    common = F.col("s").isNotNull() & F.col("t").isNotNull()
    yes, no = F.lit(True), F.lit(False)
    per = _listed(
        both, keys,
        change("field", "field_presence", F.col("s").isNull() & ~_absence_allowed("t"), yes, name),
        change("field", "field_presence", F.col("t").isNull() & ~_absence_allowed("s"), no, name),
        change("field", "types", common & (F.size(F.array_except("t.types", "s.types")) > 0), no, name),
        change("field", "types", common & (F.size(F.array_except("s.types", "t.types")) > 0), yes, name),
        change("field", "required", common & (F.col("s.required") != F.col("t.required")), F.col("t.required"), name),
        change("field", "nullable", common & (F.col("s.nullable") != F.col("t.nullable")), ~F.col("t.nullable"), name),
        change("field", "max_missing_rate", common & (F.col("s.max_missing_rate") != F.col("t.max_missing_rate")), F.col("t.max_missing_rate") < F.col("s.max_missing_rate"), name),
        change("field", "unique", common & (F.col("s.unique") != F.col("t.unique")), F.col("t.unique"), name),
    )
    return whole.unionByName(per)


def field_set_changes(pairs: DataFrame, contract_fields: DataFrame) -> DataFrame:
    """baseline, candidate, added_fields, removed_fields, new_required_fields (sorted)."""
    both = _joined_fields(pairs, contract_fields, "baseline", "candidate")
    pick = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("field"))))
    return both.groupBy("baseline", "candidate").agg(pick(F.col("s").isNull()).alias("added_fields"), pick(F.col("t").isNull()).alias("removed_fields"), pick(F.col("s").isNull() & ~_absence_allowed("t")).alias("new_required_fields"))


def compatibility(pairs: DataFrame, contracts: DataFrame, contract_fields: DataFrame) -> DataFrame:
    """baseline, candidate, backward, forward, qualification, insufficient_reasons of (baseline, candidate) pairs.

    Backward: what the baseline accepts, the candidate accepts. Contracts of different datasets are INSUFFICIENT, with
    both directions null.
    """
    forth = compatibility_reasons(pairs.select(F.col("baseline").alias("source"), F.col("candidate").alias("target")), contracts, contract_fields)
    back = compatibility_reasons(pairs.select(F.col("candidate").alias("source"), F.col("baseline").alias("target")), contracts, contract_fields)
    b = forth.groupBy(F.col("source").alias("baseline"), F.col("target").alias("candidate")).agg(F.count("*").alias("_b"))
    f = back.groupBy(F.col("target").alias("baseline"), F.col("source").alias("candidate")).agg(F.count("*").alias("_f"))
    ids = lambda end: contracts.select(F.col("contract_id").alias(end), F.col("dataset_id").alias(f"_{end}"))
    out = pairs.join(ids("baseline"), "baseline").join(ids("candidate"), "candidate").join(b, ["baseline", "candidate"], "left").join(f, ["baseline", "candidate"], "left")
    same = F.col("_baseline") == F.col("_candidate")
    out = out.withColumn("backward", F.when(same, F.col("_b").isNull())).withColumn("forward", F.when(same, F.col("_f").isNull()))
    q = verdict((~same, "INSUFFICIENT"), (F.col("backward") & F.col("forward"), "FULLY_COMPATIBLE"), (F.col("backward"), "BACKWARD_COMPATIBLE"), (F.col("forward"), "FORWARD_COMPATIBLE"), otherwise="BREAKING")
    reasons = F.when(same, F.array().cast("array<string>")).otherwise(F.array(F.lit("contracts_belong_to_different_datasets")))
    return out.select("baseline", "candidate", "backward", "forward", q.alias("qualification"), reasons.alias("insufficient_reasons"))
