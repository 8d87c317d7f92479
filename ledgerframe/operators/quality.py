"""Quality checks of dataset versions: missing values, duplicate rows, schema conformance, provenance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsontypes import matches_declared, static_tag, variant_tag
from ..functions.rules import verdict

RULES_VERSION = "1.0.0"
SHOWN_VIOLATIONS = 100


def _status(fail, insufficient):
    return verdict((insufficient, "INSUFFICIENT"), (fail, "FAIL"), otherwise="PASS")


def missing_check(tables: DataFrame, fields: DataFrame, keys: Sequence[str], declared: Mapping[str, Mapping] | None = None) -> DataFrame:
    """keys, basis, missing_values, checked_cells, missing_rate, status.

    With a declared schema only its required fields count, else every field seen. A required field that no record has is missing in all rows.
    """
    spark = tables.sparkSession
    if declared:
        wanted = spark.createDataFrame([(f,) for f, d in sorted(declared.items()) if d.get("required", True)], "field string")
        grid = tables.select(*keys, "rows").crossJoin(F.broadcast(wanted))  # versions x declared fields: metadata on both sides
        per = grid.join(fields.select(*keys, "field", "non_null"), [*keys, "field"], "left").withColumn("missing", F.col("rows") - F.coalesce("non_null", F.lit(0)))
    else:
        per = fields.select(*keys, "field", (F.col("rows") - F.col("non_null")).alias("missing"))
    total = per.groupBy(*keys).agg(F.sum("missing").alias("missing_values"), F.count("*").alias("n_fields"))
    out = tables.select(*keys, "rows").join(total, list(keys), "left").select(
        *keys, F.lit("declared_required_fields" if declared else "inferred_union_fields").alias("basis"),
        F.coalesce("missing_values", F.lit(0)).alias("missing_values"), (F.col("rows") * F.coalesce("n_fields", F.lit(0))).alias("checked_cells"),
    )
    rate = F.try_divide(F.col("missing_values").cast("double"), F.col("checked_cells"))
    return out.withColumn("missing_rate", rate).withColumn("status", _status(F.col("missing_values") > 0, F.col("checked_cells") == 0))


def duplicate_check(tables: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, duplicate_rows, unique_rows, duplicate_rate, status."""
    return tables.select(*keys, "duplicate_rows", "unique_rows", "duplicate_rate", _status(F.col("duplicate_rows") > 0, F.col("rows") == 0).alias("status"))


def violations(records: DataFrame, keys: Sequence[str], declared: Mapping[str, Mapping], allow_extra: bool, json_col: str = "record", row_col: str = "row_index") -> DataFrame:
    """Row-level violations of JSON records: keys, row, ord, field, issue, expected, actual.

    Each record is checked where it lies; only violations leave the row. ``ord`` is the place among the record's
    violations: declared fields in order, then extra fields by name.
    """
    v = F.try_parse_json(F.col(json_col))
    held = records.select(*keys, F.col(row_col).alias("row"), v.alias("_v"), F.json_object_keys(F.col(json_col)).alias("_keys"))
    item = lambda f, issue, expected=None, actual=None: F.struct(F.lit(f).alias("field") if isinstance(f, str) else f.alias("field"), F.lit(issue).alias("issue"), F.lit(expected).cast("string").alias("expected"), (actual if actual is not None else F.lit(None)).cast("string").alias("actual"))
    found = []
    for name, d in declared.items():
        tag = variant_tag(F.try_variant_get(F.col("_v"), _path(name), "variant"))
        mismatch = F.when(tag.isNotNull() & ~matches_declared(tag, F.lit(d["type"])), item(name, "type_mismatch", d["type"], tag))
        found.append(F.when(tag.isNull(), item(name, "required_value_missing")).otherwise(mismatch) if d.get("required", True) else mismatch)
    listed = F.filter(F.array(*found), lambda x: x.isNotNull())
    if not allow_extra:
        extra = F.array_sort(F.array_except(F.coalesce("_keys", F.array().cast("array<string>")), F.array(*map(F.lit, declared))))
        listed = F.concat(listed, F.transform(extra, lambda k: item(k, "extra_field")))
    return held.select(*keys, "row", F.posexplode(listed).alias("ord", "x")).select(*keys, "row", "ord", "x.field", "x.issue", "x.expected", "x.actual")


def _path(name: str) -> str:
    return "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"


def typed_violations(rows: DataFrame, keys: Sequence[str], declared: Mapping[str, Mapping], allow_extra: bool, row_col: str) -> DataFrame:
    """``violations`` of typed rows: a wrong column type shows in every non-null row, an undeclared column in every row."""
    tags = {f.name: static_tag(f.dataType) for f in rows.schema if f.name not in (*keys, row_col)}
    item = lambda f, issue, expected, actual: F.struct(F.lit(f).alias("field"), F.lit(issue).alias("issue"), F.lit(expected).cast("string").alias("expected"), F.lit(actual).cast("string").alias("actual"))
    found = []
    for name, d in declared.items():
        tag = tags.get(name)
        here = F.col(f"`{name}`") if name in tags else F.lit(None)
        if d.get("required", True):
            found.append(F.when(here.isNull(), item(name, "required_value_missing", None, None)))
        if tag is not None and tag != d["type"] and not (d["type"] == "number" and tag == "integer"):
            found.append(F.when(here.isNotNull(), item(name, "type_mismatch", d["type"], tag)))
    if not allow_extra:
        found += [item(name, "extra_field", None, None) for name in sorted(set(tags) - set(declared))]
    listed = F.filter(F.array(*found), lambda x: x.isNotNull())
    return rows.select(*keys, F.col(row_col).alias("row"), F.posexplode(listed).alias("ord", "x")).select(*keys, "row", "ord", "x.field", "x.issue", "x.expected", "x.actual")


def shown(found: DataFrame, keys: Sequence[str], limit: int = SHOWN_VIOLATIONS) -> DataFrame:
    """The first ``limit`` violations of each version in order of row and place (a report's excerpt; counts stay exact)."""
    order = Window.partitionBy(*keys).orderBy("row", "ord")
    return found.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= limit).drop("_rank")


def schema_check(tables: DataFrame, found: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """keys, violation_count, violations_truncated, status; without a declared schema (``found`` None) INSUFFICIENT."""
    if found is None:
        return tables.select(*keys, F.lit(0).cast("long").alias("violation_count"), F.lit(False).alias("violations_truncated"), F.lit("INSUFFICIENT").alias("status"))
    counted = found.groupBy(*keys).agg(F.count("*").alias("n"))
    out = tables.select(*keys, "rows").join(counted, list(keys), "left").withColumn("violation_count", F.coalesce("n", F.lit(0)))
    return out.select(*keys, "violation_count", (F.col("violation_count") > SHOWN_VIOLATIONS).alias("violations_truncated"), _status(F.col("violation_count") > 0, F.col("rows") == 0).alias("status"))


def quality_verdict(missing: DataFrame, duplicates: DataFrame, schema: DataFrame, provenance: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, the four statuses, verdict. A FAIL rejects whatever else is open; INSUFFICIENT comes next.

    ``provenance`` is (keys, valid).
    """
    named = [df.select(*keys, F.col("status").alias(n)) for df, n in ((missing, "missing"), (duplicates, "duplicates"), (schema, "schema"))]
    named.append(provenance.select(*keys, F.when(F.col("valid"), "PASS").otherwise("FAIL").alias("provenance")))
    out = named[0]
    for df in named[1:]:
        out = out.join(df, list(keys))
    statuses = F.array("missing", "duplicates", "schema", "provenance")
    return out.withColumn("verdict", verdict((F.array_contains(statuses, "FAIL"), "REJECTED"), (F.array_contains(statuses, "INSUFFICIENT"), "INSUFFICIENT"), otherwise="VERIFIED"))


def latest(evaluations: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order`` (ties by the later columns), with its other columns."""
    rest = [c for c in evaluations.columns if c not in keys]
    picked = evaluations.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))
