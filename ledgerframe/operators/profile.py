"""Profiles of dataset versions, computed once and shared by quality, drift and contract checks.

Two lanes. Typed rows: tags are static, an absent value is a null. Schemaless rows: one JSON text a
record, unfolded into cells (version, row, field, tag, value), where absent and null differ.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsontypes import is_object, static_tag, variant_tag

FIELD_COLUMNS = ("field", "rows", "present", "nulls", "non_null", "distinct_values", "types")


def table_profile(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """keys, rows, unique_rows, duplicate_rows, duplicate_rate over whole rows.

    Rows are compared as structs, nulls equal. Equal rows are folded map-side before they are shuffled.
    """
    columns = list(columns or [c for c in df.columns if c not in keys])
    folded = df.groupBy(*keys, *columns).agg(F.count("*").alias("_n"))
    out = folded.groupBy(*keys).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count("*").alias("unique_rows"))
    return _duplicates(out)


def _duplicates(counted: DataFrame) -> DataFrame:
    return counted.withColumn("duplicate_rows", F.col("rows") - F.col("unique_rows")).withColumn("duplicate_rate", F.try_divide(F.col("duplicate_rows").cast("double"), F.col("rows")))


def field_profile(df: DataFrame, keys: Sequence[str], fields: Sequence[str], unique: Sequence[str] = ()) -> DataFrame:
    """One row per (keys, field): rows, present, nulls, non_null, distinct_values, types.

    All counts come from one pass. ``distinct_values`` is null but for the fields in ``unique``, which cost a distinct
    aggregation each. An absent value is a null here, so present counts every row.
    """
    tags = {f.name: static_tag(f.dataType) for f in df.schema}
    parts = [F.count("*").alias("_rows"), *(F.count(f"`{f}`").alias(f"_n_{i}") for i, f in enumerate(fields))]
    wide = df.groupBy(*keys).agg(*parts)
    items = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"_n_{i}").alias("non_null"), F.lit(tags[f]).cast("string").alias("tag")) for i, f in enumerate(fields)))
    long = wide.select(*keys, F.col("_rows").alias("rows"), F.explode(items).alias("x"))
    types = F.when((F.col("x.non_null") > 0) & F.col("x.tag").isNotNull(), F.array("x.tag")).otherwise(F.array().cast("array<string>"))
    out = long.select(*keys, F.col("x.field").alias("field"), "rows", F.col("rows").alias("present"), (F.col("rows") - F.col("x.non_null")).alias("nulls"), F.col("x.non_null").alias("non_null"), types.alias("types"))
    distinct = None
    for f in unique:
        one = df.where(F.col(f"`{f}`").isNotNull()).select(*keys, f).distinct().groupBy(*keys).agg(F.count("*").alias("distinct_values")).withColumn("field", F.lit(f))
        distinct = one if distinct is None else distinct.unionByName(one)
    if distinct is None:
        return out.withColumn("distinct_values", F.lit(None).cast("long")).select(*keys, *FIELD_COLUMNS)
    got = out.join(distinct, [*keys, "field"], "left")
    fill = F.when(F.col("field").isin(*unique), F.coalesce("distinct_values", F.lit(0)))
    return got.withColumn("distinct_values", fill).select(*keys, *FIELD_COLUMNS)


def cells(records: DataFrame, keys: Sequence[str], json_col: str = "record", row_col: str = "row_index") -> DataFrame:
    """Unfold JSON objects: keys, row_index, field, tag (null for JSON null), value (its JSON text).

    Records that are not objects give no cells; ``bad_records`` finds them.
    """
    parsed = records.select(*keys, F.col(row_col).alias("row_index"), F.try_parse_json(F.col(json_col)).alias("_v")).where(F.schema_of_variant("_v").startswith("OBJECT"))
    spark = records.sparkSession
    unfolded = parsed.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))
    return unfolded.select(*keys, "row_index", F.col("key").alias("field"), variant_tag(F.col("value")).alias("tag"), F.to_json("value").alias("value"))


def bad_records(records: DataFrame, json_col: str = "record") -> DataFrame:
    """Records that are not JSON objects, or hold duplicate keys or no valid JSON."""
    return records.where(~is_object(F.col(json_col)))


def cell_profile(records: DataFrame, found: DataFrame, keys: Sequence[str], unique: Sequence[str] = ()) -> DataFrame:
    """``field_profile`` of the JSON lane: ``present`` counts the records that have the field at all.

    ``distinct_values`` is null but for the fields in ``unique``: only their values are shuffled.
    """
    rows = records.groupBy(*keys).agg(F.count("*").alias("rows"))
    out = found.groupBy(*keys, "field").agg(
        F.count("*").alias("present"), F.count_if(F.col("tag").isNull()).alias("nulls"), F.count("tag").alias("non_null"),
        F.array_sort(F.collect_set("tag")).alias("types"),
    )
    if unique:
        wanted = found.where(F.col("tag").isNotNull() & F.col("field").isin(*unique))
        distinct = wanted.select(*keys, "field", "tag", "value").distinct().groupBy(*keys, "field").agg(F.count("*").alias("distinct_values"))
        out = out.join(distinct, [*keys, "field"], "left").withColumn("distinct_values", F.when(F.col("field").isin(*unique), F.coalesce("distinct_values", F.lit(0))))
    else:
        out = out.withColumn("distinct_values", F.lit(None).cast("long"))
    return out.join(rows, list(keys)).select(*keys, *FIELD_COLUMNS)


def missing_of(profile: DataFrame) -> DataFrame:
    """Adds missing (absent or null) and missing_rate to a field profile."""
    return profile.withColumn("missing", F.col("rows") - F.col("non_null")).withColumn("missing_rate", F.try_divide(F.col("missing").cast("double"), F.col("rows")))
