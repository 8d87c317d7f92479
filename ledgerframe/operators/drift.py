"""Drift between two versions of a dataset, from their profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import fired, some, verdict

RULES_VERSION = "1.0.1"
# Thresholds (strictly greater drifts) and digits of the rounded metrics.
ROW_COUNT_RELATIVE, MISSING_RATE_ABSOLUTE, DUPLICATE_RATE_ABSOLUTE, DIGITS = 0.10, 0.05, 0.05, 12


def consecutive_pairs(versions: DataFrame) -> DataFrame:
    """(baseline, candidate) of each dataset's neighbouring versions; ``versions`` is (dataset_id, version_number, version_id)."""
    order = Window.partitionBy("dataset_id").orderBy("version_number")
    return versions.select(F.lag("version_id").over(order).alias("baseline"), F.col("version_id").alias("candidate")).where("baseline is not null")


def field_changes(pairs: DataFrame, tables: DataFrame, fields: DataFrame) -> DataFrame:
    """baseline, candidate, field, status, type_change, types and missing rates of both sides, delta.

    A field that one side lacks is missing in all its rows; a side without rows has no rate.
    """
    side = lambda end: pairs.join(fields.withColumnRenamed("version_id", end), end).select("baseline", "candidate", "field", F.col("types").alias(f"{end}_types"), F.col("non_null").alias(f"{end}_n"))
    both = side("baseline").join(side("candidate"), ["baseline", "candidate", "field"], "full")
    for end in ("baseline", "candidate"):
        both = both.join(tables.select(F.col("version_id").alias(end), F.col("rows").alias(f"{end}_rows")), end, "left")
        rate = F.try_divide((F.col(f"{end}_rows") - F.coalesce(f"{end}_n", F.lit(0))).cast("double"), F.col(f"{end}_rows"))
        both = both.withColumn(f"{end}_rate", F.round(rate, DIGITS))
    status = F.when(F.col("baseline_types").isNull(), "added").when(F.col("candidate_types").isNull(), "removed").otherwise("kept")
    changed = F.coalesce(F.col("baseline_types") != F.col("candidate_types"), F.lit(False))
    return both.select("baseline", "candidate", "field", status.alias("status"), changed.alias("type_change"), "baseline_types", "candidate_types", "baseline_rate", "candidate_rate", F.round(F.col("candidate_rate") - F.col("baseline_rate"), DIGITS).alias("delta"))


def drift_report(pairs: DataFrame, tables: DataFrame, fields: DataFrame) -> DataFrame:
    """One row a pair: counts, changes, triggers, insufficient_reasons, verdict (INSUFFICIENT beats DRIFTED)."""
    per = field_changes(pairs, tables, fields).groupBy("baseline", "candidate").agg(
        F.count_if(F.col("status") != "added").alias("_b"), F.count_if(F.col("status") != "removed").alias("_c"),
        F.array_sort(F.collect_list(F.when(F.col("status") == "added", F.col("field")))).alias("added_fields"),
        F.array_sort(F.collect_list(F.when(F.col("status") == "removed", F.col("field")))).alias("removed_fields"),
        F.array_sort(F.collect_list(F.when(F.col("type_change"), F.col("field")))).alias("type_changes"),
        F.max(F.abs("delta")).alias("max_missing_delta"),
    )
    out = pairs
    for end in ("baseline", "candidate"):
        out = out.join(tables.select(F.col("version_id").alias(end), F.col("rows").alias(f"{end}_rows"), F.round("duplicate_rate", DIGITS).alias(f"{end}_duplicate_rate")), end, "left")
        out = out.withColumn(f"{end}_rows", F.coalesce(f"{end}_rows", F.lit(0)))
    none = F.array().cast("array<string>")
    out = out.join(per, ["baseline", "candidate"], "left").withColumns({c: F.coalesce(c, none) for c in ("added_fields", "removed_fields", "type_changes")})
    out = out.withColumn("row_change", F.col("candidate_rows") - F.col("baseline_rows"))
    out = out.withColumn("relative_row_change", F.round(F.try_divide(F.col("row_change").cast("double"), F.col("baseline_rows")), DIGITS))
    out = out.withColumn("duplicate_rate_change", F.round(F.col("candidate_duplicate_rate") - F.col("baseline_duplicate_rate"), DIGITS))
    triggers = fired(
        ("fields_added", F.size("added_fields") > 0), ("fields_removed", F.size("removed_fields") > 0), ("observed_types_changed", F.size("type_changes") > 0),
        ("row_count_change_exceeds_threshold", F.abs("relative_row_change") > ROW_COUNT_RELATIVE),
        ("missing_rate_change_exceeds_threshold", F.col("max_missing_delta") > MISSING_RATE_ABSOLUTE),
        ("duplicate_rate_change_exceeds_threshold", F.abs("duplicate_rate_change") > DUPLICATE_RATE_ABSOLUTE),
    )
    reasons = fired(
        ("baseline_has_no_rows", F.col("baseline_rows") == 0), ("candidate_has_no_rows", F.col("candidate_rows") == 0),
        ("baseline_has_no_observable_fields", F.coalesce("_b", F.lit(0)) == 0), ("candidate_has_no_observable_fields", F.coalesce("_c", F.lit(0)) == 0),
    )
    out = out.withColumn("triggers", triggers).withColumn("insufficient_reasons", reasons).drop("_b", "_c")
    return out.withColumn("verdict", verdict((some(F.col("insufficient_reasons")), "INSUFFICIENT"), (some(F.col("triggers")), "DRIFTED"), otherwise="STABLE"))
