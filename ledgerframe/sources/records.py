"""Record sources: files that Spark reads, typed rows, JSON objects in memory."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import canonical_json, row_json
from ..plans.errors import ValidationError

FORMATS = ("parquet", "json", "csv", "orc", "text", "jdbc")


def read_records(spark: SparkSession, kind: str, path: str | None = None, schema: str | None = None, **options: str) -> DataFrame:
    """Typed rows of a file format or a JDBC table."""
    if kind not in FORMATS:
        raise ValidationError(f"kind must be one of {', '.join(FORMATS)}")
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def from_objects(spark: SparkSession, records: Iterable[Mapping[str, Any]]) -> DataFrame:
    """row_index, record (canonical JSON) of objects in memory; ValidationError for what is no object or holds NaN."""
    rows = []
    for i, r in enumerate(records):
        if not isinstance(r, Mapping):
            raise ValidationError(f"record {i} is not an object")
        try:
            rows.append((i, canonical_json(r)))
        except ValueError as e:
            raise ValidationError(f"record {i}: {e}") from e
    return spark.createDataFrame(rows, "row_index long, record string")


def from_rows(rows: DataFrame, index_col: str | None = None) -> DataFrame:
    """row_index, record of typed rows. Without an index column rows are numbered by partition, in no order that is kept."""
    columns = [c for c in rows.columns if c != index_col]
    bad = [c for c, t in rows.dtypes if t in ("float", "double") and c != index_col]
    index = F.col(index_col).cast("long") if index_col else F.monotonically_increasing_id()
    out = rows
    if bad:
        nan = [F.isnan(c) | (F.abs(c) == float("inf")) for c in bad]
        any_ = nan[0]
        for n in nan[1:]:
            any_ = any_ | n
        text = F.when(any_, F.raise_error(F.lit("NaN or infinity has no JSON form"))).otherwise(row_json(columns))
    else:
        text = row_json(columns)
    return out.select(index.alias("row_index"), text.alias("record"))
