"""JSON type tags of typed columns and of schemaless values.

Six observable tags: string, integer, number, boolean, object, array; null stands apart. Dates, timestamps and binary
count as string, their JSON form.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OBSERVABLE = ("array", "boolean", "integer", "number", "object", "string")
DECLARABLE = (*OBSERVABLE, "null")


def static_tag(kind: T.DataType) -> str | None:
    """The tag of a Spark type; None for the null type."""
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "number"
    if isinstance(kind, T.DecimalType):
        return "number" if kind.scale else "integer"
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)):
        return "string"
    if isinstance(kind, (T.StructType, T.MapType)):
        return "object"
    if isinstance(kind, T.ArrayType):
        return "array"
    if isinstance(kind, T.NullType):
        return None
    raise TypeError(f"{kind.simpleString()} has no JSON form")


def variant_tag(value: Column) -> Column:
    """The tag of a variant value; NULL for JSON null and for an absent value.

    Whole numbers too large for a long are read as decimals without fraction and count as integer.
    """
    kind = F.schema_of_variant(value)
    precision = F.regexp_extract(kind, r"^DECIMAL\((\d+),0\)$", 1)
    return (
        F.when(value.isNull() | (kind == "VOID"), F.lit(None).cast("string"))
        .when(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "integer")
        .when((precision != "") & (F.try_to_number(precision, F.lit("99")) >= 19), "integer")
        .when(kind.isin("DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), "number")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
        .otherwise("string")
    )


def is_object(text: Column) -> Column:
    """Whether a text is a JSON object without duplicate keys."""
    v = F.try_parse_json(text)
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def matches_declared(tag: Column, declared: Column) -> Column:
    """Whether a non-null value's tag satisfies a declared schema type: ``number`` takes integers too."""
    return (tag == declared) | ((declared == "number") & (tag == "integer"))
