"""The registry's tables: append-only Parquet folders under one root.

A single writer is assumed. Rows become visible when their file is committed. Records and parts of reports lie in a folder for each version
or report, which nothing reads before the version's or report's own row is there; so a write that died is repeated by replacing its folder.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMAS = {
    "sources": "source_id string, name string, kind string, descriptor string, source_hash string, created_at string",
    "datasets": "dataset_id string, name string, descriptor string, schema_json string, dataset_hash string, created_at string",
    "versions": "version_id string, dataset_id string, source_id string, version_number long, previous_version_id string, record_count long, content_hash string, manifest string, provenance_hash string, created_at string",
    "records": "version_id string, row_index long, record string, record_hash string, valid boolean",
    "evaluations": "evaluation_id string, version_id string, sequence long, missing string, duplicates string, schema string, provenance string, verdict string, evaluated_at string",
    "contracts": "contract_id string, dataset_id string, name string, version_number long, previous_contract_hash string, contract_hash string, definition string, created_at string",
    "contract_reports": "report_id string, contract_id string, version_id string, verdict string, violations array<struct<code:string,field:string,observed:string,expected:string>>, insufficient_reasons array<string>, report_hash string, rules_version string, created_at string",
    "drift_reports": "report_id string, dataset_id string, baseline string, candidate string, verdict string, triggers array<string>, insufficient_reasons array<string>, metrics string, report_hash string, rules_version string, created_at string",
    "compatibility_reports": "report_id string, baseline string, candidate string, qualification string, backward boolean, forward boolean, reasons array<struct<source:string,target:string,code:string,field:string>>, changes array<struct<scope:string,constraint:string,field:string,direction:string>>, insufficient_reasons array<string>, evidence_hash string, report_hash string, rules_version string, created_at string",
    "links": "id string, upstream_version_id string, downstream_version_id string, relation_type string, link_hash string, created_at string",
    "graph_reports": "report_id string, kind string, request string, snapshot_hash string, qualification string, summary string, report_hash string, rules_version string, created_at string",
    "report_parts": "report_id string, part string, item string",
    "audit": "sequence long, action string, resource_type string, resource_id string, actor string, details string, occurred_at timestamp",
}


#: Tables kept in a folder for each value of a column.
FOLDERS = {"records": "version_id", "report_parts": "report_id"}


@cache
def _schema(name: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[name])


class Tables:
    """Reads and appends the tables under ``root``; one that was never written is empty."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def schema(self, name: str) -> StructType:
        return _schema(name)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def read(self, name: str) -> DataFrame:
        schema = self.schema(name)
        return self.spark.read.schema(schema).parquet(self.path(name)) if self.exists(name) else self.spark.createDataFrame([], schema)

    def append(self, name: str, rows: DataFrame | list[tuple]) -> None:
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, self.schema(name)).coalesce(1)
        writer = df.select(*self.schema(name).names).write.mode("append")
        (writer.partitionBy(FOLDERS[name]) if name in FOLDERS else writer).parquet(self.path(name))

    def clear(self, name: str, key: str) -> None:
        """Delete the folder of a version or report that has no row of its own yet."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}/{FOLDERS[name]}={key}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def one(self, table: str, /, **where: object) -> Row | None:
        """The first row with these values, found by pushed-down filters."""
        df = self.read(table)
        for c, v in where.items():
            df = df.where(F.col(c).eqNullSafe(F.lit(v)))
        return df.first()

    def missing(self, rows: DataFrame, name: str, keys: list[str]) -> DataFrame:
        """The rows whose key isn't in the table yet."""
        return rows.join(self.read(name).select(*keys), keys, "left_anti")
