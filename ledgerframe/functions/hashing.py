"""Content addressing with SHA-256.

Rows are hashed from their canonical JSON (columns in order of name, nulls kept). A version's content hash is a tree over row hashes:
rows are grouped by the first six hex digits of their hash and each group is hashed in order, then the groups' digests by
the first three digits, then those of all. Row order doesn't matter. Of a version's rows a leaf holds one in 16 million, a
node above at most 4,096 digests, so no list grows with the version before it has some 10^11 rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_json(value: Any) -> str:
    """Sorted keys, no spaces, UTF-8, no NaN or infinity; ValueError if the value has no such form."""
    try:
        return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    except (TypeError, ValueError) as e:
        raise ValueError(f"no canonical JSON: {e}") from e


def sha256_text(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def hash_json(value: Any) -> str:
    return sha256_text(canonical_json(value))


def row_json(columns: Sequence[str]) -> Column:
    """Canonical JSON of a typed row."""
    return F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(columns))), {"ignoreNullFields": "false"})


def row_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def content_hash(rows: DataFrame, keys: Sequence[str], hash_col: str) -> DataFrame:
    """keys, record_count, content_hash of each group of row hashes (SHA-256 in hex).

    Rows are shuffled once, by key and first three digits, so that a large version is spread over 4,096 places; both lower levels
    of the tree are made where the rows then lie.
    """
    digest = lambda items: F.sha2(F.array_join(items, ""), 256)
    level = lambda: digest(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_h"))), lambda x: x["_h"])).alias("_h")
    start = F.substring(hash_col, 1, 3).alias("_top")
    spread = rows.select(*keys, start, F.substring(hash_col, 1, 6).alias("_at"), F.col(hash_col).alias("_h")).repartition(*keys, "_top")
    leaf = spread.groupBy(*keys, "_top", "_at").agg(F.count("*").alias("_n"), digest(F.array_sort(F.collect_list("_h"))).alias("_h"))
    node = leaf.groupBy(*keys, "_top").agg(F.sum("_n").alias("_n"), level()).withColumnRenamed("_top", "_at")
    return node.groupBy(*keys).agg(F.sum("_n").alias("record_count"), level()).withColumnRenamed("_h", "content_hash")


def chain_hash(rows: DataFrame, keys: Sequence[str], order: str, payload: Column) -> DataFrame:
    """Hash chains: in each group and in order, the digest of the predecessor's digest and the row's payload.

    One row per (keys, order) with ``previous`` and ``chained``. A chain is sequential, and holds one short payload a version.
    """
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), payload.alias("p"))))
    empty = F.array().cast("array<struct<o:bigint,previous:string,chained:string>>")
    step = lambda acc, x: F.concat(acc, F.array(F.struct(x["o"].cast("bigint").alias("o"), F.when(F.size(acc) > 0, F.element_at(acc, -1)["chained"]).alias("previous"), F.sha2(F.concat(F.when(F.size(acc) > 0, F.element_at(acc, -1)["chained"]).otherwise(F.lit("")), x["p"]), 256).alias("chained"))))
    grouped = rows.groupBy(*keys).agg(items.alias("items"))
    out = grouped.select(*keys, F.explode(F.aggregate("items", empty, step)).alias("x"))
    return out.select(*keys, F.col("x.o").alias(order), F.col("x.previous").alias("previous"), F.col("x.chained").alias("chained"))
