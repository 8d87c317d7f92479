"""The registered queries of the core analyses over the driver's tables, and DuckDB SQL for the same rows.

Versions: ``orders`` split by priority (the dataset) and year (the version). Graph: suppliers as versions with links
k -> 7k+3 and k -> 3k+1 modulo their number; the DAG keeps the links that ascend. For the analyses of registered versions, four
suppliers in a row are the versions of a dataset, with manifests chained as a registry chains them; a tampered copy exchanges one
field of every second version. A small registry of three tables, written once a session and folder, shows the verbs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import hashing as H
from .functions.hashing import chain_hash, content_hash
from .functions.jsontypes import static_tag
from .functions.lineage import settle, shared_folder
from .operators import contracts as C
from .operators import drift as D
from .operators import graph as G
from .operators import lineage as L
from .operators import provenance as P
from .operators import quality as Q
from .operators.profile import cell_profile, cells, field_profile, missing_of, table_profile
from .plans.registry import Registry

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Versions of orders

VY = """vy AS (
  SELECT o.*, 'p' || o_orderpriority || '#' || CAST(ver AS VARCHAR) AS version_id, ver, nullif(o_custkey % 10, 0) AS cust10
  FROM (SELECT *, dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY year(o_orderdate)) AS ver FROM orders) o
)"""


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    """(priority, year, ver, version_id): numbered from the distinct years, which are few, not from the rows."""
    years = _t(spark, sf, "orders").select("o_orderpriority", F.year("o_orderdate").alias("yr")).distinct()
    ver = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("yr"))
    return years.withColumn("ver", ver.cast("long")).withColumn("version_id", F.concat(F.lit("p"), "o_orderpriority", F.lit("#"), F.col("ver").cast("string")))


def _vy(spark: SparkSession, sf: str) -> DataFrame:
    orders = _t(spark, sf, "orders").withColumn("yr", F.year("o_orderdate"))
    return orders.join(_versions(spark, sf), ["o_orderpriority", "yr"]).withColumn("cust10", F.expr("nullif(o_custkey % 10, 0)"))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return D.consecutive_pairs(_versions(spark, sf).select(F.col("o_orderpriority").alias("dataset_id"), F.col("ver").alias("version_number"), "version_id"))


VY_FIELDS = ["cust10", "o_orderstatus", "o_totalprice"]
VY_ROW = ["o_orderstatus", "cust10", "o_orderdate"]


def _profiles(spark: SparkSession, sf: str, unique: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Profiles of all versions, computed once: they are small, and each comparison reads them several times."""
    vy = _vy(spark, sf)
    tables = table_profile(vy.select("version_id", *VY_ROW), ["version_id"])
    return settle(tables), settle(field_profile(vy, ["version_id"], VY_FIELDS, unique))


def _declared_orders():
    return {"custkey": {"type": "integer", "required": True}, "status": {"type": "string", "required": True}}


@query("""SELECT CAST(count(*) - count(nullif(o_custkey % 10, 0)) AS BIGINT) AS missing_values, CAST(2 * count(*) AS BIGINT) AS checked_cells,
 (count(*) - count(nullif(o_custkey % 10, 0))) / CAST(2 * count(*) AS DOUBLE) AS missing_rate FROM orders""")
def missing_declared(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "orders").select(F.lit("orders").alias("v"), F.expr("nullif(o_custkey % 10, 0)").alias("custkey"), F.col("o_orderstatus").alias("status"))
    totals = rows.groupBy("v").agg(F.count("*").alias("rows"))
    return Q.missing_check(totals, field_profile(rows, ["v"], ["custkey", "status"]), ["v"], _declared_orders()).select("missing_values", "checked_cells", "missing_rate")


@query("""WITH c AS (SELECT nullif(c_custkey % 7, 0) AS k, c_name AS n, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS b FROM customer)
SELECT field, CAST(missing AS BIGINT) AS missing, missing / CAST(n_rows AS DOUBLE) AS rate FROM (
 SELECT unnest(['k', 'n', 'b']) AS field, unnest([count(*) - count(k), count(*) - count(n), count(*) - count(b)]) AS missing, count(*) AS n_rows FROM c)""")
def missing_inferred_by_field(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "customer").select(F.lit(1).alias("v"), F.expr("nullif(c_custkey % 7, 0)").alias("k"), F.col("c_name").alias("n"), F.expr("CASE WHEN c_acctbal >= 0 THEN c_acctbal END").alias("b"))
    return missing_of(field_profile(rows, ["v"], ["k", "n", "b"])).select("field", "missing", F.col("missing_rate").alias("rate"))


@query("""WITH d AS (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey, l_linenumber, l_returnflag)
SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS unique_rows, CAST(sum(n) - count(*) AS BIGINT) AS duplicate_rows, (sum(n) - count(*)) / CAST(sum(n) AS DOUBLE) AS duplicate_rate FROM d""")
def duplicate_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "lineitem").select("l_suppkey", "l_linenumber", "l_returnflag")
    return table_profile(rows, [])


EVENTS = """ev AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"id":' || event_id || ',"name":"a"}' WHEN 1 THEN '{"id":"x","name":"b"}' WHEN 2 THEN '{"id":null,"name":null}'
 WHEN 3 THEN '{"id":' || event_id || '.5,"z":[1],"a":true}' ELSE '{"id":' || event_id || ',"name":"c","score":' || event_id || '}' END AS record FROM events)"""
SCHEMA = {"id": {"type": "integer", "required": True}, "name": {"type": "string", "required": True}, "score": {"type": "number", "required": False}}


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as JSON records of mixed types."""
    case = EVENTS.split("SELECT event_id, ")[1].split(" AS record")[0]
    return _t(spark, sf, "events").selectExpr("'e' AS version_id", "event_id AS row_index", f"{case} AS record")


VIOLATIONS = f"""WITH {EVENTS}, found AS (
 SELECT event_id AS row, 'id' AS field, CASE WHEN event_id % 5 = 2 THEN 'required_value_missing' ELSE 'type_mismatch' END AS issue, CASE WHEN event_id % 5 <> 2 THEN 'integer' END AS expected FROM ev WHERE event_id % 5 IN (1, 2, 3)
 UNION ALL SELECT event_id, 'name', 'required_value_missing', NULL FROM ev WHERE event_id % 5 IN (2, 3)
 UNION ALL SELECT event_id, unnest(['a', 'z']), 'extra_field', NULL FROM ev WHERE event_id % 5 = 3)"""


@query(VIOLATIONS + " SELECT row, field, issue, expected FROM found")
def schema_violations(spark: SparkSession, sf: str) -> DataFrame:
    return Q.violations(_events(spark, sf), ["version_id"], SCHEMA, False).select("row", "field", "issue", "expected")


@query(VIOLATIONS + " SELECT issue, count(*) AS n FROM found GROUP BY issue")
def schema_violation_count(spark: SparkSession, sf: str) -> DataFrame:
    return schema_violations(spark, sf).groupBy("issue").agg(F.count("*").alias("n"))


@query(VIOLATIONS + ", o AS (SELECT *, row_number() OVER (ORDER BY row, CASE field WHEN 'id' THEN 0 WHEN 'name' THEN 1 WHEN 'a' THEN 2 ELSE 3 END) AS r FROM found) SELECT row, field, issue FROM o WHERE r <= 100")
def schema_violations_shown(spark: SparkSession, sf: str) -> DataFrame:
    return Q.shown(Q.violations(_events(spark, sf), ["version_id"], SCHEMA, False), ["version_id"]).select("row", "field", "issue")


#: The tables that quality_verdict judges; those with True are declared with the types they have, the others not at all.
JUDGED = {"region": True, "nation": True, "customer": True, "supplier": True, "part": True, "orders": True, "lineitem": True, "events": False}


@query(" UNION ALL ".join(f"""SELECT '{t}' AS version_id, CASE WHEN n > u THEN 'REJECTED' WHEN {'false' if known else 'true'} THEN 'INSUFFICIENT' ELSE 'VERIFIED' END AS verdict, 'PASS' AS provenance,
 CASE WHEN n > u THEN 'FAIL' ELSE 'PASS' END AS duplicates FROM (SELECT (SELECT count(*) FROM {t}) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})) AS u)""" for t, known in JUDGED.items()))
def quality_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """Every table with all its columns, as first version of a dataset whose chain is verified."""
    key, parts = ["version_id"], []
    for name, known in JUDGED.items():
        rows = _t(spark, sf, name).withColumn("version_id", F.lit(name))
        cols = [c for c in rows.columns if c != "version_id"]
        declared = {f.name: {"type": static_tag(f.dataType)} for f in rows.schema if f.name in cols} if known else None
        tables, fields = table_profile(rows, key, cols), field_profile(rows, key, cols)
        bad = Q.typed_violations(rows.withColumn("_row", F.lit(0)), key, declared, False, "_row") if declared else None
        parts.append((Q.missing_check(tables, fields, key, declared), Q.duplicate_check(tables, key), Q.schema_check(tables, bad, key), tables.select("version_id", "rows")))
    missing, duplicates, schema, counts = (_union(*p) for p in zip(*parts))
    chain = _registered(counts.select("version_id", F.col("version_id").alias("dataset_id"), F.lit("tables").alias("source_id"), F.lit(1).cast("long").alias("version_number"), F.lit(None).cast("string").alias("previous_version_id"), F.col("rows").alias("record_count"), F.sha2("version_id", 256).alias("content_hash")))
    proof = P.verify_chain(*chain[:4]).select("version_id", (F.size("issues") == 0).alias("valid"))
    return Q.quality_verdict(missing, duplicates, schema, proof, key).select("version_id", "verdict", "provenance", "duplicates")


def _union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    return Q.latest(_t(spark, sf, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"])


TAGS = """x AS (SELECT e.event_id, k.field, json_type(record, '$.' || k.field) AS t, json_extract(record, '$.' || k.field) AS v FROM ev e, (SELECT unnest(['id', 'name', 'score', 'z', 'a']) AS field) k),
tags AS (SELECT event_id, field, v, t IS NOT NULL AS here, CASE WHEN t IN ('BIGINT', 'UBIGINT') THEN 'integer' WHEN t = 'DOUBLE' THEN 'number' WHEN t = 'VARCHAR' THEN 'string' WHEN t = 'BOOLEAN' THEN 'boolean' WHEN t = 'ARRAY' THEN 'array' WHEN t = 'OBJECT' THEN 'object' END AS tag FROM x)"""


@query(f"WITH {EVENTS}, {TAGS} SELECT field, string_agg(DISTINCT tag, ',' ORDER BY tag) AS types FROM tags WHERE tag IS NOT NULL GROUP BY field")
def observed_types(spark: SparkSession, sf: str) -> DataFrame:
    found = cells(_events(spark, sf), ["version_id"])
    return found.groupBy("field").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("types"))


@query(f"""WITH {EVENTS}, {TAGS} SELECT field, count(*) FILTER (here) AS present, count(*) FILTER (here AND tag IS NULL) AS nulls, count(tag) AS non_null, count(DISTINCT CASE WHEN tag IS NOT NULL THEN tag || ':' || CAST(v AS VARCHAR) END) AS distinct_values FROM tags GROUP BY field""")
def json_field_profile(spark: SparkSession, sf: str) -> DataFrame:
    rows = _events(spark, sf)
    return cell_profile(rows, cells(rows, ["version_id"]), ["version_id"], ("id", "name", "score", "z", "a")).select("field", "present", "nulls", "non_null", "distinct_values")


# Drift

DRIFT = f"""WITH {VY}, n AS (SELECT o_orderpriority AS priority, ver, count(*) AS n, count(*) - count(cust10) AS miss FROM vy GROUP BY ALL),
u AS (SELECT o_orderpriority AS priority, ver, count(*) AS uniq FROM (SELECT DISTINCT o_orderpriority, ver, o_orderstatus, cust10, o_orderdate FROM vy) GROUP BY ALL),
p AS (SELECT n.*, round(miss / CAST(n AS DOUBLE), 12) AS mr, round((n - uniq) / CAST(n AS DOUBLE), 12) AS dr FROM n JOIN u USING (priority, ver)),
l AS (SELECT *, lag(n) OVER w AS n0, lag(mr) OVER w AS mr0, lag(dr) OVER w AS dr0 FROM p WINDOW w AS (PARTITION BY priority ORDER BY ver)),
d AS (SELECT *, round((n - n0) / CAST(n0 AS DOUBLE), 12) AS rel, round(mr - mr0, 12) AS md, round(dr - dr0, 12) AS dd FROM l WHERE n0 IS NOT NULL)"""


def _drift(spark: SparkSession, sf: str) -> DataFrame:
    tables, fields = _profiles(spark, sf)
    names = _versions(spark, sf).select(F.col("version_id").alias("candidate"), F.col("o_orderpriority").alias("priority"), "ver")
    return D.drift_report(_pairs(spark, sf), tables, fields).join(names, "candidate")


@query(DRIFT + " SELECT priority, ver, n, round(rel, 9) AS rel_change FROM d")
def drift_row_count(spark: SparkSession, sf: str) -> DataFrame:
    return _drift(spark, sf).select("priority", "ver", F.col("candidate_rows").alias("n"), F.round("relative_row_change", 9).alias("rel_change"))


@query(DRIFT + " SELECT priority, ver, unnest(['cust10', 'o_orderstatus', 'o_totalprice']) AS field, round(unnest([md, 0.0, 0.0]), 9) AS delta FROM d")
def drift_missing(spark: SparkSession, sf: str) -> DataFrame:
    tables, fields = _profiles(spark, sf)
    names = _versions(spark, sf).select(F.col("version_id").alias("candidate"), F.col("o_orderpriority").alias("priority"), "ver")
    return D.field_changes(_pairs(spark, sf), tables, fields).join(names, "candidate").select("priority", "ver", "field", F.round("delta", 9).alias("delta"))


@query(DRIFT + " SELECT priority, ver, round(dd, 9) AS rate_change FROM d")
def drift_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return _drift(spark, sf).select("priority", "ver", F.round("duplicate_rate_change", 9).alias("rate_change"))


@query(f"""WITH {EVENTS}, {TAGS}, side AS (SELECT CASE WHEN event_id % 5 < 3 THEN 'b' ELSE 'c' END AS side, * FROM tags WHERE here), per AS (SELECT side, field, coalesce(string_agg(DISTINCT tag, ',' ORDER BY tag), '') AS types FROM side GROUP BY ALL)
SELECT field, CASE WHEN b.types IS NULL THEN 'added' WHEN c.types IS NULL THEN 'removed' ELSE 'kept' END AS status, coalesce(b.types <> c.types, false) AS type_change FROM (SELECT * FROM per WHERE side = 'b') b FULL JOIN (SELECT * FROM per WHERE side = 'c') c USING (field)""")
def drift_schema_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Events of the first three kinds as baseline, of the other two as candidate."""
    rows = _events(spark, sf).withColumn("version_id", F.when(F.col("row_index") % 5 < 3, "b").otherwise("c"))
    fields = cell_profile(rows, cells(rows, ["version_id"]), ["version_id"])
    tables = table_profile(rows.select("version_id", "record"), ["version_id"])
    return D.field_changes(spark.createDataFrame([("b", "c")], "baseline string, candidate string"), tables, fields).select("field", "status", "type_change")


@query(DRIFT + """, t AS (SELECT priority, ver, list_filter([CASE WHEN abs(rel) > 0.1 THEN 'row_count_change_exceeds_threshold' END, CASE WHEN abs(md) > 0.05 THEN 'missing_rate_change_exceeds_threshold' END,
 CASE WHEN abs(dd) > 0.05 THEN 'duplicate_rate_change_exceeds_threshold' END], lambda x: x IS NOT NULL) AS tr FROM d)
SELECT priority, ver, CASE WHEN len(tr) > 0 THEN 'DRIFTED' ELSE 'STABLE' END AS verdict, coalesce(array_to_string(tr, ','), '') AS triggers FROM t""")
def drift_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return _drift(spark, sf).select("priority", "ver", "verdict", F.array_join("triggers", ",").alias("triggers"))


# Contracts

PART_RULES = {"p_partkey": {"types": ["integer"], "unique": True}, "p_name": {"types": ["string"]}, "p_size": {"types": ["integer"], "nullable": True, "max_missing_rate": 0.5}, "p_ghost": {"types": ["string"], "required": True}}


def _part(spark: SparkSession, sf: str):
    rows = _t(spark, sf, "part").select(F.lit("part").alias("version_id"), "p_partkey", "p_name", F.expr("nullif(p_size % 4, 0)").alias("p_size"), "p_brand")
    cols = ["p_partkey", "p_name", "p_size", "p_brand"]
    heads, rules = C.contract_frames(spark, [("ct", "part", {"fields": PART_RULES, "min_rows": 1, "max_rows": 100})])
    checks = spark.createDataFrame([("ct", "part")], "contract_id string, version_id string")
    return checks, heads, rules, table_profile(rows, ["version_id"]), field_profile(rows, ["version_id"], cols, ("p_partkey",))


@query("""WITH p AS (SELECT p_partkey, p_name, nullif(p_size % 4, 0) AS s FROM part)
SELECT unnest(['p_partkey', 'p_name', 'p_size', 'p_ghost']) AS field, unnest([count(*), count(*), count(*), 0]) AS present, unnest([0, 0, count(*) - count(s), 0]) AS nulls, unnest([count(*), count(*), count(s), 0]) AS non_null FROM p""")
def contract_field_metrics(spark: SparkSession, sf: str) -> DataFrame:
    checks, _, rules, tables, fields = _part(spark, sf)
    return C.contract_metrics(checks, rules, tables, fields).select("field", "present", "nulls", "non_null")


@query("""SELECT unnest(['o_orderkey', 'o_custkey']) AS field, unnest([count(o_orderkey) - count(DISTINCT o_orderkey), count(o_custkey) - count(DISTINCT o_custkey)]) AS duplicate_values FROM orders""")
def contract_uniqueness(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "orders").select(F.lit("o").alias("version_id"), "o_orderkey", "o_custkey")
    _, rules = C.contract_frames(spark, [("ct", "o", {"fields": {f: {"types": ["integer"], "unique": True} for f in ("o_orderkey", "o_custkey")}})])
    checks = spark.createDataFrame([("ct", "o")], "contract_id string, version_id string")
    totals = rows.groupBy("version_id").agg(F.count("*").alias("rows"))
    return C.contract_metrics(checks, rules, totals, field_profile(rows, ["version_id"], ["o_orderkey", "o_custkey"], ("o_orderkey", "o_custkey"))).select("field", "duplicate_values")


#: Two contracts that the parts break in all ways that one version can.
STRICT = {
    "few": {"fields": {"p_type": {"types": ["string"], "unique": True}, "p_size": {"types": ["integer"], "max_missing_rate": 0.1}, "p_retailprice": {"types": ["integer", "string"]}, "p_ghost": {"types": ["string"], "max_missing_rate": 1.0}}, "min_rows": 1, "max_rows": 100, "max_duplicate_rate": 0.0},
    "many": {"fields": {"p_type": {"types": ["string"]}, "p_size": {"types": ["integer"], "nullable": True, "max_missing_rate": 1.0}, "p_retailprice": {"types": ["number"]}}, "allow_extra": True, "min_rows": 10_000_000, "max_duplicate_rate": 1.0},
}


@query("""WITH p AS (SELECT p_type, nullif(p_size % 4, 0) AS p_size, p_retailprice > 0 AS p_retailprice, p_size % 5 AS p_grade FROM part), n AS (SELECT count(*) AS n, count(DISTINCT p_type) AS types, count(*) - count(p_size) AS nulls, (SELECT count(*) FROM (SELECT DISTINCT * FROM p)) AS u FROM p)
SELECT 'few' AS contract, 'row_count_above_maximum' AS code, NULL AS field FROM n WHERE n > 100 UNION ALL SELECT 'few', 'duplicate_rate_exceeded', NULL FROM n WHERE n > u UNION ALL SELECT 'few', 'extra_field', 'p_grade' FROM n WHERE n > 0
UNION ALL SELECT 'few', 'uniqueness_violated', 'p_type' FROM n WHERE n > types UNION ALL SELECT 'few', 'null_not_allowed', 'p_size' FROM n WHERE nulls > 0 UNION ALL SELECT 'few', 'missing_rate_exceeded', 'p_size' FROM n WHERE nulls > 0.1 * n
UNION ALL SELECT 'few', 'type_not_allowed', 'p_retailprice' FROM n WHERE n > 0 UNION ALL SELECT 'few', 'required_field_unobserved', 'p_ghost' FROM n UNION ALL SELECT 'many', 'row_count_below_minimum', NULL FROM n WHERE n < 10000000 UNION ALL SELECT 'many', 'type_not_allowed', 'p_retailprice' FROM n WHERE n > 0""")
def contract_violations(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "part").selectExpr("'part' AS version_id", "p_type", "nullif(p_size % 4, 0) AS p_size", "p_retailprice > 0 AS p_retailprice", "p_size % 5 AS p_grade")
    heads, rules = C.contract_frames(spark, [(k, "part", d) for k, d in STRICT.items()])
    checks = spark.createDataFrame([(k, "part") for k in STRICT], "contract_id string, version_id string")
    cols = ["p_type", "p_size", "p_retailprice", "p_grade"]
    return C.contract_violations(checks, heads, rules, table_profile(rows, ["version_id"]), field_profile(rows, ["version_id"], cols, ("p_type",))).select(F.col("contract_id").alias("contract"), "code", "field")


@query(f"""WITH {VY}, c AS (SELECT version_id, count(*) AS n, (count(*) - count(cust10)) / CAST(count(*) AS DOUBLE) AS mr FROM vy GROUP BY version_id)
SELECT version_id, CASE WHEN mr > 0.1 OR n < 250 THEN 'VIOLATION' ELSE 'COMPATIBLE' END AS verdict FROM c""")
def contract_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """One contract against every version of orders: at least 250 rows, at most a tenth of cust10 missing."""
    tables, fields = _profiles(spark, sf)
    rules = {"cust10": {"types": ["integer"], "nullable": True, "max_missing_rate": 0.1}, "o_orderstatus": {"types": ["string"]}, "o_totalprice": {"types": ["number"]}}
    heads, rows = C.contract_frames(spark, [("ct", "orders", {"fields": rules, "min_rows": 250, "max_duplicate_rate": 1.0})])
    checks = tables.select(F.lit("ct").alias("contract_id"), "version_id")
    return C.contract_verdict(checks, C.contract_violations(checks, heads, rows, tables, fields), tables).select("version_id", "verdict")


#: Contracts made from nations: one a nation, its region the dataset; four fields present and ruled by the bits of its key.
NATION_CONTRACTS = """h AS (SELECT n_nationkey AS c, n_regionkey AS ds, n_nationkey % 2 = 0 AS extra, n_nationkey % 7 AS lo, CASE WHEN n_nationkey % 3 = 0 THEN 1e18 ELSE 50 + n_nationkey % 4 END AS hi, (n_nationkey % 5) / 4.0 AS dup FROM nation),
f AS (SELECT c, 'f' || i AS field, list_filter(['integer', 'number', 'string'], lambda x, j: (c // i) % 3 <> j - 1) AS types, (c + i) % 2 = 0 AS req, (c + i) % 3 = 0 AS nul, ((c + i) % 5) / 4.0 AS mis, (c + i) % 4 = 0 AS uni FROM h, (SELECT unnest([1, 2, 3, 4]) AS i) WHERE (c + i) % 4 <> 0 OR i = 1),
pr AS (SELECT a.c AS a, b.c AS b, a.ds = b.ds AS same FROM h a JOIN h b ON a.c <> b.c AND (a.ds = b.ds OR a.c = b.c + 1))"""
REASONS = NATION_CONTRACTS + """, fs AS (SELECT pr.a, pr.b, f.* EXCLUDE (c) FROM pr JOIN f ON f.c = pr.a), ft AS (SELECT pr.a, pr.b, f.* EXCLUDE (c) FROM pr JOIN f ON f.c = pr.b),
j AS (SELECT coalesce(fs.a, ft.a) AS a, coalesce(fs.b, ft.b) AS b, coalesce(fs.field, ft.field) AS field, fs.field IS NULL AS only_t, ft.field IS NULL AS only_s, fs.types AS st, ft.types AS tt, fs.req AS sr, ft.req AS tr, fs.nul AS sn, ft.nul AS tn, fs.mis AS sm, ft.mis AS tm, fs.uni AS su, ft.uni AS tu
 FROM fs FULL JOIN ft ON fs.a = ft.a AND fs.b = ft.b AND fs.field = ft.field),
w AS (SELECT pr.a, pr.b, s.extra AS se, t.extra AS te, s.lo AS sl, t.lo AS tl, s.hi AS sh, t.hi AS th, s.dup AS sd, t.dup AS td FROM pr JOIN h s ON s.c = pr.a JOIN h t ON t.c = pr.b),
r AS (SELECT a, b, 'extra_fields_newly_forbidden' AS code, NULL AS field FROM w WHERE se AND NOT te UNION ALL SELECT a, b, 'minimum_rows_increased', NULL FROM w WHERE tl > sl UNION ALL SELECT a, b, 'maximum_rows_decreased', NULL FROM w WHERE th < sh UNION ALL SELECT a, b, 'maximum_duplicate_rate_decreased', NULL FROM w WHERE td < sd
 UNION ALL SELECT a, b, 'source_field_forbidden_by_target', field FROM j JOIN w USING (a, b) WHERE only_s AND NOT te UNION ALL SELECT a, b, 'target_requires_source_absent_field', field FROM j WHERE only_t AND (tr OR tm < 1) UNION ALL SELECT a, b, 'source_unconstrained_field_restricted_by_target', field FROM j JOIN w USING (a, b) WHERE only_t AND se
 UNION ALL SELECT a, b, 'allowed_types_narrowed', field FROM j WHERE NOT only_s AND NOT only_t AND len(list_filter(st, lambda x: NOT list_contains(tt, x))) > 0 UNION ALL SELECT a, b, 'nullability_removed', field FROM j WHERE sn AND NOT tn UNION ALL SELECT a, b, 'maximum_missing_rate_decreased', field FROM j WHERE tm < sm
 UNION ALL SELECT a, b, 'field_became_required', field FROM j WHERE NOT sr AND tr UNION ALL SELECT a, b, 'uniqueness_added', field FROM j WHERE NOT su AND tu)"""


def _contracts(spark: SparkSession, sf: str):
    """Pairs of one region, and each nation with the one before it; the nations are 25, so definitions are made on the driver."""
    nations = sorted((r.n_nationkey, r.n_regionkey) for r in _t(spark, sf, "nation").collect())
    rule = lambda c, i: {"types": [x for j, x in enumerate(("integer", "number", "string")) if (c // i) % 3 != j], "required": (c + i) % 2 == 0, "nullable": (c + i) % 3 == 0, "max_missing_rate": (c + i) % 5 / 4, "unique": (c + i) % 4 == 0}
    definition = lambda c: {"fields": {f"f{i}": rule(c, i) for i in (1, 2, 3, 4) if (c + i) % 4 or i == 1}, "allow_extra": c % 2 == 0, "min_rows": c % 7, "max_rows": 50 + c % 4 if c % 3 else None, "max_duplicate_rate": c % 5 / 4}
    heads, rules = C.contract_frames(spark, [(str(c), str(r), definition(c)) for c, r in nations])
    pairs = [(str(a), str(b)) for a, x in nations for b, y in nations if a != b and (x == y or a == b + 1)]
    return spark.createDataFrame(pairs, "baseline string, candidate string"), heads, rules


@query(f"WITH {REASONS} SELECT a || '>' || b AS pair, code, field FROM r")
def compat_reasons(spark: SparkSession, sf: str) -> DataFrame:
    pairs, heads, rules = _contracts(spark, sf)
    got = C.compatibility_reasons(pairs.select(F.col("baseline").alias("source"), F.col("candidate").alias("target")), heads, rules)
    return got.select(F.concat_ws(">", "source", "target").alias("pair"), "code", "field")


@query(f"""WITH {REASONS}, g AS (SELECT a, b, 'allow_extra' AS what, NULL AS field, CASE WHEN te THEN 'RELAXED' ELSE 'TIGHTENED' END AS direction FROM w WHERE se <> te UNION ALL SELECT a, b, 'min_rows', NULL, CASE WHEN tl > sl THEN 'TIGHTENED' ELSE 'RELAXED' END FROM w WHERE sl <> tl
 UNION ALL SELECT a, b, 'max_rows', NULL, CASE WHEN th < sh THEN 'TIGHTENED' ELSE 'RELAXED' END FROM w WHERE sh <> th UNION ALL SELECT a, b, 'max_duplicate_rate', NULL, CASE WHEN td < sd THEN 'TIGHTENED' ELSE 'RELAXED' END FROM w WHERE sd <> td
 UNION ALL SELECT a, b, 'field_presence', field, 'TIGHTENED' FROM j WHERE only_t AND (tr OR tm < 1) UNION ALL SELECT a, b, 'field_presence', field, 'RELAXED' FROM j WHERE only_s AND (sr OR sm < 1)
 UNION ALL SELECT a, b, 'types', field, 'RELAXED' FROM j WHERE len(list_filter(tt, lambda x: NOT list_contains(st, x))) > 0 UNION ALL SELECT a, b, 'types', field, 'TIGHTENED' FROM j WHERE len(list_filter(st, lambda x: NOT list_contains(tt, x))) > 0
 UNION ALL SELECT a, b, 'required', field, CASE WHEN tr THEN 'TIGHTENED' ELSE 'RELAXED' END FROM j WHERE sr <> tr UNION ALL SELECT a, b, 'nullable', field, CASE WHEN tn THEN 'RELAXED' ELSE 'TIGHTENED' END FROM j WHERE sn <> tn
 UNION ALL SELECT a, b, 'max_missing_rate', field, CASE WHEN tm < sm THEN 'TIGHTENED' ELSE 'RELAXED' END FROM j WHERE sm <> tm UNION ALL SELECT a, b, 'unique', field, CASE WHEN tu THEN 'TIGHTENED' ELSE 'RELAXED' END FROM j WHERE su <> tu)
SELECT a || '>' || b AS pair, what AS "constraint", field, direction FROM g""")
def compat_changes(spark: SparkSession, sf: str) -> DataFrame:
    got = C.compatibility_changes(*_contracts(spark, sf))
    return got.select(F.concat_ws(">", "baseline", "candidate").alias("pair"), "constraint", "field", "direction")


@query(f"""WITH {REASONS}, q AS (SELECT pr.a, pr.b, same, EXISTS (SELECT 1 FROM r WHERE r.a = pr.a AND r.b = pr.b) AS back, EXISTS (SELECT 1 FROM r WHERE r.a = pr.b AND r.b = pr.a) AS forth FROM pr)
SELECT a || '>' || b AS pair, CASE WHEN NOT same THEN 'INSUFFICIENT' WHEN NOT back AND NOT forth THEN 'FULLY_COMPATIBLE' WHEN NOT back THEN 'BACKWARD_COMPATIBLE' WHEN NOT forth THEN 'FORWARD_COMPATIBLE' ELSE 'BREAKING' END AS qualification FROM q""")
def compat_qualification(spark: SparkSession, sf: str) -> DataFrame:
    return C.compatibility(*_contracts(spark, sf)).select(F.concat_ws(">", "baseline", "candidate").alias("pair"), "qualification")


@query(f"""WITH {REASONS} SELECT pr.a || '>' || pr.b AS pair, coalesce(string_agg(j.field, ',' ORDER BY j.field) FILTER (only_t), '') AS added, coalesce(string_agg(j.field, ',' ORDER BY j.field) FILTER (only_s), '') AS removed,
 coalesce(string_agg(j.field, ',' ORDER BY j.field) FILTER (only_t AND (tr OR tm < 1)), '') AS newly_required FROM pr JOIN j USING (a, b) GROUP BY pr.a, pr.b""")
def compat_field_sets(spark: SparkSession, sf: str) -> DataFrame:
    pairs, _, rules = _contracts(spark, sf)
    got = C.field_set_changes(pairs, rules)
    return got.select(F.concat_ws(">", "baseline", "candidate").alias("pair"), *(F.array_join(c, ",").alias(n) for c, n in (("added_fields", "added"), ("removed_fields", "removed"), ("new_required_fields", "newly_required"))))


# Hashes and chains

@query("""SELECT l_orderkey, l_linenumber, l_suppkey, sha256('{"l_linenumber":' || l_linenumber || ',"l_linestatus":"' || l_linestatus || '","l_orderkey":' || l_orderkey || ',"l_partkey":' || CASE WHEN l_partkey % 3 = 0 THEN 'null' ELSE CAST(l_partkey AS VARCHAR) END || ',"l_returnflag":"' || l_returnflag || '"}') AS h FROM lineitem""")
def row_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical JSON of typed rows, with nulls, and its hash."""
    rows = _t(spark, sf, "lineitem").withColumn("l_partkey", F.expr("nullif(l_partkey, CASE WHEN l_partkey % 3 = 0 THEN l_partkey END)"))
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", H.row_hash(H.row_json(["l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus"])).alias("h"))


CONTENT = f"""WITH {VY}, h AS (SELECT version_id, sha256('{{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}}') AS h FROM vy),
leaf AS (SELECT version_id, h[1:6] AS leaf, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS d FROM h GROUP BY ALL),
branch AS (SELECT version_id, leaf[1:3] AS leaf, sum(n) AS n, sha256(string_agg(d, '' ORDER BY leaf)) AS d FROM leaf GROUP BY version_id, leaf[1:3]),
content AS (SELECT version_id, CAST(sum(n) AS BIGINT) AS record_count, sha256(string_agg(d, '' ORDER BY leaf)) AS content_hash FROM branch GROUP BY version_id)"""


def _content(spark: SparkSession, sf: str) -> DataFrame:
    text = H.row_json(["o_orderkey", "o_custkey", "o_orderstatus"])
    return content_hash(_vy(spark, sf).select("version_id", H.row_hash(text).alias("h")), ["version_id"], "h")


@query(CONTENT + " SELECT * FROM content")
def content_hash_tree(spark: SparkSession, sf: str) -> DataFrame:
    return _content(spark, sf)


CHAIN = CONTENT.replace("WITH ", "WITH RECURSIVE ", 1) + """, c AS (SELECT DISTINCT vy.version_id, o_orderpriority AS ds, ver, content_hash FROM vy JOIN content USING (version_id)),
chain AS (SELECT version_id, ds, ver, CAST(NULL AS VARCHAR) AS prev_id, sha256(version_id || ':' || content_hash) AS provenance_hash FROM c WHERE ver = 1
 UNION ALL SELECT c.version_id, c.ds, c.ver, chain.version_id, sha256(chain.provenance_hash || c.version_id || ':' || c.content_hash) FROM chain JOIN c ON c.ds = chain.ds AND c.ver = chain.ver + 1)"""


def _chained(spark: SparkSession, sf: str, content: DataFrame) -> DataFrame:
    v = _versions(spark, sf).join(content, "version_id")
    chain = chain_hash(v, ["o_orderpriority"], "ver", F.concat_ws(":", "version_id", "content_hash"))
    return v.join(chain, ["o_orderpriority", "ver"]).withColumn("prev_id", F.lag("version_id").over(Window.partitionBy("o_orderpriority").orderBy("ver")))


@query(CHAIN + " SELECT version_id, prev_id, provenance_hash FROM chain")
def manifest_chain(spark: SparkSession, sf: str) -> DataFrame:
    return _chained(spark, sf, _content(spark, sf)).select("version_id", "prev_id", F.col("chained").alias("provenance_hash"))


# Joins

@query("""WITH r AS (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderdate DESC, o_orderkey DESC) AS k FROM orders)
SELECT c_custkey AS key, CASE WHEN o_custkey IS NULL THEN 'NOT_AVAILABLE' ELSE 'AVAILABLE' END AS status, o_orderstatus AS verdict FROM customer LEFT JOIN r ON c_custkey = o_custkey AND k = 1""")
def latest_compliance_join(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as versions, orders as contract reports: the report of the highest contract version, then the newest."""
    reports = _t(spark, sf, "orders").select(F.col("o_custkey").alias("version_id"), F.col("o_orderkey").alias("contract_id"), F.col("o_orderstatus").alias("verdict"), F.col("o_orderdate").alias("created_at"))
    contracts = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("contract_id"), F.col("o_totalprice").alias("version_number"))
    got = L.compliance_of(_t(spark, sf, "customer").select(F.col("c_custkey").alias("version_id")), reports, contracts)
    return got.select(F.col("version_id").alias("key"), "status", "verdict")


# Graphs

GRAPH = """s AS (SELECT s_suppkey AS k, s_nationkey AS ds, (SELECT count(*) FROM supplier) AS n FROM supplier),
ve AS (SELECT DISTINCT u, d FROM (SELECT k AS u, (7 * k + 3) % n AS d FROM s UNION ALL SELECT k, (3 * k + 1) % n FROM s) WHERE u <> d), vd AS (SELECT * FROM ve WHERE u < d)"""


def _ve(spark: SparkSession, sf: str, dag: bool = False) -> DataFrame:
    s = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("src"))
    n = s.count()
    e = s.select("src", F.explode(F.array((F.col("src") * 7 + 3) % n, (F.col("src") * 3 + 1) % n)).alias("dst")).where("src <> dst").distinct()
    return settle(e.where("src < dst") if dag else e)


def _at(spark: SparkSession, *nodes: int) -> DataFrame:
    return spark.createDataFrame([(n, n) for n in nodes], "root long, node long")


def _down(graph: str, roots: str, depth: int = 64) -> str:
    """Shortest paths by recursion over distinct nodes of each level, smallest path first."""
    return f"""WITH RECURSIVE {GRAPH}, seeds AS (SELECT unnest({roots})::BIGINT AS root), walk AS (
 SELECT root, root AS node, 0 AS depth, [root] AS path FROM seeds
 UNION ALL SELECT w.root, e.d, w.depth + 1, list_append(w.path, e.d) FROM walk w JOIN {graph} e ON e.u = w.node WHERE w.depth < {depth} AND NOT list_contains(w.path, e.d)),
best AS (SELECT root, node, min(depth) AS depth, arg_min(path, (depth, path)) AS path FROM walk GROUP BY root, node)"""


@query(f"WITH {GRAPH}, e AS (SELECT * FROM ve UNION ALL SELECT k, k + 1000000 FROM s WHERE k % 10 = 0) SELECT u, d FROM e WHERE d NOT IN (SELECT k FROM s)")
def missing_references(spark: SparkSession, sf: str) -> DataFrame:
    s = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("src"))
    e = _ve(spark, sf).unionByName(s.where("src % 10 = 0").select("src", (F.col("src") + 1000000).alias("dst")))
    return e.join(s.withColumnRenamed("src", "dst"), "dst", "left_anti").select(F.col("src").alias("u"), F.col("dst").alias("d"))


@query(_down("ve", "[1]", 3) + " SELECT node, depth, array_to_string(path, '-') AS path FROM best WHERE depth > 0")
def impact_bfs(spark: SparkSession, sf: str) -> DataFrame:
    got = G.bfs(_ve(spark, sf), _at(spark, 1), 3).where("depth > 0")
    return got.select("node", F.col("depth").cast("int").alias("depth"), F.array_join(F.col("path").cast("array<string>"), "-").alias("path"))


@query(f"""WITH RECURSIVE {GRAPH}, e AS (SELECT 'VE' AS graph, * FROM ve UNION ALL SELECT 'VD', * FROM vd), r AS (SELECT graph, u, d FROM e UNION SELECT r.graph, r.u, e.d FROM r JOIN e ON e.graph = r.graph AND e.u = r.d) SELECT graph, bool_or(u = d) AS has_cycle FROM r GROUP BY graph""")
def cycle_exists(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([("VE", G.has_cycle(_ve(spark, sf))), ("VD", G.has_cycle(_ve(spark, sf, dag=True)))], "graph string, has_cycle boolean")


@query()
def cycle_list(spark: SparkSession, sf: str) -> DataFrame:
    """The back-edge cycles of the sorted depth-first search, which SQL can't express; tests hold it against a plain search."""
    return G.cycles(_ve(spark, sf)).select(F.array_join(F.col("cycle").cast("array<string>"), "-").alias("cycle"))


@query(f"WITH RECURSIVE {GRAPH}, up AS (SELECT max(d) AS node FROM vd UNION SELECT e.u FROM up JOIN vd e ON e.d = up.node) SELECT node FROM up")
def closure_reach(spark: SparkSession, sf: str) -> DataFrame:
    e = _ve(spark, sf, dag=True)
    top = e.agg(F.max("dst").alias("node")).withColumn("root", F.col("node"))
    return G.reach(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), top).select("node")


@query(f"""WITH RECURSIVE {GRAPH}, t AS (SELECT DISTINCT d AS target FROM vd), p AS (SELECT target, target AS node, [target] AS path FROM t
 UNION ALL SELECT target, e.u, list_append(path, e.u) FROM p JOIN vd e ON e.d = p.node) SELECT target, array_to_string(path, '-') AS path FROM p""")
def closure_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Every path upstream of every target, of any length."""
    e = _ve(spark, sf, dag=True)
    got = G.simple_paths(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), e.select(F.col("dst").alias("node")).distinct())
    return got.select("target", F.array_join(F.col("path").cast("array<string>"), "-").alias("path"))


@query(f"""WITH RECURSIVE {GRAPH}, e AS (SELECT u AS a, d AS b FROM ve UNION SELECT d, u FROM ve),
r AS (SELECT k AS start, k AS node FROM s UNION SELECT start, e.b FROM r JOIN e ON e.a = r.node) SELECT node, min(start) AS component FROM r GROUP BY node""")
def components(spark: SparkSession, sf: str) -> DataFrame:
    return G.components(_ve(spark, sf), _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("node")))


@query(f"""WITH RECURSIVE {GRAPH}, seeds AS (SELECT unnest([0, 1, 2])::BIGINT AS node), walk AS (SELECT node, 0 AS depth, [node] AS path FROM seeds
 UNION ALL SELECT e.d, depth + 1, list_append(path, e.d) FROM walk w JOIN vd e ON e.u = w.node) SELECT node, min(depth) AS depth, array_to_string(arg_min(path, (depth, path)), '-') AS path FROM walk GROUP BY node""")
def dossier_multi_source(spark: SparkSession, sf: str) -> DataFrame:
    seeds = spark.createDataFrame([(0, n) for n in (0, 1, 2)], "root long, node long")
    got = G.bfs(_ve(spark, sf, dag=True), seeds)
    return got.select("node", F.col("depth").cast("int").alias("depth"), F.array_join(F.col("path").cast("array<string>"), "-").alias("path"))


# Registered versions

REGISTERED = """sv AS (SELECT k, k // 4 AS g, k % 4 + 1 AS num, k % 20 AS z, CASE WHEN k % 4 > 0 THEN k - 1 END AS prev, 'v' || lpad(CAST(k AS VARCHAR), 7, '0') AS vid FROM s),
links AS (SELECT u, d, 'l-' || u || '-' || d AS id FROM vd), orphan AS (SELECT k AS u, 'l-' || k || '-gone' AS id FROM s WHERE k % 10 = 0),
issues AS (SELECT k, g, num, z, vid, unnest(CASE z WHEN 1 THEN ['content_hash_mismatch', 'manifest_content_hash_mismatch'] WHEN 3 THEN ['record_count_mismatch', 'manifest_record_count_mismatch'] WHEN 5 THEN ['manifest_source_id_mismatch', 'manifest_source_hash_mismatch']
 WHEN 7 THEN ['manifest_created_at_mismatch'] WHEN 9 THEN ['provenance_hash_mismatch'] WHEN 13 THEN ['provenance_hash_mismatch'] WHEN 14 THEN ['previous_provenance_hash_mismatch'] WHEN 15 THEN ['manifest_source_id_mismatch', 'source_reference_missing']
 WHEN 11 THEN ['invalid_stored_json', 'provenance_hash_mismatch', 'manifest_version_id_mismatch', 'manifest_dataset_id_mismatch', 'manifest_source_id_mismatch', 'manifest_version_number_mismatch', 'manifest_record_count_mismatch', 'manifest_content_hash_mismatch',
  'manifest_previous_version_id_mismatch', 'manifest_created_at_mismatch', 'manifest_dataset_hash_mismatch', 'manifest_source_hash_mismatch', 'previous_provenance_hash_mismatch']
 WHEN 17 THEN ['dataset_reference_missing', 'manifest_dataset_id_mismatch', 'previous_version_dataset_mismatch'] WHEN 18 THEN ['previous_version_dataset_mismatch'] WHEN 19 THEN ['manifest_previous_version_id_mismatch', 'previous_version_reference_missing'] ELSE [] END) AS issue FROM sv),
link_issues AS (SELECT u, id, 'lineage_link_hash_mismatch' AS issue FROM links WHERE u % 20 = 1 OR d % 20 = 1 OR (u + d) % 9 = 0 UNION ALL SELECT u, id, 'lineage_endpoint_missing' FROM orphan)"""


def _vid(k: Column) -> Column:
    return F.concat(F.lit("v"), F.lpad(k.cast("string"), 7, "0"))


def _registered(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """versions, datasets, sources, contents of (version_id, dataset_id, source_id, version_number, previous_version_id, record_count, content_hash).

    Manifests are chained in each dataset as the registry chains them; a dataset's versions are metadata, and few.
    """
    def named(column: str, kind: str) -> DataFrame:
        text = F.to_json(F.struct(F.col(column).alias("name")))
        return rows.select(column).distinct().select(column, text.alias("descriptor"), F.sha2(text, 256).alias(f"{kind}_hash"))

    datasets, sources = named("dataset_id", "dataset"), named("source_id", "source")
    full = rows.withColumn("created_at", F.concat(F.lit("2024-01-"), F.lpad(F.col("version_number").cast("string"), 2, "0"))).join(datasets.drop("descriptor"), "dataset_id").join(sources.drop("descriptor"), "source_id")
    said = F.to_json(F.struct("version_id", "dataset_id", "dataset_hash", "source_id", "source_hash", "version_number", "record_count", "content_hash", "previous_version_id", "created_at"))
    items = F.array_sort(F.collect_list(F.struct("version_number", "version_id", said.alias("said"))))
    text = lambda acc, x: F.when(F.size(acc) == 0, x["said"]).otherwise(F.concat(F.substr(x["said"], F.lit(1), F.length(x["said"]) - 1), F.lit(',"previous_provenance_hash":"'), F.try_element_at(acc, F.lit(-1))["proof"], F.lit('"}')))
    step = lambda acc, x: F.concat(acc, F.array(F.struct(x["version_id"].alias("version_id"), text(acc, x).alias("manifest"), F.sha2(text(acc, x), 256).alias("proof"))))
    chained = full.groupBy("dataset_id").agg(items.alias("i")).select(F.explode(F.aggregate("i", F.array().cast("array<struct<version_id:string,manifest:string,proof:string>>"), step)).alias("x"))
    proofs = chained.select("x.version_id", "x.manifest", F.col("x.proof").alias("provenance_hash"))
    versions = full.join(proofs, "version_id").select(*rows.columns, "manifest", "provenance_hash", "created_at")
    return settle(versions), datasets, sources, rows.select("version_id", "record_count", "content_hash")


FRAMES: dict[tuple, tuple[DataFrame, ...]] = {}


def _frames(spark: SparkSession, sf: str, tampered: tuple[int, ...] = (), orphans: bool = False, dag: bool = True) -> tuple[DataFrame, ...]:
    """versions, datasets, sources, contents, links of the suppliers, written once a session and folder.

    ``tampered`` lists the remainders by 20 whose version has a field exchanged.
    """
    key = spark.sparkContext.applicationId, sf, tampered, orphans, dag
    if key not in FRAMES:
        FRAMES[key] = _made(spark, sf, tampered, orphans, dag)
    return FRAMES[key]


def _made(spark: SparkSession, sf: str, tampered: tuple[int, ...], orphans: bool, dag: bool) -> tuple[DataFrame, ...]:
    s = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    vid = _vid(F.col("k"))
    rows = s.select(
        vid.alias("version_id"), F.concat(F.lit("d"), F.lpad(F.floor(F.col("k") / 4).cast("string"), 6, "0")).alias("dataset_id"), F.concat(F.lit("src"), (F.col("k") % 2).cast("string")).alias("source_id"), (F.col("k") % 4 + 1).alias("version_number"),
        F.when(F.col("k") % 4 > 0, _vid(F.col("k") - 1)).alias("previous_version_id"), (F.col("k") % 7 + 1).alias("record_count"), F.sha2(vid, 256).alias("content_hash"),
    )
    versions, datasets, sources, contents = _registered(rows)
    e = _ve(spark, sf, dag=dag).withColumn("id", F.concat_ws("-", F.lit("l"), "src", "dst"))
    relation = F.element_at(F.array(*map(F.lit, L.RELATIONS)), ((F.col("src") + F.col("dst")) % 6 + 1).cast("int"))
    ends = e.select("id", _vid(F.col("src")).alias("upstream_version_id"), _vid(F.col("dst")).alias("downstream_version_id"), relation.alias("relation_type"), ((F.col("src") + F.col("dst")) % 9 == 0).alias("forged"))
    own = lambda end: versions.select(F.col("version_id").alias(f"{end}_version_id"), F.col("content_hash").alias(end))
    links = ends.join(own("upstream"), "upstream_version_id").join(own("downstream"), "downstream_version_id")
    sealed = P.link_hash(F.col("upstream_version_id"), F.col("upstream"), F.col("downstream_version_id"), F.col("downstream"), F.col("relation_type"))
    links = links.select("id", "upstream_version_id", "downstream_version_id", "relation_type", (F.when(F.col("forged"), "x").otherwise(sealed) if tampered else sealed).alias("link_hash"))
    if orphans:
        lost = s.where("k % 10 = 0").select(F.concat_ws("-", F.lit("l"), "k", F.lit("gone")).alias("id"), vid.alias("upstream_version_id"), F.concat(F.lit("gone"), "k").alias("downstream_version_id"), F.lit(L.RELATIONS[0]).alias("relation_type"), F.lit("x").alias("link_hash"))
        links = links.unionByName(lost)
    if tampered:
        z = F.substr("version_id", F.lit(2)).cast("long") % 20
        swap = {
            1: ("content_hash", F.lit("x")), 3: ("record_count", F.col("record_count") + 1), 5: ("source_id", F.when(F.col("source_id") == "src0", "src1").otherwise("src0")), 7: ("created_at", F.lit("later")), 9: ("manifest", F.concat("manifest", F.lit(" "))),
            11: ("manifest", F.lit("{")), 13: ("provenance_hash", F.lit("x")), 15: ("source_id", F.lit("gone")), 17: ("dataset_id", F.lit("gone")), 19: ("previous_version_id", F.lit("gone")),
        }
        for n in tampered:
            column, value = swap[n]
            versions = versions.withColumn(column, F.when(z == n, value).otherwise(F.col(column)))
        versions = settle(versions)
    return versions, settle(datasets), settle(sources), settle(contents), settle(links)


ALL_TAMPERED = (1, 3, 5, 7, 9, 11, 13, 15, 17, 19)


@query(f"WITH {GRAPH}, {REGISTERED} SELECT vid AS version_id, issue FROM issues")
def version_integrity(spark: SparkSession, sf: str) -> DataFrame:
    """Every second version has one field exchanged after the fact: what its row, its manifest and its successor give away."""
    versions, datasets, sources, contents, _ = _frames(spark, sf, ALL_TAMPERED)
    return P.version_integrity(versions, datasets, sources, contents).select("version_id", F.explode("issues").alias("issue"))


CHAIN_ISSUES = f"""{GRAPH}, {REGISTERED}, chain AS (SELECT g, num, vid, issue FROM issues WHERE z NOT IN (17, 18) UNION ALL SELECT g, num, vid, 'previous_version_mismatch' FROM sv WHERE z = 19)"""


@query(f"WITH {CHAIN_ISSUES} SELECT vid AS version_id, issue FROM chain")
def chain_verify_tampered(spark: SparkSession, sf: str) -> DataFrame:
    """Each dataset's chain in order of its numbers, on the same exchanges but that of the dataset."""
    versions, datasets, sources, contents, _ = _frames(spark, sf, tuple(n for n in ALL_TAMPERED if n != 17))
    return P.verify_chain(versions, datasets, sources, contents).select("version_id", F.explode("issues").alias("issue"))


@query(f"""WITH {CHAIN_ISSUES} SELECT t.vid AS version_id, count(c.issue) = 0 AS valid, CAST(t.num AS BIGINT) AS checked_versions, coalesce(string_agg(c.vid || ':' || c.issue, ',' ORDER BY c.vid || ':' || c.issue), '') AS issues
FROM sv t LEFT JOIN chain c ON c.g = t.g AND c.num <= t.num WHERE t.k IN (0, 3, 6) GROUP BY t.vid, t.num""")
def verify_version(spark: SparkSession, sf: str) -> DataFrame:
    """Three versions, each with all before it in its dataset."""
    versions, datasets, sources, contents, _ = _frames(spark, sf, tuple(n for n in ALL_TAMPERED if n != 17))
    got = _union(*(P.verify_version(versions, datasets, sources, contents, f"v{k:07d}") for k in (0, 3, 6)))
    return got.withColumn("issues", F.array_join("issues", ","))


@query(f"WITH {GRAPH}, {REGISTERED} SELECT id AS resource_id, issue FROM link_issues")
def link_integrity(spark: SparkSession, sf: str) -> DataFrame:
    versions, _, _, _, links = _frames(spark, sf, ALL_TAMPERED, orphans=True)
    return P.link_integrity(links, versions).select("resource_id", F.explode("issues").alias("issue"))


IMPACTS = (("VE", 1, 3), ("VD", 1, 2), ("VD", 0, 3), ("VD", 9, 3))


def _impact_sql(graph: str, root: int, depth: int) -> str:
    lost = f"(SELECT count(*) FROM best WHERE depth < {depth} AND node % 10 = 0)" if graph == "VD" else "0"
    return f"""SELECT * FROM ({_down(graph.lower(), f"[{root}]", depth)}, inside AS (SELECT u, d FROM {graph.lower()} WHERE u IN (SELECT node FROM best) AND d IN (SELECT node FROM best)), loops AS (SELECT u, d FROM inside UNION SELECT l.u, i.d FROM loops l JOIN inside i ON l.d = i.u),
 a AS (SELECT count(*) AS n, count(DISTINCT node // 4) AS ds, max(depth) AS m FROM best WHERE depth > 0)
 SELECT '{graph}:{root}' AS run, CASE WHEN (SELECT count(*) FROM loops WHERE u = d) > 0 THEN 'CYCLE_DETECTED' WHEN n = 0 THEN 'ISOLATED' WHEN n >= 3 THEN 'PROPAGATED' ELSE 'CONTAINED' END AS qualification, n AS affected, ds AS datasets, CAST(coalesce(m, 0) AS BIGINT) AS max_depth, CAST({lost} AS BIGINT) AS orphans FROM a)"""


@query(" UNION ALL ".join(_impact_sql(*i) for i in IMPACTS))
def impact_qualification(spark: SparkSession, sf: str) -> DataFrame:
    """Impact reports on the cyclic graph and, with links to versions that aren't registered, on the other."""
    found = []
    for graph, root, depth in IMPACTS:
        versions, _, _, _, links = _frames(spark, sf, orphans=graph == "VD", dag=graph == "VD")
        got = L.impact_report(versions, links, f"v{root:07d}", depth).summary
        found.append(got.select(F.lit(f"{graph}:{root}").alias("run"), "qualification", F.col("affected_version_count").alias("affected"), F.col("affected_dataset_count").alias("datasets"), F.col("max_depth_reached").cast("long").alias("max_depth"), F.col("orphan_count").alias("orphans")))
    return _union(*found)


@query(_down("vd", "[1]", 3) + """ SELECT 'v' || lpad(CAST(node AS VARCHAR), 7, '0') AS version, 'd' || lpad(CAST(node // 4 AS VARCHAR), 6, '0') AS dataset, depth, list_aggregate(list_transform(path, lambda x: 'v' || lpad(CAST(x AS VARCHAR), 7, '0')), 'string_agg', '>') AS path,
 CASE WHEN node % 3 = 0 THEN 'AVAILABLE' ELSE 'NOT_AVAILABLE' END AS compliance FROM best WHERE depth > 0""")
def impact_affected(spark: SparkSession, sf: str) -> DataFrame:
    """What an impact report lists, with the contract reports that every third version has."""
    versions, _, _, _, links = _frames(spark, sf)
    contracts = spark.createDataFrame([("c1", 1), ("c2", 2)], "contract_id string, version_number long")
    third = versions.where(F.substr("version_id", F.lit(2)).cast("long") % 3 == 0).select("version_id", F.explode(F.array(F.lit("c1"), F.lit("c2"))).alias("contract_id"), F.lit("COMPATIBLE").alias("verdict"), "created_at")
    got = L.impact_report(versions, links, "v0000001", 3, L.compliance_of(versions, third, contracts)).parts["affected"]
    return got.select(F.col("version_id").alias("version"), F.col("dataset_id").alias("dataset"), "depth", F.array_join("version_path", ">").alias("path"), "compliance")


@query(_down("vd", "[1]", 3) + " SELECT 'd' || lpad(CAST(node // 4 AS VARCHAR), 6, '0') AS dataset, count(*) AS n, min(depth) AS min_depth FROM best WHERE depth > 0 GROUP BY node // 4")
def impact_dataset_rollup(spark: SparkSession, sf: str) -> DataFrame:
    versions, _, _, _, links = _frames(spark, sf)
    return L.impact_report(versions, links, "v0000001", 3).parts["datasets"].select(F.col("dataset_id").alias("dataset"), F.col("affected_version_count").alias("n"), "min_depth")


def _top(spark: SparkSession, sf: str) -> str:
    """The version furthest down the DAG."""
    return f"v{_ve(spark, sf, dag=True).agg(F.max('dst')).first()[0]:07d}"


CLOSURE = f"""WITH RECURSIVE {GRAPH}, {REGISTERED}, up AS (SELECT max(d) AS node FROM vd UNION SELECT x.src FROM up JOIN (SELECT d AS at, u AS src FROM links UNION ALL SELECT k, prev FROM sv WHERE prev IS NOT NULL CUT) x ON x.at = up.node)"""


@query(CLOSURE.replace("CUT", "") + """, i AS (SELECT count(*) AS n, count(DISTINCT g) AS ds, count(DISTINCT k % 2) AS src FROM sv WHERE k IN (SELECT node FROM up)),
o AS (SELECT count(*) AS n FROM sv WHERE g IN (SELECT node // 4 FROM up) AND k NOT IN (SELECT node FROM up))
SELECT CASE WHEN i.n = 1 THEN 'INSUFFICIENT' WHEN o.n > 0 THEN 'PARTIAL' ELSE 'COMPLETE' END AS qualification, i.n AS versions, ds AS datasets, src AS sources, (SELECT count(*) FROM links WHERE d IN (SELECT node FROM up)) AS links, o.n AS unused FROM i, o""")
def closure_report(spark: SparkSession, sf: str) -> DataFrame:
    """The summary of the last version's closure. Its number of chains grows exponentially, so they are not asked for here."""
    got = L.provenance_closure(*_frames(spark, sf), [_top(spark, sf)], chains=False).summary
    return got.select("qualification", F.col("closure_version_count").alias("versions"), F.col("dataset_count").alias("datasets"), F.col("source_count").alias("sources"), F.col("lineage_link_count").alias("links"), F.col("unused_count").alias("unused"))


@query(CLOSURE.replace("CUT", "AND z <> 19") + """ SELECT 'break' AS kind, vid AS resource_id, issue AS code FROM issues WHERE k IN (SELECT node FROM up) AND NOT ends_with(issue, '_reference_missing')
UNION ALL SELECT 'break', l.id, l.issue FROM link_issues l JOIN links USING (id) WHERE links.d IN (SELECT node FROM up)
UNION ALL SELECT 'missing', vid, CASE WHEN z = 15 THEN 'source_reference_missing' WHEN z = 17 THEN 'dataset_reference_missing' ELSE 'upstream_version_missing' END FROM sv WHERE z IN (15, 17, 19) AND k IN (SELECT node FROM up)""")
def closure_findings(spark: SparkSession, sf: str) -> DataFrame:
    """What the same closure finds where every second version was tampered with."""
    parts = L.provenance_closure(*_frames(spark, sf, ALL_TAMPERED), [_top(spark, sf)], chains=False).parts
    return parts["breaks"].select(F.lit("break").alias("kind"), "resource_id", "code").unionByName(parts["missing_references"].select(F.lit("missing").alias("kind"), "resource_id", "code"))


@query(CLOSURE.replace("CUT", "") + " SELECT vid AS node FROM sv WHERE g IN (SELECT node // 4 FROM up) AND k NOT IN (SELECT node FROM up)")
def unused_versions(spark: SparkSession, sf: str) -> DataFrame:
    return L.provenance_closure(*_frames(spark, sf), [_top(spark, sf)], chains=False).parts["unused"]


@query(f"""WITH RECURSIVE {GRAPH}, {REGISTERED}, up AS (SELECT k, vid AS path FROM sv WHERE k IN (2, 7) UNION ALL SELECT x.src, path || '>' || x.vid FROM up JOIN (SELECT d AS at, u AS src, vid FROM links JOIN sv ON k = u UNION ALL SELECT a.k, a.prev, b.vid FROM sv a JOIN sv b ON b.k = a.prev) x ON x.at = up.k)
SELECT path, true AS complete, 'src' || k % 2 AS source FROM up""")
def closure_chain_report(spark: SparkSession, sf: str) -> DataFrame:
    """All upstream chains of two versions, over links and predecessors."""
    versions, _, sources, _, links = _frames(spark, sf)
    return L.closure_chains(versions, sources, links, ["v0000002", "v0000007"]).select(F.array_join("version_path", ">").alias("path"), "complete", F.col("source_id").alias("source"))


SELECTIONS = {"one": ("v0000000",), "late": ("v0000006",), "set": ("d000001",), "none": ("dnone",)}
DOSSIER = f"""{GRAPH}, {REGISTERED}, seeds AS (SELECT * FROM (VALUES ('one', 0), ('late', 6), ('set', 4), ('set', 5), ('set', 6), ('set', 7)) t(pick, node) WHERE node IN (SELECT k FROM s)), down AS (SELECT u AS src, d AS dst FROM links UNION ALL SELECT prev, k FROM sv WHERE prev IS NOT NULL)"""


def _dossier(spark: SparkSession, sf: str, pick: str) -> L.Report:
    ids = SELECTIONS[pick]
    return L.impact_dossier(*_frames(spark, sf), *((ids, ()) if ids[0][0] == "v" else ((), ids)))


@query(f"""WITH RECURSIVE {DOSSIER}, walk AS (SELECT pick, node, 0 AS depth FROM seeds UNION SELECT pick, e.dst, depth + 1 FROM walk JOIN down e ON e.src = walk.node), best AS (SELECT pick, node, min(depth) AS depth FROM walk GROUP BY ALL),
a AS (SELECT pick, count(*) FILTER (depth = 0) AS seeds, count(*) FILTER (depth > 0) AS n, count(DISTINCT node // 4) FILTER (depth > 0) AS ds, CAST(max(depth) AS BIGINT) AS m FROM best GROUP BY pick UNION ALL SELECT 'none', 0, 0, 0, 0)
SELECT pick, CASE WHEN n = 0 THEN 'INSUFFICIENT' WHEN n >= 5 OR ds >= 3 OR m >= 4 THEN 'WIDESPREAD' ELSE 'CONTAINED' END AS qualification, seeds, n AS affected, ds AS datasets, m AS max_depth,
 CASE WHEN pick = 'none' THEN 'dataset_without_versions:dnone,no_downstream_impact_observed' WHEN n = 0 THEN 'no_downstream_impact_observed' ELSE '' END AS reasons FROM a""")
def dossier_qualification(spark: SparkSession, sf: str) -> DataFrame:
    """Dossiers of two versions, of a dataset, and of a dataset without versions."""
    cols = ("qualification", F.col("seed_version_count").alias("seeds"), F.col("affected_version_count").alias("affected"), F.col("affected_dataset_count").alias("datasets"), F.col("maximum_depth").cast("long").alias("max_depth"), F.array_join("insufficient_reasons", ",").alias("reasons"))
    return _union(*(_dossier(spark, sf, pick).summary.select(F.lit(pick).alias("pick"), *cols) for pick in SELECTIONS))


@query(f"""WITH RECURSIVE {DOSSIER}, walk AS (SELECT node, 0 AS depth, [node] AS path FROM seeds WHERE pick = 'late' UNION ALL SELECT e.dst, depth + 1, list_append(path, e.dst) FROM walk JOIN down e ON e.src = walk.node),
best AS (SELECT node, min(depth) AS depth, arg_min(path, (depth, path)) AS path FROM walk GROUP BY node) SELECT depth, list_aggregate(list_transform(path, lambda x: 'v' || lpad(CAST(x AS VARCHAR), 7, '0')), 'string_agg', '>') AS path FROM best WHERE depth > 0 ORDER BY depth DESC, best.path LIMIT 1""")
def worst_branch(spark: SparkSession, sf: str) -> DataFrame:
    return _dossier(spark, sf, "late").parts["worst_branch"].select("depth", F.array_join("version_path", ">").alias("path"))


EVOLUTION = _down("vd", "[0, 1, 2, 3]") + f""", {REGISTERED}, states AS (SELECT b.root, count(*) - 1 AS n_down, count(DISTINCT b.node // 4) FILTER (depth > 0 AND node % 20 <> 17) + CASE WHEN bool_or(depth > 0 AND node % 20 = 17) THEN 1 ELSE 0 END AS n_datasets, max(depth) AS max_depth,
  list(node) FILTER (depth > 0) AS down, (SELECT list(issue || ':' || vid) FROM issues i JOIN best x ON x.node = i.k WHERE x.root = b.root) AS broken, (SELECT list(issue || ':' || id) FROM link_issues l JOIN best x ON x.node = l.u WHERE x.root = b.root) AS broken_links,
  (SELECT list(id) FROM orphan o JOIN best x ON x.node = o.u WHERE x.root = b.root) AS lost, (SELECT count(*) FROM issues i WHERE i.k = b.root) = 0 AS proof_valid FROM best b GROUP BY b.root),
st AS (SELECT root, n_down, n_datasets, max_depth, proof_valid, coalesce(down, []) AS down, list_concat(coalesce(broken, []), coalesce(broken_links, [])) AS breaks, coalesce(lost, []) AS lost FROM states),
pairs AS (SELECT a.root AS f, b.root AS t, len(list_filter(b.down, lambda x: NOT list_contains(a.down, x))) AS n_added, len(list_filter(a.down, lambda x: NOT list_contains(b.down, x))) AS n_removed, len(list_filter(b.breaks, lambda x: NOT list_contains(a.breaks, x))) AS new_breaks,
 len(list_filter(a.breaks, lambda x: NOT list_contains(b.breaks, x))) AS resolved_breaks, len(list_filter(b.lost, lambda x: NOT list_contains(a.lost, x))) AS new_orphans, len(list_filter(a.lost, lambda x: NOT list_contains(b.lost, x))) AS resolved_orphans FROM st a JOIN st b ON b.root = a.root + 1),
tr AS (SELECT *, 100 * new_breaks + 50 * new_orphans + 10 * n_removed + n_added AS severity FROM pairs)"""


def _evolution(spark: SparkSession, sf: str, tampered: bool = True) -> L.Report:
    return L.lineage_evolution(*_frames(spark, sf, ALL_TAMPERED if tampered else (), orphans=tampered), [f"v{k:07d}" for k in range(4)])


@query(EVOLUTION + " SELECT root, n_down, n_datasets, CAST(max_depth AS BIGINT) AS max_depth, CAST(len(breaks) AS BIGINT) AS n_breaks, CAST(len(lost) AS BIGINT) AS n_orphans, proof_valid FROM st")
def evolution_states(spark: SparkSession, sf: str) -> DataFrame:
    """A dataset's four versions, with links to what isn't registered and every second version tampered with."""
    size = lambda c: F.size(c).cast("long")
    root = F.substr("root", F.lit(2)).cast("long").alias("root")
    return _evolution(spark, sf).parts["states"].select(root, size("downstream").alias("n_down"), size("downstream_datasets").alias("n_datasets"), F.col("maximum_depth").cast("long").alias("max_depth"), size("breaks").alias("n_breaks"), size("orphans").alias("n_orphans"), "proof_valid")


def _transition(df: DataFrame) -> DataFrame:
    ends = [F.substr(c, F.lit(2)).cast("long").alias(c) for c in ("from_root", "to_root")]
    sizes = [F.size(c).cast("long").alias(n) for c, n in (("added", "n_added"), ("removed", "n_removed"), ("new_breaks", "new_breaks"), ("resolved_breaks", "resolved_breaks"), ("new_orphans", "new_orphans"), ("resolved_orphans", "resolved_orphans"))]
    return df.select(*ends, *sizes, F.col("severity").cast("long").alias("severity"))


TRANSITION = " SELECT f AS from_root, t AS to_root, CAST(n_added AS BIGINT) AS n_added, CAST(n_removed AS BIGINT) AS n_removed, CAST(new_breaks AS BIGINT) AS new_breaks, CAST(resolved_breaks AS BIGINT) AS resolved_breaks, CAST(new_orphans AS BIGINT) AS new_orphans, CAST(resolved_orphans AS BIGINT) AS resolved_orphans, CAST(severity AS BIGINT) AS severity FROM tr"


@query(EVOLUTION + TRANSITION)
def evolution_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return _transition(_evolution(spark, sf).parts["transitions"])


@query(EVOLUTION + TRANSITION + " ORDER BY severity DESC, to_root DESC LIMIT 1")
def evolution_worst(spark: SparkSession, sf: str) -> DataFrame:
    return _transition(_evolution(spark, sf).parts["worst_transition"])


@query(EVOLUTION + """ SELECT 'tampered' AS run, CASE WHEN (SELECT bool_and(proof_valid) FROM st) AND (SELECT max(n_down) FROM st) > 0 THEN 'PARTIAL' ELSE 'INSUFFICIENT' END AS qualification, CAST(count(*) AS BIGINT) AS transitions, CAST(sum(n_added) AS BIGINT) AS added, CAST(sum(n_removed) AS BIGINT) AS removed,
 CAST(sum(new_breaks) AS BIGINT) AS new_breaks, CAST(sum(new_orphans) AS BIGINT) AS new_orphans FROM tr
UNION ALL SELECT 'clean', CASE WHEN (SELECT max(n_down) FROM st) > 0 THEN 'EXPLAINED' ELSE 'INSUFFICIENT' END, count(*), sum(n_added), sum(n_removed), 0, 0 FROM tr""")
def evolution_report(spark: SparkSession, sf: str) -> DataFrame:
    cols = ("qualification", F.col("transition_count").alias("transitions"), F.col("added_dependency_count").alias("added"), F.col("removed_dependency_count").alias("removed"), F.col("new_break_count").alias("new_breaks"), F.col("new_orphan_count").alias("new_orphans"))
    return _union(*(_evolution(spark, sf, bad).summary.select(F.lit(name).alias("run"), *cols) for name, bad in (("tampered", True), ("clean", False))))


# The registry's verbs

BOOKS: dict[tuple[str, str], str] = {}
SUPPLIER = {"fields": {"s_suppkey": {"type": "integer"}, "s_name": {"type": "string"}, "s_nationkey": {"type": "integer"}, "s_acctbal": {"type": "number"}}}
SUPPLIER_RULES = {"fields": {"s_suppkey": {"types": ["integer"], "unique": True}, "s_name": {"types": ["string"]}, "s_nationkey": {"types": ["integer"]}, "s_acctbal": {"types": ["number"], "nullable": True, "max_missing_rate": 0.05}}, "max_rows": 10_000_000}


def _book(spark: SparkSession, sf: str) -> Registry:
    """A registry of region, nation and two versions of supplier, made by its verbs once a session and folder.

    The second version lacks the balances under zero and repeats every fifth supplier.
    """
    key = spark.sparkContext.applicationId, sf
    if key in BOOKS:
        return Registry(spark, BOOKS[key])
    reg = Registry(spark, f"{shared_folder(spark)}/{key[0]}/registry-{uuid.uuid4().hex}")
    src = reg.create_source("tables", "parquet", uri=sf).source_id
    ids = {}
    for name, schema in (("region", None), ("nation", {"fields": {"n_nationkey": {"type": "integer"}, "n_name": {"type": "string"}, "n_regionkey": {"type": "string"}}}), ("supplier", SUPPLIER)):
        data = reg.create_dataset(name, schema=schema).dataset_id
        rows = _t(spark, sf, name)
        ids[name] = [reg.create_version(data, src, rows, index_col=None).version_id]
        if name == "supplier":
            later = rows.withColumn("s_acctbal", F.expr("CASE WHEN s_acctbal >= 0 THEN s_acctbal END"))
            ids[name].append(reg.create_version(data, src, later.unionByName(later.where("s_suppkey % 5 = 0"))).version_id)
            contract = reg.create_data_contract(data, "balances", SUPPLIER_RULES).contract_id
            for v in ids[name]:
                reg.create_contract_report(contract, v)
            for _ in range(2):  # the second request finds the first one's report
                reg.create_drift_report(*ids[name])
    reg.create_lineage_link(ids["region"][0], ids["nation"][0], "JOINED_FROM")
    for _ in range(2):
        reg.create_lineage_link(ids["nation"][0], ids["supplier"][0], "JOINED_FROM")
    BOOKS[key] = reg.tables.root
    return reg


SECOND = """b AS (SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS bal FROM supplier), v2 AS (SELECT * FROM b UNION ALL SELECT * FROM b WHERE s_suppkey % 5 = 0), c AS (SELECT (SELECT count(*) FROM supplier) AS n1, count(*) AS n2, count(DISTINCT s_suppkey) AS u2, count(*) - count(bal) AS gaps FROM v2)"""


@query(f"""WITH {SECOND} SELECT 'region' AS dataset, 1 AS version_number, CAST(NULL AS BIGINT) AS previous, count(*) AS records, 1 AS versions FROM region UNION ALL SELECT 'nation', 1, NULL, count(*), 1 FROM nation UNION ALL SELECT 'supplier', 1, NULL, n1, 2 FROM c UNION ALL SELECT 'supplier', 2, 1, n2, 2 FROM c""")
def version_numbering(spark: SparkSession, sf: str) -> DataFrame:
    reg = _book(spark, sf)
    versions = reg.tables.read("versions")
    before = versions.select(F.col("version_id").alias("previous_version_id"), F.col("version_number").alias("previous"))
    counts = versions.groupBy("dataset_id").agg(F.count("*").cast("int").alias("versions"))
    named = reg.tables.read("datasets").select("dataset_id", F.col("name").alias("dataset"))
    got = versions.join(before, "previous_version_id", "left").join(counts, "dataset_id").join(named, "dataset_id")
    return got.select("dataset", F.col("version_number").cast("int").alias("version_number"), "previous", F.col("record_count").alias("records"), "versions")


@query(f"""WITH {SECOND} SELECT 'region' AS dataset, 1 AS version_number, 'PASS' AS missing, 'PASS' AS duplicates, 'INSUFFICIENT' AS schema, 'PASS' AS provenance, 'INSUFFICIENT' AS verdict WHERE EXISTS (SELECT 1 FROM region) UNION ALL SELECT 'nation', 1, 'PASS', 'PASS', 'FAIL', 'PASS', 'REJECTED' WHERE EXISTS (SELECT 1 FROM nation)
UNION ALL SELECT 'supplier', 1, 'PASS', 'PASS', 'PASS', 'PASS', 'VERIFIED' FROM c UNION ALL SELECT 'supplier', 2, CASE WHEN gaps > 0 THEN 'FAIL' ELSE 'PASS' END, CASE WHEN n2 > u2 THEN 'FAIL' ELSE 'PASS' END, CASE WHEN gaps > 0 THEN 'FAIL' ELSE 'PASS' END, 'PASS', CASE WHEN gaps > 0 OR n2 > u2 THEN 'REJECTED' ELSE 'VERIFIED' END FROM c""")
def registry_quality(spark: SparkSession, sf: str) -> DataFrame:
    """The first evaluations that the registry made."""
    reg = _book(spark, sf)
    versions = reg.tables.read("versions").select("version_id", "dataset_id", F.col("version_number").cast("int").alias("version_number"))
    named = reg.tables.read("datasets").select("dataset_id", F.col("name").alias("dataset"))
    return Q.latest(reg.tables.read("evaluations"), ["version_id"], ["sequence"]).join(versions, "version_id").join(named, "dataset_id").select("dataset", "version_number", "missing", "duplicates", "schema", "provenance", "verdict")


@query("""WITH h AS (SELECT 'region' AS dataset, sha256('{"r_name":"' || r_name || '","r_regionkey":' || r_regionkey || '}') AS h FROM region UNION ALL SELECT 'nation', sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') FROM nation),
leaf AS (SELECT dataset, h[1:6] AS leaf, sha256(string_agg(h, '' ORDER BY h)) AS d FROM h GROUP BY ALL), branch AS (SELECT dataset, leaf[1:3] AS leaf, sha256(string_agg(d, '' ORDER BY leaf)) AS d FROM leaf GROUP BY dataset, leaf[1:3])
SELECT dataset, sha256(string_agg(d, '' ORDER BY leaf)) AS content_hash, true AS valid FROM branch GROUP BY dataset""")
def registry_content_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Stored content hashes of two tables, and whether their chains verify."""
    reg, out = _book(spark, sf), []
    for r in reg.tables.read("datasets").where("name in ('region', 'nation')").collect():
        v = reg.list("versions", dataset_id=r.dataset_id).first()
        out.append((r.name, v.content_hash, reg.verify_provenance(v.version_id).valid))
    return spark.createDataFrame(out, "dataset string, content_hash string, valid boolean")


@query(f"""WITH {SECOND}, d AS (SELECT *, list_filter([CASE WHEN abs(round((n2 - n1) / CAST(n1 AS DOUBLE), 12)) > 0.1 THEN 'row_count_change_exceeds_threshold' END, CASE WHEN round(gaps / CAST(n2 AS DOUBLE), 12) > 0.05 THEN 'missing_rate_change_exceeds_threshold' END, CASE WHEN round((n2 - u2) / CAST(n2 AS DOUBLE), 12) > 0.05 THEN 'duplicate_rate_change_exceeds_threshold' END], lambda x: x IS NOT NULL) AS tr,
 list_filter([CASE WHEN n2 > u2 THEN 'duplicate_rate_exceeded' END, CASE WHEN gaps > 0.05 * n2 THEN 'missing_rate_exceeded:s_acctbal' END, CASE WHEN n2 > u2 THEN 'uniqueness_violated:s_suppkey' END], lambda x: x IS NOT NULL) AS co FROM c)
SELECT 'drift' AS report, CASE WHEN len(tr) > 0 THEN 'DRIFTED' ELSE 'STABLE' END AS verdict, array_to_string(tr, ',') AS details FROM d UNION ALL SELECT 'contract', 'COMPATIBLE', '' FROM d UNION ALL SELECT 'contract', CASE WHEN len(co) > 0 THEN 'VIOLATION' ELSE 'COMPATIBLE' END, array_to_string(co, ',') FROM d""")
def registry_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Drift and contract reports as stored."""
    reg = _book(spark, sf)
    drift = reg.tables.read("drift_reports").select(F.lit("drift").alias("report"), "verdict", F.array_join("triggers", ",").alias("details"))
    said = F.transform("violations", lambda v: F.concat_ws(":", v["code"], v["field"]))
    return drift.unionByName(reg.tables.read("contract_reports").select(F.lit("contract").alias("report"), "verdict", F.array_join(said, ",").alias("details")))


@query("""SELECT * FROM (VALUES ('SOURCE_CREATED', 1), ('DATASET_CREATED', 3), ('VERSION_CREATED', 4), ('QUALITY_EVALUATED', 4), ('DATA_CONTRACT_CREATED', 1), ('CONTRACT_REPORT_CREATED', 2), ('DRIFT_REPORT_CREATED', 1), ('LINEAGE_LINK_CREATED', 2)) t(action, n) WHERE (SELECT count(*) FROM supplier) > 0""")
def idempotent_append(spark: SparkSession, sf: str) -> DataFrame:
    """Audit events by action: a report or link that is asked for twice is made and logged once."""
    return _book(spark, sf).tables.read("audit").groupBy("action").agg(F.count("*").cast("int").alias("n"))


@query("SELECT 'supplier' AS dataset, unnest([2, 1]) AS version_number, unnest([1, 2]) AS place UNION ALL SELECT 'nation', 1, 1")
def list_paginated(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of one version each, as the registry lists them: newest first."""
    reg, out = _book(spark, sf), []
    for d in reg.list("datasets", limit=2, offset=1).collect():
        for place in range(1, reg.get_dataset(d.dataset_id)["version_count"] + 1):
            out += [(d.name, int(r.version_number), place) for r in reg.list("versions", limit=1, offset=place - 1, dataset_id=d.dataset_id).collect()]
    return spark.createDataFrame(out, "dataset string, version_number int, place int")


@query("SELECT CAST(unnest([2, 1]) AS BIGINT) AS version_number, 'VERSION_CREATED' AS action, unnest([n + CAST(ceil(n / 5.0) AS BIGINT), n]) AS records FROM (SELECT count(*) AS n FROM supplier)")
def audit_filter(spark: SparkSession, sf: str) -> DataFrame:
    """The audit events of the suppliers' versions, filtered by action, kind and resource."""
    reg = _book(spark, sf)
    data = reg.tables.one("datasets", name="supplier").dataset_id
    found = []
    for v in reg.list("versions", dataset_id=data).collect():  # two
        found.append(reg.list_audit("VERSION_CREATED", "dataset_version", v.version_id).select(F.lit(v.version_number).cast("long").alias("version_number"), "action", F.get_json_object("details", "$.record_count").cast("long").alias("records")))
    return _union(*found)
