"""Key and relationship queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkeda.operators import schema as op
from sparkeda.plans.registry import query, table

FKS = (
    ("nation", "n_nationkey", "customer", "c_nationkey"), ("region", "r_regionkey", "nation", "n_regionkey"), ("nation", "n_nationkey", "supplier", "s_nationkey"), ("customer", "c_custkey", "orders", "o_custkey"),
    ("orders", "o_orderkey", "lineitem", "l_orderkey"), ("part", "p_partkey", "lineitem", "l_partkey"), ("supplier", "s_suppkey", "lineitem", "l_suppkey"), ("documents", "doc_id", "labels", "doc_id"),
)


def _key_sql(t: str, key: tuple[str, ...]) -> str:
    full = " AND ".join(f"{c} IS NOT NULL" for c in key)
    d = f"count(DISTINCT ({', '.join(key)})) FILTER ({full})"
    return f"SELECT '{','.join(key)}' AS key, count(*) AS n_rows, count(*) FILTER ({full}) AS n_complete, {d} AS n_distinct, round(count(*) FILTER ({full}) / count(*)::DOUBLE, 6) AS completeness, round({d} / (count(*) FILTER ({full}))::DOUBLE, 6) AS uniqueness FROM {t}"


@query(_key_sql("lineitem", ("l_orderkey",)) + " UNION ALL " + _key_sql("lineitem", ("l_orderkey", "l_linenumber")) + " UNION ALL " + _key_sql("conversations", ("conv_id", "turn")))
def key_metrics(spark, sf_dir):
    return op.key_metrics(table(spark, sf_dir, "lineitem"), [("l_orderkey",), ("l_orderkey", "l_linenumber")]).unionByName(op.key_metrics(table(spark, sf_dir, "conversations"), [("conv_id", "turn")]))


@query("SELECT 'event_id' AS key, 'events' AS \"table\", 1.0::DOUBLE AS uniqueness, 1.0::DOUBLE AS confidence UNION ALL SELECT 'doc_id', 'documents', 1.0, 0.97")
def composite_key_search(spark, sf_dir):
    found = op.key_candidates(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "events") + op.key_candidates(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "documents")
    return spark.createDataFrame([(k["key"], k["table"], k["uniqueness"], k["confidence"]) for k in found], "key string, `table` string, uniqueness double, confidence double")


def _fk_sql(p: str, pk: str, c: str, ck: str) -> str:
    return (
        f"SELECT '{p}' AS parent, '{c}' AS child, count({ck}) AS child_rows, count(DISTINCT {ck}) AS child_keys, round(count(DISTINCT {ck}) FILTER ({ck} IN (SELECT {pk} FROM {p})) / count(DISTINCT {ck})::DOUBLE, 6) AS inclusion, "
        f"round(count(*) FILTER ({ck} IN (SELECT {pk} FROM {p})) / count({ck})::DOUBLE, 6) AS row_coverage, count(*) FILTER ({ck} NOT IN (SELECT {pk} FROM {p})) AS orphan_rows, (SELECT count(DISTINCT {pk}) FROM {p} WHERE {pk} NOT IN (SELECT {ck} FROM {c})) AS unreferenced_parents, round(count(DISTINCT {ck}) / count({ck})::DOUBLE, 6) AS child_uniqueness FROM {c}"
    )


@query(" UNION ALL ".join(_fk_sql(*fk) for fk in FKS))
def fk_metrics(spark, sf_dir):
    out = None
    for p, pk, c, ck in FKS:
        one = op.relationship_metrics(table(spark, sf_dir, p), (pk,), table(spark, sf_dir, c), (ck,)).select(F.lit(p).alias("parent"), F.lit(c).alias("child"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)")
def orphan_rows(spark, sf_dir):
    return op.orphans(table(spark, sf_dir, "customer").where("c_custkey % 10 <> 0"), "c_custkey", table(spark, sf_dir, "orders"), "o_custkey").select("o_orderkey", "o_custkey")


@query(
    "WITH e(parent, child) AS (VALUES " + ", ".join(f"('{p}', '{c}')" for p, _, c, _ in FKS) + "), t AS (SELECT DISTINCT unnest([parent, child]) AS \"table\" FROM e), "
    "d AS (SELECT t.\"table\", (SELECT count(DISTINCT parent) FROM e WHERE child = t.\"table\") AS n_parents, (SELECT count(DISTINCT child) FROM e WHERE parent = t.\"table\") AS n_children, greatest(3, ceil(.4 * (SELECT count(*) FROM t))) AS hub FROM t) "
    "SELECT \"table\", n_parents, n_children, CASE WHEN n_parents + n_children >= hub THEN 'hub' WHEN n_parents >= 2 AND n_children = 0 THEN 'junction' WHEN n_parents > 0 AND n_children > 0 THEN 'bridge' WHEN n_children > 0 THEN 'dimension' ELSE 'fact' END AS role FROM d"
)
def fk_graph_roles(spark, sf_dir):
    edges = spark.createDataFrame([(p, c) for p, _, c, _ in FKS], "parent string, child string")
    tables = edges.select(F.explode(F.array("parent", "child")).alias("table")).distinct()
    return op.graph_roles(edges, tables)


@query(
    "WITH a AS (SELECT count(DISTINCT o_custkey) AS k, count(DISTINCT o_custkey) FILTER (o_custkey IN (SELECT c_custkey FROM customer)) AS m FROM orders), "
    "b AS (SELECT count(DISTINCT n) AS k, count(DISTINCT n) FILTER (n IN (SELECT c_custkey FROM customer)) AS m FROM (SELECT (o_custkey * 7) % 100 + 1 AS n FROM orders)) "
    "SELECT 'customers' AS parent, 'customer_id' AS parent_key, 'orders' AS child, 'customer_id' AS child_key, round(m / k::DOUBLE, 6) AS inclusion, round(.5 * m / k + .18 + .17 + .15, 6) AS confidence, 'one_to_many' AS cardinality FROM a "
    "UNION ALL SELECT 'customers', 'customer_id', 'orders', 'ship_customer_id', round(m / k::DOUBLE, 6), round(.5 * m / k + .18 + .17 * (2 / 3) + .15, 6), 'one_to_many' FROM b"
)
def relationship_search(spark, sf_dir):
    """Orders refer to one key of customers by two columns."""
    orders = table(spark, sf_dir, "orders").withColumnsRenamed({"o_orderkey": "order_id", "o_custkey": "customer_id"}).withColumn("ship_customer_id", F.expr("(customer_id * 7) % 100 + 1"))
    named = {"customers": table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "customer_id").drop("c_nationkey"), "orders": orders}
    keys = [k for n, df in named.items() for k in op.key_candidates(df, n, 1)]
    rows = [(r["parent"], r["parent_key"], r["child"], r["child_key"], r["inclusion"], r["confidence"], r["cardinality"]) for r in op.relationship_candidates(named, keys)]
    return spark.createDataFrame(rows, "parent string, parent_key string, child string, child_key string, inclusion double, confidence double, cardinality string")
