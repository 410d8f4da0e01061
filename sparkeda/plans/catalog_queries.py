"""Catalogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkeda.operators import catalog as op
from sparkeda.plans.registry import query, table

# Column names and kinds of the standard tables, for the SQL only.
SCHEMAS = {
    "lineitem": "l_orderkey numeric, l_partkey numeric, l_suppkey numeric, l_linenumber numeric, l_quantity numeric, l_extendedprice numeric, l_discount numeric, l_tax numeric, l_returnflag string, l_linestatus string, l_shipdate datetime",
    "customer": "c_custkey numeric, c_name string, c_nationkey numeric, c_acctbal numeric, c_mktsegment string",
    "events": "event_id numeric, ts datetime, user_id numeric, event_type string, value numeric, props string",
}


def catalog_sql(name: str) -> str:
    parts = []
    for c, kind in (x.split() for x in SCHEMAS[name].split(", ")):
        sem = f"'{kind}'" if kind != "string" else "CASE WHEN d <= 50 OR (d <= 200 AND d <= 0.05 * v) THEN 'categorical' ELSE 'text' END"
        roles = []
        if kind == "datetime" or any(t in c for t in ("date", "time")):
            roles.append("'timestamp_candidate'")
        if c.endswith("_id"):
            roles.append("CASE WHEN d / v::DOUBLE >= 0.98 AND n = v THEN 'identifier_candidate' END")
        if kind == "numeric":
            roles.append("'measure_candidate'")
        if kind == "string":
            roles.append("CASE sem WHEN 'categorical' THEN 'dimension_candidate' ELSE 'free_text_candidate' END")
        parts.append(
            f"SELECT '{name}' AS \"table\", '{c}' AS \"column\", '{kind}' AS kind, n AS n_rows, n - v AS n_missing, round((n - v) / n::DOUBLE, 6) AS missing_rate, d AS n_distinct, round(d / v::DOUBLE, 6) AS unique_rate, sem AS semantic_type, "
            f"concat_ws(',', {', '.join(roles)}) AS roles, concat_ws(',', CASE WHEN n - v >= 0.5 * n THEN 'mostly_missing' END, CASE WHEN d <= 1 THEN 'constant' END, CASE WHEN sem = 'categorical' AND d > 100 THEN 'high_cardinality' END) AS warnings "
            f"FROM (SELECT *, {sem} AS sem FROM (SELECT count(*) AS n, count({c}) AS v, count(DISTINCT {c}) AS d FROM {name}))"
        )
    return " UNION ALL ".join(parts)


@query(catalog_sql("lineitem"))
def catalog_columns(spark, sf_dir):
    return op.column_catalog(table(spark, sf_dir, "lineitem"), "lineitem")


@query(catalog_sql("customer") + " UNION ALL " + catalog_sql("events"))
def catalog_roles(spark, sf_dir):
    return op.column_catalog(table(spark, sf_dir, "customer"), "customer").unionByName(op.column_catalog(table(spark, sf_dir, "events"), "events"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n_rows, {n}::BIGINT AS n_columns, (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t}))) AS n_duplicates, 0::BIGINT AS n_missing FROM {t}" for t, n in (("lineitem", 11), ("customer", 5), ("labels", 3), ("nation", 3))))
def catalog_tables(spark, sf_dir):
    out = None
    for name in ("lineitem", "customer", "labels", "nation"):
        one = op.table_catalog(table(spark, sf_dir, name), name)
        out = one if out is None else out.unionByName(one)
    return out


def _stats_sql(source: str, columns: list[str]) -> str:
    one = "SELECT '{c}' AS \"column\", count({c}) AS n, round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(quantile_cont({c}::DOUBLE, 0.05), 4) AS p5, round(quantile_cont({c}::DOUBLE, 0.25), 4) AS q1, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS median, round(quantile_cont({c}::DOUBLE, 0.75), 4) AS q3, round(quantile_cont({c}::DOUBLE, 0.95), 4) AS p95, round(skewness({c}), 4) AS skew, round(kurtosis({c}), 4) AS kurtosis, count(*) FILTER ({c} = 0) AS n_zero, count(*) FILTER ({c} < 0) AS n_negative, 0::BIGINT AS n_infinite FROM {t}"
    return " UNION ALL ".join(one.format(c=c, t=source) for c in columns)


@query(_stats_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def numeric_stats(spark, sf_dir):
    return op.numeric_statistics(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query("SELECT count(o_orderdate) AS n, min(o_orderdate) AS min, max(o_orderdate) AS max, count(DISTINCT o_orderdate) AS n_distinct FROM orders")
def datetime_stats(spark, sf_dir):
    return op.datetime_statistics(table(spark, sf_dir, "orders"), "o_orderdate")


@query("SELECT count(text) AS n, min(length(text))::INTEGER AS min_length, max(length(text))::INTEGER AS max_length, round(avg(length(text)), 4) AS mean_length FROM documents")
def text_stats(spark, sf_dir):
    return op.text_statistics(table(spark, sf_dir, "documents"), "text")


@query("SELECT value, n FROM (SELECT source AS value, count(*) AS n FROM documents GROUP BY source) ORDER BY n DESC, value NULLS LAST LIMIT 10")
def top_values(spark, sf_dir):
    return op.top_values(table(spark, sf_dir, "documents"), "source")


@query("SELECT count(*) - count(DISTINCT (text, lang)) AS n_duplicate_rows FROM documents WHERE text IS NOT NULL")
def duplicate_rows(spark, sf_dir):
    groups = op.duplicate_groups(table(spark, sf_dir, "documents").where("text IS NOT NULL"), ["text", "lang"])
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicate_rows"))


@query("SELECT md5(text) AS text_md5, lang, count(*) AS n FROM documents GROUP BY text, lang HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    return op.duplicate_groups(table(spark, sf_dir, "documents"), ["text", "lang"]).select(F.md5("text").alias("text_md5"), "lang", "n")


@query("(SELECT conv_id, turn, role, 'head' AS part FROM conversations ORDER BY conv_id, turn LIMIT 10) UNION ALL (SELECT conv_id, turn, role, 'tail' AS part FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 10)")
def sample_head_tail(spark, sf_dir):
    return op.head_and_tail(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"], 10)


@query()
def seeded_sample(spark, sf_dir):
    return op.seeded_sample(table(spark, sf_dir, "orders"), 1000, ["o_orderkey"])


@query("SELECT * FROM (VALUES ('c_custkey', 'numeric', ''), ('c_nationkey', 'numeric', ''), ('c_acctbal', 'numeric', ''), ('c_name', 'none', 'high_cardinality')) t(\"column\", use, reason)")
def feature_admission(spark, sf_dir):
    return op.feature_admission(table(spark, sf_dir, "customer"), "c_mktsegment")
