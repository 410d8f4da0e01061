"""Data-quality queries. The tables are clean, so defects are planted, alike in both."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkeda.operators import quality as op
from sparkeda.plans.registry import query, table

TOKENS = ", ".join(f"'{t}'" for t in op.MISSING_TOKENS)
_SEGMENT = "CASE c_custkey % 7 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN concat(' ', c_mktsegment, ' ') ELSE c_mktsegment END"


@query(f"SELECT label, count(*) AS n_forms, sum(n)::BIGINT AS n_rows, sum(CASE WHEN trim(raw) <> raw THEN n ELSE 0 END)::BIGINT AS n_padded FROM (SELECT raw, lower(trim(raw)) AS label, count(*) AS n FROM (SELECT {_SEGMENT} AS raw FROM customer) GROUP BY raw) GROUP BY label HAVING count(*) > 1")
def quality_case_variants(spark, sf_dir):
    return op.case_variants(table(spark, sf_dir, "customer").select(F.expr(_SEGMENT).alias("segment")), "segment")


_AMOUNT = "CASE WHEN o_orderkey % 50 = 0 THEN 'about 3' WHEN o_orderkey % 60 = 0 THEN NULL ELSE CAST(CAST(o_totalprice AS BIGINT) AS STRING) END"


@query(f"SELECT count(x) AS n_values, count(*) FILTER (regexp_matches(x, '^[0-9]+$')) AS n_numeric, round(count(*) FILTER (regexp_matches(x, '^[0-9]+$')) / count(x)::DOUBLE, 6) AS rate, count(*) FILTER (regexp_matches(x, '^[0-9]+$')) >= 0.95 * count(x) AS is_numeric_text FROM (SELECT {_AMOUNT} AS x FROM orders)")
def quality_numeric_text(spark, sf_dir):
    return op.numeric_text(table(spark, sf_dir, "orders").select(F.expr(_AMOUNT).alias("x")), "x")


_MIXED = "CASE o_orderkey % 5 WHEN 0 THEN '12' WHEN 1 THEN '1.5' WHEN 2 THEN 'true' WHEN 3 THEN '2024-01-05' ELSE o_orderpriority END"


@query(f"SELECT cell_type, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(x, '^[+-]?[0-9]+$') THEN 'integer' WHEN regexp_matches(x, '^[0-9]+[.][0-9]+$') THEN 'float' WHEN x IN ('true', 'false') THEN 'boolean' WHEN regexp_matches(x, '^[0-9]{{4}}-[0-9]') THEN 'date' ELSE 'text' END AS cell_type FROM (SELECT {_MIXED} AS x FROM orders)) GROUP BY cell_type")
def quality_mixed_types(spark, sf_dir):
    return op.cell_types(table(spark, sf_dir, "orders").select(F.expr(_MIXED).alias("x")), "x")


_DAY = "CASE o_orderkey % 4 WHEN 0 THEN {iso} WHEN 1 THEN {dmy} WHEN 2 THEN {mdy} ELSE {dot} END"
_SPARK_DAY = _DAY.format(iso="date_format(o_orderdate, 'yyyy-MM-dd')", dmy="date_format(o_orderdate, 'dd/MM/yyyy')", mdy="date_format(o_orderdate, 'MM/dd/yyyy')", dot="date_format(o_orderdate, 'dd.MM.yyyy')")
_DUCK_DAY = _DAY.format(iso="strftime(o_orderdate, '%Y-%m-%d')", dmy="strftime(o_orderdate, '%d/%m/%Y')", mdy="strftime(o_orderdate, '%m/%d/%Y')", dot="strftime(o_orderdate, '%d.%m.%Y')")


@query(
    f"SELECT layout, count(*) AS n, count(*) FILTER (a > 12) AS n_first_over_12, count(*) FILTER (b > 12) AS n_second_over_12 FROM (SELECT CASE WHEN regexp_matches(x, '^[0-9]{{4}}-') THEN 'iso_date' WHEN x LIKE '%/%' THEN 'dmy_or_mdy_slash' ELSE 'dmy_dot' END AS layout, CASE WHEN x LIKE '%/%' THEN x[1:2]::INT END AS a, CASE WHEN x LIKE '%/%' THEN x[4:5]::INT END AS b FROM (SELECT {_DUCK_DAY} AS x FROM orders)) GROUP BY layout"
)
def quality_date_layouts(spark, sf_dir):
    return op.date_layouts(table(spark, sf_dir, "orders").select(F.expr(_SPARK_DAY).alias("x")), "x")


_HIDDEN = "CASE c_custkey % 11 WHEN 0 THEN ' N/A ' WHEN 1 THEN 'unknown' WHEN 2 THEN NULL WHEN 3 THEN '-' ELSE c_name END"


@query(f"SELECT count(*) AS n_rows, count(*) - count(x) AS n_declared, count(*) FILTER (lower(trim(x)) IN ({TOKENS})) AS n_hidden, round((count(*) - count(x) + count(*) FILTER (lower(trim(x)) IN ({TOKENS}))) / count(*)::DOUBLE, 6) AS effective_rate FROM (SELECT {_HIDDEN} AS x FROM customer)")
def quality_disguised_missing(spark, sf_dir):
    return op.disguised_missing(table(spark, sf_dir, "customer").select(F.expr(_HIDDEN).alias("x")), "x")


_PRICE = "CASE WHEN l_orderkey % 97 = 0 THEN -999.0D ELSE l_extendedprice END"


@query("WITH x AS (SELECT CASE WHEN l_orderkey % 97 = 0 THEN -999.0::DOUBLE ELSE l_extendedprice END AS x FROM lineitem) SELECT x AS sentinel, count(*) AS n, (SELECT min(x) FROM x WHERE x <> -999) AS rest_min FROM x WHERE x = -999 GROUP BY x")
def quality_numeric_sentinel(spark, sf_dir):
    return op.numeric_sentinels(table(spark, sf_dir, "lineitem").select(F.expr(_PRICE).alias("x")), "x")


_WHEN = "CASE o_orderkey % 40 WHEN 0 THEN TIMESTAMP_NTZ'1970-01-01' WHEN 1 THEN TIMESTAMP_NTZ'1700-05-05' WHEN 2 THEN TIMESTAMP_NTZ'2050-01-01' ELSE o_orderdate END"


@query(f"SELECT count(x) AS n, count(*) FILTER (x = '1970-01-01') AS n_sentinel, count(*) FILTER (x < '1800-01-01' OR x > '2125-01-01') AS n_implausible, count(*) FILTER (x > '2025-01-01' AND x <= '2125-01-01') AS n_future FROM (SELECT {_WHEN.replace('TIMESTAMP_NTZ', 'TIMESTAMP ')} AS x FROM orders)")
def quality_invalid_dates(spark, sf_dir):
    return op.invalid_dates(table(spark, sf_dir, "orders").select(F.expr(_WHEN).alias("x")), "x", "2025-01-01")


@query("SELECT count(*) AS n_both, count(*) FILTER (l_shipdate < o_orderdate) AS n_reversed FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def quality_reversed_ranges(spark, sf_dir):
    both = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("ship_start")).join(table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_shipdate").alias("ship_end")), F.col("o_orderkey") == F.col("l_orderkey"))
    (start, end), *_ = op.range_pairs(both.columns)
    return op.reversed_ranges(both, start, end)


@query("SELECT 'l_quantity' AS first, 'copy' AS second, count(*) AS n_rows FROM lineitem")
def quality_aliased_columns(spark, sf_dir):
    return op.aliased_columns(table(spark, sf_dir, "lineitem").withColumn("copy", F.col("l_quantity")))


_HOLES = ("l_quantity", "l_tax", "l_discount")


def with_holes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", *[F.expr(f"CASE WHEN l_orderkey % {k} = 0 THEN NULL ELSE {c} END").alias(c) for c, k in zip(_HOLES, (7, 14, 5), strict=True)])


HOLES_SQL = "(SELECT l_orderkey, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity, CASE WHEN l_orderkey % 14 = 0 THEN NULL ELSE l_tax END AS l_tax, CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_discount END AS l_discount FROM lineitem)"


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_missing, round((count(*) - count({c})) / count(*)::DOUBLE, 6) AS rate FROM {HOLES_SQL}" for c in ("l_orderkey", *_HOLES)))
def missing_rates(spark, sf_dir):
    return op.missing_rates(with_holes(spark, sf_dir))


@query(" UNION ALL ".join(f"SELECT '{a}' AS first, '{b}' AS second, count(*) FILTER ({a} IS NULL AND {b} IS NULL) AS n_both, count(*) FILTER ({a} IS NULL OR {b} IS NULL) AS n_either, round(count(*) FILTER ({a} IS NULL AND {b} IS NULL) / (count(*) FILTER ({a} IS NULL OR {b} IS NULL))::DOUBLE, 6) AS jaccard FROM {HOLES_SQL}" for a, b in (("l_quantity", "l_tax"), ("l_quantity", "l_discount"), ("l_tax", "l_discount"))))
def co_missingness(spark, sf_dir):
    return op.co_missing(with_holes(spark, sf_dir), list(_HOLES))


@query("SELECT 'status' AS \"column\", count(*) AS n_values FROM orders")
def constant_columns(spark, sf_dir):
    return op.constant_columns(table(spark, sf_dir, "orders").withColumn("status", F.lit("open")))
