"""Distribution and association queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkeda.operators import associations as assoc
from sparkeda.operators import distributions as dist
from sparkeda.plans.registry import query, table


_SHAPE = """
SELECT '{c}' AS "column", n, round(g1, 4) AS skew, round(g2, 4) AS kurtosis, CASE WHEN lo = hi THEN 'constant' WHEN abs(g1) < .5 AND g2 <= -.9 THEN 'uniform' WHEN abs(g1) < .5 AND g2 < 3 THEN 'bell' WHEN g1 >= 1 THEN 'right_skewed' WHEN g1 <= -1 THEN 'left_skewed' WHEN abs(g1) < .5 THEN 'symmetric' ELSE 'mildly_skewed' END AS label,
 round(zero / n::DOUBLE, 6) AS zero_rate, round(top / n::DOUBLE, 6) AS top_share, g2 >= 3 AS heavy_tail FROM (
 SELECT count(*) AS n, sum((x - m)**3) / count(*) / power(sum((x - m)**2) / count(*), 1.5) AS g1, kurtosis_pop(x) AS g2, min(x) AS lo, max(x) AS hi, count(*) FILTER (x = 0) AS zero, (SELECT max(k) FROM (SELECT count(*) AS k FROM {t} GROUP BY {c})) AS top
 FROM (SELECT {c}::DOUBLE AS x, avg({c}::DOUBLE) OVER () AS m FROM {t}))"""


@query(" UNION ALL ".join(_SHAPE.format(c=c, t=t) for t, c in (("lineitem", "l_extendedprice"), ("lineitem", "l_discount"), ("events", "value"))))
def shape_labels(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return dist.shape(li, "l_extendedprice").unionByName(dist.shape(li, "l_discount")).unionByName(dist.shape(table(spark, sf_dir, "events"), "value"))


_TWO = "CASE WHEN p_partkey % 3 = 0 THEN p_retailprice + 5000 ELSE p_retailprice END"


@query(
    f"WITH v AS (SELECT {_TWO} AS x, count(*) AS n FROM part GROUP BY 1), g AS (SELECT x, n, lead(x) OVER (ORDER BY x) AS nxt, lead(x) OVER (ORDER BY x) - x AS gap, sum(n) OVER (ORDER BY x) AS below FROM v), "
    "s AS (SELECT median(gap) FILTER (gap > 0) AS typical, max(x) - min(x) AS r, sum(n) AS total FROM g), b AS (SELECT * FROM g WHERE gap IS NOT NULL ORDER BY gap DESC, x LIMIT 1) "
    "SELECT total::BIGINT AS n, false AS used_log, round(gap, 6) AS gap, round(x, 6) AS low, round(nxt, 6) AS high, below::BIGINT AS n_below, gap >= 2.5 * typical AND gap >= .1 * r AND least(below, total - below) >= greatest(4, .15 * total) AS is_multimodal FROM b, s"
)
def modality_gap(spark, sf_dir):
    return dist.modality_gap(table(spark, sf_dir, "part").select(F.expr(_TWO).alias("x")), "x")


@query("WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT least(floor((l_extendedprice - lo) / ((hi - lo) / 24)), 23)::INTEGER AS bin, count(*) AS n FROM lineitem, e GROUP BY 1")
def histogram_numeric(spark, sf_dir):
    return dist.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 24)


@query("WITH q AS (SELECT quantile_cont(value, .25) AS q1, quantile_cont(value, .5) AS median, quantile_cont(value, .75) AS q3 FROM events), f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM q) SELECT round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, round(low, 4) AS low, round(high, 4) AS high, count(*) AS n, count(*) FILTER (value < low OR value > high) AS n_outside FROM events, f GROUP BY ALL")
def box_stats(spark, sf_dir):
    return dist.box(table(spark, sf_dir, "events"), "value")


@query("WITH c AS (SELECT source AS label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS k FROM documents GROUP BY source), s AS (SELECT CASE WHEN k <= 15 THEN label ELSE '(other)' END AS label, sum(n)::BIGINT AS n FROM c GROUP BY 1) SELECT label, n, round(n / (SELECT sum(n) FROM c), 6) AS rate FROM s")
def category_frequency(spark, sf_dir):
    return dist.category_frequency(table(spark, sf_dir, "documents"), "source")


@query("SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS period, count(*) AS n, 'month' AS unit FROM orders GROUP BY 1")
def timeline_counts(spark, sf_dir):
    return dist.timeline(table(spark, sf_dir, "orders"), "o_orderdate")


def _ks_sql(t: str, c: str, law: str) -> str:
    cdf = {"uniform": "(x - lo) / (hi - lo)", "expon": "1 - exp(-x / m)"}[law]
    log_l = {"uniform": "-t * ln(hi - lo)", "expon": "-t * (ln(m) + 1)"}[law]
    k = 1 if law == "expon" else 2
    return f"WITH v AS (SELECT {c}::DOUBLE AS x, count(*) AS n FROM {t} GROUP BY 1), f AS (SELECT sum(n) AS t, sum(n * x) / sum(n) AS m, sqrt(greatest(sum(n * x * x) / sum(n) - (sum(n * x) / sum(n))**2, 0)) AS sd, min(x) AS lo, max(x) AS hi FROM v), s AS (SELECT *, sum(n) OVER (ORDER BY x) AS c, {cdf} AS p FROM v, f) SELECT '{law}' AS law, t::BIGINT AS n, round(m, 6) AS location, round(sd, 6) AS scale, round(max(greatest(abs(c / t - p), abs(p - (c - n) / t))), 6) AS ks, round({2 * k} - 2 * ({log_l}), 3) AS aic FROM s GROUP BY t, m, sd, lo, hi"


@query(_ks_sql("lineitem", "l_quantity", "uniform"))
def ks_uniform(spark, sf_dir):
    return dist.ks_distance(table(spark, sf_dir, "lineitem"), "l_quantity", "uniform")


@query(_ks_sql("events", "value", "expon"))
def ks_expon(spark, sf_dir):
    return dist.ks_distance(table(spark, sf_dir, "events"), "value", "expon")


@query()
def ks_normal(spark, sf_dir):
    return dist.ks_distance(table(spark, sf_dir, "events"), "value", "norm")


@query()
def family_fit(spark, sf_dir):
    return dist.family_fit(table(spark, sf_dir, "events"), "value")


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PAIRS = [(a, b) for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]]


@query(" UNION ALL ".join(f"SELECT '{a}' AS first, '{b}' AS second, count(*) AS n, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in _PAIRS))
def assoc_pearson(spark, sf_dir):
    return assoc.pearson(table(spark, sf_dir, "lineitem"), _NUM)


def _ranked(t: str, cols: list[str]) -> str:
    return "(SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in cols) + f" FROM {t})"


@query(" UNION ALL ".join(f"SELECT '{a}' AS first, '{b}' AS second, count(*) AS n, round(corr({a}, {b}), 6) AS rho FROM {_ranked('lineitem', _NUM)}" for a, b in _PAIRS))
def assoc_spearman(spark, sf_dir):
    return assoc.spearman(table(spark, sf_dir, "lineitem"), _NUM)


def chi2_sql(t: str, a: str, b: str, corrected: bool) -> str:
    base = f"SELECT sum(n) AS n, count(DISTINCT a)::DOUBLE AS r, count(DISTINCT b)::DOUBLE AS c, sum(n * n / (na * nb)::DOUBLE) - 1 AS phi2 FROM (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb FROM (SELECT {a} AS a, {b} AS b, count(*) AS n FROM {t} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2))"
    v = "sqrt(greatest(0, phi2 - (c - 1) * (r - 1) / (n - 1)) / (least(r - (r - 1)**2 / (n - 1), c - (c - 1)**2 / (n - 1)) - 1))" if corrected else "sqrt(phi2 / (least(r, c) - 1))"
    return f"SELECT '{a}' AS first, '{b}' AS second, n::BIGINT AS n, round(least(1, {v}), 6) AS strength FROM ({base})"


@query(chi2_sql("lineitem", "l_returnflag", "l_linestatus", True) + " UNION ALL " + chi2_sql("documents", "lang", "source", True))
def assoc_cramers_v(spark, sf_dir):
    return assoc.cramers_v(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus").unionByName(assoc.cramers_v(table(spark, sf_dir, "documents"), "lang", "source"))


def eta_sql(t: str, value: str, group: str) -> str:
    return f"SELECT count(*) AS n, count(DISTINCT g)::BIGINT AS groups, sum((gm - m)**2) / sum((x - m)**2) AS eta2 FROM (SELECT x, g, avg(x) OVER (PARTITION BY g) AS gm, avg(x) OVER () AS m FROM (SELECT {value}::DOUBLE AS x, {group} AS g FROM {t} WHERE {value} IS NOT NULL AND {group} IS NOT NULL))"


@query(f"SELECT 'o_totalprice' AS value, 'o_orderpriority' AS \"group\", n, round(sqrt(eta2), 5) AS eta FROM ({eta_sql('orders', 'o_totalprice', 'o_orderpriority')}) UNION ALL SELECT 'o_totalprice', 'o_orderstatus', n, round(sqrt(eta2), 5) FROM ({eta_sql('orders', 'o_totalprice', 'o_orderstatus')})")
def assoc_correlation_ratio(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return assoc.correlation_ratio(o, "o_totalprice", "o_orderpriority").unionByName(assoc.correlation_ratio(o, "o_totalprice", "o_orderstatus"))


@query(
    f"SELECT 'c_custkey' AS first, 'c_acctbal' AS second, round(abs(corr(c_custkey, c_acctbal)), 6) AS strength, 'spearman' AS method FROM {_ranked('customer', ['c_custkey', 'c_acctbal'])} "
    + "".join(f"UNION ALL SELECT '{v}', 'c_mktsegment', round(sqrt(eta2), 5), 'correlation_ratio' FROM ({eta_sql('customer', v, 'c_mktsegment')}) " for v in ("c_custkey", "c_acctbal"))
)
def assoc_matrix(spark, sf_dir):
    return assoc.association_matrix(table(spark, sf_dir, "customer"), ["c_custkey", "c_acctbal"], ["c_mktsegment"])


@query(
    "WITH t AS (SELECT DISTINCT epoch_us(o_orderdate) AS t FROM orders), g AS (SELECT t, lead(t) OVER (ORDER BY t) - t AS gap FROM t), m AS (SELECT median(gap) AS typical, max(gap) AS mx, count(*) AS d FROM g), "
    "b AS (SELECT count(*) FILTER (back) AS n_backward FROM (SELECT epoch_us(o_orderdate) < lag(epoch_us(o_orderdate)) OVER (ORDER BY o_orderkey, o_orderdate) AS back FROM orders)) "
    "SELECT (SELECT count(*) FROM orders) AS n, d AS n_distinct, round((SELECT (max(t) - min(t)) / 86400e6 FROM t), 6) AS span_days, round(typical / 1e6, 3) AS median_gap_s, round(mx / 1e6, 3) AS max_gap_s, (SELECT count(*) FROM g WHERE gap > 3 * typical) AS n_wide_gaps, n_backward FROM m, b"
)
def time_coverage_gaps(spark, sf_dir):
    return assoc.time_coverage(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey")


@query("SELECT 'c_custkey' AS \"column\" UNION ALL SELECT 'c_name'")
def all_unique_columns(spark, sf_dir):
    from sparkeda.operators.catalog import column_catalog

    return column_catalog(table(spark, sf_dir, "customer").drop("c_acctbal"), "customer").where("n_distinct = n_rows").select("column")


@query("SELECT label, n, round(n / t, 6) AS rate FROM (SELECT role AS label, count(*) AS n, sum(count(*)) OVER () AS t FROM conversations GROUP BY role) ORDER BY n DESC, label LIMIT 1")
def dominant_label(spark, sf_dir):
    return dist.category_frequency(table(spark, sf_dir, "conversations"), "role").orderBy(F.desc("n"), "label").limit(1)
