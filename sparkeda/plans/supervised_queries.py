"""Classification and regression queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkeda.operators import associations as assoc
from sparkeda.operators import supervised as op
from sparkeda.plans.profile_queries import _ranked, chi2_sql, eta_sql
from sparkeda.plans.registry import query, table


@query("SELECT *, round(h, 6) AS entropy FROM (SELECT label, n, round(n / t, 6) AS share, round(mx / mn::DOUBLE, 6) AS imbalance, k, hh / log2(k) AS h FROM (SELECT *, sum(-n / t * log2(n / t)) OVER () AS hh, count(*) OVER () AS k FROM (SELECT toxic::VARCHAR AS label, count(*) AS n, sum(count(*)) OVER () AS t, max(count(*)) OVER () AS mx, min(count(*)) OVER () AS mn FROM labels GROUP BY toxic)))".replace("SELECT *, round(h, 6)", "SELECT label, n, share, imbalance, round(h, 6)"))
def target_summary(spark, sf_dir):
    return op.target_classes(table(spark, sf_dir, "labels"), "toxic")


@query(f"SELECT 'o_totalprice' AS value, 'o_orderstatus' AS \"group\", n, groups, round(eta2, 6) AS eta2 FROM ({eta_sql('orders', 'o_totalprice', 'o_orderstatus')})")
def eta_squared(spark, sf_dir):
    return assoc.eta_squared(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderstatus")


@query(chi2_sql("orders", "o_orderpriority", "o_orderstatus", False))
def cramers_v_raw(spark, sf_dir):
    return assoc.cramers_v(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", corrected=False)


_CODE = "CASE o_orderstatus WHEN 'F' THEN 'x1' WHEN 'O' THEN 'x2' ELSE 'x3' END"


@query(
    f"WITH o AS (SELECT o_orderstatus, {_CODE} AS code, o_orderpriority, o_orderstatus AS o_orderstatus_copy FROM orders), m AS (SELECT max(n) / sum(n) AS major FROM (SELECT count(*) AS n FROM o GROUP BY o_orderstatus)) "
    + " UNION ALL ".join(f"SELECT '{f}' AS feature, count(*) AS n_values, round(sum(best) / sum(n), 6) AS accuracy, {'true' if c else 'false'} AS exact_copy, {'true' if c else 'false'} AS named, sum(best) / sum(n) >= .98 AND sum(best) / sum(n) - any_value(major) >= .05 AS suspect FROM (SELECT {f}, max(n) AS best, sum(n) AS n FROM (SELECT {f}, o_orderstatus, count(*) AS n FROM o GROUP BY ALL) GROUP BY {f}), m" for f, c in (("code", 0), ("o_orderpriority", 0), ("o_orderstatus_copy", 1)))
)
def value_rule_leakage(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderstatus", F.expr(_CODE).alias("code"), "o_orderpriority", F.col("o_orderstatus").alias("o_orderstatus_copy"))
    return op.leakage(o, "o_orderstatus", ["code", "o_orderpriority", "o_orderstatus_copy"])


@query("SELECT count(*) AS n_groups, coalesce(sum(n), 0)::BIGINT AS n_rows, coalesce(max(k), 0)::BIGINT AS max_labels FROM (SELECT count(*) AS n, count(DISTINCT lang) AS k FROM documents GROUP BY source HAVING k > 1)")
def conflicting_labels(spark, sf_dir):
    return op.conflicting_labels(table(spark, sf_dir, "documents"), "lang", ["source"])


@query("SELECT 'value' AS \"column\", round(min(m), 6) AS low, round(max(m), 6) AS high, max(m) - min(m) >= .2 AS differs FROM (SELECT event_type, avg((value IS NULL)::INT) AS m FROM (SELECT event_type, CASE WHEN event_type = (SELECT min(event_type) FROM events) AND event_id % 2 = 0 THEN NULL ELSE value END AS value FROM events) GROUP BY event_type)")
def missing_by_class(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    first = e.agg(F.min("event_type").alias("t"))
    holed = e.join(F.broadcast(first)).select("event_type", F.when(~((F.col("event_type") == F.col("t")) & (F.col("event_id") % 2 == 0)), F.col("value")).alias("value"))
    return op.missing_by_class(holed, "event_type", ["value"])


@query("SELECT count(*) AS n_entities, count(*) FILTER (n > 1) AS n_repeated, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS rows_of_repeated FROM (SELECT count(*) AS n FROM events GROUP BY user_id)")
def split_guidance_group(spark, sf_dir):
    return op.repeated_entities(table(spark, sf_dir, "events"), "user_id")


@query("WITH r AS (SELECT event_type, row_number() OVER (ORDER BY ts, event_id) AS k, count(*) OVER () AS n FROM events), q AS (SELECT event_type AS label, count(*) FILTER (k <= n // 4) AS a, count(*) FILTER (k > n - n // 4) AS b, any_value(n // 4) AS q FROM r GROUP BY event_type) SELECT label, round(a / q::DOUBLE, 6) AS early, round(b / q::DOUBLE, 6) AS late FROM q")
def split_guidance_time(spark, sf_dir):
    return op.label_shift(table(spark, sf_dir, "events"), "event_type", "ts", "event_id")


@query()
def logistic_probe(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "quality", "n_chars", (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|]", ""))).alias("symbols"))
    return op.logistic_probe(d, "quality", ["n_chars", "symbols"], "doc_id")


@query(
    "WITH d AS (SELECT a.vec_id AS i, a.label AS li, b.label AS lj, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) SELECT i AS vec_id, round(avg((li <> lj)::INT), 6) AS disagreement FROM d WHERE r <= 9 GROUP BY i"
)
def knn_label_overlap(spark, sf_dir):
    return op.neighbour_disagreement(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


_Q = ", ".join(f"round(quantile_cont(o_totalprice, {p}), 4) AS {n}" for p, n in ((0.01, "q01"), (0.05, "q05"), (0.25, "q25"), (0.5, "q50"), (0.75, "q75"), (0.95, "q95"), (0.99, "q99")))


@query(f"SELECT count(*) AS n, {_Q}, round(skewness(o_totalprice), 6) AS skew, round(kurtosis(o_totalprice), 6) AS kurtosis, count(*) FILTER (o_totalprice = 0) AS zero, count(*) FILTER (o_totalprice < 0) AS negative, round(stddev_samp(o_totalprice) / abs(avg(o_totalprice)), 6) AS cv, count(DISTINCT o_totalprice) <= 20 OR count(DISTINCT o_totalprice) < .05 * count(*) AS discrete, round((quantile_cont(o_totalprice, .99) - quantile_cont(o_totalprice, .5)) / (quantile_cont(o_totalprice, .5) - quantile_cont(o_totalprice, .01)), 6) AS tail_ratio FROM orders")
def target_quantiles(spark, sf_dir):
    return op.target_quantiles(table(spark, sf_dir, "orders"), "o_totalprice")


@query("WITH s AS (SELECT skewness(value) AS s0, skewness(ln(1 + value)) AS s1, skewness(sqrt(value)) AS s2 FROM events) SELECT 'none' AS transform, round(s0, 6) AS skew, false AS recommended FROM s UNION ALL SELECT 'log1p', round(s1, 6), abs(s0) - abs(s1) >= .3 AND abs(s1) < .5 FROM s UNION ALL SELECT 'sqrt', round(s2, 6), abs(s0) - abs(s2) >= .3 AND abs(s2) < .5 FROM s")
def target_transforms(spark, sf_dir):
    return op.target_transforms(table(spark, sf_dir, "events"), "value")


@query()
def target_power_transform(spark, sf_dir):
    return op.target_transforms(table(spark, sf_dir, "events"), "value", with_power=True)


@query("WITH c AS (SELECT l_quantity::DOUBLE AS value, count(*) AS n, sum(count(*)) OVER () AS t FROM lineitem GROUP BY 1), x AS (SELECT *, min(value) OVER () AS lo, max(value) OVER () AS hi FROM c) SELECT value, n, round(n / t, 6) AS share, CASE WHEN value = hi THEN 'maximum' WHEN value = 0 THEN 'zero' WHEN value = lo THEN 'minimum' ELSE 'interior' END AS position FROM x WHERE n >= 5 AND n >= .01 * t ORDER BY n DESC, value LIMIT 5")
def target_spikes(spark, sf_dir):
    return op.target_spikes(table(spark, sf_dir, "lineitem"), "l_quantity")


@query("SELECT round(avg((x % 100 = 0)::INT), 6) AS share_100, round(avg((x % 10 = 0)::INT), 6) AS share_10, round(avg((x % 5 = 0)::INT), 6) AS share_5, CASE WHEN avg((x % 100 = 0)::INT) >= .25 THEN 100 WHEN avg((x % 10 = 0)::INT) >= .25 THEN 10 WHEN avg((x % 5 = 0)::INT) >= .25 THEN 5 END AS base FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 37) * 10 ELSE o_orderkey % 997 END AS x FROM orders)")
def target_heaping(spark, sf_dir):
    return op.target_heaping(table(spark, sf_dir, "orders").select(F.expr("CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 37) * 10 ELSE o_orderkey % 997 END").alias("x")), "x")


def _binned_sql(f: str, t: str, src: str, bins: int = 10) -> str:
    qs = ", ".join(str(i / bins) for i in range(bins + 1))
    return f"SELECT '{f}' AS feature, '{t}' AS target, n, groups AS bins, round(eta2, 6) AS eta2 FROM ({eta_sql(f'(SELECT {t}, len(list_filter(e[2:len(e) - 1], lambda v: v <= {f})) AS b FROM {src}, (SELECT list_sort(list_distinct(quantile_cont({f}::DOUBLE, [{qs}]))) AS e FROM {src}))', t, 'b')})"


@query(_binned_sql("l_quantity", "l_extendedprice", "lineitem"))
def binned_eta_squared(spark, sf_dir):
    return assoc.binned_eta_squared(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")


@query(f"SELECT 'l_quantity' AS feature, round((SELECT corr(l_quantity, l_extendedprice) FROM lineitem), 6) AS pearson, round((SELECT corr(l_quantity, l_extendedprice) FROM {_ranked('lineitem', ['l_quantity', 'l_extendedprice'])}), 6) AS spearman")
def feature_association(spark, sf_dir):
    li, cols = table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"]
    return assoc.pearson(li, cols).join(assoc.spearman(li, cols).select("first", "rho"), "first").select(F.col("first").alias("feature"), F.col("r").alias("pearson"), F.col("rho").alias("spearman"))


@query("SELECT 'l_quantity' AS first, 'twice' AS second, count(*) AS n, 1.0::DOUBLE AS r FROM lineitem")
def redundant_pairs(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", (2 * F.col("l_quantity") + 1).alias("twice"))
    return op.redundant_pairs(li, ["l_quantity", "l_discount", "twice"])


@query("WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem) SELECT c AS \"column\", round(1 / (1 - r * r), 4) AS vif, round(sqrt((1 + abs(r)) / (1 - abs(r))), 4) AS condition FROM r, (VALUES ('l_quantity'), ('l_extendedprice')) v(c)")
def vif(spark, sf_dir):
    return op.vif(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"])


_SCORED = "(SELECT l_orderkey, l_returnflag, l_extendedprice AS y, regr_intercept(l_extendedprice, l_quantity) OVER () + regr_slope(l_extendedprice, l_quantity) OVER () * l_quantity AS p FROM lineitem)"


def scored(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    beta, facts = op.linear_fit(li, "l_extendedprice", ["l_quantity"])
    return li.select("l_orderkey", "l_returnflag", F.col("l_extendedprice").alias("y"), op.predicted(["l_quantity"], beta, facts).alias("p"))


@query(f"SELECT count(*) AS n, round(1 - sum((y - p)**2) / (var_pop(y) * count(*)), 6) AS r2, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p)**2)), 4) AS rmse, round(median(abs(y - p)), 4) AS medae FROM {_SCORED}")
def regression_metrics(spark, sf_dir):
    return op.regression_metrics(scored(spark, sf_dir))


_PRED = "(SELECT l_extendedprice AS y, l_quantity * 1000 + (l_orderkey % 7) AS p, l_returnflag FROM lineitem)"


def _pred(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1000 + F.col("l_orderkey") % 7).alias("p"), "l_returnflag")


@query(f"WITH e AS (SELECT list_sort(list_distinct(quantile_cont(p::DOUBLE, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) AS e FROM {_PRED}) SELECT len(list_filter(e[2:len(e) - 1], lambda v: v <= p))::INTEGER AS bin, count(*) AS n, round(avg(y - p), 4) AS mean, round(stddev_samp(y - p), 4) AS std, round(avg(abs(y - p)), 4) AS mae FROM {_PRED}, e GROUP BY 1 HAVING count(*) >= 5")
def residual_bins(spark, sf_dir):
    return op.residual_bins(_pred(spark, sf_dir), "y", "p")


@query(f"SELECT count(*) AS n, round(avg(e), 4) AS mean, round(stddev_samp(e), 4) AS std, round(skewness(e) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)), 6) AS skew, round(count(*) * corr(e * e, p)**2, 4) AS breusch_pagan FROM (SELECT y - p AS e, p FROM {_PRED})")
def residual_shape(spark, sf_dir):
    return op.residual_shape(_pred(spark, sf_dir), "y", "p")


@query(f"WITH g AS (SELECT l_returnflag AS level, count(*) AS n, avg(abs(y - p)) AS mae, avg(abs(y - p)) / stddev_samp(y) AS relative FROM {_PRED} GROUP BY 1), k AS (SELECT * FROM g WHERE n >= .05 * (SELECT sum(n) FROM g)) SELECT level, n, round(mae, 4) AS mae, round(relative, 6) AS relative, round(relative / (SELECT median(relative) FROM k), 6) AS ratio FROM k")
def subgroup_error(spark, sf_dir):
    return op.subgroup_error(_pred(spark, sf_dir), "y", "p", "l_returnflag")


@query("WITH e AS (SELECT min(x) AS lo, max(x) AS hi, count(*) AS t FROM (SELECT CASE WHEN l_quantity BETWEEN 20 AND 30 THEN 1 ELSE l_quantity END AS x FROM lineitem)), c AS (SELECT least(floor((x - lo) / ((hi - lo) / 10)), 9)::INT AS bin, count(*) AS n FROM (SELECT CASE WHEN l_quantity BETWEEN 20 AND 30 THEN 1 ELSE l_quantity END AS x FROM lineitem), e GROUP BY 1), g AS (SELECT r.range::INT AS bin, coalesce(n, 0)::BIGINT AS n FROM range(10) r LEFT JOIN c ON c.bin = r.range), s AS (SELECT bin, n, sum(n) OVER (ORDER BY bin) - n AS below, sum(n) OVER () - sum(n) OVER (ORDER BY bin) AS above, sum(n) OVER () AS t FROM g) SELECT bin, n, n < .02 * t AND below >= .05 * t AND above >= .05 * t AS thin FROM s")
def weak_support(spark, sf_dir):
    return op.weak_support(table(spark, sf_dir, "lineitem").select(F.expr("CASE WHEN l_quantity BETWEEN 20 AND 30 THEN 1D ELSE l_quantity END").alias("x")), "x")


@query()
def ridge_probe(spark, sf_dir):
    return op.regression_metrics(op.ridge_probe(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], "l_orderkey"))


@query()
def huber_probe(spark, sf_dir):
    return op.regression_metrics(op.huber_probe(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"], "l_orderkey"))


@query(
    "WITH f AS (SELECT o_orderkey, o_totalprice AS y, (o_custkey - avg(o_custkey) OVER ()) / stddev_pop(o_custkey) OVER () AS z, regr_intercept(o_totalprice, o_custkey) OVER () + regr_slope(o_totalprice, o_custkey) OVER () * o_custkey AS p, count(*) OVER () AS n FROM orders), e AS (SELECT *, y - p AS e, 1.0 / n + z * z / n AS h FROM f), s AS (SELECT *, sum(e * e) OVER () / (n - 2) AS s2 FROM e) "
    "SELECT o_orderkey, round(h, 8) AS leverage, round(e / sqrt(s2), 6) AS error, round(e * e * h / (2 * s2 * (1 - h)**2), 8) AS cook FROM s"
)
def cooks_distance(spark, sf_dir):
    return op.cooks_distance(table(spark, sf_dir, "orders"), "o_totalprice", ["o_custkey"], "o_orderkey")
