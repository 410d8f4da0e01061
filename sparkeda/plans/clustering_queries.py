"""Clustering, comparison and content-duplicate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkeda.operators import clustering as op
from sparkeda.operators import compare as cmp
from sparkeda.plans.registry import query, table

COLS = ["p_size", "p_retailprice"]


def _wide(c: str) -> str:
    return f"(max({c}) - min({c}))::DOUBLE"


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, {_wide(c)} AS range, 0.0::DOUBLE AS missing_rate, round(greatest({_wide(COLS[0])}, {_wide(COLS[1])}) / least({_wide(COLS[0])}, {_wide(COLS[1])}), 4) AS scale_ratio FROM part" for c in COLS))
def feature_ranges(spark, sf_dir):
    return op.feature_ranges(table(spark, sf_dir, "part"), COLS)


@query("WITH h AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_size END AS s, p_retailprice AS r FROM part), f AS (SELECT p_partkey, coalesce(s, median(s) OVER ()) AS s, r FROM h) SELECT p_partkey, round((s - avg(s) OVER ()) / stddev_pop(s) OVER (), 6) AS p_size, round((r - avg(r) OVER ()) / stddev_pop(r) OVER (), 6) AS p_retailprice FROM f")
def scaled_matrix(spark, sf_dir):
    holed = table(spark, sf_dir, "part").select("p_partkey", F.expr("CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_size END AS p_size"), "p_retailprice")
    return op.matrix(holed, "p_partkey", COLS).select("p_partkey", *[F.round(c, 6).alias(c) for c in COLS])


@query()
def near_duplicates(spark, sf_dir):
    return op.near_duplicates(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), "c_custkey", ["c_nationkey", "c_acctbal"])


_LAB = "(SELECT c_custkey, c_acctbal::DOUBLE AS c_acctbal, c_nationkey::DOUBLE AS c_nationkey, c_mktsegment, CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal < 5000 THEN 1 ELSE 2 END AS label FROM customer)"


def labelled(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("c_acctbal"), F.col("c_nationkey").cast("double").alias("c_nationkey"), "c_mktsegment", F.expr("CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal < 5000 THEN 1 ELSE 2 END").alias("label"))


@query(
    f"WITH s AS (SELECT label, c, count(*) AS n, (SELECT count(*) FROM customer) AS t, avg(v) AS m FROM (SELECT label, 'c_acctbal' AS c, c_acctbal AS v FROM {_LAB} UNION ALL SELECT label, 'c_nationkey', c_nationkey FROM {_LAB}) GROUP BY label, c), g AS (SELECT 'c_acctbal' AS c, avg(c_acctbal) AS a, stddev_pop(c_acctbal) AS sd FROM {_LAB} UNION ALL SELECT 'c_nationkey', avg(c_nationkey), stddev_pop(c_nationkey) FROM {_LAB}) "
    "SELECT label, n, round(n / t::DOUBLE, 6) AS share, c AS \"column\", round((m - a) / sd, 6) AS z FROM s JOIN g USING (c) WHERE abs((m - a) / sd) >= .5"
)
def segment_profile(spark, sf_dir):
    return op.segment_profile(labelled(spark, sf_dir), "label", ["c_acctbal", "c_nationkey"])


@query(f"SELECT label, c_mktsegment AS category, n, round(n * t / (ns * nc)::DOUBLE, 6) AS lift FROM (SELECT *, sum(n) OVER (PARTITION BY label) AS ns, sum(n) OVER (PARTITION BY c_mktsegment) AS nc, sum(n) OVER () AS t FROM (SELECT label, c_mktsegment, count(*) AS n FROM {_LAB} GROUP BY ALL)) WHERE n * t / (ns * nc)::DOUBLE >= 1.02")
def category_lift(spark, sf_dir):
    return op.category_lift(labelled(spark, sf_dir), "label", "c_mktsegment", 1.02)


@query(
    f"WITH d AS (SELECT a.c_custkey AS i, a.label AS li, b.label AS lj, avg(sqrt((a.c_acctbal - b.c_acctbal)**2 + (a.c_nationkey - b.c_nationkey)**2)) AS m FROM {_LAB} a JOIN {_LAB} b ON a.c_custkey <> b.c_custkey GROUP BY ALL), s AS (SELECT i, li, max(m) FILTER (li = lj) AS a, min(m) FILTER (li <> lj) AS b FROM d GROUP BY i, li) "
    "SELECT li AS label, count(*) AS n, round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM s GROUP BY li"
)
def silhouette_by_segment(spark, sf_dir):
    return op.silhouette(labelled(spark, sf_dir).select("c_custkey", "c_acctbal", "c_nationkey", "label"), "c_custkey", ["c_acctbal", "c_nationkey"])


@query(f"WITH c AS (SELECT label, count(*) AS n, avg(c_acctbal) AS x, avg(c_nationkey) AS y FROM {_LAB} GROUP BY label), d AS (SELECT l.label, (c_acctbal - x)**2 + (c_nationkey - y)**2 AS d2 FROM {_LAB} l JOIN c USING (label)), w AS (SELECT label, sum(d2) AS ss, avg(sqrt(d2)) AS s FROM d GROUP BY label), g AS (SELECT avg(c_acctbal) AS gx, avg(c_nationkey) AS gy, count(*) AS t FROM {_LAB}), b AS (SELECT sum(n * ((x - gx)**2 + (y - gy)**2)) AS b FROM c, g), r AS (SELECT p.label, max((pw.s + qw.s) / sqrt((p.x - q.x)**2 + (p.y - q.y)**2)) AS m FROM c p JOIN c q ON p.label <> q.label JOIN w pw ON pw.label = p.label JOIN w qw ON qw.label = q.label GROUP BY p.label) SELECT t AS n, 3 AS k, round((b / 2) / ((SELECT sum(ss) FROM w) / (t - 3)), 4) AS calinski_harabasz, (SELECT round(avg(m), 6) FROM r) AS davies_bouldin FROM g, b")
def cluster_separation(spark, sf_dir):
    return op.separation(labelled(spark, sf_dir), ["c_acctbal", "c_nationkey"])


@query(f"WITH c AS (SELECT label AS a, c_nationkey % 3 AS b, count(*)::DOUBLE AS n FROM {_LAB} GROUP BY ALL), s AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS n FROM c), x AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT sum(n) AS n FROM c GROUP BY a)), y AS (SELECT sum(n * (n - 1) / 2) AS y FROM (SELECT sum(n) AS n FROM c GROUP BY b)) SELECT n::BIGINT AS n, round((s - x * y / (n * (n - 1) / 2)) / ((x + y) / 2 - x * y / (n * (n - 1) / 2)), 6) AS ari FROM s, x, y")
def adjusted_rand(spark, sf_dir):
    lab = labelled(spark, sf_dir)
    return op.adjusted_rand(lab, lab.withColumn("label", F.col("c_nationkey") % 3), "c_custkey")


@query()
def hopkins(spark, sf_dir):
    return op.hopkins(table(spark, sf_dir, "part"), "p_partkey", COLS)


@query()
def cluster_geometry(spark, sf_dir):
    return op.geometry(table(spark, sf_dir, "part"), "p_partkey", COLS)


@query()
def kmeans_sweep(spark, sf_dir):
    return op.kmeans_sweep(table(spark, sf_dir, "part"), "p_partkey", COLS, [2, 3], repeats=1)


@query()
def cluster_sensitivity(spark, sf_dir):
    return op.sensitivity(table(spark, sf_dir, "part"), "p_partkey", COLS, 3)


@query()
def pca_projection(spark, sf_dir):
    return op.pca_projection(table(spark, sf_dir, "part"), "p_partkey", COLS)


@query("WITH u AS (SELECT l_extendedprice AS x, l_returnflag AS f FROM lineitem WHERE l_returnflag IN ('R', 'N')), e AS (SELECT min(x) AS lo, max(x) AS hi FROM u) SELECT least(floor((x - lo) / ((hi - lo) / 24)), 23)::INTEGER AS bin, count(*) FILTER (f = 'R') AS n_base, count(*) FILTER (f = 'N') AS n_compare FROM u, e GROUP BY 1")
def compare_numeric(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return cmp.numeric_histograms(li.where("l_returnflag = 'R'"), li.where("l_returnflag = 'N'"), "l_extendedprice")


@query(" UNION ALL ".join(f"SELECT '{side}' AS side, count(x) AS n, count(*) - count(x) AS missing, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, round(min(x), 4) AS min, round(quantile_cont(x, .25), 4) AS q1, round(median(x), 4) AS median, round(quantile_cont(x, .75), 4) AS q3, round(max(x), 4) AS max FROM (SELECT o_totalprice AS x FROM orders WHERE o_orderdate {op_} '1998-01-01')" for side, op_ in (("base", "<"), ("compare", ">="))))
def compare_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    return cmp.numeric_summary(o.where(F.col("o_orderdate") < cut), "o_totalprice", "base").unionByName(cmp.numeric_summary(o.where(F.col("o_orderdate") >= cut), "o_totalprice", "compare"))


@query("WITH a AS (SELECT source AS label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS k FROM documents WHERE lang = 'en' GROUP BY 1), b AS (SELECT source AS label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS k FROM documents WHERE lang = 'fr' GROUP BY 1) SELECT label, coalesce(a.n, 0) AS n_base, coalesce(b.n, 0) AS n_compare FROM a FULL JOIN b USING (label) WHERE a.k <= 15 OR b.k <= 15")
def compare_categorical(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return cmp.category_counts(d.where("lang = 'en'"), d.where("lang = 'fr'"), "source")


@query(" UNION ALL ".join(f"SELECT '{side}' AS side, count(*) AS n, 0::BIGINT AS missing, count(DISTINCT source) AS n_labels, (SELECT source FROM documents WHERE lang = '{lang}' GROUP BY source ORDER BY count(*) DESC, source LIMIT 1) AS top, (SELECT max(n) FROM (SELECT count(*) AS n FROM documents WHERE lang = '{lang}' GROUP BY source)) AS top_n FROM documents WHERE lang = '{lang}'" for side, lang in (("base", "en"), ("compare", "fr"))))
def compare_categories_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return cmp.category_summary(d.where("lang = 'en'"), "source", "base").unionByName(cmp.category_summary(d.where("lang = 'fr'"), "source", "compare"))


@query("SELECT sha256(text) AS content, count(*) AS n, count(DISTINCT source) AS n_splits, count(DISTINCT lang) AS n_labels FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def cross_group_duplicates(spark, sf_dir):
    from sparkeda.operators.images import exact_duplicates

    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("sha256"), F.col("source").alias("split"), F.col("lang").alias("label"))
    return exact_duplicates(d)


@query("SELECT sha256(html) AS content, count(*) AS n, 1::BIGINT AS n_splits, 1::BIGINT AS n_labels FROM pages WHERE html IS NOT NULL GROUP BY html HAVING count(*) > 1")
def exact_dup_content(spark, sf_dir):
    from sparkeda.operators.images import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "pages").where("html IS NOT NULL").select(F.sha2("html", 256).alias("sha256"), F.lit("all").alias("split"), F.lit("page").alias("label")))
