"""Ranks, quantiles, counts, keys and neighbours against pandas and numpy, on data with holes, ties and repeats."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkeda.functions import ordered
from sparkeda.operators import anomaly, associations, catalog, schema, supervised


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(5)
    f = pd.DataFrame({"a": rng.normal(size=400), "b": rng.integers(0, 9, 400).astype(float), "c": rng.exponential(size=400)})
    f["c"] += f["a"]
    f.loc[rng.choice(400, 60, replace=False), "b"] = np.nan
    f.loc[rng.choice(400, 30, replace=False), "c"] = np.nan
    f["key"] = np.arange(400)
    return f


@pytest.fixture(scope="module")
def table(spark, frame):
    return spark.createDataFrame(frame).repartition(3).persist()


def test_spearman_uses_the_complete_rows_of_each_pair(table, frame):
    want = frame[["a", "b", "c"]].corr(method="spearman")
    got = {(r["first"], r["second"]): r["rho"] for r in associations.spearman(table, ["a", "b", "c"]).collect()}
    assert len(got) == 3 and all(abs(v - want.loc[k]) < 1e-6 for k, v in got.items())


def test_quantiles_of_many_columns(table, frame):
    shares = [0.0, 0.05, 0.33, 0.5, 0.95, 1.0]
    for c, q in zip("abc", ordered.column_quantiles(table, ["a", "b", "c"], shares), strict=True):
        assert np.allclose(q, np.nanquantile(frame[c], shares), atol=1e-12)
    assert ordered.column_quantiles(table.withColumn("none", F.lit(None).cast("double")), ["none", "a"], [0.5])[0] == [None]
    assert ordered.column_quantiles(table.limit(0), ["a"], [0.5]) == [[None]]


def test_distinct_counts_of_odd_values(spark):
    rows = [(0.0, "x", [1]), (-0.0, "X", [1]), (float("nan"), None, None), (1.5, "", [2]), (None, "x", [2])]
    df = spark.createDataFrame(rows, "d double, s string, l array<int>")
    got = {r["column"]: (r["n_rows"], r["n_missing"], r["n_distinct"]) for r in catalog.column_catalog(df, "t").collect()}
    assert got == {"d": (5, 2, 2), "s": (5, 1, 3), "l": (5, 1, 2)}
    assert {r["n_rows"] for r in catalog.column_catalog(df.limit(0), "t").collect()} == {0}


def test_row_numbers_are_whole_and_stay(spark):
    df = ordered.row_index(spark.range(0, 1000, 1, 7).select(F.pmod("id", F.lit(3)).alias("v")), "n")
    one, two = df.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first(), df.select(F.sum(F.col("n") * F.col("v"))).first()
    assert tuple(one) == (0, 999, 1000) and two == df.repartition(4).select(F.sum(F.col("n") * F.col("v"))).first()


def test_two_foreign_keys_to_one_parent(spark):
    customers = spark.range(1, 101).toDF("customer_id")
    orders = spark.range(500).selectExpr("id AS order_id", "id % 100 + 1 AS bill_customer_id", "(id * 7) % 100 + 1 AS ship_customer_id", "id * 1.5D AS amount")
    tables = {"customers": customers, "orders": orders}
    keys = [k for n, df in tables.items() for k in schema.key_candidates(df, n, 1)]
    got = {(r["parent"], r["child"], r["child_key"]) for r in schema.relationship_candidates(tables, keys)}
    assert got == {("customers", "orders", "bill_customer_id"), ("customers", "orders", "ship_customer_id")}


def test_key_search_looks_at_every_column(spark):
    df = spark.range(60).select(*[(F.col("id") % (5 + i)).alias(f"code_{i}") for i in range(20)], F.col("id").alias("zz_id"))
    assert [k["key"] for k in schema.key_candidates(df, "t", 1)] == ["zz_id"]


def test_neighbours_among_all_rows(spark):
    rng = np.random.default_rng(3)
    x, label = rng.normal(size=(90, 5)), rng.integers(0, 3, 90)
    df = spark.createDataFrame([(i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, label, strict=True))], "k long, v array<double>, t int")
    got = {r["k"]: r["disagreement"] for r in supervised.neighbour_disagreement(df, "k", "v", "t", 4).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, math.inf)
    for i in range(90):
        assert abs(got[i] - np.mean(label[np.argsort(d[i], kind="stable")[:4]] != label[i])) < 1e-6


def test_rows_are_explained(spark):
    rng = np.random.default_rng(2)
    age = rng.integers(10, 70, 120).astype(float)
    f = pd.DataFrame({"key": range(120), "age": age, "weight": 20 + 1.1 * age + rng.normal(0, 1, 120)})
    f.loc[7, "weight"] = 300.0
    df = spark.createDataFrame(f)
    parts = {r["column"]: r for r in anomaly.contributors(df, "key", ["age", "weight"], [7]).collect()}
    assert parts["weight"]["direction"] == "above" and parts["weight"]["z"] > 5 > abs(parts["age"]["z"]) and parts["weight"]["median"] == round(float(np.median(f.weight)), 4)
    peers = [r for r in anomaly.conditional_examples(df, "key", ["age", "weight"]).collect() if r["key"] == 7 and r["value"] == "weight"]
    assert peers and peers[0]["x"] == 300.0 and peers[0]["q1"] <= peers[0]["median"] <= peers[0]["q3"] < 300 and peers[0]["n_peers"] >= 5


def test_quantile_from_a_bracket_is_exact(spark):
    rng = np.random.default_rng(8)
    for x in (rng.normal(size=2001), np.round(rng.exponential(size=1500), 1), np.repeat([1.0, 2.0], 700), rng.normal(size=2) * 1e200):
        df = spark.createDataFrame(pd.DataFrame({"x": x}))
        for share in (0.0, 0.3, 0.5, 1.0):
            for accuracy in (20, 10_000):
                assert np.isclose(ordered.narrowed_quantile(df, "x", share, accuracy), np.quantile(x, share), rtol=1e-12, atol=0)
    assert ordered.narrowed_quantile(spark.createDataFrame([(None,)], "x double"), "x", 0.5) is None


def test_median_error_is_not_held_by_one_task(spark):
    scored = spark.range(1000).selectExpr("id * 1D AS y", "id * 1.5D + 2 AS p")
    got = supervised.regression_metrics(scored)
    assert got.first()["medae"] == round(float(np.median(np.arange(1000) * 0.5 + 2)), 4)
    assert "percentile(" not in got._jdf.queryExecution().toString()


def test_probes_of_all_folds_read_the_rows_once(spark):
    rng = np.random.default_rng(4)
    f = pd.DataFrame({"key": np.arange(300), "a": rng.normal(50, 9, 300), "b": rng.exponential(size=300), "same": 7.3})
    f["y"] = 3 * f["a"] - f["b"] + rng.normal(size=300)
    df = spark.createDataFrame(f).withColumn("y", F.when(F.col("key") != 5, F.col("y")))
    fold = {r["key"]: r["f"] for r in df.select("key", supervised.fold(["key"], 3).alias("f")).collect()}
    f = f[f["key"] != 5].assign(fold=f["key"].map(fold))
    want = {}
    for i in range(3):
        train, test = f[f["fold"] != i], f[f["fold"] == i]
        x = train[["a", "b", "same"]]
        m, s = x.mean(), x.std(ddof=0).where(lambda v: v > 1e-9, 1.0)
        z = ((x - m) / s).to_numpy()
        beta = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (train["y"] - train["y"].mean()))
        want |= dict(zip(test["key"], train["y"].mean() + ((test[["a", "b", "same"]] - m) / s).to_numpy() @ beta, strict=True))
    ridge = supervised.ridge_probe(df, "y", ["a", "b", "same"], "key")
    got = {r["key"]: r["p"] for r in ridge.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)
    huber = supervised.huber_probe(df, "y", ["a", "b"], "key")
    assert all(abs(r["p"] - r["y"]) < 5 for r in huber.collect()) and huber.count() == 299
    for out in (ridge, huber):
        assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()


def huber_loss(b, x, y):
    """The sum at the best scale for coefficients b, by bisection of its slope in the scale."""
    r = np.abs(y - b[0] - x @ b[1:])
    lo, hi = 1e-12, 1e6
    for _ in range(200):
        s = math.sqrt(lo * hi)
        lo, hi = (s, hi) if len(r) < (np.minimum(r / s, 1.35) ** 2).sum() else (lo, s)
    t = r / s
    return (s + s * np.where(t <= 1.35, t * t, 2.7 * t - 1.35**2)).sum()


def huber_data(kind):
    rng = np.random.default_rng(6)
    f = pd.DataFrame({"key": np.arange(400), "a": rng.normal(1e6, 3, 400), "b": rng.exponential(size=400), "same": 7.3})
    f["y"] = 2 * (f["a"] - 1e6) - 5 * f["b"] + {"normal": rng.normal(size=400), "cauchy": rng.standard_cauchy(400), "line": np.where(rng.random(400) < 0.9, 0.0, rng.exponential(50, 400)), "rare": rng.normal(size=400)}[kind]
    if kind == "rare":  # a feature of five rows, far from each other
        f["b"] = 0.0
        f.loc[[7, 80, 150, 220, 310], ["b", "y"]] = [[1.0, v] for v in (900.0, 5000.0, -3000.0, 1e4, 2.5e4)]
    return f


@pytest.mark.parametrize("kind", ["normal", "cauchy", "line", "rare"])
def test_huber_fits_are_the_least_points(spark, kind):
    f = huber_data(kind)
    df = spark.createDataFrame(f).repartition(3).select("*", supervised.fold(["key"], 3).alias("_fold"))
    f["fold"] = f["key"].map({r["key"]: r["_fold"] for r in df.collect()})
    fits = supervised.huber_fits(df.select("_fold", "y", F.col("a").alias("x0"), F.col("b").alias("x1"), F.col("same").alias("x2")), 3, 3)
    for i, beta in enumerate(fits):
        train = f[f["fold"] != i]
        x, y = train[["a", "b", "same"]].to_numpy() - [1e6, 0, 7.3], train["y"].to_numpy()
        b = np.array([beta[0] + beta[1:] @ [1e6, 0, 7.3], *beta[1:]])
        assert abs(b[3]) < 1e-9
        best = huber_loss(b, x, y)
        for j in range(3):
            for step in (1e-5, -1e-5, 1e-2, -1e-2, 3.0, -3.0):
                assert huber_loss(b + step * np.eye(4)[j], x, y) >= best - 1e-10 * abs(best)
        if kind == "line":
            assert np.allclose(b, [0, 2, -5, 0], atol=1e-7)


def test_huber_fits_of_all_folds_need_few_passes(spark):
    df = spark.createDataFrame(huber_data("cauchy")).repartition(3).persist()
    df.count()
    sc, held = spark.sparkContext, spark.sparkContext._jsc.getPersistentRDDs().size()
    sc.setJobGroup("huber", "huber")
    supervised.huber_probe(df, "y", ["a", "b"], "key")
    jobs = len(sc.statusTracker().getJobIdsForGroup("huber"))
    sc._jsc.clearJobGroup()
    assert 0 < jobs <= 40 and sc._jsc.getPersistentRDDs().size() == held


def test_huber_fits_of_odd_tables(spark):
    rows = "_fold int, y double, x0 double"
    assert [b.tolist() for b in supervised.huber_fits(spark.createDataFrame([], rows), 3, 1)] == [[0.0, 0.0]] * 3
    same = spark.createDataFrame([(i % 3, 4.0, float(i)) for i in range(30)], rows)
    assert all(np.allclose(b, [4.0, 0.0]) for b in supervised.huber_fits(same, 3, 1))
    with pytest.raises(ValueError, match="fewer folds"):
        supervised.huber_fits(spark.createDataFrame([(1, 1.0, 2.0)], rows), 3, 1)
    far = spark.createDataFrame([(i % 3, 1e15 if i == 5 else 2.0 * i + (i % 7), float(i)) for i in range(300)], rows)
    assert all(abs(b[1] - 2) < 0.01 for b in supervised.huber_fits(far, 3, 1))
