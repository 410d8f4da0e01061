import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkeda.functions.ordered import backward_steps, quantiles, running
from sparkeda.functions.special import digamma, gamma_lower, gamma_shape, trigamma
from sparkeda.operators import distributions, timeseries


def test_running_over_ranges_is_the_window(spark):
    c = spark.createDataFrame([(float(i * 7 % 997), i % 5 + 1) for i in range(997)], "x double, n int")
    cum, want = 0, {}
    ordered = sorted(c.collect())
    for k, r in enumerate(ordered):
        cum += r.n
        want[r.x] = (cum, ordered[k + 1].x if k + 1 < len(ordered) else None)
    assert {r.x: (r.cum, r["next"]) for r in running(c, "x", "n").collect()} == want


def test_quantiles(spark):
    rng = np.random.default_rng(1)
    for x in (rng.normal(size=501), np.round(rng.normal(size=400), 1), np.array([3.0])):
        df = spark.createDataFrame([(float(v),) for v in x], "x double")
        assert np.allclose(quantiles(df, "x", [0, 0.1, 0.5, 0.77, 1]).first()["q"], np.quantile(x, [0, 0.1, 0.5, 0.77, 1]))


def test_backward_steps(spark):
    v = [1, 2, 1, 5, 4, 4, 9, 0]
    df = spark.createDataFrame(list(enumerate(v)), "k long, v long")
    for width in (1, 3, 100):
        assert backward_steps(df, "k", "v", width).first()[0] == 3


def test_special_functions():
    assert abs(digamma(1) + 0.5772156649015329) < 1e-10 and abs(trigamma(1) - math.pi**2 / 6) < 1e-9
    assert np.allclose(gamma_lower(1.0, np.array([0, 0.5, 3, 20])), 1 - np.exp(-np.array([0, 0.5, 3, 20])), atol=1e-10)
    x = np.random.default_rng(2).gamma(3.5, 2.0, 20000)
    assert abs(gamma_shape(x.mean(), np.log(x).mean()) - 3.5) < 0.15


@pytest.mark.parametrize(("law", "draw"), [("norm", lambda r: r.normal(50, 4, 1500)), ("uniform", lambda r: r.uniform(2, 9, 1500)), ("lognorm", lambda r: r.lognormal(0, 1, 1500)), ("gamma", lambda r: r.gamma(3, 2, 3000)), ("weibull", lambda r: 2 * r.weibull(3.5, 3000)), ("poisson", lambda r: r.poisson(4, 800).astype(float))])
def test_draws_recover_their_law(spark, law, draw):
    x = draw(np.random.default_rng(5))
    rows = distributions.family_fit(spark.createDataFrame([(float(v),) for v in x], "x double"), "x").collect()
    chosen = next(r for r in rows if r["chosen"])
    assert chosen["verdict"] == "close" and (chosen["law"] == law or next(r for r in rows if r["law"] == law)["aic"] - chosen["aic"] < 12)


def test_stl_and_stationarity(spark):
    t = np.arange(210)
    x = 0.2 * t + 10 * np.sin(t * 2 * np.pi / 7) + np.random.default_rng(3).normal(0, 0.5, 210)
    trend, cycle, rest = timeseries.stl(x, 7)
    assert np.allclose(trend + cycle + rest, x) and rest[14:-14].std() < 1.5
    walk = np.cumsum(np.random.default_rng(4).normal(size=400))
    assert timeseries.adf(walk)[0] > timeseries.adf(walk)[2] and timeseries.kpss(walk) > 0.463
    noise = np.random.default_rng(4).normal(size=400)
    assert timeseries.adf(noise)[0] < timeseries.adf(noise)[2] and timeseries.kpss(noise) < 0.463


def test_normal_cdf(spark):
    got = spark.range(1).select(*[distributions.normal_cdf(F.lit(z)) for z in (-5.0, -1.0, 0.0, 1.96, 4.0)]).first()
    assert np.allclose(list(got), [0.5 * math.erfc(-z / math.sqrt(2)) for z in (-5.0, -1.0, 0.0, 1.96, 4.0)], atol=1e-12)
