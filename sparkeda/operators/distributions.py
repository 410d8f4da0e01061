"""Distributions of columns."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkeda.functions.columns import equal_bin, finite
from sparkeda.functions.ordered import quantiles, running
from sparkeda.functions.special import gamma_lower, gamma_shape


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Distinct finite values and their rows: what order statistics below work on, so that windows see values, not rows."""
    x = finite(column)
    return df.select(x.alias("x")).where("x IS NOT NULL").groupBy("x").agg(F.count(F.lit(1)).alias("n"))


def shape(df: DataFrame, column: str) -> DataFrame:
    """Shape label by population moments: n, skew, kurtosis, label, zero_rate, top_share."""
    c = value_counts(df, column)
    top = c.agg(F.max("n").alias("top"))
    x = df.select(finite(column).alias("x"))
    m = x.agg(F.count("x").alias("n"), F.skewness("x").alias("g1"), F.kurtosis("x").alias("g2"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.count_if(F.col("x") == 0).alias("zero"))
    label = (
        F.when(F.col("lo") == F.col("hi"), "constant").when((F.abs("g1") < 0.5) & (F.col("g2") <= -0.9), "uniform").when((F.abs("g1") < 0.5) & (F.col("g2") < 3), "bell")
        .when(F.col("g1") >= 1, "right_skewed").when(F.col("g1") <= -1, "left_skewed").when(F.abs("g1") < 0.5, "symmetric").otherwise("mildly_skewed")
    )
    rate = lambda c: F.round(F.coalesce(F.try_divide(c, "n"), F.lit(0.0)), 6)
    return m.join(F.broadcast(top)).select(F.lit(column).alias("column"), "n", F.round("g1", 4).alias("skew"), F.round("g2", 4).alias("kurtosis"), label.alias("label"), rate("zero").alias("zero_rate"), rate("top").alias("top_share"), (F.col("g2") >= 3).alias("heavy_tail"))


def modality_gap(df: DataFrame, column: str) -> DataFrame:
    """The widest gap between neighbouring values, on a log scale where values are positive and skewed or spread 50-fold.

    Two populations: the gap is 2.5 times the median gap or more, a tenth of the range, with 4 rows
    and 15 % on each side, of 20 rows at least. Returns n, used_log, gap, low, high, n_below, is_multimodal.
    """
    c = value_counts(df, column)
    facts = df.select(finite(column).alias("x")).agg(F.count("x").alias("total"), F.skewness("x").alias("g"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    logs = (F.col("lo") > 0) & ((F.abs("g") >= 1) | (F.col("hi") >= 50 * F.col("lo")))
    both = running(c, "x", "n").join(F.broadcast(facts)).withColumn("used_log", logs).withColumn("y", F.when(F.col("used_log"), F.log10("x")).otherwise(F.col("x")))
    after = F.when(F.col("used_log"), F.log10("next")).otherwise(F.col("next"))
    gaps = both.select("*", (after - F.col("y")).alias("gap"), F.col("cum").alias("n_below"))
    best = gaps.agg(F.max_by(F.struct("x", "next", "n_below", "gap"), F.struct("gap", -F.col("x"))).alias("b"), F.percentile(F.when(F.col("gap") > 0, F.col("gap")), 0.5).alias("typical"), (F.max("y") - F.min("y")).alias("range"), F.max("total").alias("n"), F.max("used_log").alias("used_log"))
    above = F.col("n") - F.col("b.n_below")
    least = F.least(F.col("b.n_below"), above)
    two = (F.col("n") >= 20) & (F.col("b.gap") >= 2.5 * F.col("typical")) & (F.col("b.gap") >= 0.1 * F.col("range")) & (least >= 4) & (least >= 0.15 * F.col("n"))
    return best.select("n", "used_log", F.round("b.gap", 6).alias("gap"), F.round("b.x", 6).alias("low"), F.round("b.next", 6).alias("high"), F.col("b.n_below").alias("n_below"), F.coalesce(two, F.lit(False)).alias("is_multimodal"))


def histogram(df: DataFrame, column: str, bins: int = 24) -> DataFrame:
    """Rows of each of `bins` equal bins between the smallest and largest finite value; the last bin is closed."""
    x = df.select(finite(column).alias("x")).where("x IS NOT NULL")
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return x.join(F.broadcast(ends)).groupBy(equal_bin(F.col("x"), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def box(df: DataFrame, column: str) -> DataFrame:
    """Exact quartiles, Tukey fences and the rows outside them."""
    x = df.select(finite(column).alias("x"))
    q = quantiles(x, "x", [0.25, 0.5, 0.75]).select(*[F.col("q")[i].alias(k) for i, k in enumerate(("q1", "median", "q3"))])
    q = q.withColumn("low", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).withColumn("high", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    n = x.join(F.broadcast(q)).groupBy("q1", "median", "q3", "low", "high").agg(F.count("x").alias("n"), F.count_if((F.col("x") < F.col("low")) | (F.col("x") > F.col("high"))).alias("n_outside"))
    return n.select(*[F.round(c, 4).alias(c) for c in ("q1", "median", "q3", "low", "high")], "n", "n_outside")


def category_frequency(df: DataFrame, column: str, top: int = 15) -> DataFrame:
    """The most frequent labels and one row for all others; rates over all rows, an empty label is (blank)."""
    raw = F.col(column).cast("string")
    label = F.when(F.regexp_replace(raw, r"\s", "") == "", "(blank)").otherwise(raw)
    counts = df.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    named = counts.where("label IS NOT NULL").orderBy(F.desc("n"), "label").limit(top)
    rest = counts.where("label IS NOT NULL").join(F.broadcast(named.select("label")), "label", "left_anti").agg(F.sum("n").alias("n")).where("n > 0").select(F.lit("(other)").alias("label"), "n")
    return named.unionByName(rest).join(F.broadcast(total)).select("label", "n", F.round(F.col("n") / F.col("total"), 6).alias("rate"))


def timeline_unit(span_days: float) -> str:
    return "hour" if span_days <= 2 else "day" if span_days <= 90 else "week" if span_days <= 900 else "month" if span_days <= 3650 else "year"


def timeline(df: DataFrame, column: str) -> DataFrame:
    """Rows of each period; the unit follows from the span."""
    t = F.col(column).cast("timestamp_ntz")
    lo, hi = df.agg(F.min(t), F.max(t)).first()
    unit = timeline_unit((hi - lo).total_seconds() / 86400 if lo is not None else 0)
    return df.where(t.isNotNull()).groupBy(F.date_trunc(unit, t).cast("timestamp_ntz").alias("period")).agg(F.count(F.lit(1)).alias("n")).withColumn("unit", F.lit(unit))


def _erf(z: Column) -> Column:
    """Error function by its series below 3 and the continued fraction beyond, to 1e-13."""
    a = F.abs(z)
    series, term = F.lit(1.0), F.lit(1.0)
    small = F.least(a, F.lit(3.0))
    sq = small * small
    for k in range(60, 0, -1):  # Horner form of sum (2 z^2)^k / (1 3 5 ..)
        series = 1.0 + series * (2.0 * sq) / (2 * k + 1)
    near = 2 / math.sqrt(math.pi) * small * F.exp(-sq) * series
    big = F.greatest(a, F.lit(3.0))
    tail = big
    for k in range(40, 0, -1):
        tail = big + (k / 2.0) / tail
    far = 1 - F.exp(-big * big) / (math.sqrt(math.pi) * tail)
    return F.signum(z) * F.when(a < 3, near).otherwise(far)


def normal_cdf(z: Column) -> Column:
    return (_erf(z / math.sqrt(2)) + 1) / 2


def ks_distance(df: DataFrame, column: str, law: str) -> DataFrame:
    """Kolmogorov-Smirnov distance of a column to its fitted law ('norm', 'uniform', 'expon' or 'lognorm'), with the fit and its AIC.

    Works on distinct values with cumulative counts; both sides of each step count.
    """
    c = value_counts(df, column)
    if law == "lognorm":
        c = c.where("x > 0")
    y = F.log("x") if law == "lognorm" else F.col("x")
    n, s, q = F.sum("n"), F.sum(F.col("n") * y), F.sum(F.col("n") * y * y)
    fit = c.agg(n.alias("total"), (s / n).alias("mean"), F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))).alias("sd"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum(F.col("n") * F.log(F.when(F.col("x") > 0, F.col("x")))).alias("logs"))
    cdf = {
        "norm": normal_cdf((F.col("x") - F.col("mean")) / F.col("sd")), "lognorm": normal_cdf((F.log("x") - F.col("mean")) / F.col("sd")),
        "uniform": (F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")), "expon": 1 - F.exp(-F.col("x") / F.col("mean")),
    }[law]
    steps = running(c, "x", "n").join(F.broadcast(fit)).select("*", cdf.alias("p"))
    d = F.greatest(F.abs(F.col("cum") / F.col("total") - F.col("p")), F.abs(F.col("p") - (F.col("cum") - F.col("n")) / F.col("total")))
    out = steps.agg(F.max(d).alias("ks"), *[F.first(k).alias(k) for k in ("total", "mean", "sd", "lo", "hi", "logs")])
    half = F.log(2 * math.pi * F.col("sd") * F.col("sd")) + 1
    log_l = {"norm": -F.col("total") / 2 * half, "lognorm": -F.col("total") / 2 * half - F.col("logs"), "uniform": -F.col("total") * F.log(F.col("hi") - F.col("lo")), "expon": -F.col("total") * (F.log("mean") + 1)}[law]
    k = 1 if law == "expon" else 2
    return out.select(F.lit(law).alias("law"), F.col("total").alias("n"), F.round("mean", 6).alias("location"), F.round("sd", 6).alias("scale"), F.round("ks", 6).alias("ks"), F.round(2 * k - 2 * log_l, 3).alias("aic"))


def _steps_distance(c: DataFrame, cdf: Column) -> float:
    """Largest distance of cumulated shares to a law, on both sides of each step."""
    total = c.agg(F.sum("n").alias("total"))
    steps = running(c, "x", "n").join(F.broadcast(total)).select("n", "cum", "total", cdf.alias("p"))
    d = F.greatest(F.abs(F.col("cum") / F.col("total") - F.col("p")), F.abs(F.col("p") - (F.col("cum") - F.col("n")) / F.col("total")))
    return steps.agg(F.max(d)).first()[0]


def weibull_distance(df: DataFrame, column: str, rounds: int = 30) -> DataFrame:
    """Weibull law of positive values: the shape by Newton's method, one aggregate a round."""
    c = value_counts(df, column).where("x > 0").persist()
    n, logs = c.agg(F.sum("n"), F.sum(F.col("n") * F.log("x"))).first()
    k = 1.0
    for _ in range(rounds):
        w = F.col("n") * F.pow("x", F.lit(k))
        a, b, e = c.agg(F.sum(w), F.sum(w * F.log("x")), F.sum(w * F.log("x") ** 2)).first()
        step = (b / a - 1 / k - logs / n) / (1 / k**2 + e / a - (b / a) ** 2)
        k = max(k - step, k / 4)
        if abs(step) < 1e-10 * k:
            break
    scale = (c.agg(F.sum(F.col("n") * F.pow("x", F.lit(k)))).first()[0] / n) ** (1 / k)
    ks = _steps_distance(c, 1 - F.exp(-F.pow(F.col("x") / scale, F.lit(k))))
    log_l = n * math.log(k) - n * k * math.log(scale) + (k - 1) * logs - n
    c.unpersist()
    return df.sparkSession.createDataFrame([("weibull", n, round(scale, 6), round(k, 6), round(ks, 6), round(4 - 2 * log_l, 3))], "law string, n long, location double, scale double, ks double, aic double")


def gamma_distance(df: DataFrame, column: str) -> DataFrame:
    """Gamma law of positive values: shape from two sums, the distance by a vectorised distribution function."""
    c = value_counts(df, column).where("x > 0").persist()
    n, total, logs = c.agg(F.sum("n"), F.sum(F.col("n") * F.col("x")), F.sum(F.col("n") * F.log("x"))).first()
    k = gamma_shape(total / n, logs / n)
    scale = total / n / k

    @F.pandas_udf("double")
    def cdf(x: pd.Series) -> pd.Series:
        return pd.Series(gamma_lower(k, x.to_numpy() / scale))

    ks = _steps_distance(c, cdf("x"))
    log_l = (k - 1) * logs - total / scale - n * k * math.log(scale) - n * math.lgamma(k)
    c.unpersist()
    return df.sparkSession.createDataFrame([("gamma", n, round(k, 6), round(scale, 6), round(ks, 6), round(4 - 2 * log_l, 3))], "law string, n long, location double, scale double, ks double, aic double")


def poisson_distance(df: DataFrame, column: str) -> DataFrame:
    """Poisson law by the mean, and its distance on the support of the counts seen."""
    c = value_counts(df, column)
    fit = c.agg(F.sum("n").alias("total"), (F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("rate"), F.max("x").cast("int").alias("hi"))
    # the law's steps up to the largest value: a table as long as that value, on distinct values alone
    grid = fit.select("total", "rate", F.explode(F.sequence(F.lit(0), "hi")).alias("k"))
    log_p = lambda k, r: k * F.log(r) - r - F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))
    steps = grid.join(c.withColumnRenamed("n", "m"), grid["k"] == c["x"], "left").withColumn("p", F.exp(log_p(F.col("k"), F.col("rate"))))
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    d = steps.select("total", "rate", F.abs(F.sum(F.coalesce("m", F.lit(0))).over(w) / F.col("total") - F.sum("p").over(w)).alias("d"))
    return d.agg(F.max("d").alias("ks"), F.first("total").alias("n"), F.first("rate").alias("location")).select(F.lit("poisson").alias("law"), "n", F.round("location", 6).alias("location"), F.sqrt(F.round("location", 6)).alias("scale"), F.round("ks", 6).alias("ks"), F.lit(None).cast("double").alias("aic"))


def family_fit(df: DataFrame, column: str) -> DataFrame:
    """Candidate laws with distance and AIC; `chosen` is the least AIC, or Poisson if its distance is within .01 of it; verdict close, approximate or none."""
    facts = df.select(finite(column).alias("x")).agg(F.min("x").alias("lo"), F.min(F.col("x") == F.floor("x")).alias("whole"), F.count_distinct("x").alias("d"), F.count("x").alias("n")).first()
    laws = ["norm", "uniform"] + (["lognorm", "expon"] if (facts["lo"] or 0) > 0 else [])
    out = None
    for law in laws:
        one = ks_distance(df, column, law)
        out = one if out is None else out.unionByName(one)
    if (facts["lo"] or 0) > 0 and facts["d"] > 2:
        out = out.unionByName(weibull_distance(df, column)).unionByName(gamma_distance(df, column))
    if facts["whole"] and facts["lo"] is not None and facts["lo"] >= 0:
        out = out.unionByName(poisson_distance(df, column))
    rows = out.collect()
    enough = facts["n"] >= 30 and facts["d"] >= 3
    by_aic = [r for r in rows if r["aic"] is not None]
    best = min(by_aic, key=lambda r: (r["aic"], r["law"]))
    for r in rows:
        if r["law"] == "poisson" and r["ks"] <= best["ks"] + 0.01:
            best = r
    verdict = F.when(F.col("ks") <= 0.05, "close").when(F.col("ks") <= 0.10, "approximate").otherwise("none")
    return out.select("*", ((F.col("law") == best["law"]) & F.lit(enough)).alias("chosen"), verdict.alias("verdict"))
