"""Time-series readiness.

Rows become one value a period early on (a group-by), so the ordered windows after it run over
periods. With an entity, windows are partitioned by it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkeda.functions.columns import finite
from sparkeda.functions.ordered import running

DAY = 86400.0
# Calendar bands of gaps in days (low, high, name, periods a cycle) and exact gaps in seconds.
CALENDAR = ((28, 31, "monthly", 12), (89, 92, "quarterly", 4), (365, 366, "yearly", 1))
EXACT = ((1, "second", 60), (60, "minute", 60), (900, "15min", 96), (1800, "30min", 48), (3600, "hourly", 24), (86400, "daily", 7), (604800, "weekly", 52))


def observed(df: DataFrame, timestamp: str, value: str, *keep: str) -> DataFrame:
    """(t, x) with t in seconds; rows without a timestamp go, duplicates stay."""
    return df.where(F.col(timestamp).isNotNull()).select(F.col(timestamp).cast("timestamp_ntz").alias("ts"), (F.unix_micros(F.col(timestamp).cast("timestamp")) / 1e6).alias("t"), finite(value).alias("x"), *keep)


def infer_frequency(df: DataFrame, timestamp: str) -> DataFrame:
    """name, step_s, period, regularity, n_gaps: a calendar band with 60 % of the gaps, else the most frequent gap (smallest on ties)."""
    t = df.where(F.col(timestamp).isNotNull()).select((F.unix_micros(F.col(timestamp).cast("timestamp")) / 1e6).alias("t")).distinct()
    gaps = running(t, "t").select((F.col("next") - F.col("t")).alias("gap")).where("gap IS NOT NULL").groupBy("gap").agg(F.count(F.lit(1)).alias("n"))
    bands = [F.sum(F.when(F.col("gap").between(lo * DAY, hi * DAY), F.col("n")).otherwise(0)).alias(name) for lo, hi, name, _ in CALENDAR]
    got = gaps.agg(F.sum("n").alias("n"), F.max_by("gap", F.struct("n", -F.col("gap"))).alias("mode"), F.max("n").alias("mode_n"), *bands)
    name, period, share = F.lit("custom"), F.lit(1), F.col("mode_n") / F.col("n")
    for s, label, p in EXACT:
        name, period = F.when(F.col("mode") == s, label).otherwise(name), F.when(F.col("mode") == s, p).otherwise(period)
    for lo, hi, label, p in reversed(CALENDAR):
        hit = F.col(label) >= 0.6 * F.col("n")
        name, period, share = F.when(hit, label).otherwise(name), F.when(hit, p).otherwise(period), F.when(hit, F.col(label) / F.col("n")).otherwise(share)
    return got.select(name.alias("frequency"), F.col("mode").alias("step_s"), period.alias("period"), F.round(share, 6).alias("regularity"), F.col("n").alias("n_gaps"))


def index_facts(df: DataFrame, timestamp: str, now: str) -> DataFrame:
    t = F.col(timestamp).cast("timestamp_ntz")
    return df.agg(F.count(timestamp).alias("n"), F.count_distinct(t).alias("n_distinct"), F.min(t).alias("start"), F.max(t).alias("end"), F.count_if(t > F.lit(now).cast("timestamp_ntz")).alias("n_future"))


def duplicate_timestamps(df: DataFrame, timestamp: str, value: str, entity: str | None = None) -> DataFrame:
    """Groups and rows that share a timestamp (and entity), and groups whose values differ."""
    by = df.where(F.col(timestamp).isNotNull()).groupBy(timestamp, *([entity] if entity else [])).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).where("n > 1")
    return by.agg(F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count_if(F.col("lo") != F.col("hi")).alias("n_conflicting"))


def per_period(df: DataFrame, timestamp: str, value: str, unit: str = "day", how: str = "avg") -> DataFrame:
    """One row a period: ts, x (avg, sum with NULL if all are NULL, or count)."""
    agg = {"avg": F.avg(finite(value)), "sum": F.sum(finite(value)), "count": F.count(F.lit(1)).cast("double")}[how]
    return df.where(F.col(timestamp).isNotNull()).groupBy(F.date_trunc(unit, F.col(timestamp)).cast("timestamp_ntz").alias("ts")).agg(agg.alias("x"))


def regular_grid(series: DataFrame, step: str = "INTERVAL 1 DAY") -> DataFrame:
    """(ts, x, recorded): every period between the ends; those without a row have NULL."""
    ends = series.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    grid = ends.select(F.explode(F.expr(f"sequence(a, b, {step})")).alias("ts"))
    return grid.join(series.withColumn("recorded", F.lit(True)), "ts", "left").withColumn("recorded", F.coalesce("recorded", F.lit(False)))


def blocks(grid: DataFrame, kind: str = "gap") -> DataFrame:
    """Contiguous runs of periods without a row ('gap') or with a row but no value ('blank'): start, end, n_periods."""
    mark = ~F.col("recorded") if kind == "gap" else F.col("recorded") & F.col("x").isNull()
    w = Window.orderBy("ts")
    marked = grid.select("ts", mark.alias("m"), F.row_number().over(w).alias("i")).where("m")
    return marked.withColumn("island", F.col("i") - F.row_number().over(w)).groupBy("island").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n_periods")).drop("island")


def interpolate(grid: DataFrame) -> DataFrame:
    """(ts, x, filled): linear in time between known values, flat beyond them."""
    w = Window.orderBy("ts")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("x").isNotNull(), F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    g = grid.select("ts", "x", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), known.alias("k"))
    g = g.select("*", F.last("x", True).over(back).alias("x0"), F.last("k", True).over(back).alias("t0"), F.first("x", True).over(ahead).alias("x1"), F.first("k", True).over(ahead).alias("t1"))
    line = F.when(F.col("t1") > F.col("t0"), F.col("x0") + (F.col("x1") - F.col("x0")) * (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0")))
    return g.select("ts", F.coalesce("x", line, "x0", "x1").alias("x"), F.col("x").isNull().alias("filled"))


def irregularity(df: DataFrame, timestamp: str) -> DataFrame:
    t = df.where(F.col(timestamp).isNotNull()).select((F.unix_micros(F.col(timestamp).cast("timestamp")) / 1e6).alias("t")).distinct()
    gaps = running(t, "t").select((F.col("next") - F.col("t")).alias("gap")).where("gap IS NOT NULL")
    mode = gaps.groupBy("gap").agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") / F.sum("n")).alias("share"))
    return gaps.agg(F.min("gap").alias("min"), F.percentile("gap", 0.5).alias("median"), F.max("gap").alias("max")).join(F.broadcast(mode)).select(*[F.round(c, 3).alias(f"{c}_gap_s") for c in ("min", "median", "max")], F.round("share", 6).alias("modal_share"), (F.col("share") < 0.9).alias("irregular"))


def composition(df: DataFrame, timestamp: str, entity: str, unit: str = "day") -> DataFrame:
    """Periods at which the number of active entities changes: ts, before, active."""
    by = df.groupBy(F.date_trunc(unit, F.col(timestamp)).cast("timestamp_ntz").alias("ts")).agg(F.count_distinct(entity).alias("active"))
    return by.select("ts", F.lag("active").over(Window.orderBy("ts")).alias("before"), "active").where("before IS NULL OR before <> active")


def panel(df: DataFrame, timestamp: str, entity: str, unit: str = "day") -> DataFrame:
    """Of each entity: rows, periods with a row, periods between its ends, coverage."""
    seconds = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2629746, "quarter": 7889238, "year": 31556952}[unit]
    p = F.date_trunc(unit, F.col(timestamp))
    by = df.groupBy(entity).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(p).alias("n_periods"), ((F.unix_seconds(F.max(p).cast("timestamp")) - F.unix_seconds(F.min(p).cast("timestamp"))) / seconds + 1).cast("long").alias("expected"))
    return by.withColumn("coverage", F.round(F.col("n_periods") / F.col("expected"), 6))


def acf(series: DataFrame, lags: int) -> DataFrame:
    """Autocorrelation at lags 1.. with the lag-0 sum below and the band 1.96 / sqrt(n): one window pass for all lags."""
    m = series.agg(F.avg("x").alias("m"), F.count("x").alias("n"))
    w = Window.orderBy("ts")
    d = series.join(F.broadcast(m)).select("ts", "n", (F.col("x") - F.col("m")).alias("d"))
    shifted = d.select("n", "d", *[F.lag("d", k).over(w).alias(f"l{k}") for k in range(1, lags + 1)])
    got = shifted.agg(F.first("n").alias("n"), F.sum(F.col("d") * F.col("d")).alias("s0"), *[F.sum(F.col("d") * F.col(f"l{k}")).alias(f"s{k}") for k in range(1, lags + 1)])
    return got.select(F.inline(F.array(*[F.struct(F.lit(k).alias("lag"), F.round(F.col(f"s{k}") / F.col("s0"), 6).alias("acf"), F.round(1.96 / F.sqrt("n"), 6).alias("band")) for k in range(1, lags + 1)])))


def pacf(series: DataFrame, lags: int) -> DataFrame:
    """Partial autocorrelation by Durbin-Levinson from the collected lags."""
    r = [1.0] + [x["acf"] for x in acf(series, lags).orderBy("lag").collect()]
    phi, out = [], []
    for k in range(1, lags + 1):
        num = r[k] - sum(p * r[k - 1 - j] for j, p in enumerate(phi))
        den = 1 - sum(p * r[j + 1] for j, p in enumerate(phi))
        a = num / den if abs(den) > 1e-12 else 0.0
        phi = [p - a * q for p, q in zip(phi, reversed(phi), strict=True)] + [a]
        out.append((k, round(a, 6)))
    return series.sparkSession.createDataFrame(out, "lag int, pacf double")


def rolling_dispersion(series: DataFrame, width: int) -> DataFrame:
    """Standard deviation of full windows of `width` periods."""
    w = Window.orderBy("ts").rowsBetween(-(width - 1), 0)
    return series.select("ts", F.when(F.count("x").over(w) == width, F.round(F.stddev_samp("x").over(w), 6)).alias("std")).where("std IS NOT NULL")


def cusum_split(series: DataFrame, min_segment: int = 10) -> DataFrame:
    """The best single split in two means: at, statistic, effect, is_change (5 and .5 at least)."""
    w = Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    f = series.agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.stddev_samp("x").alias("sd"))
    p = series.select("ts", F.row_number().over(Window.orderBy("ts")).alias("i"), F.sum("x").over(w).alias("c")).join(F.broadcast(f))
    p = p.where((F.col("i") >= min_segment) & (F.col("n") - F.col("i") >= min_segment))
    step = F.abs(F.col("c") / F.col("i") - (F.col("s") - F.col("c")) / (F.col("n") - F.col("i")))
    p = p.select("ts", "i", (step * F.sqrt(F.col("i") * (F.col("n") - F.col("i")) / F.col("n")) / F.col("sd")).alias("stat"), (step / F.col("sd")).alias("effect"))
    best = p.agg(F.max_by(F.struct("ts", "i", "stat", "effect"), F.struct("stat", -F.col("i"))).alias("b")).where("b IS NOT NULL")
    return best.select(F.col("b.ts").alias("last_before"), F.col("b.i").alias("n_before"), F.round("b.stat", 4).alias("statistic"), F.round("b.effect", 4).alias("effect"), ((F.col("b.stat") >= 5) & (F.col("b.effect") >= 0.5)).alias("is_change"))


def moving_average_parts(series: DataFrame, period: int) -> DataFrame:
    """Classical decomposition: centred moving average, mean of each phase, remainder: ts, x, trend, cycle, remainder."""
    half = period // 2
    o = Window.orderBy("ts")
    w = o.rowsBetween(-half, half)
    s = series.select("ts", "x", F.row_number().over(o).alias("i"), F.when(F.count("x").over(w) == 2 * half + 1, F.avg("x").over(w)).alias("trend")) if period % 2 else series.select(
        "ts", "x", F.row_number().over(o).alias("i"), F.when(F.count("x").over(w) == 2 * half + 1, (F.sum("x").over(w) - (F.lag("x", half).over(o) + F.lead("x", half).over(o)) / 2) / period).alias("trend")
    )
    phase = s.groupBy((F.col("i") % period).alias("phase")).agg(F.avg(F.col("x") - F.col("trend")).alias("c"))
    level = phase.agg(F.avg("c").alias("level"))
    phase = phase.join(F.broadcast(level)).select("phase", (F.col("c") - F.col("level")).alias("cycle"))
    out = s.withColumn("phase", F.col("i") % period).join(F.broadcast(phase), "phase")
    return out.select("ts", "x", "trend", "cycle", (F.col("x") - F.col("trend") - F.col("cycle")).alias("remainder"))


def strengths(parts: DataFrame) -> DataFrame:
    """Strength of cycle and trend: 1 - Var(remainder) / Var(component + remainder), within [0, 1]."""
    p = parts.where("trend IS NOT NULL")
    s = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.var_samp("remainder") / F.var_samp(F.col(c) + F.col("remainder"))))
    return p.agg(F.count(F.lit(1)).alias("n"), F.round(s("cycle"), 6).alias("cycle_strength"), F.round(s("trend"), 6).alias("trend_strength"))


def remainder_outliers(parts: DataFrame, fence: float = 4.5, top: int = 15, most: float = 0.02) -> DataFrame:
    """Remainders outside the quartiles by `fence` ranges; none where more than `most` of all are."""
    p = parts.where("remainder IS NOT NULL")
    q = p.agg(F.percentile("remainder", F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.count(F.lit(1)).alias("n"))
    iqr = F.col("q")[1] - F.col("q")[0]
    out = p.join(F.broadcast(q)).where((F.col("remainder") < F.col("q")[0] - fence * iqr) | (F.col("remainder") > F.col("q")[1] + fence * iqr))
    few = out.agg(F.count(F.lit(1)).alias("k"))
    kept = out.join(F.broadcast(few)).where(F.col("k") <= most * F.col("n"))
    return kept.select("ts", F.round("x", 4).alias("x"), F.round("remainder", 4).alias("remainder")).orderBy(F.desc(F.abs("remainder")), "ts").limit(top)


def intermittency(series: DataFrame) -> DataFrame:
    """Zero rate, mean spacing of non-zero periods (ADI), squared variation of their values, class, longest zero run."""
    o = Window.orderBy("ts")
    s = series.select("x", F.row_number().over(o).alias("i"))
    nz = s.where("x <> 0").select("x", (F.col("i") - F.lag("i").over(Window.orderBy("i"))).alias("step"))
    facts = nz.agg(F.avg("step").alias("adi"), F.pow(F.stddev_samp("x") / F.avg("x"), 2).alias("cv2"))
    rate = s.agg(F.avg((F.col("x") == 0).cast("int")).alias("zero_rate"))
    run = s.where("x = 0").withColumn("g", F.col("i") - F.row_number().over(Window.orderBy("i"))).groupBy("g").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("longest_zero_run"))
    kind = F.when(F.col("adi") < 1.32, F.when(F.col("cv2") < 0.49, "smooth").otherwise("erratic")).otherwise(F.when(F.col("cv2") < 0.49, "intermittent").otherwise("lumpy"))
    return facts.join(F.broadcast(rate)).join(F.broadcast(run)).select(F.round("zero_rate", 6).alias("zero_rate"), F.round("adi", 6).alias("adi"), F.round("cv2", 6).alias("cv2"), kind.alias("kind"), "longest_zero_run")


def cross_correlation(left: DataFrame, right: DataFrame, lags: int = 14) -> DataFrame:
    """Correlation of left with right `lag` periods earlier, at lags 0..: one window pass."""
    both = left.select("ts", F.col("x").alias("y")).join(right.select("ts", F.col("x").alias("z")), "ts")
    w = Window.orderBy("ts")
    s = both.select("y", *[F.lag("z", k).over(w).alias(f"z{k}") if k else F.col("z").alias("z0") for k in range(lags + 1)])
    got = s.agg(*[F.corr("y", f"z{k}").alias(f"r{k}") for k in range(lags + 1)])
    return got.select(F.inline(F.array(*[F.struct(F.lit(k).alias("lag"), F.round(f"r{k}", 6).alias("r")) for k in range(lags + 1)])))


def history(n_periods: int, period: int, horizon: int) -> dict:
    """Whether there is history enough: two cycles, three horizons, and a horizon no longer than the cycles seen."""
    cycles = n_periods / max(period, 1)
    return {"cycles": cycles, "enough_cycles": cycles >= 2, "enough_history": n_periods >= 3 * horizon, "horizon_ok": horizon / max(period, 1) <= cycles}


def backtest_plan(series: DataFrame, period: int, horizon: int | None = None, folds: int = 5) -> DataFrame:
    """Expanding-window folds, the last one ending with the series: fold, n_train, train_end, test_end."""
    numbered = series.select("ts", F.row_number().over(Window.orderBy("ts")).alias("i"))
    n = numbered.count()
    step = horizon or max(period, n // 10)
    least = max(2 * period, n // 3)
    cuts = [n - step * k for k in range(min(folds, 50), 0, -1) if n - step * k >= least]
    if not cuts:
        return numbered.limit(0).select(F.lit(0).alias("fold"), F.col("i").cast("long").alias("n_train"), F.col("ts").alias("train_end"), F.col("ts").alias("test_end"))
    plan = series.sparkSession.createDataFrame([(k + 1, c, c + step) for k, c in enumerate(cuts)], "fold int, n_train long, stop long")
    return plan.join(numbered.select(F.col("i").alias("n_train"), F.col("ts").alias("train_end")), "n_train").join(numbered.select(F.col("i").alias("stop"), F.col("ts").alias("test_end")), "stop").select("fold", "n_train", "train_end", "test_end")


def loess(x: np.ndarray, width: int, robust: np.ndarray) -> np.ndarray:
    """Local linear smoothing on an even grid with tricube weights."""
    n = len(x)
    width = max(3, min(width | 1, n if n % 2 else n - 1))
    out = np.empty(n)
    for i in range(n):
        a = min(max(0, i - width // 2), n - width)
        t = np.arange(a, a + width) - i
        w = (1 - (np.abs(t) / (np.abs(t).max() + 1)) ** 3) ** 3 * robust[a : a + width]
        s, m = w.sum(), (w * t).sum()
        d = s * (w * t * t).sum() - m * m
        y = x[a : a + width]
        out[i] = ((w * t * t).sum() * (w * y).sum() - m * (w * t * y).sum()) / d if d > 1e-12 else (w * y).sum() / max(s, 1e-12)
    return out


def stl(x: np.ndarray, period: int, rounds: int = 2, outer: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Robust seasonal-trend decomposition: (trend, cycle, remainder)."""
    n = len(x)
    trend, robust, cycle = np.zeros(n), np.ones(n), np.zeros(n)
    wide = int(1.5 * period / (1 - 1.5 / (10 * (n // period) + 1))) | 1
    for _ in range(outer):
        for _ in range(rounds):
            free = x - trend
            raw = np.empty(n)
            for k in range(period):
                raw[k::period] = loess(free[k::period], 7, robust[k::period])
            low = loess(np.convolve(np.pad(raw, period // 2, mode="edge"), np.ones(period) / period, "same")[period // 2 : period // 2 + n], period | 1, np.ones(n))
            cycle = raw - low
            trend = loess(x - cycle, wide, robust)
        left = np.abs(x - trend - cycle)
        scale = 6 * np.median(left)
        robust = np.clip(1 - (left / scale) ** 2, 0, 1) ** 2 if scale > 0 else np.ones(n)
    return trend, cycle, x - trend - cycle


def stl_strength(series: DataFrame, period: int, entity: str | None = None) -> DataFrame:
    """Strengths by STL of each series (of each entity): one series is one group, after aggregation to periods."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("ts")["x"].to_numpy(float)
        if len(x) < 2 * period:
            return pd.DataFrame({"series": [str(pdf["series"].iloc[0])], "n": [len(x)], "cycle_strength": [None], "trend_strength": [None]}).astype({"cycle_strength": float, "trend_strength": float})
        t, c, r = stl(x, period)
        s = lambda part: float(np.clip(1 - r.var(ddof=1) / max((part + r).var(ddof=1), 1e-300), 0, 1))
        return pd.DataFrame({"series": [str(pdf["series"].iloc[0])], "n": [len(x)], "cycle_strength": [round(s(c), 6)], "trend_strength": [round(s(t), 6)]})

    named = series.select((F.col(entity).cast("string") if entity else F.lit("all")).alias("series"), "ts", "x")
    return named.groupBy("series").applyInPandas(run, "series string, n long, cycle_strength double, trend_strength double")


def _ols(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ beta
    s2 = e @ e / max(len(y) - x.shape[1], 1)
    return beta, float(e @ e), np.sqrt(np.diag(s2 * np.linalg.pinv(x.T @ x)))


def adf(x: np.ndarray) -> tuple[float, int, float]:
    """Augmented Dickey-Fuller with a constant, lags by AIC: (statistic, lags, 5 % critical value by the finite-sample surface)."""
    n = len(x)
    most = min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 3)
    d = np.diff(x)

    def design(p: int, start: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(start, len(d))
        cols = [np.ones(len(rows)), x[rows]] + [d[rows - k] for k in range(1, p + 1)]
        return d[rows], np.column_stack(cols)

    def aic(p: int) -> float:
        y, m = design(p, most)
        return len(y) * math.log(max(_ols(y, m)[1] / len(y), 1e-300)) + 2 * (p + 2)

    p = min(range(max(most, 0) + 1), key=aic)
    beta, _, se = _ols(*design(p, p))
    return float(beta[1] / se[1]), p, -2.86154 - 2.8903 / n - 4.234 / n**2 - 40.04 / n**3


def kpss(x: np.ndarray) -> float:
    """KPSS statistic around a level with a Bartlett window; .463 is the 5 % critical value."""
    n, e = len(x), x - x.mean()
    lags = int(math.ceil(12 * (n / 100) ** 0.25))
    s2 = e @ e / n + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) / n for k in range(1, min(lags, n - 1) + 1))
    return float((np.cumsum(e) ** 2).sum() / (n * n * max(s2, 1e-300)))


def stationarity(series: DataFrame, entity: str | None = None) -> DataFrame:
    """ADF and KPSS of each series and their joint verdict."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("ts")["x"].to_numpy(float)
        stat, lags, critical = adf(x)
        k = kpss(x)
        unit, level = stat >= critical, k >= 0.463
        verdict = {(False, False): "stationary", (True, True): "non_stationary", (True, False): "trend_stationary", (False, True): "difference_stationary"}[(unit, level)]
        return pd.DataFrame({"series": [str(pdf["series"].iloc[0])], "n": [len(x)], "adf": [round(stat, 6)], "lags": [lags], "kpss": [round(k, 6)], "verdict": [verdict]})

    named = series.select((F.col(entity).cast("string") if entity else F.lit("all")).alias("series"), "ts", "x")
    return named.groupBy("series").applyInPandas(run, "series string, n long, adf double, lags int, kpss double, verdict string")


def change_points(series: DataFrame, period: int, depth: int = 5) -> DataFrame:
    """Level shifts by binary segmentation after a Theil-Sen trend: ts, statistic, effect."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts").reset_index(drop=True)
        x, n = pdf["x"].to_numpy(float), len(pdf)
        at = np.unique(np.linspace(0, n - 1, min(n, 300)).astype(int))
        i, j = np.triu_indices(len(at), 1)
        slope = np.median((x[at[j]] - x[at[i]]) / (at[j] - at[i])) if n > 1 else 0.0
        x, least, found = x - slope * np.arange(n), max(2 * period, 10), []

        def split(a: int, b: int, left: int) -> None:
            m = b - a
            if left == 0 or m < 2 * least or x[a:b].std(ddof=1) == 0:
                return
            i, c, sd = np.arange(least, m - least + 1), np.cumsum(x[a:b]), x[a:b].std(ddof=1)
            step = np.abs(c[i - 1] / i - (c[-1] - c[i - 1]) / (m - i))
            stat = step * np.sqrt(i * (m - i) / m) / sd
            k = int(np.argmax(stat))
            if stat[k] >= 5 and step[k] / sd >= 0.5:
                found.append((a + int(i[k]), float(stat[k]), float(step[k] / sd)))
                split(a, a + int(i[k]), left - 1)
                split(a + int(i[k]), b, left - 1)

        split(0, n, depth)
        # a shift shows on either side of itself as well: by the noise of one step, over four periods
        y, w = pdf["x"].to_numpy(float), 4 * period
        noise = 1.4826 * np.median(np.abs(np.diff(y))) / 2**0.5 if n > 1 else 0.0
        found = sorted(f for f in found if abs(y[f[0] : f[0] + w].mean() - y[max(0, f[0] - w) : f[0]].mean()) >= noise)
        return pd.DataFrame({"ts": pdf["ts"].iloc[[f[0] for f in found]].reset_index(drop=True), "statistic": [round(f[1], 4) for f in found], "effect": [round(f[2], 4) for f in found]}, columns=["ts", "statistic", "effect"])

    return series.groupBy(F.lit("all")).applyInPandas(lambda pdf: run(pdf), "ts timestamp_ntz, statistic double, effect double")


def thinned(series: DataFrame, most: int = 1500) -> DataFrame:
    """Every k-th point so that at most `most` remain."""
    n = series.count()
    step = max(1, -(-n // most))
    return series.withColumn("_i", F.row_number().over(Window.orderBy("ts"))).where((F.col("_i") - 1) % step == 0).drop("_i")
