"""Time-series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkeda.operators import timeseries as op
from sparkeda.plans.registry import query, table

# Days of orders with some taken out, so that there are gaps.
_DAYS = "(SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS ts, sum(o_totalprice) AS x FROM orders WHERE date_diff('day', DATE '1995-01-01', o_orderdate::DATE) % 50 NOT IN (7, 8, 9) GROUP BY 1)"
_GRID = f"(SELECT g.ts, d.x, d.ts IS NOT NULL AS recorded FROM (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM {_DAYS}) g LEFT JOIN {_DAYS} d ON d.ts = g.ts)"
_FULL = f"(SELECT ts, coalesce(x, 0) AS x FROM (SELECT g.ts, d.x FROM (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM {_DAYS}) g LEFT JOIN {_DAYS} d ON d.ts = g.ts))"


def days(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where(~(F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")) % 50).isin(7, 8, 9))
    return op.per_period(o, "o_orderdate", "o_totalprice", "day", "sum")


def grid(spark, sf_dir):
    return op.regular_grid(days(spark, sf_dir))


def full(spark, sf_dir):
    return grid(spark, sf_dir).select("ts", F.coalesce("x", F.lit(0.0)).alias("x"))


@query("WITH g AS (SELECT epoch(lead(t) OVER (ORDER BY t)) - epoch(t) AS gap FROM (SELECT DISTINCT o_orderdate AS t FROM orders)), c AS (SELECT gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY gap) SELECT 'daily' AS frequency, (SELECT gap FROM c ORDER BY n DESC, gap LIMIT 1)::DOUBLE AS step_s, 7 AS period, round(max(n) / sum(n), 6) AS regularity, sum(n)::BIGINT AS n_gaps FROM c")
def infer_frequency(spark, sf_dir):
    return op.infer_frequency(table(spark, sf_dir, "orders"), "o_orderdate")


@query("SELECT count(ts) AS n, count(DISTINCT ts) AS n_distinct, min(ts) AS start, max(ts) AS \"end\", count(*) FILTER (ts > '2024-01-15') AS n_future FROM events")
def time_index(spark, sf_dir):
    return op.index_facts(table(spark, sf_dir, "events"), "ts", "2024-01-15")


@query("SELECT count(*) AS n_groups, coalesce(sum(n), 0)::BIGINT AS n_rows, count(*) FILTER (lo <> hi) AS n_conflicting FROM (SELECT count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY o_orderdate, o_orderstatus HAVING count(*) > 1)")
def duplicate_timestamps(spark, sf_dir):
    return op.duplicate_timestamps(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "o_orderstatus")


@query(f"SELECT ts, round(x, 2) AS x, recorded FROM {_GRID}")
def regular_grid(spark, sf_dir):
    return grid(spark, sf_dir).select("ts", F.round("x", 2).alias("x"), "recorded")


def _blocks(mark: str, src: str) -> str:
    return f"SELECT min(ts) AS start, max(ts) AS \"end\", count(*) AS n_periods FROM (SELECT ts, i - row_number() OVER (ORDER BY ts) AS g FROM (SELECT *, row_number() OVER (ORDER BY ts) AS i FROM {src}) WHERE {mark}) GROUP BY g"


@query(_blocks("NOT recorded", _GRID))
def gap_blocks(spark, sf_dir):
    return op.blocks(grid(spark, sf_dir))


@query(_blocks("recorded AND x IS NULL", f"(SELECT ts, recorded, CASE WHEN day(ts) NOT IN (3, 4) THEN x END AS x FROM {_GRID})"))
def blank_blocks(spark, sf_dir):
    return op.blocks(grid(spark, sf_dir).withColumn("x", F.when(~F.dayofmonth("ts").isin(3, 4), F.col("x"))), "blank")


@query(f"WITH k AS (SELECT ts, x, epoch(ts) AS t, CASE WHEN x IS NOT NULL THEN epoch(ts) END AS k FROM {_GRID}), f AS (SELECT *, last_value(x IGNORE NULLS) OVER b AS x0, last_value(k IGNORE NULLS) OVER b AS t0, first_value(x IGNORE NULLS) OVER a AS x1, first_value(k IGNORE NULLS) OVER a AS t1 FROM k WINDOW b AS (ORDER BY ts ROWS UNBOUNDED PRECEDING), a AS (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT ts, round(coalesce(x, CASE WHEN t1 > t0 THEN x0 + (x1 - x0) * (t - t0) / (t1 - t0) END, x0, x1), 5) AS x, x IS NULL AS filled FROM f")
def interpolate_grid(spark, sf_dir):
    return op.interpolate(grid(spark, sf_dir)).select("ts", F.round("x", 5).alias("x"), "filled")


@query("WITH g AS (SELECT epoch_us(lead(t) OVER (ORDER BY t)) / 1e6 - epoch_us(t) / 1e6 AS gap FROM (SELECT DISTINCT ts AS t FROM events)), c AS (SELECT gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY gap) SELECT round(min(gap), 3) AS min_gap_s, round(median(gap), 3) AS median_gap_s, round(max(gap), 3) AS max_gap_s, (SELECT round(max(n) / sum(n), 6) FROM c) AS modal_share, (SELECT max(n) / sum(n) < .9 FROM c) AS irregular FROM g WHERE gap IS NOT NULL")
def spacing_irregularity(spark, sf_dir):
    return op.irregularity(table(spark, sf_dir, "events"), "ts")


@query("SELECT * FROM (SELECT ts, lag(active) OVER (ORDER BY ts) AS before, active FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS ts, count(DISTINCT user_id) AS active FROM events GROUP BY 1)) WHERE before IS NULL OR before <> active")
def panel_composition(spark, sf_dir):
    return op.composition(table(spark, sf_dir, "events"), "ts", "user_id")


@query("SELECT event_type, n_rows, n_periods, expected, round(n_periods / expected::DOUBLE, 6) AS coverage FROM (SELECT event_type, count(*) AS n_rows, count(DISTINCT date_trunc('hour', ts)) AS n_periods, date_diff('hour', min(date_trunc('hour', ts)), max(date_trunc('hour', ts))) + 1 AS expected FROM events GROUP BY 1)")
def panel_coverage(spark, sf_dir):
    return op.panel(table(spark, sf_dir, "events"), "ts", "event_type", "hour")


@query("WITH " + f"d AS (SELECT ts, x - avg(x) OVER () AS d, count(*) OVER () AS n FROM {_FULL}), l AS (SELECT d, n, " + ", ".join(f"lag(d, {k}) OVER (ORDER BY ts) AS l{k}" for k in range(1, 15)) + " FROM d) " + " UNION ALL ".join(f"SELECT {k} AS lag, round(sum(d * l{k}) / sum(d * d), 6) AS acf, round(1.96 / sqrt(any_value(n)), 6) AS band FROM l" for k in range(1, 15)))
def acf(spark, sf_dir):
    return op.acf(full(spark, sf_dir), 14)


@query()
def pacf(spark, sf_dir):
    return op.pacf(full(spark, sf_dir), 14)


@query(f"SELECT ts, round(s, 6) AS std FROM (SELECT ts, stddev_samp(x) OVER w AS s, count(x) OVER w AS n FROM {_FULL} WINDOW w AS (ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)) WHERE n = 14".replace("round(s, 6)", "round(s, 2)"))
def rolling_dispersion(spark, sf_dir):
    return op.rolling_dispersion(full(spark, sf_dir), 14).withColumn("std", F.round("std", 2))


@query(f"WITH s AS (SELECT ts, CASE WHEN ts >= '1999-01-01' THEN x * 1.5 ELSE x END AS x FROM {_FULL}), p AS (SELECT ts, row_number() OVER (ORDER BY ts) AS i, sum(x) OVER (ORDER BY ts) AS c, sum(x) OVER () AS s, count(*) OVER () AS n, stddev_samp(x) OVER () AS sd FROM s), q AS (SELECT ts, i, abs(c / i - (s - c) / (n - i)) AS step, n, sd FROM p WHERE i >= 10 AND n - i >= 10), r AS (SELECT ts, i, step * sqrt(i * (n - i) / n::DOUBLE) / sd AS stat, step / sd AS effect FROM q ORDER BY stat DESC, i LIMIT 1) SELECT ts AS last_before, i::INTEGER AS n_before, round(stat, 4) AS statistic, round(effect, 4) AS effect, stat >= 5 AND effect >= .5 AS is_change FROM r")
def cusum_split(spark, sf_dir):
    return op.cusum_split(full(spark, sf_dir).withColumn("x", F.when(F.col("ts") >= F.lit("1999-01-01").cast("timestamp_ntz"), F.col("x") * 1.5).otherwise(F.col("x"))))


_PARTS = (
    f"(WITH s AS (SELECT ts, x, row_number() OVER (ORDER BY ts) AS i, CASE WHEN count(x) OVER w = 7 THEN avg(x) OVER w END AS trend FROM {_FULL} WINDOW w AS (ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)), p AS (SELECT i % 7 AS phase, avg(x - trend) AS c FROM s GROUP BY 1), q AS (SELECT phase, c - avg(c) OVER () AS cycle FROM p) "
    "SELECT ts, x, trend, cycle, x - trend - cycle AS remainder FROM s JOIN q ON i % 7 = phase)"
)


@query(f"SELECT count(*) AS n, round(greatest(0, least(1, 1 - var_samp(remainder) / var_samp(cycle + remainder))), 6) AS cycle_strength, round(greatest(0, least(1, 1 - var_samp(remainder) / var_samp(trend + remainder))), 6) AS trend_strength FROM {_PARTS} WHERE trend IS NOT NULL")
def moving_average_strength(spark, sf_dir):
    return op.strengths(op.moving_average_parts(full(spark, sf_dir), 7))


@query(f"WITH p AS (SELECT * FROM {_PARTS} WHERE remainder IS NOT NULL), q AS (SELECT quantile_cont(remainder, .25) AS a, quantile_cont(remainder, .75) AS b, count(*) AS n FROM p), o AS (SELECT ts, x, remainder, n FROM p, q WHERE remainder < a - 1.5 * (b - a) OR remainder > b + 1.5 * (b - a)) SELECT ts, round(x, 4) AS x, round(remainder, 4) AS remainder FROM o WHERE (SELECT count(*) FROM o) <= .2 * n ORDER BY abs(remainder) DESC, ts LIMIT 15".replace("round(x, 4)", "round(x, 2)").replace("round(remainder, 4)", "round(remainder, 2)"))
def remainder_outliers(spark, sf_dir):
    out = op.remainder_outliers(op.moving_average_parts(full(spark, sf_dir), 7), fence=1.5, most=0.2)
    return out.select("ts", F.round("x", 2).alias("x"), F.round("remainder", 2).alias("remainder"))


_SPARSE = f"(SELECT ts, CASE WHEN dayofyear(ts) % 3 = 0 THEN x ELSE 0 END AS x FROM {_FULL})"


@query(f"WITH s AS (SELECT x, row_number() OVER (ORDER BY ts) AS i FROM {_SPARSE}), z AS (SELECT x, i - lag(i) OVER (ORDER BY i) AS step FROM s WHERE x <> 0), f AS (SELECT avg(step) AS adi, (stddev_samp(x) / avg(x))**2 AS cv2 FROM z), r AS (SELECT max(n) AS m FROM (SELECT count(*) AS n FROM (SELECT i - row_number() OVER (ORDER BY i) AS g FROM s WHERE x = 0) GROUP BY g)) SELECT (SELECT round(avg((x = 0)::INT), 6) FROM s) AS zero_rate, round(adi, 6) AS adi, round(cv2, 6) AS cv2, CASE WHEN adi < 1.32 THEN CASE WHEN cv2 < .49 THEN 'smooth' ELSE 'erratic' END WHEN cv2 < .49 THEN 'intermittent' ELSE 'lumpy' END AS kind, m AS longest_zero_run FROM f, r")
def intermittency(spark, sf_dir):
    return op.intermittency(full(spark, sf_dir).withColumn("x", F.when(F.dayofyear("ts") % 3 == 0, F.col("x")).otherwise(0.0)))


@query(
    f"WITH b AS (SELECT a.ts, a.x AS y, s.x AS z FROM {_DAYS} a JOIN (SELECT date_trunc('day', l_shipdate)::TIMESTAMP AS ts, sum(l_quantity) AS x FROM lineitem GROUP BY 1) s USING (ts)), l AS (SELECT y, z AS z0, " + ", ".join(f"lag(z, {k}) OVER (ORDER BY ts) AS z{k}" for k in range(1, 15)) + " FROM b) " + " UNION ALL ".join(f"SELECT {k} AS lag, round(corr(y, z{k}), 6) AS r FROM l" for k in range(15))
)
def cross_correlation(spark, sf_dir):
    return op.cross_correlation(days(spark, sf_dir), op.per_period(table(spark, sf_dir, "lineitem"), "l_shipdate", "l_quantity", "day", "sum"), 14)


@query(f"WITH s AS (SELECT ts, row_number() OVER (ORDER BY ts) AS i, count(*) OVER () AS n FROM {_FULL}), c AS (SELECT k, n - 30 * (6 - k) AS cut FROM range(1, 6) r(k), (SELECT any_value(n) AS n FROM s)) SELECT row_number() OVER (ORDER BY cut)::INTEGER AS fold, cut AS n_train, a.ts AS train_end, b.ts AS test_end FROM c JOIN s a ON a.i = cut JOIN s b ON b.i = cut + 30")
def backtest_plan(spark, sf_dir):
    return op.backtest_plan(full(spark, sf_dir), 7, 30)


@query()
def stl_strength(spark, sf_dir):
    return op.stl_strength(full(spark, sf_dir), 7)


@query()
def stationarity(spark, sf_dir):
    return op.stationarity(full(spark, sf_dir))


@query()
def change_points(spark, sf_dir):
    return op.change_points(full(spark, sf_dir).withColumn("x", F.when(F.col("ts") >= F.lit("1999-01-01").cast("timestamp_ntz"), F.col("x") * 2).otherwise(F.col("x"))), 7)
