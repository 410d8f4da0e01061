"""Incremental statistics of a stream: mergeable aggregates by event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def event_time(df: DataFrame, timestamp: str) -> DataFrame:
    """Watermarks need a timestamp with a zone; one without is taken as UTC."""
    kind = df.schema[timestamp].dataType
    return df.withColumn(timestamp, F.col(timestamp).cast("timestamp")) if isinstance(kind, T.TimestampNTZType) else df


def windowed_catalog(df: DataFrame, timestamp: str, value: str, keys: list[str] | None = None, window: str = "1 day", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Counts, NULLs, sums, squares, ends and an approximate distinct count by window: all merge by addition, minimum or sketch."""
    w = F.window(timestamp, window, slide) if slide else F.window(timestamp, window)
    x = F.col(value).cast("double")
    return event_time(df, timestamp).withWatermark(timestamp, late).groupBy(w.alias("window"), *(keys or [])).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(value).isNull()).alias("n_missing"), F.sum(x).alias("sum"), F.sum(x * x).alias("sum_squares"), F.min(x).alias("min"), F.max(x).alias("max"), F.approx_count_distinct(value).alias("n_distinct")
    ).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *(keys or []), "n", "n_missing", "sum", "sum_squares", "min", "max", "n_distinct")


def merged(parts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Fold window rows into totals with mean and sample deviation."""
    keys = keys or []
    t = parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("n_missing").alias("n_missing"), F.sum("sum").alias("s"), F.sum("sum_squares").alias("q"), F.min("min").alias("min"), F.max("max").alias("max"))
    v = F.col("n") - F.col("n_missing")
    return t.select(*keys, "n", "n_missing", (F.col("s") / v).alias("mean"), F.sqrt((F.col("q") - F.col("s") * F.col("s") / v) / (v - 1)).alias("std"), "min", "max")


def deduplicated(df: DataFrame, timestamp: str, keys: list[str], late: str = "2 hours") -> DataFrame:
    """First row of each key within the watermark."""
    return event_time(df, timestamp).withWatermark(timestamp, late).dropDuplicatesWithinWatermark(keys)


def sessions(df: DataFrame, timestamp: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Runs of a key's events with no gap of that length."""
    w = F.session_window(timestamp, gap)
    out = event_time(df, timestamp).withWatermark(timestamp, late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
