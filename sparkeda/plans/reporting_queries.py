"""Findings and streaming-shaped queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkeda.operators import catalog
from sparkeda.plans.registry import query, table
from sparkeda.streaming import incremental

SEVERITY = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}


@query("SELECT * FROM (VALUES ('High missingness', 'c_name', 'high', 0::INTEGER), ('Constant column', 'flag', 'low', 1), ('All-unique values', 'c_custkey', 'info', 2)) t(title, \"column\", severity, \"position\")")
def findings_ranked(spark, sf_dir):
    """Findings of a catalogue with planted defects, by severity and then name."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 1, F.col("c_mktsegment")).alias("c_name"), F.lit("x").alias("flag"))
    cat = catalog.column_catalog(c, "customer")
    title = F.when(F.col("missing_rate") >= 0.2, "High missingness").when(F.col("n_distinct") == 1, "Constant column").when(F.col("n_distinct") == F.col("n_rows"), "All-unique values")
    severity = F.when(F.col("missing_rate") >= 0.5, "high").when(F.col("missing_rate") >= 0.2, "medium").when(F.col("n_distinct") == 1, "low").otherwise("info")
    rank = F.create_map(*[F.lit(v) for pair in SEVERITY.items() for v in pair])
    found = cat.select(title.alias("title"), "column", severity.alias("severity")).where("title IS NOT NULL")
    return found.withColumn("position", F.row_number().over(Window.orderBy(rank[F.col("severity")], "title", "column")) - 1)


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 2) AS sum, round(min(value), 4) AS min, round(max(value), 4) AS max FROM events GROUP BY 1, 2")
def windowed_catalog(spark, sf_dir):
    """The stream's window statistics, run over the events as a batch."""
    out = incremental.windowed_catalog(table(spark, sf_dir, "events"), "ts", "value", ["event_type"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("sum", 2).alias("sum"), F.round("min", 4).alias("min"), F.round("max", 4).alias("max"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def event_sessions(spark, sf_dir):
    out = incremental.sessions(table(spark, sf_dir, "events"), "ts", "user_id", "6 hours")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")
