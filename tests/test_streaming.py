from pyspark.sql import functions as F

from sparkeda.streaming import incremental as inc


def test_windows_of_a_stream_equal_the_batch(spark, tmp_path):
    src = spark.range(500).select(F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, id * 7)").cast("timestamp_ntz").alias("ts"), (F.col("id") % 5).alias("k"), F.when(F.col("id") % 11 != 0, F.col("id") * 1.5).alias("v"))
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = inc.windowed_catalog(stream, "ts", "v").writeStream.outputMode("complete").format("memory").queryName("win").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("win")
    assert got.agg(F.sum("n"), F.sum("n_missing")).first() == (500, 46)
    m = inc.merged(got).first()
    want = src.agg(F.avg("v"), F.stddev_samp("v")).first()
    assert abs(m["mean"] - want[0]) < 1e-9 and abs(m["std"] - want[1]) < 1e-6


def test_sessions_and_deduplication(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (1, "2024-01-01 02:00:00"), (2, "2024-01-01 00:00:00")], "k int, t string").select("k", F.col("t").cast("timestamp_ntz").alias("ts"))
    assert inc.sessions(df, "ts", "k").count() == 3
