"""Streams give what batches give."""

from pyspark.sql import functions as F

from pulsegrid.streaming import online


def test_online_intervals(spark, tmp_path):
    rows = [(t, i * 1000 + t, i) for t in (1, 2) for i in range(6)]
    df = spark.createDataFrame(rows, "train long, us long, part int").withColumn("ts", F.timestamp_micros(F.col("us") + 1_700_000_000_000_000))
    for k in range(3):
        df.where(f"part div 2 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = online.online_intervals(stream).writeStream.format("memory").queryName("online").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("online").collect()
    assert len(got) == 12
    assert sum(r.isi is None and not r.late for r in got) == 2
    assert {round(r.isi * 1e12) for r in got if r.isi is not None} == {1000}


def test_window_counts_of_a_stream(spark, tmp_path):
    df = spark.range(20).select((F.col("id") % 2).alias("train"), F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000).alias("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = online.window_counts(stream, "5 minutes").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, online.window_counts(df, "5 minutes").collect()))
