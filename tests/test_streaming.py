import shutil

from pyspark.sql import functions as F

from glyphstream.streaming.temporal import windowed_counts

SF = "/root/testdata/sf0.001"


def test_stream_counts_what_a_batch_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    shutil.copy(f"{SF}/events.parquet", tmp_path / "in")
    batch = spark.read.parquet(f"{SF}/events.parquet")
    assert dict(batch.dtypes)["ts"] == "timestamp_ntz"
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    query = windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    want = batch.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").count().select("w.start", "event_type", F.col("count").alias("n"))
    got = spark.table("counts").select("start", "event_type", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
