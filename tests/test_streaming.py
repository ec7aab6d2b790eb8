"""The ledger's streaming forms give what the batch forms give."""

from pyspark.sql import functions as F

from stratafile.sources import corpus
from stratafile.streaming import liveness


def test_sessions_in_a_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00"), (1, "2024-01-01 00:10:00"), (2, "2024-01-01 00:00:30"), (3, "2024-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "run_id long, t string").select("run_id", F.to_timestamp("t").alias("event_time"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = liveness.sessions(stream).writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["run_id"], r["beats"]) for r in spark.table("sessions").collect()) == [(1, 1), (1, 2), (2, 1)]


def test_minutes_of_the_event_table(spark):
    e = corpus.read(spark, "/root/testdata/sf0.001", "events").select(F.col("ts").cast("timestamp").alias("event_time"), F.col("event_type").alias("severity"))
    assert liveness.per_minute(e).agg(F.sum("events")).first()[0] == e.count()
