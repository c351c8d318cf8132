from cuewright.operators.words import sessions
from cuewright.streaming.sessions import pause_sessions
from pyspark.sql import functions as F


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, 0), (1, 3600), (1, 3600 + 21600), (1, 3600 + 2 * 21600 - 1), (2, 50), (1, 10_000_000), (2, 10_000_000)]
    df = spark.createDataFrame(rows, "user_id long, t long").select("user_id", F.timestamp_seconds("t").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = {(r["user_id"], r["start_s"], r["n_events"]) for r in sessions(df, "user_id", F.col("ts").cast("long"), 21600).collect()}
    assert {(r["user_id"], r["start_us"] // 1_000_000, r["n_events"]) for r in pause_sessions(df).collect()} == batch
    stream = pause_sessions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("s").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    done = {(r["user_id"], r["start_us"] // 1_000_000, r["n_events"]) for r in spark.table("s").collect()}
    assert done == {b for b in batch if b[1] < 10_000_000}
