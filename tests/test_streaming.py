"""Streams give what the same operators give on tables."""

from pyspark.sql import functions as F

from chunkwright.streaming.watch import assigned_clusters, keep_chunks, rate_limited, watched_files
from chunkwright.streaming.windows import hourly, sessions


def test_windows(spark, folder, tmp_path):
    events = spark.read.parquet(f"{folder}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = hourly(stream).writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("hours").count() == hourly(events).count()
    assert sessions(events).agg(F.sum("n")).first()[0] == events.count()


def test_watch_and_keep(spark, tmp_path):
    src, out, ck = (tmp_path / n for n in ("src", "out", "ck"))
    src.mkdir()
    (src / "a.py").write_text("def f():\n    pass\n")
    for text in (None, "def g():\n    pass\n\ndef h():\n    pass\n"):
        if text:
            (src / "b.py").write_text(text)
        keep_chunks(watched_files(spark, str(src)), str(out), str(ck)).awaitTermination()
    assert sorted(r["name"] for r in spark.read.parquet(str(out)).filter("name IS NOT NULL").collect()) == ["f", "g", "h"]


def test_token_bucket(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.createDataFrame([("u", float(t)) for t in (0, 0, 0, 1, 10)], "user_id STRING, ts DOUBLE").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id STRING, ts DOUBLE").parquet(str(tmp_path / "in"))
    q = rate_limited(stream, 2, 1.0).writeStream.format("memory").queryName("bucket").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.allowed for r in spark.table("bucket").orderBy("ts", F.desc("allowed")).collect()] == [True, True, False, True, True]


def test_clusters(spark):
    v = spark.createDataFrame([("p", 1, [1.0, 0.0]), ("p", 2, [0.99, 0.01]), ("p", 3, [0.0, 1.0])], "part STRING, id BIGINT, v ARRAY<DOUBLE>")
    assert [(r.id, r.cluster) for r in assigned_clusters(v).orderBy("id").collect()] == [(1, 1), (2, 1), (3, 3)]
