"""Stream operators over files, against the batch ones."""

from pyspark.sql import functions as F

from blockloom.operators import events
from blockloom.streaming import events as streams


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def source(spark, tmp_path, times):
    rows = [("a" if i % 2 else "b", t, i) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "k string, t int, i int").select("k", F.timestamp_seconds(F.col("t") + 1_700_000_000).alias("ts"), "i")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return df, spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def test_throttle_stream(spark, tmp_path):
    df, stream = source(spark, tmp_path, [0, 0, 4, 5, 9, 12, 30, 31])
    got = run(streams.throttle_stream(stream, "k", "ts", 10, "1 hour"), "throttled", "append")
    assert {r.i for r in got.collect()} == {r.i for r in events.throttle(df, "k", "ts", "i", 10).collect()}


def test_latest_stream(spark, tmp_path):
    _, stream = source(spark, tmp_path, [0, 0, 4, 5])
    got = run(streams.latest_stream(stream, "k", "ts", "i"), "latest", "complete")
    assert {(r.k, r.i) for r in got.collect()} == {("b", 2), ("a", 3)}


def test_debounce_stream(spark, tmp_path):
    df, stream = source(spark, tmp_path, [0, 0, 4, 5, 60, 61, 100_000, 100_000])
    got = run(streams.debounce_stream(stream, "k", "ts", "i", "10 seconds", "1 second"), "debounced", "append")
    expected = {(r.k, r.i, r.n) for r in events.debounce(df.where("i < 6"), "k", "ts", "i", 10).collect()}
    assert {(r.k, r.i, r.n) for r in got.collect()} == expected
