from __future__ import annotations

from pyspark.sql import functions as F

from litspan.operators import state as batch
from litspan.streaming import state


def run(df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def events(spark, sf_dir, tmp_path):
    source = f"{tmp_path}/events"
    spark.read.parquet(f"{sf_dir}/events.parquet").write.parquet(source)
    return state.event_time(spark.readStream.schema(spark.read.parquet(source).schema).parquet(source))


def test_cache_outcomes_equal_the_replay(spark, sf_dir, tmp_path):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    stream = state.cache_outcomes(events(spark, sf_dir, tmp_path), "user_id", "ts", "event_id", ttl=86_400.0, delay="1 day")
    got = {r.event_id: r.outcome for r in run(stream, "append", "outcomes").collect()}
    log = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    want = {r.event_id: r.outcome for r in batch.cache_replay(log, "user_id", "s", "event_id", ttl=86_400.0).collect()}
    assert got == want


def test_windows_equal_a_batch_count(spark, sf_dir, tmp_path):
    stream = state.request_windows(events(spark, sf_dir, tmp_path), "ts", "event_type", "1 day")
    got = {(r.window_start, r.event_type): r.requests for r in run(stream, "complete", "windows").collect()}
    day = F.window(F.col("ts").cast("timestamp"), "1 day").start
    want = {(r.d, r.event_type): r["count"] for r in spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(day.alias("d"), "event_type").count().collect()}
    assert got == want


def test_single_flight_keeps_one_of_each_key(spark, sf_dir, tmp_path):
    stream = state.single_flight(events(spark, sf_dir, tmp_path), ["user_id"], "ts", "3650 days")
    found = run(stream, "append", "flights")
    assert found.count() == found.select("user_id").distinct().count() == spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().count()


def test_upsert_sink_is_repeatable(spark, tmp_path):
    write = state.upsert_sink(str(tmp_path / "t"), "k", "at")
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, at int, v string")
    write(df, 0)
    write(df, 0)
    assert sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [("a", "y"), ("b", "z")]
