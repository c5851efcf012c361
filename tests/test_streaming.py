from pyspark.sql import functions as F

from glintflow.operators.incremental import changed_files
from glintflow.schema import severity_rank
from glintflow.streaming import monitor


def test_stream_equals_batch(spark, tiny, tmp_path):
    src = spark.read.parquet(f"{tiny}/sample_diagnostics.parquet")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    seen = []
    s = monitor.read_stream(spark, str(tmp_path / "in"), src.schema, 1)
    q = monitor.fan_out(monitor.worst(s), [lambda b, n: seen.append(b.count()), lambda b, n: b.write.mode("append").parquet(str(tmp_path / "out"))], str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert len(seen) == 3 and spark.read.parquet(str(tmp_path / "out")).count() == sum(seen) == src.where(severity_rank(F.col("severity")) <= 2).count()


def test_windows_with_a_watermark(spark, tiny, tmp_path):
    ev = spark.read.parquet(f"{tiny}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("severity"))
    ev.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = monitor.windowed_counts(monitor.read_stream(spark, str(tmp_path / "in"), ev.schema), "ts", "1 day", "1 hour")
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.start, r.severity): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.start, r.severity): r.n for r in ev.groupBy(F.window("ts", "1 day").start.alias("start"), "severity").agg(F.count(F.lit(1)).alias("n")).collect()}
    last = max(s for s, _ in want)
    assert got == {k: v for k, v in want.items() if k[0] < last}  # the last window is still open


def test_pushed_on_change_only(spark):
    pushed = []
    sink = monitor.OnChange(lambda b: b.groupBy("x").count(), lambda r, n: pushed.append(n))
    one, two = spark.createDataFrame([(1,), (1,)], "x int"), spark.createDataFrame([(2,)], "x int")
    for n, b in enumerate((one, one, two, one)):
        sink(b, n)
    assert pushed == [0, 2, 3]


def test_changed_files_only(spark, tmp_path):
    rows = [("a", "1"), ("b", "2"), ("c", "3")]
    spark.createDataFrame(rows, "file string, hash string").write.parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([("a", "1"), ("b", "x")], "file string, hash string")
    got = []
    s = monitor.read_stream(spark, str(tmp_path / "in"), known.schema)
    monitor.changed_only(s, lambda: known, str(tmp_path / "ck"), lambda b, n: got.extend(r.file for r in b.collect())).awaitTermination(120)
    assert sorted(got) == ["b", "c"]
    v = "file string, mtime bigint, hash string"
    now, was = spark.createDataFrame([("a", 2, "h"), ("b", 1, "h"), ("d", 3, "k")], v), spark.createDataFrame([("a", 1, "h"), ("b", 1, "h"), ("c", 1, "h"), ("d", 1, "h")], v)
    assert {r.file: r.state for r in changed_files(now, was).collect()} == {"a": "touched", "b": "unchanged", "c": "removed", "d": "changed"}


def test_first_seen(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:10:00"), ("b", "2024-01-01 00:20:00")], "id string, t string").select("id", F.to_timestamp("t").alias("t"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = monitor.first_seen(monitor.read_stream(spark, str(tmp_path / "in"), rows.schema), "t", ["id"]).writeStream.format("memory").queryName("first_seen").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.id for r in spark.table("first_seen").collect()) == ["a", "b"]


def test_a_restarted_subscription_goes_on(spark, tmp_path):
    one, two = spark.createDataFrame([(1,), (1,)], "x int"), spark.createDataFrame([(2,)], "x int")
    pushed = []
    for n, b in enumerate((one, one, two, two, one)):  # a new sink each time, as after a restart
        monitor.OnChange(lambda b: b.groupBy("x").count(), lambda r, k: pushed.append(k), str(tmp_path / "last"))(b, n)
    assert pushed == [0, 2, 4]


def test_subscribed_and_health_loop(spark, tiny, tmp_path):
    ev = spark.read.parquet(f"{tiny}/events.parquet").select("event_type", "value")
    ev.repartition(3).write.parquet(str(tmp_path / "in"))
    pushed, scores = [], []
    s = monitor.read_stream(spark, str(tmp_path / "in"), ev.schema, 1)
    monitor.subscribed(s, lambda b: b.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), lambda r, n: pushed.append(r.count()), str(tmp_path / "ck1")).awaitTermination(120)
    assert len(pushed) == 3
    measured = lambda b: b.groupBy(F.col("event_type").alias("component")).agg((F.avg("value") / 100).alias("hit_rate"), F.avg("value").alias("error_rate"), F.lit(False).alias("breaker_open"), F.lit(True).alias("available"), F.max("value").alias("cpu"), F.avg("value").alias("memory"), F.avg("value").alias("response_ms"))
    monitor.health_loop(s, measured, lambda r, n: scores.extend(r.collect()), str(tmp_path / "ck2")).awaitTermination(120)
    assert len(scores) == 15 and {r.status for r in scores} <= {"Online", "Degraded", "Offline"} and any(r.alerts for r in scores)
