from collections import Counter

from pyspark.sql import functions as F

from tidemark.operators import security
from tidemark.streaming import stateful


def run(df, mode="append"):
    name = f"t{abs(hash(str(df.schema)))}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def source(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "in"))
    return stateful.read_stream(spark, str(tmp_path / "in"), schema.replace("ts string", "ts timestamp_ntz"))


def test_lockout(spark, tmp_path):
    rows = [("u", i, f"2024-01-01 00:00:0{i}", i != 4) for i in range(4)] + [("u", 9, "2024-01-01 01:00:00", False)]
    s = source(spark, tmp_path, rows, "key string, attempt_id long, ts string, failed boolean")
    got = dict(map(tuple, run(stateful.lockout(s, failures=3))))
    assert got == {0: "failed", 1: "failed", 2: "locked", 3: "refused", 9: "ok"}


def test_fixed_windows(spark, tmp_path):
    rows = [("u", i, f"2024-01-01 00:00:{t:02d}") for i, t in enumerate((0, 5, 9, 10, 30))]
    s = source(spark, tmp_path, rows, "key string, request_id long, ts string")
    got = {r["request_id"]: (r["seen"], r["allowed"]) for r in run(stateful.fixed_windows(s, 10, 2))}
    assert got == {0: (1, True), 1: (2, True), 2: (3, False), 3: (1, True), 4: (1, True)}


def test_replay_guard(spark, tmp_path):
    rows = [("A", "n1", 100.0, "2024-01-01 00:00:00"), ("A", "n1", 90.0, "2024-01-01 00:00:01"), ("A", "n2", 80.0, "2024-01-01 00:00:02")]
    s = source(spark, tmp_path, rows, "asset string, nonce string, price double, ts string")
    assert sorted(r["nonce"] for r in run(stateful.replay_guard(s))) == ["n1", "n2"]


def test_sliding_windows(spark, tmp_path):
    rows = [("u", i, f"2024-01-01 00:00:{t:02d}") for i, t in enumerate((0, 5, 9, 10, 30))]
    s = source(spark, tmp_path, rows, "key string, request_id long, ts string")
    got = {r["request_id"]: (r["seen"], r["allowed"]) for r in run(stateful.sliding_windows(s, 10, 2))}
    assert got == {0: (1, True), 1: (2, True), 2: (3, False), 3: (4, False), 4: (1, True)}


def test_state_goes_with_the_watermark(spark, tmp_path):
    """A key's state is dropped once the watermark has passed its window, and a later request starts anew."""
    path, schema = str(tmp_path / "in"), "key string, request_id long, ts timestamp_ntz"
    (tmp_path / "in").mkdir()
    q = stateful.fixed_windows(stateful.read_stream(spark, path, schema, delay="1 second"), 10, 2)
    for rows in ([("u", 1, "2024-01-01 00:00:00")], [("v", 2, "2024-01-01 02:00:00")], [("v", 3, "2024-01-01 04:00:00")]):
        df = spark.createDataFrame(rows, "key string, request_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        df.coalesce(1).write.mode("append").parquet(path)
        w = q.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        w.awaitTermination(120)
        left = w.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert left == 1


def test_push(spark, tmp_path):
    bars = [(a, f"2024-{1 + i // 28:02d}-{1 + i % 28:02d} 00:00:00", 100.0 + (i * 7 + j * 3) % 11) for j, a in enumerate("AB") for i in range(60)]
    s = source(spark, tmp_path, bars, "asset string, ts string, close double")
    table = spark.createDataFrame([(a, d[:10], c) for a, d, c in bars], "asset string, d string, close double")
    watch = spark.createDataFrame([(7, "B")], "user_id long, asset string")
    got = []
    q = stateful.push(s, lambda df: got.append(df.select("user_id", "asset").collect()), lambda: table, watchlist=lambda: watch).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in got[-1]] == [(7, "B")]


def test_limits_of_a_key_with_more_rows_than_a_batch(spark, tmp_path):
    """25,000 requests of one key, stored newest first: batches of a trigger come in no order."""
    rows = spark.range(25_000).select(F.lit("u").alias("key"), F.col("id").alias("request_id"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id")).cast("timestamp_ntz").alias("ts"), (F.col("id") % 3 > 0).alias("failed"))
    rows.coalesce(1).sortWithinPartitions(F.desc("request_id")).write.parquet(str(tmp_path / "in"))
    s = stateful.read_stream(spark, str(tmp_path / "in"), "key string, request_id long, ts timestamp_ntz, failed boolean")
    want = {r["request_id"]: (r["seen"], r["allowed"]) for r in security.rate_limited(rows.withColumnRenamed("ts", "at"), 60, 30).collect()}
    got = {r["request_id"]: (r["seen"], r["allowed"]) for r in run(stateful.sliding_windows(s, 60, 30))}
    assert got == want and max(n for n, _ in got.values()) == 61
    fixed = {r["request_id"]: r["seen"] for r in run(stateful.fixed_windows(s, 60, 30))}
    assert fixed == {i: i % 60 + 1 for i in range(25_000)}
    attempts = rows.withColumnRenamed("request_id", "attempt_id")
    locks = Counter(r["outcome"] for r in run(stateful.lockout(s.withColumnRenamed("request_id", "attempt_id"), 2, 100, 50)))
    batch = security.lockouts(attempts.withColumnRenamed("ts", "at"), 2, 100, 50).first()
    assert (locks["locked"], locks["refused"]) == (batch["locks"], batch["refused"])


def test_sliding_windows_over_triggers_and_late_requests(spark, tmp_path):
    path, times = str(tmp_path / "in"), ([0, 5, 9], [3, 12, 14], [13])
    (tmp_path / "in").mkdir()
    q, got = stateful.sliding_windows(stateful.read_stream(spark, path, "key string, request_id long, ts timestamp_ntz"), 10, 2), {}
    out = str(tmp_path / "out")
    for part in times:
        df = spark.createDataFrame([("u", t, f"2024-01-01 00:00:{t:02d}") for t in part], "key string, request_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        df.coalesce(1).write.mode("append").parquet(path)
        q.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    got = {r["request_id"]: r["seen"] for r in spark.read.parquet(out).collect()}
    assert got == {0: 1, 5: 2, 9: 3, 3: 2, 12: 4, 14: 4, 13: 5}
