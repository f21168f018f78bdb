"""Sessions, metrics and the outbox on streams over several triggers; reports that are one document."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import validate
from tidemark.operators import orders, security, versions
from tidemark.streaming import metrics, sessions


def add(spark, path, rows, schema):
    df = spark.createDataFrame(rows, schema.replace(" timestamp_ntz", " string"))
    times = {f.split()[0]: F.col(f.split()[0]).cast("timestamp_ntz") for f in schema.split(", ") if "timestamp_ntz" in f}
    df.withColumns(times).coalesce(1).write.mode("append").parquet(path)


def test_sessions_expire_and_are_evicted(spark, tmp_path):
    """After each trigger the store holds what the batch rule keeps, also when a batch is handed over again."""
    store, path, schema = sessions.Sessions(spark, str(tmp_path / "s"), ttl=600, cap=5, width=60), str(tmp_path / "in"), "session_id long, created_at timestamp_ntz"
    at = lambda s: f"2024-01-01 {s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"
    whole, batch = [], 0
    for times in ([0, 10, 20, 30], [100, 110, 121, 131, 140, 20], [115, 650], [1500], [1400, 1500, 1501, 1502, 1503, 1504]):
        rows = [(batch * 100 + i, at(t)) for i, t in enumerate(times)]
        whole += rows
        add(spark, path, rows + rows[:1], schema)
        opened = spark.readStream.schema(schema).parquet(path).withColumn("created_at", F.col("created_at").cast("timestamp"))
        sessions.keep_sessions(opened, store, str(tmp_path / "c")).awaitTermination(60)
        everything = spark.createDataFrame(whole, "session_id long, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
        latest = max(t for _, t in whole)
        want = {r["session_id"] for r in security.evicted(everything, latest, 600, 5).collect()}
        number = store.log.newest().number
        store.take(everything, store.log.newest().facts["batch"])
        assert store.log.newest().number == number
        assert {r["session_id"] for r in store.live().collect()} == want and len(want) <= 5
        batch += 1
    assert len(store.log.newest().facts["counts"]) <= 2  # what is over by age or by the cap is no longer named


def test_listener_equals_the_batch_query(spark, tmp_path):
    path, schema = str(tmp_path / "in"), "method string, path string, status int, latency double"
    rows = [("GET", "/a" if i % 3 else "/b", 500 if i % 7 == 0 else 200, float(i % 120)) for i in range(300)]
    heard = metrics.Totals("http")
    spark.streams.addListener(heard)
    for k in range(3):
        add(spark, path, rows[k * 100 : (k + 1) * 100], schema)
        heard.ended.clear()
        stream = metrics.observed(spark.readStream.schema(schema).parquet(path), routes=(("GET", "/a"), ("GET", "/b")))
        stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(60)
        assert heard.ended.wait(30)
    spark.streams.removeListener(heard)
    got, want = heard.totals(), security.http_latency(spark.createDataFrame(rows, schema), metrics.BOUNDS).collect()
    assert got["n"] == 300 and got["errors"] == sum(r[2] >= 500 for r in rows) and got["sum"] == sum(r[3] for r in rows)
    for w in want:
        assert tuple(got[f"GET {w['path']} {m}"] for m in ("n", "le_10", "le_50", "le_100")) == (w["n"], w["le_10"], w["le_50"], w["le_100"])


def test_outbox_of_a_stream(spark, tmp_path):
    path, schema = str(tmp_path / "in"), "event_id long, user_id long, event_name string"
    hooks = spark.createDataFrame([(1, 10, True, ["a"], "https://ok.example/x"), (1, 11, True, ["a"], "http://ok.example/x"), (2, 20, True, ["a", "b"], "https://two.example"), (2, 21, False, ["a"], "https://ok.example"), (3, 30, True, ["a"], "https://unknown.example")], "user_id long, hook_id long, is_active boolean, event_types array<string>, url string")
    addresses = spark.createDataFrame([("ok.example", "93.184.216.34"), ("two.example", "93.184.216.34"), ("two.example", "10.0.0.1")], "host string, ip string")
    box = versions.Outbox(spark, str(tmp_path / "o"))
    for k, rows in enumerate(([(1, 1, "a"), (2, 1, "b"), (3, 2, "b")], [(4, 1, "a"), (5, 3, "a")])):
        add(spark, path, rows, schema)
        for checkpoint in ("c", f"again{k}"):  # the second starts over: its batches are there already
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
            security.deliver(stream, lambda: security.deliverable(hooks, addresses), box, str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination(60)
    assert sorted((r["event_id"], r["hook_id"]) for r in box.rows().collect()) == [(1, 10), (4, 10)]


def test_orders_of_one_instant(spark):
    """Of two equal orders at one time the first stored is no duplicate."""
    rows = spark.createDataFrame([(i, 1, "A", "buy", 1.0, s, "2024-01-01 00:00:00" if i < 4 else "2024-01-01 00:00:20") for i, s in ((1, "PENDING"), (2, "PENDING"), (3, "FILLED"), (4, "FILLED"))], "order_id long, user_id long, asset string, side string, quantity double, status string, submitted_at string")
    assert sorted(r[0] for r in orders.duplicates(rows, 30).collect()) == [2, 3, 4]


@pytest.mark.parametrize("ip, public", [("192.0.0.9", True), ("192.0.0.10", True), ("192.0.0.11", False), ("::ffff:93.184.216.34", True), ("::FFFF:10.0.0.1", False), ("::ffff:5db8:d822", False), ("8.8.8.8", True), ("8.8.8", False), ("2001:4860:4860::8888", True)])
def test_public_addresses(spark, ip, public):
    assert spark.range(1).select(validate.public_ip(F.lit(ip)).alias("x")).first()["x"] is public


def test_compliance_report_without_anything(spark):
    keys = spark.createDataFrame([], "key_id long, user_id long, algorithm string, is_active boolean, created_at timestamp_ntz")
    logs = spark.createDataFrame([], "log_id long, user_id long, action string, metadata string, created_at timestamp_ntz, signature string, verified boolean")
    body = json.loads(security.compliance_report(keys, logs, 1, "2024-01-01", ("X",)).first()["body"])
    assert body["key_health"] == {"threat_level": "GREEN", "safety_score": 100, "expiring_keys": 0, "keys": []} and body["audit_log"] == {"entries_reviewed": 0, "signatures_verified": 0, "all_verified": True}
    users = spark.createDataFrame([], "user_id long, email string")
    assert security.audit_list(logs, users, 1).count() == 0
