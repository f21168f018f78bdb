import hashlib
import json

from pyspark.sql import functions as F

from tidemark.functions import validate
from tidemark.operators import sinks
from tidemark.sources import feeds, relations


def test_append_and_json_lines(spark, tmp_path):
    path = str(tmp_path / "rows")
    for a in "AB":
        sinks.append(spark.createDataFrame([(a,)], "asset string"), path)
    assert sorted(r[0] for r in spark.read.parquet(path).collect()) == ["A", "B"]
    sinks.json_lines(spark.read.parquet(path), str(tmp_path / "j"))
    assert sorted(json.loads(r[0])["asset"] for r in spark.read.text(str(tmp_path / "j")).collect()) == ["A", "B"]


def test_report_and_envelope(spark, tmp_path):
    lines = spark.createDataFrame([(2, "b", "z"), (0, "", "head"), (1, "a", "x")], "section_ord int, k string, line string")
    sinks.report(lines, str(tmp_path / "r"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "r")).collect()] == ["head", "x", "z"]
    signals = spark.createDataFrame([("B", 1.0), ("A", 2.0), ("C", 3.0)], "asset string, spin double")
    watch = spark.createDataFrame([("Z",), ("B",), ("A",), ("A",)], "asset string")
    body = json.loads(sinks.envelope(signals, watch, "now").first()["body"])
    assert (body["n_assets"], body["total_assets"], body["watchlist"]) == (2, 3, ["A", "B", "Z"]) and [s["asset"] for s in body["signals"]] == ["A", "B"]
    assert json.loads(sinks.envelope(signals.limit(0), watch.limit(0), "now").first()["body"])["signals"] == []


def test_feeds(spark, tmp_path, monkeypatch):
    sha = hashlib.sha1(b"pw").hexdigest().upper()
    (tmp_path / f"{sha[:5]}.txt").write_text(f"{sha[5:]}:7\n{'0' * 35}:1\n")
    asked = spark.createDataFrame([(1, "pw"), (2, "other")], "password_id long, password string")
    got = validate.breach_count(asked, feeds.breach_ranges(spark, str(tmp_path / "*.txt")))
    assert dict(map(tuple, got.collect())) == {1: 7, 2: 0}
    read = spark.createDataFrame([(sha[:5],)], "prefix string")
    got = validate.breach_count(asked, feeds.breach_ranges(spark, str(tmp_path / "*.txt")), read)
    assert dict(map(tuple, got.collect())) == {1: 7, 2: -1}
    (tmp_path / "i.json").write_text('{"number": 1, "title": "a"}\n{"number": 2, "pull_request": {"url": "u"}}\n')
    assert [r["number"] for r in feeds.issues(spark, str(tmp_path / "i.json")).collect()] == [1]
    (tmp_path / "secret").write_text("x\n")
    monkeypatch.setenv("TIDE_KEY_FILE", str(tmp_path / "secret"))
    monkeypatch.setenv("TIDE_KEY", "")
    assert feeds.setting("TIDE_KEY") == "x" and feeds.setting("TIDE_NONE", "d") == "d"


def test_long_bars_and_history(spark):
    wide = spark.createDataFrame([("2024-01-01", 1.0, None), ("2024-02-15", 2.0, 3.0)], "d string, A double, B double").withColumn("d", F.to_date("d"))
    long_ = relations.long_bars(wide)
    assert long_.count() == 3 and relations.history(long_, "2024-02-20", 1).count() == 2


def test_point_read_reaches_the_scan(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "t"))
    row = relations.point_read(spark.read.parquet(str(tmp_path / "t")), "id", 7)
    assert "EqualTo(id,7)" in row._jdf.queryExecution().toString() and row.count() == 1


def scanned(df):
    """Rows that the scans of a query have handed on, from its metrics."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if hasattr(plan, "executedPlan") and "AdaptiveSparkPlan" in plan.nodeName() else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_sorted_layout_reads_few_rows(spark, tmp_path):
    rows = spark.range(200_000).select((F.xxhash64("id") % 10**9).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("body"))
    plain, laid = str(tmp_path / "plain"), str(tmp_path / "laid")
    rows.repartition(4).write.parquet(plain)
    sinks.sorted_layout(rows, laid, "k", ranges=4)
    key = rows.where("id = 77").first()["k"] if "id" in rows.columns else rows.first()["k"]
    one, slow = (relations.point_read(spark.read.parquet(p), "k", key) for p in (laid, plain))
    assert one.collect() == slow.collect() and one.count() >= 1
    assert scanned(one) <= 4_000 < 100_000 <= scanned(slow)
    absent = relations.point_read(spark.read.parquet(laid), "k", key + 1)
    assert absent.count() == 0 and scanned(absent) <= 4_000
