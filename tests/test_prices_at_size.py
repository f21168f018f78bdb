"""Prices of few assets meet the trades of all users: no task gets all rows of an asset."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ledger, scans
from tidemark.plans import queries
from tidemark.sources import relations

TRADES = "trade_id long, user_id long, asset string, side string, quantity double, filled_price double, status string, filled_at string"


@pytest.mark.parametrize("few", [0, 10])
def test_looked_up(spark, few):
    """Keys without a fact and null keys stay, equal rows too; also where facts are many."""
    r = random.Random(3)
    rows = [(r.choice(["A", "A", "A", "B", "C", None]), i // 2) for i in range(4000)]
    facts = {"A": 1.5, "B": None, "D": 4.0}
    df = spark.createDataFrame(rows, "k string, i long").repartition(4)
    got = scans.looked_up(df, spark.createDataFrame(list(facts.items()), "k string, v double"), "k", few=few)
    assert got.columns == ["k", "i", "v"]
    order = lambda x: (x[1], str(x[0]))
    assert sorted(map(tuple, got.collect()), key=order) == sorted(((k, i, facts.get(k)) for k, i in rows), key=order)


@pytest.fixture
def large(spark):
    """Plans as for tables above the bounds of broadcasts and of small partitions."""
    for key, value in (bounds := {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}).items():
        spark.conf.set(key, value)
    yield
    for key in bounds:
        spark.conf.unset(key)


def test_a_hot_key_of_many_facts_is_dealt(spark, large):
    rows = spark.range(40_000).select(F.lit("A").alias("k"), "id")
    facts = spark.range(300).select(F.concat(F.lit("A"), F.when(F.col("id") > 0, F.col("id").cast("string")).otherwise("")).alias("k"), F.col("id").alias("v"))
    got = scans.looked_up(rows, facts, "k", few=100).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max("v").alias("v")).collect()
    assert sum(x["n"] for x in got) == 40_000 and {x["v"] for x in got} == {0} and max(x["n"] for x in got) < 30_000


@pytest.mark.parametrize("query", ["risk_metrics", "csv_export", "equity_curve", "positions_pnl", "fill_match", "pending_sweep", "order_precheck"])
def test_no_task_holds_an_asset(spark, large, monkeypatch, query):
    """What is shuffled by the asset alone is aggregated before."""
    plans, keep = [], scans.kept

    def seen(rows, name):
        if name != "facts":  # last prices are partial aggregates before they are shuffled
            plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return keep(rows, name)

    monkeypatch.setattr(scans, "kept", seen)
    monkeypatch.setattr(ledger, "kept", seen)
    df = queries.QUERIES[query](spark, "/root/testdata/sf0.001")
    plans.append(df._jdf.queryExecution().executedPlan().toString())
    assert any("hashpartitioning(user_id" in p for p in plans) or query in ("fill_match", "pending_sweep")
    assert not [p for p in plans if re.search(r"hashpartitioning\(asset#\d+, \d", p)]
    assert df.count() > 0


def test_figures_meet_by_one_grouping(spark, large):
    """No task sorts both sides of a join for each figure; users with one trade have zeros, trades without a user none."""
    rows = [(1, 1, "A", "buy", 2.0, 10.0, "FILLED", "2024-01-01"), (2, 2, "A", "buy", 1.0, 10.0, "FILLED", "2024-01-01"), (3, 2, "A", "sell", 1.0, 40.0, "FILLED", "2024-01-02"), (4, None, "A", "buy", 1.0, 10.0, "FILLED", "2024-01-01"), (5, 3, "A", "buy", 1.0, 10.0, "REJECTED", "2024-01-01")]
    trades = spark.createDataFrame(rows, TRADES).withColumn("filled_at", F.col("filled_at").cast("timestamp_ntz"))
    df = ledger.risk_metrics(trades, spark.createDataFrame([("A", 20.0)], "asset string, price double"))
    got = {x["user_id"]: (x["sharpe_ratio"], x["max_drawdown"], x["win_rate"], x["total_trades"], x["var_95"], x["var_99"]) for x in df.collect()}
    assert got.keys() == {1, 2} and got[1] == (0.0, 0.0, 0.0, 1, 0.0, 0.0)
    # User 2: 100,000, then 100,010 (one held at 20 for 10), then 100,030.
    a, b = 10 / 100_000, 20 / 100_010
    mean, sd = (a + b) / 2, abs(a - b) / 2**0.5
    assert got[2] == (round(mean / (sd + 1e-9) * 252**0.5, 3), 0.0, 1.0, 2, 0.0, 0.0)
    assert df._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin") <= 1


@pytest.mark.parametrize("few", [0, 10])
def test_last_price(spark, few):
    """Equal times go by id; null assets, times, ids and prices stay; also where assets are many."""
    rows = [("A", 1, 5, 1.0), ("A", 3, 2, 2.0), ("A", 3, 7, 3.0), ("A", 3, 4, 4.0), ("A", None, 9, 5.0), ("B", None, 1, 6.0), ("B", None, 2, 7.0), (None, 4, 1, 8.0), (None, 2, 2, 9.0), ("C", 1, 1, 10.0), ("C", 2, 2, None), ("D", 1, None, 11.0), ("E", 1, None, 12.0), ("E", 1, 0, 13.0)]
    ticks = spark.createDataFrame(rows, "asset string, filled_at int, trade_id long, filled_price double").withColumn("filled_at", F.timestamp_seconds("filled_at").cast("timestamp_ntz")).repartition(3)
    got = relations.last_price(ticks, few=few)
    assert got.columns == ["asset", "price"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("A", 3.0), ("B", 7.0), (None, 8.0), ("C", None), ("D", 11.0), ("E", 13.0)], key=str)


@pytest.mark.parametrize("query", ["last_price", "csv_export", "risk_metrics", "positions_pnl", "equity_curve", "fill_match", "pending_sweep", "order_precheck"])
def test_last_prices_do_not_sort_what_a_task_reads(spark, large, monkeypatch, query):
    """An aggregate by sorting holds all rows of a task, which are those of a whole row group."""
    plans, keep = [], scans.kept

    def seen(rows, name):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return keep(rows, name)

    for module in (scans, ledger, relations, queries):
        monkeypatch.setattr(module, "kept", seen, raising=False)
    df = queries.QUERIES[query](spark, "/root/testdata/sf0.001")
    plans.append(df._jdf.queryExecution().executedPlan().toString())
    assert df.count() > 0 and any("FileScan" in p for p in plans)
    assert not [p for p in plans if "SortAggregate" in p]
