"""Places of many keys: what is sent for a key doesn't grow with the parts that busy keys are dealt over."""

import random

import pytest

from tidemark.operators import scans


def want(rows, levels):
    own = {}
    for k, v in rows:
        own.setdefault(k, []).append(v)
    return {(k, j): sorted(v)[min(int(p * len(v)), len(v) - 1)] for k, v in own.items() for j, p in enumerate(levels)}


def test_many_keys_are_not_repeated(spark, monkeypatch):
    """3,000 keys of five values: one row a key is wanted, and no plan repeats it or sends all of it to every executor."""
    plans, keep = {}, scans.kept

    def seen(rows, name):
        plans[name] = rows._jdf.queryExecution()
        return keep(rows, name)

    monkeypatch.setattr(scans, "kept", seen)
    r = random.Random(1)
    rows = [(k, r.gauss(0, 1)) for k in range(3000) for _ in range(5)]
    levels = (0.01, 0.05, 0.5)
    got = scans.at_places(spark.createDataFrame(rows, "k long, v double").repartition(4), "k", "v", levels)
    assert {(x["k"], x["level"]): x["v"] for x in got.collect()} == want(rows, levels)
    plan = plans["places-found"]
    assert "explode(sequence" not in plan.optimizedPlan().toString() and "Broadcast" not in plan.sparkPlan().toString()
    assert plans["places-wanted"].toRdd().count() == 3000


@pytest.mark.parametrize("accuracy, margin", [(10_000, 2.0), (20, 0.001)])
def test_busy_and_quiet_keys(spark, accuracy, margin):
    """Some keys over the bound, one of them with one value in most rows, others under it; also where intervals miss."""
    r = random.Random(2)
    rows = [(1, 0.0 if r.random() < 0.8 else r.gauss(0, 1)) for _ in range(4000)] + [(2, r.gauss(0, 1)) for _ in range(600)] + [(k, r.gauss(0, 1)) for k in range(3, 60) for _ in range(9)] + [(None, float(i)) for i in range(700)]
    levels = (0.0, 0.05, 0.5, 1.0)
    got = scans.at_places(spark.createDataFrame(rows, "k int, v double").repartition(5), "k", "v", levels, accuracy=accuracy, margin=margin, busy_rows=500).collect()
    assert len(got) == 4 * 60 and {(x["k"], x["level"]): x["v"] for x in got} == want(rows, levels)


@pytest.mark.parametrize("query", ["risk_metrics", "csv_export"])
def test_risk_figures_send_one_row_a_user(spark, monkeypatch, query):
    """The places of the risk figures, as the queries ask for them."""
    from tidemark.plans import queries

    plans, keep = {}, scans.kept
    monkeypatch.setattr(scans, "kept", lambda rows, name: (plans.setdefault(name, rows._jdf.queryExecution()), keep(rows, name))[1])
    d = "/root/testdata/sf0.001"
    assert queries.QUERIES[query](spark, d).count() > 0
    plan, users = plans["places-found"], spark.read.parquet(f"{d}/events.parquet").where("event_type <> 'error'").select("user_id").distinct().count()
    assert "explode(sequence" not in plan.optimizedPlan().toString() and "BroadcastHashJoin" not in plan.sparkPlan().toString()
    assert plans["places-wanted"].toRdd().count() == users
