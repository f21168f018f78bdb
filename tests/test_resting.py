"""Resting orders on streams against a plain loop over events in time order."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import resting
from tidemark.streaming.runs import run_once


def loop(events):
    """Events (asset, t, kind, order_id, side, order_type, limit, stop, price) in order; fills by order."""
    open_, last, gone, out = {}, {}, set(), {}
    for asset, t, kind, order, side, type_, limit, stop, price in events:
        if kind == resting.TICK:
            last[asset] = price
            for o, (a, *row) in list(open_.items()):
                if a == asset and (p := resting.fill_price(*row, price)) is not None:
                    out[o] = (t, p)
                    del open_[o]
        elif kind == resting.CANCEL:
            if open_.pop(order, None) is None:
                gone.add(order)
        elif order not in out and order not in gone:
            row = (side, type_, limit, stop)
            if (type_ in ("limit", "stop_limit") and limit is None) or (type_ in ("stop", "stop_limit") and stop is None):
                continue
            p = resting.fill_price(*row, last[asset]) if asset in last else None
            if p is not None:
                out[order] = (t, p)
            else:
                open_[order] = (asset, *row)
    return out, set(open_)


def made(seed, n=300):
    r, rows, t = random.Random(seed), [], 0.0
    price = {"A": 100.0, "B": 50.0}
    for i in range(n):
        t, asset, kind = t + r.random(), r.choice("AB"), r.choice((1, 1, 2, 2, 2, 0))
        if kind == resting.TICK:
            price[asset] *= 1 + r.gauss(0, 0.02)
            rows.append((asset, t, kind, i, None, None, None, None, price[asset]))
        elif kind == resting.ORDER:
            type_, near = r.choice(("limit", "stop", "stop_limit", "market")), lambda: round(price[asset] * (1 + r.gauss(0, 0.04)), 2) if r.random() < 0.95 else None
            rows.append((asset, t, kind, i, r.choice(("buy", "sell")), type_, near() if "limit" in type_ else None, near() if "stop" in type_ else None, None))
        else:
            rows.append((asset, t, kind, r.randrange(n), None, None, None, None, None))
    return [x for x in rows if x[2] != 0 or any(y[3] == x[3] and y[2] == 2 and y[0] == x[0] for y in rows)]


@pytest.mark.parametrize("seed, cuts", [(1, 1), (2, 4)])
def test_fills_once(spark, tmp_path, seed, cuts):
    """Over several triggers, each a restart from the checkpoint: every order fills once, at the first event that allows it, and filled or cancelled orders leave the state."""
    rows, path = made(seed), str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    want, still = loop(rows)
    size = -(-len(rows) // cuts)
    stream = resting.fills_once(spark.readStream.schema(resting.EVENTS).parquet(path))
    for k in range(cuts):
        part = rows[k * size : (k + 1) * size]
        random.Random(k).shuffle(part)
        spark.createDataFrame(part, resting.EVENTS).coalesce(1).write.mode("append").parquet(path)
        got = run_once(stream, "t", str(tmp_path / "state"), str(tmp_path / "out")).collect()
    assert {g["order_id"]: (g["filled_at"], g["filled_price"]) for g in got} == want and len(got) == len(want)
    left = spark.read.format("statestore").option("stateVarName", "open").load(str(tmp_path / "state"))
    assert {r[0] for r in left.select("user_map_key.order_id").collect()} == still


def test_late_orders_and_early_cancels(spark, tmp_path):
    path = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    stream = resting.fills_once(spark.readStream.schema(resting.EVENTS).parquet(path))
    order = lambda t, i, limit: ("A", t, resting.ORDER, i, "buy", "limit", limit, None, None)
    tick = lambda t, p: ("A", t, resting.TICK, 0, None, None, None, None, p)
    steps = [
        [tick(10.0, 100.0), ("A", 11.0, resting.CANCEL, 5, None, None, None, None, None)],
        [order(3.0, 1, 101.0), order(4.0, 2, 95.0), order(12.0, 5, 200.0)],  # late ones: 1 fills at the known price's time, 2 rests; 5 was cancelled
        [order(3.0, 1, 101.0), tick(20.0, 90.0), tick(21.0, 80.0)],  # 1 again: it has filled, and may rest anew only as a new order
    ]
    for part in steps:
        spark.createDataFrame(part, resting.EVENTS).coalesce(1).write.mode("append").parquet(path)
        got = run_once(stream, "t", str(tmp_path / "state"), str(tmp_path / "out")).collect()
    assert {(g["order_id"], g["filled_at"], g["filled_price"]) for g in got if g["order_id"] != 1} == {(2, 20.0, 95.0)}
    assert min(g["filled_at"] for g in got if g["order_id"] == 1) == 10.0


def test_events_of_tables(spark):
    orders = spark.createDataFrame([(1, "A", "buy", "stop", None, 5.0)], "order_id long, asset string, side string, order_type string, limit_price double, stop_price double").withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    ticks = spark.createDataFrame([("A", 3.0)], "asset string, price double").withColumn("ts", F.lit("2024-01-02").cast("timestamp_ntz"))
    rows = resting.events(orders, ticks, orders.select("order_id", "asset", "ts")).collect()
    assert sorted((r["kind"], r["order_id"], r["price"]) for r in rows) == [(0, 1, None), (1, 0, 3.0), (2, 1, None)]
