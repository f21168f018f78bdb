"""Long books and busy keys, cut in blocks and buckets, against the plain rules."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ledger, scans, security

TRADES = "trade_id long, user_id long, asset string, side string, quantity double, filled_price double, status string, filled_at timestamp_ntz"


def loop(rows):
    """The ledger's rule trade by trade, as a plain loop."""
    out = {}
    for _, user, asset, side, x, p, status, _ in sorted(rows, key=lambda r: (r[7], r[0])):
        if status != "FILLED":
            continue
        q, c, real, wins, closed = out.get((user, asset), (0.0, 0.0, 0.0, 0, 0))
        p = p or 0.0
        if side == "buy":
            q, c = q + x, c + x * p
        else:
            avg, sold = (c / q if q > 0 else 0.0), min(x, q)
            if q > 0:
                closed, wins = closed + 1, wins + (p > avg)
            real += (p - avg) * sold
            q -= sold
            c = avg * q
        out[user, asset] = (q, c, real, wins, closed)
    return out


def trades(seed, n, hot=0.9, buys=0.5):
    r, rows = random.Random(seed), []
    for i in range(n):
        user, asset = (1, "A") if r.random() < hot else (r.randrange(2, 6), r.choice("AB"))
        rows.append((i, user, asset, "buy" if r.random() < buys else "sell", float(r.randrange(1, 9)), round(r.uniform(5, 50), 2) if r.random() < 0.98 else None, "FILLED" if r.random() < 0.95 else "REJECTED", f"2024-01-{1 + i * 27 // n:02d} {r.randrange(24):02d}:00:00"))
    return rows


@pytest.mark.parametrize("seed, buys, block_rows", [(1, 0.5, 37), (2, 0.8, 500), (3, 0.2, 64), (4, 0.5, 100_000)])
def test_books_in_blocks(spark, seed, buys, block_rows):
    rows = trades(seed, 4000, buys=buys)
    df = spark.createDataFrame(rows, TRADES.replace("timestamp_ntz", "string")).withColumn("filled_at", F.col("filled_at").cast("timestamp_ntz")).repartition(4)
    want, got = loop(rows), {(b["user_id"], b["asset"]): tuple(b)[2:] for b in ledger.book(df, block_rows).collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k][3:] == w[3:] and got[k][0] == w[0] and got[k][1:3] == pytest.approx(w[1:3], rel=1e-9, abs=1e-6)


def test_a_hot_book_runs_in_many_tasks(spark):
    """200,000 trades of one book: its blocks lie in several partitions, none holds more than a block."""
    n = F.col("id")
    df = spark.range(200_000).select(n.alias("trade_id"), F.lit(1).cast("long").alias("user_id"), F.lit("A").alias("asset"), F.when(F.pmod(F.xxhash64("id"), F.lit(2)) == 0, "buy").otherwise("sell").alias("side"), (1 + n % 5).cast("double").alias("quantity"), (10 + n % 7).cast("double").alias("filled_price"), F.lit("FILLED").alias("status"), F.timestamp_seconds(n).cast("timestamp_ntz").alias("filled_at"))
    one, many = ledger.book(df, 10**9).collect(), ledger.book(df, 5_000).collect()
    assert tuple(many[0])[0:2] + tuple(many[0])[5:] == tuple(one[0])[0:2] + tuple(one[0])[5:] and tuple(many[0])[2:5] == pytest.approx(tuple(one[0])[2:5], rel=1e-9)


def test_limits_of_a_busy_key(spark):
    """One key with most requests, several at one instant, and a null key, against counting; no bucket holds the whole key."""
    r = random.Random(4)
    rows = [(i, "hot" if i % 10 else r.choice(("x", None)), 1_704_067_200 + r.choice((r.randrange(4000), r.randrange(400) * 10, 777))) for i in range(3000)]
    df = spark.createDataFrame(rows, "request_id long, key string, s long").withColumn("at", F.timestamp_seconds("s").cast("timestamp_ntz"))
    got = {x["request_id"]: (x["seen"], x["allowed"]) for x in security.rate_limited(df, 60, 40).collect()}
    times = {}
    for _, k, s in rows:
        times.setdefault(k, []).append(s)
    assert got == {i: (n := sum(s - 60 <= z <= s for z in times[k]), n <= 40) for i, k, s in rows}
    with pytest.raises(ValueError, match="divide"):
        security.rate_limited(df, 1, 40, 7)


def curve_loop(rows, prices):
    """The equity curve by the rule, trade by trade."""
    curves, cash, held = {}, {}, {}
    for _, user, asset, side, x, p, status, _ in sorted(rows, key=lambda r: (r[7], r[0])):
        if status != "FILLED":
            continue
        signed = x if side == "buy" else -x
        cash[user] = cash.get(user, 100_000.0) - signed * (p or 0.0)
        own = held.setdefault(user, {})
        own[asset] = own.get(asset, 0.0) + signed
        curves.setdefault(user, [100_000.0]).append(cash[user] + sum(max(0.0, q) * prices.get(a, 100.0) for a, q in own.items()))
    return curves


@pytest.mark.parametrize("seed, block_rows", [(5, 29), (6, 400), (7, 100_000)])
def test_curves_in_blocks(spark, seed, block_rows):
    """Users with many trades, cut in blocks, have the curve, falls, returns and places of the plain rule."""
    rows, prices = trades(seed, 3000), {"A": 21.5}
    df = spark.createDataFrame(rows, TRADES.replace("timestamp_ntz", "string")).withColumn("filled_at", F.col("filled_at").cast("timestamp_ntz")).repartition(4)
    curve = ledger.equity_curve(df, spark.createDataFrame(list(prices.items()), "asset string, price double"), block_rows=block_rows)
    want, got = curve_loop(rows, prices), {}
    for r in sorted(curve.collect(), key=lambda r: (r["user_id"], r["seq"])):
        got.setdefault(r["user_id"], []).append(r["equity"])
    assert got.keys() == want.keys() and all(got[u] == pytest.approx(want[u], rel=1e-12) for u in want)
    returns = ledger.period_returns(curve, block_rows)
    falls, rets = {u: [] for u in want}, {u: [(b - a) / a if a else 0.0 for a, b in zip(v, v[1:])] for u, v in got.items()}
    for u, v in got.items():
        peak = v[0]
        for e in v:
            peak = max(peak, e)
            falls[u].append((peak - e) / peak if peak else 0.0)
    assert {r["user_id"]: r["max_drawdown"] for r in ledger.max_drawdown(curve, block_rows).collect()} == pytest.approx({u: max(f) for u, f in falls.items()}, rel=1e-12)
    assert {(r["user_id"], r["seq"]): r["ret"] for r in returns.collect()} == pytest.approx({(u, i + 1): x for u, v in rets.items() for i, x in enumerate(v)}, rel=1e-9, abs=1e-15)
    var = {r["user_id"]: (r["var_95"], r["var_99"]) for r in ledger.value_at_risk(returns, 0.05, 0.01).collect()}
    at = lambda v, p: max(0.0, -sorted(v)[min(int(p * len(v)), len(v) - 1)])
    assert {k: x[0] for k, x in var.items()} == pytest.approx({u: at(v, 0.05) for u, v in rets.items()}, rel=1e-9, abs=1e-15)
    assert {k: x[1] for k, x in var.items()} == pytest.approx({u: at(v, 0.01) for u, v in rets.items()}, rel=1e-9, abs=1e-15)


@pytest.mark.parametrize("accuracy, margin", [(10_000, 2.0), (20, 0.5), (20, 0.001), (10, 1000.0)])
def test_places_by_selection(spark, accuracy, margin):
    """One key with most values, a third of them equal, tiny keys, a null key, NaN, infinities and nulls; also where the sketch is too coarse and its intervals miss."""
    r, nan, inf = random.Random(8), float("nan"), float("inf")
    rows = [(1, 0.25 if r.random() < 0.33 else r.gauss(0, 1) ** 3) for _ in range(20_000)] + [(2, 5.0)] + [(3, x) for x in (nan, -inf, 1.0, inf, None, -0.5)] + [(None, float(i)) for i in range(50)] + [(4, None)] + [(5, 7.0)] * 300
    df = spark.createDataFrame(rows, "k int, v double").repartition(5)
    levels, want = (0.0, 0.01, 0.05, 0.5, 1.0), {}
    for k in (1, 2, 3, None, 5):
        own = sorted((v for z, v in rows if z == k and v is not None), key=lambda v: (v != v, v))
        want |= {(k, j): repr(own[min(int(p * len(own)), len(own) - 1)]) for j, p in enumerate(levels)}
    got = scans.at_places(df, "k", "v", levels, accuracy=accuracy, margin=margin).collect()
    assert len(got) == len(want) and {(x["k"], x["level"]): repr(x["v"]) for x in got} == want
    assert scans.at_places(df.where("v > 1e9 and v < 2e9"), "k", "v", levels).count() == 0


def test_selection_sorts_few_rows(spark):
    """200,000 values of one key: what is put in order for a place is a small share, whatever lies in the key."""
    df = spark.range(200_000).select(F.lit(1).alias("k"), (F.hash("id") / 1000.0).alias("v")).cache()
    lo, hi = df.agg(F.percentile_approx("v", [0.0498, 0.0502], 10_000)).first()[0]
    assert df.where(F.col("v").between(lo, hi)).count() < 200
    exact = df.orderBy("v").collect()[10_000]["v"]
    assert [(x["level"], x["v"]) for x in scans.at_places(df, "k", "v", (0.05,)).collect()] == [(0, exact)]


def locked_loop(rows, failures, window, lock):
    out, until, times = {}, {}, {}
    for _, key, t, failed in sorted(rows, key=lambda r: (r[2], r[0])):
        locks, refused = out.get(key, (0, 0))
        if t < until.get(key, 0):
            refused += 1
        elif failed:
            times[key] = [z for z in times.get(key, []) if z > t - window] + [t]
            if len(times[key]) >= failures:
                locks, until[key], times[key] = locks + 1, t + lock, []
        else:
            times[key] = []
        out[key] = (locks, refused)
    return out


@pytest.mark.parametrize("failures, window, lock, block_rows", [(3, 60, 50, 16), (5, 900, 900, 64), (1, 60, 30, 7), (4, 20, 200, 3), (3, 60, 50, 100_000)])
def test_lockouts_of_busy_keys(spark, failures, window, lock, block_rows):
    """Attempts of one instant, a null key, keys under and over a block, runs over the edges of blocks."""
    r = random.Random(failures)
    rows = [(i, "hot" if i % 10 else r.choice(("x", None, "y")), 1_704_067_200 + r.randrange(20_000) // r.choice((1, 1, 4)), r.random() < 0.75) for i in range(4000)]
    df = spark.createDataFrame(rows, "attempt_id long, key string, s long, failed boolean").withColumn("at", F.timestamp_seconds("s").cast("timestamp_ntz")).repartition(5)
    got = {x["key"]: (x["locks"], x["refused"]) for x in security.lockouts(df, failures, window, lock, block_rows).collect()}
    assert got == locked_loop(rows, failures, window, lock) and got["hot"][0] > 10


def test_lockout_of_a_key_over_many_batches(spark):
    """50,000 attempts of one key, most at few instants, stored newest first; locks are chosen over several Arrow batches."""
    n = F.col("id")
    df = spark.range(50_000).select((50_000 - n).alias("attempt_id"), F.lit(7).alias("key"), F.timestamp_seconds(F.lit(1_704_067_200) + F.floor((50_000 - n) / 3)).cast("timestamp_ntz").alias("at"), (n % 11 != 0).alias("failed"))
    rows = [(x["attempt_id"], x["key"], x["at"].timestamp(), x["failed"]) for x in df.collect()]
    got = security.lockouts(df, 5, 900, 9, block_rows=1_000).collect()
    assert [(x["key"], x["locks"], x["refused"]) for x in got] == [(7, *locked_loop(rows, 5, 900, 9)[7])]
