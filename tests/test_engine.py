import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import keyed_hash, series, validate
from tidemark.operators import backtest, catalog, ledger, orders, security, signals


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def array(values):
    return F.array(*(F.lit(float(v)) for v in values)) if values else F.array().cast("array<double>")


def rsi(c, period=14):
    if len(c) < 3 * period:
        return 50.0
    d = np.diff(c)
    g, l = np.maximum(d, 0), np.maximum(-d, 0)
    a, b = g[:period].mean(), l[:period].mean()
    for x, y in zip(g[period:], l[period:]):
        a, b = (a * 13 + x) / 14, (b * 13 + y) / 14
    return 100.0 if b < 1e-10 else 100 - 100 / (1 + a / b)


@pytest.mark.parametrize("closes", [[], [1.0], [5.0] * 60, list(range(1, 61)), [100 + 9 * math.sin(i * 1.7) for i in range(80)]])
def test_series(spark, closes):
    c = array(closes)
    assert one(spark, series.wilder_rsi(c)) == pytest.approx(rsi(closes))
    assert one(spark, series.momentum(c)) == pytest.approx(closes[-1] / closes[-21] - 1 if len(closes) > 20 else 0)
    width = 4 * np.std(closes[-20:], ddof=1) / np.mean(closes[-20:]) if len(closes) >= 20 else 0
    assert one(spark, series.bollinger_width(c)) == pytest.approx(width)
    if len(closes) >= 35:
        a = b = closes[0]
        s = 0.0
        for x in closes[1:]:
            a, b = 2 / 13 * x + 11 / 13 * a, 2 / 27 * x + 25 / 27 * b
            s = 0.2 * (a - b) + 0.8 * s
        assert one(spark, series.macd_histogram(c)) == pytest.approx(a - b - s, abs=1e-9)


def test_optimizer_is_reproducible_and_right(spark):
    j = spark.createDataFrame([("a", "a", 0.0), ("a", "b", 0.2), ("b", "a", 0.2), ("b", "b", 0.0)], "i string, j string, v double")
    h = spark.createDataFrame([("a", 0.1), ("b", -0.2)], "asset string, h double")
    got = [dict(map(tuple, signals.spins(j, h).collect())) for _ in range(2)]
    assert got[0] == got[1]
    m, f = np.array([[0, 0.2], [0.2, 0]]), np.array([0.1, -0.2])
    x, y = np.clip(0.05 * f, -0.05, 0.05), np.zeros(2)
    for k in range(200):
        y = y + 0.05 * ((k / 200 - 1) * x - x**3 + 0.5 * (m @ x) + f)
        x = np.clip(x + 0.05 * y, -1, 1)
    assert got[0]["a"] == pytest.approx(x[0]) and got[0]["b"] == pytest.approx(x[1])


def test_coupling_of_flat_series_is_zero(spark):
    r = spark.createDataFrame([("a", k, 0.0) for k in range(1, 21)] + [("b", k, float(k % 3)) for k in range(1, 21)], "asset string, k int, ret double")
    assert all(row["v"] == 0 for row in signals.coupling(r).collect())


def test_stops_dont_trigger_on_the_wrong_side(spark):
    kind, none = F.lit("stop"), F.lit(None).cast("double")
    assert one(spark, orders.fill(F.lit("buy"), kind, F.lit(100.0), none, F.lit(110.0)))["status"] == "ACCEPTED"
    assert one(spark, orders.fill(F.lit("sell"), kind, F.lit(100.0), none, F.lit(90.0)))["status"] == "ACCEPTED"
    assert one(spark, orders.fill(F.lit("buy"), kind, F.lit(110.0), none, F.lit(110.0)))["filled_price"] == 110
    assert one(spark, orders.fill(F.lit("buy"), F.lit("stop_limit"), F.lit(110.0), F.lit(105.0), F.lit(109.0)))["status"] == "ACCEPTED"


def test_unsafe_urls_are_rejected(spark):
    for url, ok in (("http://127.0.0.1/x", False), ("https://u:p@a.example/x", False), ("https://a.example/x", True), ("https:///x", False), (None, False), ("no url", False)):
        assert one(spark, validate.https_url(F.lit(url).cast("string"))) is ok
    assert one(spark, validate.public_https(F.lit("https://a.example"), F.lit("127.0.0.1"))) is False
    assert one(spark, validate.public_ip(F.lit("8.8.8.8"))) is True


def test_api_keys(spark):
    keys = spark.createDataFrame([("k1", ["read"], False, None), ("k2", ["admin"], True, None)], "raw string, scopes array<string>, is_revoked boolean, expires_at timestamp_ntz").withColumn("key_hash", F.sha2("raw", 256))
    asked = spark.createDataFrame([(1, "k1", "read"), (2, "k1", "trade"), (3, "k2", "read"), (4, "k3", "read")], "request_id long, raw string, scope string")
    assert dict(map(tuple, security.api_key_check(asked, keys, "2024-01-01").collect())) == {1: True, 2: False, 3: False, 4: False}


def test_book_against_a_loop(spark):
    r = random.Random(5)
    rows = [(i, r.randrange(3), r.choice("AB"), r.choice(["buy", "sell"]), float(r.randrange(1, 5)), round(r.uniform(5, 50), 2), "FILLED", i // 2) for i in range(300)]
    df = spark.createDataFrame(rows, "trade_id long, user_id int, asset string, side string, quantity double, filled_price double, status string, filled_at long")
    state = {}
    for _, u, a, side, x, p, _, _ in rows:
        q, c, g, w, n = state.get((u, a), (0.0, 0.0, 0.0, 0, 0))
        if side == "buy":
            q, c = q + x, c + x * p
        else:
            avg, s = (c / q if q else 0.0), min(x, q)
            w, n = w + (q > 0 and p > avg), n + (q > 0)
            g, q = g + (p - avg) * s, q - s
            c = avg * q
        state[u, a] = (q, c, g, w, n)
    got = {(b["user_id"], b["asset"]): (b["quantity"], b["cost"], b["realized"], b["wins"], b["closed"]) for b in ledger.book(df).collect()}
    assert got.keys() == state.keys()
    for k in got:
        assert got[k] == pytest.approx(state[k])


def test_backtest_against_a_loop(spark):
    r = random.Random(3)
    closes = [100.0]
    for _ in range(200):
        closes.append(closes[-1] * r.uniform(0.95, 1.05))
    bars = spark.createDataFrame([("A", i, c) for i, c in enumerate(closes)], "asset string, d int, close double")
    fast, slow, cash, held, entry, trips = 5, 12, 100_000.0, False, 0.0, []
    mean = lambda i, n: sum(closes[i - n + 1 : i + 1]) / n
    curve = []
    for i in range(slow, len(closes)):
        if held:
            cash *= closes[i] / closes[i - 1]
        above, before = mean(i, fast) > mean(i, slow), mean(i - 1, fast) > mean(i - 1, slow)
        if above and not before and not held:
            held, entry = True, closes[i]
        elif held and not above:
            held = False
            trips.append(closes[i] > entry)
        curve.append(cash)
    if held:
        trips.append(closes[-1] > entry)
    row = backtest.report(bars, fast, slow).first()
    assert row["final_capital"] == pytest.approx(curve[-1], abs=0.01)
    assert row["total_trades"] == 2 * len(trips) and row["win_rate"] == pytest.approx(sum(trips) / max(1, len(trips)), abs=0.001)


def test_market_hours(spark):
    times = [("US", "2024-01-08 14:29:30", "pre", 0), ("US", "2024-01-08 14:28:00", "pre", 2), ("US", "2024-01-08 14:30:00", "open", 390), ("US", "2024-01-08 21:00:00", "open", 0), ("US", "2024-01-08 21:00:30", "closed", None), ("US", "2024-01-06 15:00:00", "closed", None), ("CRYPTO", "2024-01-06 15:00:00", "open", None), ("LSE", "2024-07-08 07:00:00", "open", 510)]
    df = spark.createDataFrame([(e, t) for e, t, _, _ in times], "exchange string, at string").join(catalog.exchanges(spark), "exchange")
    rows = catalog.market_status(df).collect()
    assert {(r["exchange"], r["at"]): (r["status"], r["minutes"]) for r in rows} == {(e, t): (s, m) for e, t, s, m in times}
    assert {r["label"] for r in rows} == {"PRE-MARKET", "OPEN", "CLOSED", "WEEKEND", "24/7 OPEN"}


def test_addresses_that_arent_public(spark):
    import ipaddress

    v4 = ["8.8.8.8", "0.1.2.3", "10.0.0.1", "100.64.0.1", "127.0.0.1", "169.254.1.1", "172.15.0.1", "172.16.0.1", "172.32.0.1", "192.0.0.1", "192.0.2.9", "192.168.1.1", "198.18.0.1", "198.20.0.1", "198.51.100.7", "203.0.113.9", "224.0.0.1", "240.0.0.1", "255.255.255.255"]
    v6 = ["::1", "::", "fe80::1", "fc00::1", "fd12::1", "2001:db8::1", "2606:4700::1111", "2a00:1450::8"]
    bad = ["999.1.1.1", "8.8.8.8.9", "8.8.8", "8.8.8.8.", "x", "", "08.8.8.8", None]
    got = {r["ip"]: r["ok"] for r in spark.createDataFrame([(x,) for x in v4 + v6 + bad], "ip string").select("ip", validate.public_ip(F.col("ip")).alias("ok")).collect()}
    for x in v4 + v6:
        a = ipaddress.ip_address(x)
        assert got[x] is not (a.is_private or a.is_loopback or a.is_link_local), x
    assert not any(got[x] for x in bad)


def test_duplicates_are_of_open_orders(spark):
    rows = [(1, "FILLED", 0), (2, "ACCEPTED", 10), (3, "PENDING", 20), (4, "ACCEPTED", 60)]
    df = spark.createDataFrame([(i, 1, "A", "buy", 1.0, s, f"2024-01-01 00:{t // 60:02d}:{t % 60:02d}") for i, s, t in rows], "order_id long, user_id long, asset string, side string, quantity double, status string, submitted_at string")
    df = df.withColumn("submitted_at", F.col("submitted_at").cast("timestamp_ntz"))
    assert [r[0] for r in orders.duplicates(df).collect()] == [3]


def test_lockout_window_is_open_at_its_far_end(spark):
    rows = [(1, 0, True), (2, 100, True), (3, 900, True), (4, 999, True), (5, 2000, True)]
    df = spark.createDataFrame([("u", i, f"2024-01-01 00:{t // 60:02d}:{t % 60:02d}", f) for i, t, f in rows], "key string, attempt_id long, at string, failed boolean")
    row = security.lockouts(df, 3, 900, 900).first()
    assert (row["locks"], row["refused"]) == (1, 0)  # at 900 the first failure is out of the window, so only 999 locks


def test_text_of_numbers(spark):
    for x, text in ((12.0, "12.0"), (0.0001, "0.0001"), (12_345_678.5, "12345678.5"), (-0.25, "-0.25"), (None, "None")):
        assert one(spark, orders.text_of(F.lit(x).cast("double"))) == text


def test_aes_round_trip(spark):
    key = "0123456789abcdef"
    stored = security.protected(F.lit("secret"), key)
    assert one(spark, security.unprotected(stored, key)) == "secret" and one(spark, security.unprotected(stored, key[::-1])) is None
    assert one(spark, security.unprotected(F.lit("old row"), key)) == "old row"


def test_keyed_hashes(spark):
    import hashlib
    import hmac

    df = spark.createDataFrame([("a", "s"), (None, "s")], "x string, y string")
    got = [r[0] for r in df.select(keyed_hash.hmac_sha256("k")("x")).collect()]
    assert got == [hmac.new(b"k", b"a", hashlib.sha256).hexdigest(), None]
    assert len(df.select(keyed_hash.hkdf_sha256("ctx")("x", "y")).first()[0]) == 64
    stored = hashlib.pbkdf2_hmac("sha256", b"a", b"s", 10).hex()
    assert df.withColumn("d", F.lit(stored)).select(keyed_hash.pbkdf2_verify(10)("x", "y", "d")).first()[0] is True


def test_edge(spark):
    """Halves go to the even side, below zero too; noise of binary numbers doesn't move a half; what no decimal holds stays."""
    values = [0.125, 0.135, -0.125, -0.135, 2.675, 0.1 + 0.2 - 0.175, 1234567.125, 1e-12, -0.004, 1e300, float("inf"), None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    got = [r["y"] for r in df.select("i", series.edge(F.col("x"), 2).alias("y")).orderBy("i").collect()]
    assert got == [0.12, 0.14, -0.12, -0.14, 2.68, 0.12, 1234567.12, 0.0, 0.0, 1e300, float("inf"), None]
    assert np.isnan(spark.range(1).select(series.edge(F.lit(float("nan")), 2).alias("y")).first()["y"])


def test_total_of_cents(spark):
    """Sums are exact: a million cents, and what takes them back."""
    pnl = spark.range(100_000).select(F.lit(1).alias("user_id"), F.lit(0.1).alias("unrealized_pnl"), F.when(F.col("id") < 1, -9999.995).otherwise(0.0).alias("realized_pnl"))
    assert ledger.total_pnl(pnl).first()["total_pnl"] == 0.0
