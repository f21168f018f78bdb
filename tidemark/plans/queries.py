"""The engine's own queries over the tables at hand, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import series, validate
from ..operators import backtest, catalog, ledger, orders, security, signals, sinks
from ..operators.scans import kept
from ..sources import relations as src

AS_OF = "2001-08-01"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# Relations of the SQL side; see sources/relations.py.
BARS = "bars AS (SELECT p_brand AS asset, CAST(l_shipdate AS DATE) AS d, sum(l_extendedprice) / sum(l_quantity) AS close FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"
SERIES = BARS + ", s AS (SELECT asset, list(close ORDER BY d) AS c FROM bars GROUP BY 1)"
K = "(CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS INT) % 10)"
SIDE = "CASE WHEN event_type IN ('purchase', 'click') THEN 'buy' ELSE 'sell' END"
TRADES = f"trades AS (SELECT event_id AS trade_id, user_id, 'K' || {K} AS asset, {SIDE} AS side, CAST(1 + event_id % 5 AS DOUBLE) AS quantity, value AS filled_price, ts AS filled_at FROM events WHERE event_type <> 'error')"
PRICES = "prices AS (SELECT asset, arg_max(filled_price, filled_at) AS price FROM trades GROUP BY 1)"
CANDS = f"""cands AS (SELECT event_id AS order_id, user_id, 'K' || {K} AS asset, {SIDE} AS side, CAST(1 + event_id % 5 AS DOUBLE) AS quantity, ['market', 'limit', 'stop', 'stop_limit'][event_id % 4 + 1] AS order_type,
 CASE WHEN event_id % 4 IN (1, 3) AND event_id % 17 <> 0 THEN value * 1.02 END AS limit_price, CASE WHEN event_id % 4 IN (2, 3) AND event_id % 17 <> 0 THEN value * 0.98 END AS stop_price, ['day', 'gtc', 'ioc'][event_id % 3 + 1] AS time_in_force, ts AS submitted_at,
 ['ACCEPTED', 'PENDING', 'FILLED', 'SUBMITTED', 'CANCELLED', 'ACCEPTED'][event_id % 6 + 1] AS status, CASE WHEN event_id % 7 = 0 THEN 'b' || event_id END AS broker_order_id FROM events)"""
BOOK = TRADES + """, folded AS (SELECT user_id, asset, list_reduce(list({'s': side, 'x': quantity, 'p': filled_price, 'q': 0.0::DOUBLE, 'c': 0.0::DOUBLE, 'r': 0.0::DOUBLE, 'w': 0, 'n': 0} ORDER BY filled_at, trade_id),
 lambda a, t: CASE WHEN t.s = 'buy' THEN {'s': t.s, 'x': t.x, 'p': t.p, 'q': a.q + t.x, 'c': a.c + t.x * t.p, 'r': a.r, 'w': a.w, 'n': a.n}
 ELSE {'s': t.s, 'x': t.x, 'p': t.p, 'q': a.q - least(t.x, a.q), 'c': CASE WHEN a.q > 0 THEN a.c / a.q ELSE 0 END * (a.q - least(t.x, a.q)), 'r': a.r + (t.p - CASE WHEN a.q > 0 THEN a.c / a.q ELSE 0 END) * least(t.x, a.q), 'w': a.w + CASE WHEN a.q > 0 AND t.p > a.c / a.q THEN 1 ELSE 0 END, 'n': a.n + CASE WHEN a.q > 0 THEN 1 ELSE 0 END} END,
 {'s': '', 'x': 0.0::DOUBLE, 'p': 0.0::DOUBLE, 'q': 0.0::DOUBLE, 'c': 0.0::DOUBLE, 'r': 0.0::DOUBLE, 'w': 0, 'n': 0}) AS z FROM trades GROUP BY 1, 2),
 book AS (SELECT user_id, asset, z.q AS quantity, z.c AS cost, z.r AS realized, z.w AS wins, z.n AS closed FROM folded)"""
POSITIONS = BOOK + ", positions AS (SELECT user_id, asset, round(quantity, 6) AS quantity, CAST(round_even(CAST(cost / quantity AS DECIMAL(38, 9)), 4) AS DOUBLE) AS avg_entry_price, CAST(round_even(CAST(realized AS DECIMAL(38, 9)), 2) AS DOUBLE) AS realized_pnl FROM book WHERE quantity > 0)"
PNL = POSITIONS + ", " + PRICES + """, pnl AS (SELECT user_id, asset, quantity, avg_entry_price, CAST(round_even(CAST(price AS DECIMAL(38, 9)), 4) AS DOUBLE) AS current_price, CAST(round_even(CAST(price * quantity AS DECIMAL(38, 9)), 2) AS DOUBLE) AS market_value, CAST(round_even(CAST((price - avg_entry_price) * quantity AS DECIMAL(38, 9)), 2) AS DOUBLE) AS unrealized_pnl, realized_pnl FROM positions JOIN prices USING (asset))"""
CASH = "accounts AS (SELECT user_id, 100000.0 - sum(CASE WHEN side = 'buy' THEN quantity ELSE -quantity END * filled_price) AS cash FROM trades GROUP BY 1)"
CURVE = TRADES + ", " + PRICES + """, x AS (SELECT t.*, price, CASE WHEN side = 'buy' THEN quantity ELSE -quantity END AS x FROM trades t JOIN prices USING (asset)),
 v AS (SELECT *, greatest(0, sum(x) OVER (PARTITION BY user_id, asset ORDER BY filled_at, trade_id ROWS UNBOUNDED PRECEDING)) * price AS v FROM x),
 w AS (SELECT *, v - lag(v, 1, 0) OVER (PARTITION BY user_id, asset ORDER BY filled_at, trade_id) AS delta FROM v),
 curve AS (SELECT user_id, CAST(row_number() OVER o AS INT) AS seq, 100000.0 - sum(x * filled_price) OVER o + sum(delta) OVER o AS equity FROM w WINDOW o AS (PARTITION BY user_id ORDER BY filled_at, trade_id ROWS UNBOUNDED PRECEDING)
 UNION ALL SELECT DISTINCT user_id, 0, 100000.0 FROM trades),
 returns AS (SELECT user_id, seq, CASE WHEN prev = 0 THEN 0 ELSE (equity - prev) / prev END AS ret FROM (SELECT *, lag(equity) OVER (PARTITION BY user_id ORDER BY seq) AS prev FROM curve) WHERE prev IS NOT NULL),
 drawdowns AS (SELECT user_id, max(CASE WHEN peak > 0 THEN (peak - equity) / peak ELSE 0 END) AS dd FROM (SELECT *, max(equity) OVER (PARTITION BY user_id ORDER BY seq) AS peak FROM curve) GROUP BY 1)"""
TAIL = BARS + """, tails AS (SELECT asset, CAST(k AS INT) AS k, CASE WHEN prev = 0 THEN 0 ELSE (close - prev) / prev END AS ret FROM (SELECT asset, close, lag(close) OVER (PARTITION BY asset ORDER BY d) AS prev, row_number() OVER (PARTITION BY asset ORDER BY d DESC) AS k FROM bars) WHERE k <= 20 AND prev IS NOT NULL)"""
COUPLING = TAIL + """, coupling AS (SELECT a.asset AS i, b.asset AS j, CASE WHEN a.asset = b.asset THEN 0 ELSE coalesce(CASE WHEN isnan(corr(a.ret, b.ret)) THEN 0 ELSE corr(a.ret, b.ret) END, 0) / (SELECT count(DISTINCT asset) FROM tails) END AS v FROM tails a JOIN tails b USING (k) GROUP BY 1, 2)"""
MOMENTUM = "mom AS (SELECT asset, CASE WHEN n <= 20 THEN 0 ELSE close / old - 1 END AS momentum FROM (SELECT asset, close, lag(close, 20) OVER (PARTITION BY asset ORDER BY d) AS old, count(*) OVER (PARTITION BY asset) AS n, row_number() OVER (PARTITION BY asset ORDER BY d DESC) AS k FROM bars) WHERE k = 1)"
FIELD = MOMENTUM + ", field AS (SELECT asset, greatest(-3, least(3, (momentum - (SELECT avg(momentum) FROM mom)) / greatest(1e-9, (SELECT coalesce(stddev_samp(momentum), 1e-9) FROM mom)))) * 0.35 AS h FROM mom)"
SPINS = COUPLING + ", " + FIELD + """, start AS (SELECT list(struct_pack(asset := asset, h := h, x := greatest(-0.05, least(0.05, 0.05 * h))) ORDER BY asset) AS m FROM field),
 steps AS (SELECT 0 AS k, asset, greatest(-0.05, least(0.05, 0.05 * h)) AS x, CAST(0 AS DOUBLE) AS y FROM field
 UNION ALL SELECT k + 1, asset, greatest(-1, least(1, x + 0.05 * ny)), ny FROM (SELECT s.k, s.asset, s.x, s.y + 0.05 * ((s.k / 200.0 - 1) * s.x - s.x * s.x * s.x + 0.5 * sum(c.v * o.x ORDER BY o.asset) + f.h) AS ny
 FROM steps s JOIN steps o ON o.k = s.k JOIN coupling c ON c.i = s.asset AND c.j = o.asset JOIN field f ON f.asset = s.asset WHERE s.k < 200 GROUP BY s.k, s.asset, s.x, s.y, f.h)),
 spins AS (SELECT asset, x AS spin FROM steps WHERE k = 200)"""
DELTAS = SERIES + ", dd AS (SELECT asset, c, list_transform(range(1, len(c)), lambda i: c[i + 1] - c[i]) AS d FROM s)"
RSI = DELTAS + """, rsi AS (SELECT asset, CASE WHEN len(c) < 42 THEN 50 WHEN z.l < 1e-10 THEN 100 ELSE 100 - 100 / (1 + z.g / z.l) END AS rsi FROM (SELECT asset, c, list_reduce(list_transform(d[15:], lambda x: {'g': greatest(x, 0), 'l': greatest(-x, 0)}), lambda a, x: {'g': (a.g * 13 + x.g) / 14, 'l': (a.l * 13 + x.l) / 14},
 {'g': list_sum(list_transform(d[1:14], lambda x: greatest(x, 0))) / 14, 'l': list_sum(list_transform(d[1:14], lambda x: greatest(-x, 0))) / 14}) AS z FROM dd))"""
MACD = """macd AS (SELECT asset, CASE WHEN len(c) < 35 THEN 0 ELSE z.a - z.b - z.s END AS macd FROM (SELECT asset, c, list_reduce(list_transform(c[2:], lambda x: {'a': x, 'b': x, 's': x}),
 lambda p, x: {'a': 2.0 / 13 * x.a + (1 - 2.0 / 13) * p.a, 'b': 2.0 / 27 * x.b + (1 - 2.0 / 27) * p.b, 's': 0.2 * ((2.0 / 13 * x.a + (1 - 2.0 / 13) * p.a) - (2.0 / 27 * x.b + (1 - 2.0 / 27) * p.b)) + 0.8 * p.s}, {'a': c[1], 'b': c[1], 's': CAST(0 AS DOUBLE)}) AS z FROM s))"""
WIDTH = "width AS (SELECT asset, CASE WHEN count(*) < 20 OR avg(close) < 1e-10 THEN 0 ELSE 4 * stddev_samp(close) / avg(close) END AS bb FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY d DESC) AS k FROM bars) WHERE k <= 20 GROUP BY 1)"
LASTS = "lasts AS (SELECT asset, arg_max(close, d) AS last_price FROM bars GROUP BY 1)"
SCORED = """CASE WHEN spin > 0.15 THEN 'BUY' WHEN spin < -0.15 THEN 'SELL' ELSE 'HOLD' END AS signal_type, round(greatest(0, least(1, abs(spin) - CASE WHEN (spin > 0 AND rsi > 70) OR (spin < 0 AND rsi < 30) THEN 0.25 ELSE 0 END)), 4) AS confidence, round(spin, 4) AS spin"""
SIGNALS = SPINS.replace(BARS, RSI) + f", {MACD}, {WIDTH}, {LASTS}, signals AS (SELECT asset, {SCORED}, round(last_price, 2) AS last_price, round(rsi, 4) AS rsi, round(macd, 4) AS macd_histogram, round(momentum, 4) AS momentum, round(bb, 4) AS bb_width, 200 AS sba_iterations FROM spins JOIN rsi USING (asset) JOIN macd USING (asset) JOIN width USING (asset) JOIN mom USING (asset) JOIN lasts USING (asset))"
CROSS = BARS + """, m AS (SELECT asset, d, close, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY asset) AS n, avg(close) OVER (PARTITION BY asset ORDER BY d ROWS 19 PRECEDING) AS f, avg(close) OVER (PARTITION BY asset ORDER BY d ROWS 49 PRECEDING) AS s FROM bars WINDOW o AS (PARTITION BY asset ORDER BY d)),
 a AS (SELECT *, i >= 49 AND f > s AS above FROM m WHERE n > 52), cross_ AS (SELECT *, above AND NOT coalesce(lag(above) OVER (PARTITION BY asset ORDER BY d), FALSE) AS up FROM a), c0 AS (SELECT * FROM cross_ WHERE i >= 50),
 c1 AS (SELECT *, sum(CAST(up AS INT)) OVER (PARTITION BY asset ORDER BY d) AS trip FROM c0), c2 AS (SELECT *, above AND trip > 0 AS held FROM c1),
 c3 AS (SELECT *, coalesce(lag(held) OVER (PARTITION BY asset ORDER BY d), FALSE) AS before, lag(close) OVER (PARTITION BY asset ORDER BY d) AS prev FROM c2),
 bt AS (SELECT *, 100000 * exp(sum(ln(CASE WHEN before THEN close / prev ELSE 1 END)) OVER (PARTITION BY asset ORDER BY d)) AS equity FROM c3)"""
#: The backtest by its loop, bar by bar: cash or shares, and the curve so far.
_AT = "{{'p': x.p, 'was': x.was, 'now': x.now, 'pos': {}, 'cash': {}, 'shares': {}, 'entry': {}, 'wins': {}, 'closed': {}, 'curve': list_append(b.curve, {})}}"
_BUY = _AT.format("TRUE", "0.0::DOUBLE", "b.cash / x.p", "x.p", "b.wins", "b.closed", "b.cash / x.p * x.p")
_SELL = _AT.format("FALSE", "b.shares * x.p", "0.0::DOUBLE", "b.entry", "b.wins + CAST(b.shares * x.p > b.shares * b.entry AS INT)", "b.closed + 1", "b.shares * x.p")
_STAY = _AT.format("b.pos", "b.cash", "b.shares", "b.entry", "b.wins", "b.closed", "b.cash + b.shares * x.p")
_FIRST = "'pos': FALSE, 'cash': 100000.0::DOUBLE, 'shares': 0.0::DOUBLE, 'entry': 0.0::DOUBLE, 'wins': 0, 'closed': 0, 'curve': []::DOUBLE[]}"
LOOP = CROSS + f""", w AS (SELECT asset, i, close, f > s AS now, lag(f > s) OVER (PARTITION BY asset ORDER BY d) AS was FROM m WHERE n > 52),
 z AS (SELECT asset, arg_max(close, i) AS last_close, list_reduce(list({{'p': close, 'was': was, 'now': now, {_FIRST} ORDER BY i) FILTER (i >= 50), lambda b, x: CASE WHEN NOT b.pos AND NOT x.was AND x.now THEN {_BUY} WHEN b.pos AND x.was AND NOT x.now THEN {_SELL} ELSE {_STAY} END, {{'p': 0.0::DOUBLE, 'was': FALSE, 'now': FALSE, {_FIRST}) AS z FROM w GROUP BY 1)"""
KEYS = "keys AS (SELECT o_orderkey AS key_id, o_custkey % 50 AS user_id, CASE WHEN o_orderkey % 2 = 0 THEN 'ML-KEM-768' ELSE 'ML-DSA-65' END AS algorithm, o_orderstatus <> 'F' AS is_active, o_orderkey % 7 AS rotation_count, o_orderdate AS created_at FROM orders)"
HEALTH = KEYS + f""", health AS (SELECT key_id, user_id, algorithm, due, CASE WHEN due <= 0 THEN 'RED' WHEN due <= 14 THEN 'YELLOW' ELSE 'GREEN' END AS level FROM (SELECT *, CAST(90 - floor((epoch(TIMESTAMP '{AS_OF}') - floor(epoch(created_at))) / 86400) AS INT) AS due FROM keys WHERE is_active))"""
TICKERS = "cat AS (SELECT c_custkey AS ordinal, upper(substr(c_mktsegment, 1, 3)) || c_custkey || ['', '.NS', '.L', '.T', '.HK', '.AX', '.TO', '.DE', '-USD'][c_nationkey % 9 + 1] AS ticker FROM customer)"
EXCHANGE = "CASE WHEN ticker LIKE '%.NS' THEN 'NSE' WHEN ticker LIKE '%.L' THEN 'LSE' WHEN ticker LIKE '%.T' THEN 'TSE' WHEN ticker LIKE '%.HK' THEN 'HKEX' WHEN ticker LIKE '%.AX' THEN 'ASX' WHEN ticker LIKE '%.TO' THEN 'TSX' WHEN ticker LIKE '%.DE' THEN 'XETRA' WHEN ticker LIKE '%-USD' THEN 'CRYPTO' ELSE 'US' END"


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@query("bars_daily", f"WITH {BARS} SELECT asset, d, CAST(round_even(CAST(close AS DECIMAL(38, 9)), 6) AS DOUBLE) AS close FROM bars")
def _(s, d):
    return src.bars(s, d).select("asset", "d", series.edge(F.col("close"), 6).alias("close"))


@query("bars_unpivot", f"WITH {BARS} SELECT d, asset, CAST(round_even(CAST(close AS DECIMAL(38, 9)), 6) AS DOUBLE) AS close FROM bars")
def _(s, d):
    wide = src.bars(s, d).groupBy("d").pivot("asset").agg(F.first("close"))  # a column for each brand
    return src.long_bars(wide).select("d", "asset", series.edge(F.col("close"), 6).alias("close"))


@query("bars_history", f"WITH {BARS} SELECT asset, count(*) AS n, CAST(round_even(CAST(min(close) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS low, CAST(round_even(CAST(max(close) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS high FROM bars WHERE d > DATE '2001-02-01' AND d <= DATE '{AS_OF}' GROUP BY 1")
def _(s, d):
    return src.history(src.bars(s, d), AS_OF, 6).groupBy("asset").agg(F.count("*").alias("n"), series.edge(F.min("close"), 6).alias("low"), series.edge(F.max("close"), 6).alias("high"))


@query("min_history", "WITH bars AS (SELECT l_partkey AS asset, count(DISTINCT CAST(l_shipdate AS DATE)) AS n FROM lineitem GROUP BY 1) SELECT asset, n FROM bars WHERE n >= 20")
def _(s, d):
    return signals.min_history(src.part_bars(s, d), 20).groupBy("asset").agg(F.count("*").alias("n"))


@query("series_diff", f"WITH {BARS} SELECT asset, d, CAST(round_even(CAST(close - prev AS DECIMAL(38, 9)), 6) AS DOUBLE) AS diff, CAST(round_even(CAST(greatest(close - prev, 0) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS gain, CAST(round_even(CAST(greatest(prev - close, 0) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS loss FROM (SELECT *, lag(close) OVER (PARTITION BY asset ORDER BY d) AS prev FROM bars) WHERE prev IS NOT NULL")
def _(s, d):
    diff = F.col("close") - F.lag("close").over(Window.partitionBy("asset").orderBy("d"))
    r = lambda c: series.edge(F.greatest(c, F.lit(0.0)), 6)
    return src.bars(s, d).withColumn("x", diff).where("x is not null").select("asset", "d", series.edge(F.col("x"), 6).alias("diff"), r(F.col("x")).alias("gain"), r(-F.col("x")).alias("loss"))


@query("tail_returns", f"WITH {TAIL} SELECT asset, k, round(ret, 8) AS ret FROM tails")
def _(s, d):
    return signals.tail_returns(src.bars(s, d)).select("asset", "k", F.round("ret", 8).alias("ret"))


@query("rsi_wilder", f"WITH {RSI} SELECT asset, round(rsi, 6) AS rsi FROM rsi")
def _(s, d):
    return series.closes(src.bars(s, d)).select("asset", F.round(series.wilder_rsi(F.col("closes")), 6).alias("rsi"))


@query("ema_last", f"WITH {SERIES} SELECT asset, round(list_reduce(c[2:], lambda e, x: 2.0 / 13 * x + (1 - 2.0 / 13) * e, c[1]), 6) AS ema FROM s")
def _(s, d):
    return series.closes(src.bars(s, d)).select("asset", F.round(series.ema(F.col("closes"), 12), 6).alias("ema"))


@query("macd_hist", f"WITH {SERIES}, {MACD} SELECT asset, round(macd, 6) AS macd_histogram FROM macd")
def _(s, d):
    return series.closes(src.bars(s, d)).select("asset", F.round(series.macd_histogram(F.col("closes")), 6).alias("macd_histogram"))


@query("momentum_20", f"WITH {BARS}, {MOMENTUM} SELECT asset, round(momentum, 8) AS momentum FROM mom")
def _(s, d):
    return series.closes(src.bars(s, d)).select("asset", F.round(series.momentum(F.col("closes")), 8).alias("momentum"))


@query("bollinger_width", f"WITH {BARS}, {WIDTH} SELECT asset, round(bb, 8) AS bb_width FROM width")
def _(s, d):
    return series.closes(src.bars(s, d)).select("asset", F.round(series.bollinger_width(F.col("closes")), 8).alias("bb_width"))


@query("rolling_mean", f"WITH {BARS} SELECT asset, d, CASE WHEN count(*) OVER w = 20 THEN round(avg(close) OVER w, 6) END AS mean_20 FROM bars WINDOW w AS (PARTITION BY asset ORDER BY d ROWS 19 PRECEDING)")
def _(s, d):
    return backtest.rolling_mean(src.bars(s, d), 20, "m").select("asset", "d", F.round("m", 6).alias("mean_20"))


@query("ma_cross", f"WITH {CROSS} SELECT asset, d, above FROM c0 WHERE up")
def _(s, d):
    return backtest.crossings(src.bars(s, d), 20, 50).where("up").select("asset", "d", "above")


@query("momentum_zscore", f"WITH {BARS}, {FIELD} SELECT asset, round(h, 8) AS h FROM field")
def _(s, d):
    m = series.closes(src.bars(s, d)).select("asset", series.momentum(F.col("closes")).alias("momentum"))
    return signals.field(m).select("asset", F.round("h", 8).alias("h"))


@query("corr_matrix", f"WITH {COUPLING} SELECT i, j, round(v, 8) AS v FROM coupling")
def _(s, d):
    return signals.coupling(signals.tail_returns(src.bars(s, d))).select("i", "j", F.round("v", 8).alias("v"))


@query("sba_spins", f"WITH RECURSIVE {SPINS} SELECT asset, round(spin, 6) AS spin FROM spins")
def _(s, d):
    b = src.bars(s, d)
    m = series.closes(b).select("asset", series.momentum(F.col("closes")).alias("momentum"))
    return signals.spins(signals.coupling(signals.tail_returns(b)), signals.field(m)).select("asset", F.round("spin", 6).alias("spin"))


@query("signals_latest", f"WITH RECURSIVE {SIGNALS} SELECT * FROM signals")
def signals_latest(s, d):
    return signals.compute(src.bars(s, d))


def watchlists(s, d):
    c = src.table(s, d, "customer").select("c_custkey", "c_nationkey")
    w = c.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("n"), F.explode(F.array((F.col("c_custkey") % 5 + 1), (F.col("c_custkey") % 4 + 1))).alias("a"))
    return w.select("user_id", F.concat(F.lit("Brand#"), F.col("a").cast("string"), (F.col("n") % 5 + 1).cast("string")).alias("asset"), (F.col("a") == 1).alias("preferred")).distinct()


@query("signals_filtered", f"WITH RECURSIVE {SIGNALS}, w AS (SELECT DISTINCT c_custkey AS user_id, 'Brand#' || a || (c_nationkey % 5 + 1) AS asset, a = 1 AS preferred FROM customer, unnest([c_custkey % 5 + 1, c_custkey % 4 + 1]) AS t(a)), k AS (SELECT *, max(CAST(preferred AS INT)) OVER (PARTITION BY user_id) AS any_ FROM w) SELECT user_id, asset, signal_type, confidence FROM k JOIN signals USING (asset) WHERE any_ = 0 OR preferred")
def _(s, d):
    return signals.watched(signals.compute(src.bars(s, d)), watchlists(s, d)).select("user_id", "asset", "signal_type", "confidence")


@query("signal_single", f"WITH {RSI}, {MOMENTUM}, p AS (SELECT asset, tanh(5 * momentum) AS spin, rsi FROM mom JOIN rsi USING (asset)) SELECT asset, {SCORED} FROM p")
def _(s, d):
    return signals.single(src.bars(s, d))


@query("signal_flips", f"WITH {BARS}, t AS (SELECT asset, d, CASE WHEN close > prev * 1.15 THEN 'BUY' WHEN close < prev * 0.85 THEN 'SELL' ELSE 'HOLD' END AS signal_type FROM (SELECT *, lag(close) OVER (PARTITION BY asset ORDER BY d) AS prev FROM bars)), f AS (SELECT *, lag(signal_type) OVER (PARTITION BY asset ORDER BY d) AS previous FROM t) SELECT asset, d, previous, signal_type FROM f WHERE previous <> signal_type")
def _(s, d):
    prev = F.lag("close").over(Window.partitionBy("asset").orderBy("d"))
    kind = F.when(F.col("close") > prev * 1.15, "BUY").when(F.col("close") < prev * 0.85, "SELL").otherwise("HOLD")
    return signals.flips(src.bars(s, d).withColumn("signal_type", kind)).select("asset", "d", "previous", "signal_type")


@query("last_price", f"WITH {TRADES}, {PRICES} SELECT asset, price FROM prices")
def _(s, d):
    return src.last_price(src.filled(src.trades(s, d)))


@query("asof_price", f"WITH {TRADES}, q AS (SELECT event_id AS decision_id, 'K' || {K} AS asset, ts AS t FROM events WHERE event_type = 'error') SELECT decision_id, q.asset, coalesce(x.filled_price, 100.0) AS price FROM q ASOF LEFT JOIN trades x ON q.asset = x.asset AND q.t >= x.filled_at")
def _(s, d):
    t = src.trades(s, d)
    q = t.where("status = 'REJECTED'").select(F.col("trade_id").alias("decision_id"), "asset", F.col("filled_at").alias("decided_at"))
    return ledger.asof_price(q, src.filled(t))


@query("positions", f"WITH {POSITIONS} SELECT * FROM positions")
def _(s, d):
    return ledger.positions(src.trades(s, d))


def _pnl(s, d):
    t = src.trades(s, d)
    return ledger.positions_pnl(t, src.last_price(src.filled(t)))


@query("positions_pnl", f"WITH {PNL} SELECT * FROM pnl")
def _(s, d):
    return _pnl(s, d)


@query("total_pnl", f"WITH {PNL} SELECT user_id, CAST(round_even(sum(CAST(unrealized_pnl AS DECIMAL(38, 9)) + CAST(realized_pnl AS DECIMAL(38, 9))), 2) AS DOUBLE) AS total_pnl, count(*) AS n_positions FROM pnl GROUP BY 1")
def _(s, d):
    return ledger.total_pnl(_pnl(s, d))


@query("cash_and_cap", f"WITH {TRADES}, {CASH} SELECT user_id, round(cash, 4) AS cash, round(greatest(5000, cash) * 0.05, 4) AS cap FROM accounts")
def _(s, d):
    return ledger.cash(src.trades(s, d))


def _curve(s, d):
    t = src.trades(s, d)
    return ledger.equity_curve(t, src.last_price(src.filled(t)))


@query("equity_curve", f"WITH {CURVE} SELECT user_id, seq, round(equity, 4) AS equity FROM curve")
def _(s, d):
    return _curve(s, d).select("user_id", "seq", F.round("equity", 4).alias("equity"))


@query("equity_scaled", f"WITH {CURVE} SELECT user_id, seq, round((equity - min(equity) OVER w) / CASE WHEN max(equity) OVER w = min(equity) OVER w THEN 1 ELSE max(equity) OVER w - min(equity) OVER w END, 6) AS scaled FROM curve WINDOW w AS (PARTITION BY user_id)")
def _(s, d):
    return ledger.scaled(_curve(s, d)).select("user_id", "seq", F.round("scaled", 6).alias("scaled"))


@query("max_drawdown", f"WITH {CURVE} SELECT user_id, round(dd, 6) AS max_drawdown FROM drawdowns")
def _(s, d):
    return ledger.max_drawdown(_curve(s, d)).select("user_id", F.round("max_drawdown", 6).alias("max_drawdown"))


@query("round_trips", f"WITH {BOOK} SELECT user_id, CAST(sum(wins) AS BIGINT) AS wins, CAST(sum(closed) AS BIGINT) AS closed, round(CASE WHEN sum(closed) = 0 THEN 0 ELSE sum(wins) / sum(closed) END, 3) AS win_rate FROM book GROUP BY 1")
def _(s, d):
    return ledger.round_trips(src.trades(s, d))


METRICS = f"""{CURVE}, {BOOK.replace(TRADES + ', ', '')}, wins AS (SELECT user_id, round(CASE WHEN sum(closed) = 0 THEN 0 ELSE sum(wins) / sum(closed) END, 3) AS win_rate FROM book GROUP BY 1),
 st AS (SELECT user_id, count(*) AS n, avg(ret) AS mean, coalesce(stddev_samp(ret), 0) AS sd, list(ret ORDER BY ret) AS r FROM returns GROUP BY 1),
 metrics AS (SELECT user_id, CASE WHEN n < 2 THEN 0 ELSE round(mean / (sd + 1e-9) * sqrt(252), 3) END AS sharpe_ratio, CASE WHEN n < 2 THEN 0 ELSE round(dd, 4) END AS max_drawdown, win_rate, total_trades,
 CASE WHEN n < 2 THEN 0 ELSE round(greatest(0, -r[CAST(least(floor(n * 0.05), n - 1) AS INT) + 1]), 4) END AS var_95, CASE WHEN n < 2 THEN 0 ELSE round(greatest(0, -r[CAST(least(floor(n * 0.01), n - 1) AS INT) + 1]), 4) END AS var_99 FROM st JOIN drawdowns USING (user_id) JOIN wins USING (user_id) JOIN (SELECT user_id, count(*) AS total_trades FROM trades GROUP BY 1) USING (user_id))"""


@query("risk_metrics", f"WITH {METRICS} SELECT * FROM metrics")
def _(s, d):
    t = src.trades(s, d)
    return ledger.risk_metrics(t, src.last_price(src.filled(t)))


@query("trades_serialized", f"WITH {TRADES} SELECT trade_id, asset, side, nullif(filled_price, 0) AS filled_price, substr(sha256(CAST(trade_id AS VARCHAR)), 1, 32) || '...' AS signature, strftime(filled_at, '%Y-%m-%dT%H:%M:%S') AS filled_at FROM trades")
def _(s, d):
    return ledger.serialized(src.filled(src.trades(s, d)))


LINE = """'"' || array_to_string([{}], '","') || '"'"""


@query("csv_export", f"""WITH {METRICS}, {PNL.replace(BOOK + ', ', '').replace(PRICES + ', ', '')} SELECT 0 AS section_ord, '' AS k, '"section","asset","quantity","avg_entry_price","current_price","market_value","unrealized_pnl"' AS line
 UNION ALL SELECT 1, asset, {LINE.format("'position', asset, CAST(quantity AS VARCHAR), CAST(avg_entry_price AS VARCHAR), CAST(current_price AS VARCHAR), CAST(market_value AS VARCHAR), CAST(unrealized_pnl AS VARCHAR)")} FROM pnl WHERE user_id = 1
 UNION ALL SELECT 2, name, {LINE.format("'metric', name, value")} FROM (UNPIVOT (SELECT user_id, CAST(CAST(sharpe_ratio AS DOUBLE) AS VARCHAR) AS sharpe_ratio, CAST(CAST(max_drawdown AS DOUBLE) AS VARCHAR) AS max_drawdown, CAST(CAST(win_rate AS DOUBLE) AS VARCHAR) AS win_rate, CAST(total_trades AS VARCHAR) AS total_trades,
 CAST(CAST(var_95 AS DOUBLE) AS VARCHAR) AS var_95, CAST(CAST(var_99 AS DOUBLE) AS VARCHAR) AS var_99 FROM metrics WHERE user_id = 1) ON sharpe_ratio, max_drawdown, win_rate, total_trades, var_95, var_99 INTO NAME name VALUE value)""")
def _(s, d):
    t = src.trades(s, d)
    prices = kept(src.last_price(src.filled(t)), "prices")
    return ledger.export_lines(ledger.positions_pnl(t, prices), ledger.risk_metrics(t, prices), 1)


FILL = f"""{CANDS}, {TRADES}, {PRICES}, j AS (SELECT c.*, coalesce(price, 100.0) AS last FROM cands c LEFT JOIN prices USING (asset)),
 t AS (SELECT *, coalesce(CASE WHEN side = 'buy' THEN last <= limit_price ELSE last >= limit_price END, FALSE) AS reach, coalesce(CASE WHEN side = 'buy' THEN last >= stop_price ELSE last <= stop_price END, FALSE) AS hit FROM j),
 f AS (SELECT *, CASE WHEN order_type = 'market' OR (order_type = 'stop' AND hit) THEN last WHEN (order_type = 'limit' AND reach) OR (order_type = 'stop_limit' AND hit AND reach) THEN limit_price END AS px FROM t),
 done AS (SELECT order_id, order_type, time_in_force, CASE WHEN px IS NOT NULL THEN 'FILLED' WHEN time_in_force = 'ioc' THEN 'EXPIRED' ELSE 'ACCEPTED' END AS status, round(px, 4) AS filled_price FROM f)"""


@query("fill_match", f"WITH {FILL} SELECT order_id, status, filled_price, CASE WHEN status = 'FILLED' THEN 'order.filled' END AS event FROM done")
def _(s, d):
    return orders.matched(src.order_candidates(s, d), src.last_price(src.filled(src.trades(s, d))))


@query("pending_sweep", f"WITH {FILL} SELECT order_id, 'FILLED' AS status, filled_price, 'order.filled' AS event FROM done JOIN (SELECT order_id FROM cands WHERE status = 'ACCEPTED' AND broker_order_id IS NULL) USING (order_id) WHERE filled_price IS NOT NULL")
def _(s, d):
    return orders.sweep(src.order_candidates(s, d), src.last_price(src.filled(src.trades(s, d))))


IS_OPEN = "CASE WHEN status IN ('PENDING', 'ACCEPTED', 'SUBMITTED') THEN 1 ELSE 0 END"
NEAR = f"near AS (SELECT order_id, sum({IS_OPEN}) OVER (PARTITION BY user_id, asset, side, quantity ORDER BY submitted_at RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW) - (SELECT coalesce(sum({IS_OPEN}), 0) FROM cands AS x WHERE (x.user_id, x.asset, x.side, x.quantity, x.submitted_at) = (cands.user_id, cands.asset, cands.side, cands.quantity, cands.submitted_at) AND x.order_id >= cands.order_id) AS near FROM cands)"


@query("duplicate_orders", f"WITH {CANDS}, {NEAR} SELECT order_id FROM near WHERE near > 0")
def _(s, d):
    return orders.duplicates(src.order_candidates(s, d), 21_600)


@query("order_precheck", f"""WITH {CANDS}, {NEAR}, {BOOK}, {PRICES}, {CASH}, j AS (SELECT c.*, near, coalesce(b.quantity, 0) AS held, coalesce(greatest(5000, cash) * 0.05, 5000) AS cap, coalesce(nullif(limit_price, 0), nullif(stop_price, 0), price, 100.0) AS risk
 FROM cands c JOIN near USING (order_id) LEFT JOIN (SELECT user_id, asset, round(quantity, 6) AS quantity FROM book WHERE quantity > 0) b USING (user_id, asset) LEFT JOIN accounts USING (user_id) LEFT JOIN prices USING (asset))
 SELECT order_id, CASE WHEN order_type IN ('limit', 'stop_limit') AND coalesce(limit_price, 0) = 0 THEN 'limit_price_required' WHEN order_type IN ('stop', 'stop_limit') AND coalesce(stop_price, 0) = 0 THEN 'stop_price_required' WHEN side = 'sell' AND quantity > held THEN 'insufficient_position'
 WHEN side = 'buy' AND quantity * risk > round(cap, 4) THEN 'concentration_limit' WHEN near > 0 THEN 'duplicate' ELSE 'accepted' END AS reject_code, round(risk, 4) AS risk_price FROM j""")
def _(s, d):
    t = src.trades(s, d)
    return orders.precheck(src.order_candidates(s, d), ledger.positions(t), ledger.cash(t), src.last_price(src.filled(t)), 21_600)


@query("order_bounds", f"WITH {CANDS} SELECT order_id, CASE WHEN quantity <= 0 OR quantity > 1000000 THEN 'quantity' WHEN coalesce(limit_price <= 0, FALSE) THEN 'limit_price' WHEN coalesce(stop_price <= 0, FALSE) THEN 'stop_price' WHEN NOT regexp_full_match(upper(trim(asset)), '[A-Z0-9.\\-]{{1,20}}') THEN 'asset' ELSE '' END AS error FROM cands")
def _(s, d):
    return orders.bounds(src.order_candidates(s, d))


OB = "ob AS (SELECT o_orderkey AS order_id, o_custkey AS user_id, 'K' || (o_custkey % 10) AS asset, CASE o_orderstatus WHEN 'F' THEN 'FILLED' WHEN 'O' THEN 'ACCEPTED' ELSE 'PENDING' END AS status, o_totalprice AS price, o_orderpriority AS side, o_orderdate AS submitted_at FROM orders)"


@query("orders_recent", f"WITH {OB} SELECT * FROM ob ORDER BY submitted_at DESC, order_id DESC LIMIT 20")
def _(s, d):
    return orders.latest(src.orders_book(s, d), 20)


@query("orders_search", f"WITH {OB} SELECT order_id, status FROM ob WHERE contains(lower(asset), 'k7') OR contains(lower(status), 'k7') OR contains(lower(side), 'k7')")
def _(s, d):
    return orders.search(src.orders_book(s, d), "K7").select("order_id", "status")


@query("orders_cancel", f"WITH {OB} SELECT order_id, CASE WHEN status IN ('FILLED', 'CANCELLED', 'REJECTED') THEN 'refused' ELSE 'CANCELLED' END AS outcome FROM ob")
def _(s, d):
    return orders.cancel(src.orders_book(s, d))


@query("orders_open", f"WITH {OB} SELECT user_id, count(*) AS n FROM ob WHERE status IN ('PENDING', 'ACCEPTED', 'SUBMITTED') GROUP BY 1")
def _(s, d):
    return src.orders_book(s, d).where(F.col("status").isin(*orders.OPEN)).groupBy("user_id").agg(F.count("*").alias("n"))


@query("backtest_ma", f"""WITH {LOOP}, e AS (SELECT asset, z.curve AS v, z.pos AS pos, z.wins + CAST(z.pos AND last_close > z.entry AS INT) AS wins, z.closed + CAST(z.pos AS INT) AS closed, CASE WHEN z.pos THEN z.cash + z.shares * last_close ELSE z.cash END AS final FROM z),
 r AS (SELECT *, [(v[i + 1] - v[i]) / greatest(v[i], 1e-9) FOR i IN range(1, len(v))] AS ret, list_max([1 - v[i] / greatest(100000, list_max(v[1:i])) FOR i IN range(1, len(v) + 1)]) AS dd FROM e)
 SELECT asset, round(final, 2) AS final_capital, round(final / 100000 - 1, 4) AS total_return, CASE WHEN len(ret) < 2 THEN 0 ELSE round(list_avg(ret) / (list_stddev_samp(ret) + 1e-9) * sqrt(252), 3) END AS sharpe_ratio, round(dd, 4) AS max_drawdown, round(wins / greatest(1, closed), 3) AS win_rate, CAST(2 * closed AS BIGINT) AS total_trades FROM r""")
def _(s, d):
    return backtest.report(src.bars(s, d))


@query("backtest_curve", f"WITH {LOOP}, p AS (SELECT asset, z.curve AS v, unnest(range(0, len(z.curve), greatest(1, len(z.curve) // 100))) AS p FROM z) SELECT asset, CAST(50 + p AS INT) AS i, round(v[p + 1], 4) AS equity FROM p")
def _(s, d):
    return backtest.sampled(backtest.curve(src.bars(s, d))).select("asset", "i", F.round("equity", 4).alias("equity"))


@query("key_health", f"WITH {HEALTH} SELECT * FROM health")
def _(s, d):
    return security.key_health(src.key_pairs(s, d), AS_OF)


@query("safety_score", f"WITH {HEALTH}, g AS (SELECT user_id, CASE WHEN count(*) FILTER (level = 'RED') > 0 THEN 'RED' WHEN count(*) FILTER (level = 'YELLOW') > 0 THEN 'YELLOW' ELSE 'GREEN' END AS threat, CAST(round_even(100.0 * count(*) FILTER (level = 'GREEN') / count(*), 0) AS INT) AS score, count(*) FILTER (level = 'RED' OR due < 15) AS expiring FROM health GROUP BY 1) SELECT * FROM g")
def _(s, d):
    return security.threat(security.key_health(src.key_pairs(s, d), AS_OF))


@query("key_rotation", f"WITH {KEYS}, l AS (SELECT user_id, algorithm, rotation_count FROM keys WHERE is_active QUALIFY row_number() OVER (PARTITION BY user_id, algorithm ORDER BY created_at DESC, key_id DESC) = 1) SELECT u.user_id, u.algorithm, coalesce(rotation_count + 1, 0) AS next_rotation FROM (SELECT DISTINCT user_id, algorithm FROM keys) u LEFT JOIN l USING (user_id, algorithm)")
def _(s, d):
    return security.rotated(src.key_pairs(s, d))


LOGS = "logs AS (SELECT event_id AS log_id, user_id, upper(event_type) AS action, props AS metadata, ts AS created_at FROM events)"


@query("audit_recent", f"WITH {LOGS} SELECT * FROM logs ORDER BY created_at DESC, log_id DESC LIMIT 50")
def _(s, d):
    return security.recent(src.audit_logs(s, d), 50)


@query("audit_enriched", f"WITH {LOGS} SELECT log_id, logs.user_id, action, c_name AS email FROM logs LEFT JOIN customer ON logs.user_id = c_custkey")
def _(s, d):
    users = src.table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("email"))
    return security.enriched(src.audit_logs(s, d), users).select("log_id", "user_id", "action", "email")


@query("audit_compliance", f"WITH {LOGS}, l AS (SELECT * FROM logs ORDER BY created_at DESC, log_id DESC LIMIT 100), p AS (SELECT log_id, sha256('{{\"action\":' || to_json(action) || ',\"log_id\":' || log_id || ',\"metadata\":' || to_json(metadata) || ',\"user_id\":' || user_id || '}}') AS right_ FROM l), v AS (SELECT right_ = CASE WHEN log_id % 10 = 0 THEN 'x' ELSE right_ END AS verified FROM p) SELECT count(*) AS entries, CAST(sum(CAST(verified AS INT)) AS BIGINT) AS verified, bool_and(verified) AS all_verified FROM v")
def _(s, d):
    hashed = lambda c: F.sha2(c, 256)
    signed = security.audit_sign(security.recent(src.audit_logs(s, d), 100), hashed)
    spoiled = signed.withColumn("signature", F.when(F.col("log_id") % 10 == 0, "x").otherwise(F.col("signature")))
    return security.compliance(security.audit_verify(spoiled, hashed))


@query("api_key_check", f"""WITH k AS (SELECT sha256('key-' || c_custkey) AS h, CASE WHEN c_custkey % 2 = 0 THEN ['read', 'trade'] WHEN c_custkey % 5 = 0 THEN ['admin'] ELSE ['read'] END AS scopes, c_custkey % 7 = 0 AS is_revoked, CASE WHEN c_custkey % 11 = 0 THEN TIMESTAMP '2001-01-01' END AS expires_at FROM customer WHERE c_custkey % 3 <> 0),
 r AS (SELECT c_custkey AS request_id, sha256('key-' || c_custkey) AS h, ['read', 'trade', 'root'][c_custkey % 3 + 1] AS scope FROM customer)
 SELECT request_id, coalesce(NOT is_revoked AND (list_contains(scopes, scope) OR list_contains(scopes, 'admin')) AND (expires_at IS NULL OR expires_at > TIMESTAMP '{AS_OF}'), FALSE) AS allowed FROM r LEFT JOIN k USING (h)""")
def _(s, d):
    n = F.col("c_custkey")
    c = src.table(s, d, "customer").select("c_custkey")
    keys = c.where(n % 3 != 0).select(F.sha2(F.concat(F.lit("key-"), n.cast("string")), 256).alias("key_hash"), F.when(n % 2 == 0, F.array(F.lit("read"), F.lit("trade"))).when(n % 5 == 0, F.array(F.lit("admin"))).otherwise(F.array(F.lit("read"))).alias("scopes"), (n % 7 == 0).alias("is_revoked"), F.when(n % 11 == 0, F.lit("2001-01-01 00:00:00").cast("timestamp_ntz")).alias("expires_at"))
    requests = c.select(n.alias("request_id"), F.concat(F.lit("key-"), n.cast("string")).alias("raw"), F.element_at(F.array(*map(F.lit, ("read", "trade", "root"))), (n % 3 + 1).cast("int")).alias("scope"))
    return security.api_key_check(requests, keys, AS_OF)


@query("scope_check", "WITH t AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN ['read', 'root'] WHEN c_custkey % 4 = 1 THEN ['trade', 'admin'] WHEN c_custkey % 4 = 2 THEN ['Read'] ELSE [] END AS scopes FROM customer) SELECT id, len(list_filter(scopes, lambda x: x NOT IN ('read', 'trade', 'admin'))) = 0 AS ok FROM t")
def _(s, d):
    n = F.col("c_custkey") % 4
    a = lambda *x: F.array(*map(F.lit, x))
    scopes = F.when(n == 0, a("read", "root")).when(n == 1, a("trade", "admin")).when(n == 2, a("Read")).otherwise(F.array().cast("array<string>"))
    return src.table(s, d, "customer").select(F.col("c_custkey").alias("id"), catalog.scopes_ok(scopes, ("read", "trade", "admin")).alias("ok"))


@query("etag_hash", "SELECT c_custkey AS id, substr(sha1(c_name), 1, 16) AS etag, sha1(c_name) AS sha1 FROM customer")
def _(s, d):
    return src.table(s, d, "customer").select(F.col("c_custkey").alias("id"), security.etag(F.col("c_name")).alias("etag"), F.sha1(F.col("c_name").cast("binary")).alias("sha1"))


@query("webhook_url_valid", "SELECT page_id, url LIKE 'https://%' AND regexp_matches(url, '^https://[^/@]+(/|$)') AS ok FROM pages")
def _(s, d):
    return src.table(s, d, "pages").select("page_id", validate.https_url(F.col("url")).alias("ok"))


OCTETS = "[10, 172, 192, 8, 127, 169, 0, 198, 203, 224, 240, 256, 100]"
#: What the first four octets of addresses that aren't public look like.
NOT_PUBLIC = "a IN (0, 10, 127) OR a >= 240 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 169 AND b = 254) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113)"


@query("public_ip", f"WITH ips AS (SELECT c_custkey AS id, {OCTETS}[c_custkey % 13 + 1] AS a, [0, 16, 168, 254, 31, 32, 18, 51][c_custkey % 8 + 1] AS b, [0, 2, 113, 100, 7][c_custkey % 5 + 1] AS c, c_custkey % 256 AS d FROM customer) SELECT id, a <= 255 AND NOT ({NOT_PUBLIC}) AS public FROM ips")
def _(s, d):
    n = F.col("c_custkey")
    pick = lambda v: F.element_at(F.array(*map(F.lit, v)), (n % len(v) + 1).cast("int")).cast("string")
    ip = F.concat_ws(".", pick((10, 172, 192, 8, 127, 169, 0, 198, 203, 224, 240, 256, 100)), pick((0, 16, 168, 254, 31, 32, 18, 51)), pick((0, 2, 113, 100, 7)), (n % 256).cast("string"))
    return src.table(s, d, "customer").select(n.alias("id"), validate.public_ip(ip).alias("public"))


@query("webhook_outbox", "SELECT event_id, user_id * 10 AS hook_id, '{\"data\":' || event_id || ',\"event\":\"' || event_type || '\"}' AS payload FROM events WHERE (user_id % 3 <> 0) AND event_type IN ('purchase', CASE WHEN user_id % 2 = 0 THEN 'signup' ELSE 'purchase' END)")
def _(s, d):
    e = src.table(s, d, "events").select("event_id", "user_id", F.col("event_type").alias("event_name"))
    u = F.col("user_id")
    hooks = e.select("user_id").distinct().select(u, (u * 10).alias("hook_id"), (u % 3 != 0).alias("is_active"), F.when(u % 2 == 0, F.array(F.lit("purchase"), F.lit("signup"))).otherwise(F.array(F.lit("purchase"))).alias("event_types"))
    return security.outbox(e, hooks)


PADS = [bytes(b ^ pad for b in b"hook-secret".ljust(64, b"\0")).hex() for pad in (0x36, 0x5C)]


@query("webhook_signed", f"""WITH p AS (SELECT event_id, user_id AS hook_id, '{{"data":' || event_id || ',"event":"' || event_type || '"}}' AS payload FROM events WHERE event_type = 'purchase') SELECT *, sha256(unhex('{PADS[1]}') || unhex(sha256(unhex('{PADS[0]}') || encode(payload)))) AS signature FROM p""")
def _(s, d):
    from ..functions.keyed_hash import hmac_sha256

    e = src.table(s, d, "events").select("event_id", "user_id", F.col("event_type").alias("event_name"))
    hooks = e.select("user_id").distinct().select("user_id", F.col("user_id").alias("hook_id"), F.lit(True).alias("is_active"), F.array(F.lit("purchase")).alias("event_types"))
    return security.outbox(e, hooks, hmac_sha256("hook-secret"))


HTTP = "req AS (SELECT ['GET', 'POST'][event_id % 2 + 1] AS method, '/' || event_type AS path, CASE WHEN event_id % 20 = 0 THEN 500 ELSE 200 END AS status, value AS latency FROM events)"


def _requests(s, d):
    e = src.table(s, d, "events")
    n = F.col("event_id")
    return e.select(F.when(n % 2 == 0, "GET").otherwise("POST").alias("method"), F.concat(F.lit("/"), "event_type").alias("path"), F.when(n % 20 == 0, 500).otherwise(200).alias("status"), F.col("value").alias("latency"))


@query("http_metrics", f"WITH {HTTP} SELECT method, path, status, count(*) AS n FROM req GROUP BY ALL")
def _(s, d):
    return security.http_counts(_requests(s, d))


@query("http_latency", f"WITH {HTTP} SELECT method, path, count(*) AS n, count(*) FILTER (latency <= 10) AS le_10, count(*) FILTER (latency <= 50) AS le_50, count(*) FILTER (latency <= 100) AS le_100 FROM req GROUP BY ALL")
def _(s, d):
    return security.http_latency(_requests(s, d))


@query("rate_limit", "SELECT event_id AS request_id, count(*) OVER w AS seen, count(*) OVER w <= 3 AS allowed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW)")
def _(s, d):
    return security.rate_limited(src.table(s, d, "events").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("key"), F.col("ts").alias("at")), 21_600, 3)


@query("lockout", "WITH att AS (SELECT user_id AS key, list({'t': epoch(ts), 'f': event_type = 'error', 'until': CAST(0 AS DOUBLE), 'times': CAST([] AS DOUBLE[]), 'locks': 0, 'refused': 0} ORDER BY ts, event_id) AS l FROM events GROUP BY 1), z AS (SELECT key, list_reduce(l, lambda a, x: CASE WHEN x.t < a.until THEN {'t': x.t, 'f': x.f, 'until': a.until, 'times': a.times, 'locks': a.locks, 'refused': a.refused + 1} WHEN x.f AND len(list_filter(a.times, lambda z: z > x.t - 86400)) + 1 >= 3 THEN {'t': x.t, 'f': x.f, 'until': x.t + 21600, 'times': CAST([] AS DOUBLE[]), 'locks': a.locks + 1, 'refused': a.refused} WHEN x.f THEN {'t': x.t, 'f': x.f, 'until': a.until, 'times': list_append(list_filter(a.times, lambda z: z > x.t - 86400), x.t), 'locks': a.locks, 'refused': a.refused} ELSE {'t': x.t, 'f': x.f, 'until': CAST(0 AS DOUBLE), 'times': CAST([] AS DOUBLE[]), 'locks': a.locks, 'refused': a.refused} END, {'t': CAST(0 AS DOUBLE), 'f': FALSE, 'until': CAST(0 AS DOUBLE), 'times': CAST([] AS DOUBLE[]), 'locks': 0, 'refused': 0}) AS z FROM att) SELECT key, z.locks AS locks, z.refused AS refused FROM z")
def _(s, d):
    return security.lockouts(src.table(s, d, "events").select(F.col("event_id").alias("attempt_id"), F.col("user_id").alias("key"), F.col("ts").alias("at"), (F.col("event_type") == "error").alias("failed")), 3, 86_400, 21_600)


@query("session_evict", "SELECT event_id AS session_id, user_id, ts AS created_at FROM events WHERE epoch(TIMESTAMP '2024-01-30 00:00:00') - floor(epoch(ts)) < 864000 ORDER BY ts DESC, event_id DESC LIMIT 500")
def _(s, d):
    return security.evicted(src.table(s, d, "events").select(F.col("event_id").alias("session_id"), "user_id", F.col("ts").alias("created_at")), "2024-01-30", 864_000, 500)


def _catalogue(s, d):
    c = src.table(s, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    ending = F.element_at(F.array(*map(F.lit, ("", ".NS", ".L", ".T", ".HK", ".AX", ".TO", ".DE", "-USD"))), F.col("c_nationkey") % 9 + 1)
    t = c.select(F.col("c_custkey").alias("ordinal"), F.concat(F.upper(F.substring("c_mktsegment", 1, 3)), F.col("c_custkey").cast("string"), ending).alias("ticker"))
    return t.withColumn("exchange", catalog.exchange_of(F.col("ticker")))


@query("exchange_infer", f"WITH {TICKERS} SELECT ticker, {EXCHANGE} AS exchange FROM cat")
def _(s, d):
    return _catalogue(s, d).select("ticker", "exchange")


@query("exchange_counts", f"WITH {TICKERS} SELECT exchange, count(ticker) AS n_assets FROM (VALUES ('US'), ('NSE'), ('LSE'), ('XETRA'), ('TSE'), ('HKEX'), ('ASX'), ('TSX'), ('CRYPTO')) v(exchange) LEFT JOIN (SELECT ticker, {EXCHANGE} AS exchange FROM cat) USING (exchange) GROUP BY 1")
def _(s, d):
    return catalog.counts(catalog.exchanges(s), _catalogue(s, d))


@query("catalog_search", f"WITH {TICKERS}, hits AS (SELECT ordinal, ticker, {EXCHANGE} AS exchange FROM cat WHERE contains(ticker, 'UT') ORDER BY ordinal LIMIT 20) SELECT *, (SELECT count(*) FROM hits) AS total FROM hits")
def _(s, d):
    return catalog.search(_catalogue(s, d), " ut ").select("ordinal", "ticker", "exchange", "total")


@query("catalog_filter", f"WITH {TICKERS} SELECT ordinal, ticker FROM cat WHERE contains(lower(ticker), 'mac') AND {EXCHANGE} = 'TSE'")
def _(s, d):
    return catalog.filtered(_catalogue(s, d), "Mac", "TSE").select("ordinal", "ticker")


@query("catalog_groups", f"WITH {TICKERS}, g AS (SELECT ticker, CASE WHEN ticker LIKE 'AUT%' THEN 'Cars' WHEN ticker LIKE 'BUI%' THEN 'Homes' ELSE 'Other' END AS label FROM cat) SELECT label, CAST(row_number() OVER (PARTITION BY label ORDER BY ticker) AS INT) AS place, ticker FROM g")
def _(s, d):
    c = _catalogue(s, d)
    groups = c.where(F.col("ticker").startswith("AUT")).select("ticker", F.lit("Cars").alias("label")).unionByName(c.where(F.col("ticker").startswith("BUI")).select("ticker", F.lit("Homes").alias("label")))
    return catalog.grouped(c, groups)


#: Minutes from UTC of the exchanges in January, where the events lie (Sydney has summer time then), and their hours.
OFFSETS = "(VALUES ('US', -300, 570, 960), ('NSE', 330, 555, 930), ('LSE', 0, 480, 990), ('XETRA', 60, 540, 1050), ('TSE', 540, 540, 930), ('HKEX', 480, 570, 960), ('ASX', 660, 600, 960), ('TSX', -300, 570, 960), ('CRYPTO', 0, NULL, NULL)) x(exchange, off, opens, closes)"


@query("market_status", f"""WITH e AS (SELECT event_id, ts, ['US', 'NSE', 'LSE', 'XETRA', 'TSE', 'HKEX', 'ASX', 'TSX', 'CRYPTO'][event_id % 9 + 1] AS exchange FROM events),
 l AS (SELECT event_id, exchange, date_trunc('second', ts + to_minutes(off)) AS t, opens * 60 AS o, closes * 60 AS c FROM e JOIN {OFFSETS} USING (exchange)), s AS (SELECT *, isodow(t) >= 6 AS weekend, hour(t) * 3600 + minute(t) * 60 + second(t) AS x FROM l)
 SELECT event_id, exchange, CASE WHEN o IS NULL THEN 'open' WHEN weekend THEN 'closed' WHEN x < o THEN 'pre' WHEN x <= c THEN 'open' ELSE 'closed' END AS status, CASE WHEN o IS NULL THEN '24/7 OPEN' WHEN weekend THEN 'WEEKEND' WHEN x < o THEN 'PRE-MARKET' WHEN x <= c THEN 'OPEN' ELSE 'CLOSED' END AS label,
 CAST(CASE WHEN o IS NULL OR weekend THEN NULL WHEN x < o THEN (o - x) // 60 WHEN x <= c THEN (c - x) // 60 END AS INT) AS minutes, CASE WHEN o IS NOT NULL THEN strftime(t, '%H:%M') END AS local_time FROM s""")
def _(s, d):
    times = src.table(s, d, "events").select(F.col("ts").alias("at"), "event_id")
    x = catalog.exchanges(s)
    return catalog.market_status(times.withColumn("exchange", F.element_at(F.array(*(F.lit(e[0]) for e in catalog.EXCHANGES)), (F.col("event_id") % 9 + 1).cast("int"))).join(F.broadcast(x), "exchange")).select("event_id", "exchange", "status", "label", "minutes", "local_time")


@query("ticker_valid", f"WITH {TICKERS}, t AS (SELECT ordinal, CASE WHEN ordinal % 5 = 0 THEN ticker || '$' ELSE ' ' || lower(ticker) END AS raw FROM cat) SELECT ordinal, regexp_full_match(upper(trim(raw)), '[A-Z0-9.\\-]{{1,20}}') AS ok FROM t")
def _(s, d):
    raw = F.when(F.col("ordinal") % 5 == 0, F.concat("ticker", F.lit("$"))).otherwise(F.concat(F.lit(" "), F.lower("ticker")))
    return _catalogue(s, d).select("ordinal", validate.ticker(raw).alias("ok"))


#: Passwords of all sorts: with and without the signs that count, runs of four, a common one.
WORDS = ("Secret!pass", "nouppercase-", "aaaa-Runs-9", "User-pass#", "Blank sign ", "Straße€Secret", "QWERTY-common-")
SIGN_CLASS = validate.SIGNS.replace("'", "''")


def _passwords(s, d):
    n = F.col("c_custkey")
    p = F.when(n % 11 == 0, "").otherwise(F.concat(F.element_at(F.array(*map(F.lit, WORDS)), (n % 7 + 1).cast("int")), (n % 1000).cast("string"), F.repeat(F.lit("xY"), (n % 3).cast("int"))))
    return src.table(s, d, "customer").select(n.alias("password_id"), p.alias("password"), F.concat(F.lit("user"), (n % 10).cast("string"), F.lit("@mail.example.com")).alias("email"))


PASSWORDS = f"""p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE {list(WORDS)}[c_custkey % 7 + 1] || (c_custkey % 1000) || repeat('xY', CAST(c_custkey % 3 AS INT)) END AS p, 'user' || (c_custkey % 10) AS l FROM customer),
 r AS (SELECT *, len(p) >= 14 AS a, regexp_matches(p, '[a-z]') AS b, regexp_matches(p, '[A-Z]') AS c, regexp_matches(p, '[0-9]') AS d, regexp_matches(p, '{SIGN_CLASS}') AS e, len(list_filter(range(1, len(p) - 2), lambda i: p[i] = p[i + 1] AND p[i] = p[i + 2] AND p[i] = p[i + 3])) = 0 AS f FROM p),
 n AS (SELECT *, CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) + CAST(d AS INT) + CAST(e AS INT) + CAST(f AS INT) AS n FROM r)"""


@query("password_policy", f"WITH {PASSWORDS} SELECT id AS password_id, a AND len(p) <= 128 AND b AND c AND d AND e AND f AND NOT contains(lower(p), l) AS ok, CASE WHEN p = '' THEN 0 WHEN n <= 2 THEN 1 WHEN n <= 4 THEN 2 WHEN n = 5 THEN 3 ELSE 4 END AS strength FROM n")
def _(s, d):
    return _passwords(s, d).select("password_id", validate.password_ok(F.col("password"), F.col("email")).alias("ok"), validate.strength(F.col("password")).alias("strength"))


@query("password_common", f"WITH {PASSWORDS} SELECT id AS password_id FROM p WHERE lower(p) NOT IN ('qwerty-common-6', 'qwerty-common-13', 'user-pass#3')")
def _(s, d):
    common = s.createDataFrame([("Qwerty-Common-6",), ("qwerty-common-13",), ("user-pass#3",), ("user-pass#3",)], "password string")
    return validate.uncommon(_passwords(s, d), common).select("password_id")


@query("email_valid", "WITH m AS (SELECT c_custkey AS id, lower(trim(' U' || c_custkey || ['@Bad.example', '@nodot', '@Good.example', '.no.at', '@a@bad.example'][c_custkey % 5 + 1])) AS mail FROM customer) SELECT id FROM m WHERE contains(mail, '@') AND contains(substr(mail, strpos(mail, '@') + 1), '.') AND substr(mail, strpos(mail, '@') + 1) NOT IN ('bad.example', 'trash.example')")
def _(s, d):
    n = F.col("c_custkey")
    mail = F.concat(F.lit(" U"), n.cast("string"), F.element_at(F.array(*map(F.lit, ("@Bad.example", "@nodot", "@Good.example", ".no.at", "@a@bad.example"))), (n % 5 + 1).cast("int")))
    blocked = s.createDataFrame([("bad.example",), ("trash.example",)], "domain string")
    return validate.unblocked(src.table(s, d, "customer").select(n.alias("id"), mail.alias("email")), blocked).select("id")


@query("breach_count", "WITH p AS (SELECT c_custkey AS id, upper(sha1('pw' || c_custkey)) AS h FROM customer), f AS (SELECT substr(h, 1, 5) AS prefix, substr(h, 6) || ':' || (id * 2) AS line FROM p WHERE id % 3 = 0) SELECT id AS password_id, CAST(coalesce(sum(CAST(split_part(line, ':', 2) AS BIGINT)), 0) AS BIGINT) AS count FROM p LEFT JOIN f ON prefix = substr(h, 1, 5) AND split_part(line, ':', 1) = substr(h, 6) GROUP BY 1")
def _(s, d):
    n = F.col("c_custkey")
    p = src.table(s, d, "customer").select(n.alias("password_id"), F.concat(F.lit("pw"), n.cast("string")).alias("password"))
    sha = F.upper(F.sha1(F.col("password").cast("binary")))
    feed = p.where(F.col("password_id") % 3 == 0).select(F.left(sha, F.lit(5)).alias("prefix"), F.concat(F.substring(sha, 6, 35), F.lit(":"), (F.col("password_id") * 2).cast("string")).alias("line"))
    return validate.breach_count(p, feed)


#: Watch lists of users: tickers by the customer's number, some not tracked, some too many; what they ask for; what they prefer.
LISTS = """lists AS (SELECT c_custkey AS id, list_transform(range(1, 2 + CASE WHEN c_custkey % 17 = 0 THEN 60 ELSE c_custkey % 6 END), lambda i: 'T' || ((c_custkey * 7 + i * i) % 40)) AS list, 'T' || (c_custkey % 45) AS ticker,
 CASE WHEN c_custkey % 4 = 0 THEN ' t1, T2 ,,t' || (c_custkey % 40) WHEN c_custkey % 4 = 1 THEN ' , ' END AS asked, [['US'], ['LSE'], ['US', 'TSE']][c_custkey % 3 + 1] AS preferred, list_transform(range(0, 40), lambda i: 'T' || i) AS tracked FROM customer)"""


def _lists(s, d):
    n = F.col("c_custkey")
    size = F.when(n % 17 == 0, 60).otherwise(n % 6)
    items = F.transform(F.sequence(F.lit(1), F.greatest(size + 1, F.lit(1)).cast("int")), lambda i: F.concat(F.lit("T"), ((n * 7 + i * i) % 40).cast("string")))
    asked = F.when(n % 4 == 0, F.concat(F.lit(" t1, T2 ,,t"), (n % 40).cast("string"))).when(n % 4 == 1, " , ")
    a = lambda *x: F.array(*map(F.lit, x))
    preferred = F.when(n % 3 == 0, a("US")).when(n % 3 == 1, a("LSE")).otherwise(a("US", "TSE"))
    return src.table(s, d, "customer").select(n.alias("id"), items.alias("list"), F.concat(F.lit("T"), (n % 45).cast("string")).alias("ticker"), asked.alias("asked"), preferred.alias("preferred"), a(*(f"T{i}" for i in range(40))).alias("tracked"))


def _exchange_map():
    """The exchange of every third and every fifth tracked ticker; the others' is not known."""
    return F.create_map(*(F.lit(x) for i in range(40) if i % 3 == 0 or i % 5 == 0 for x in (f"T{i}", "LSE" if i % 3 == 0 else "TSE")))


@query("watchlist_ops", f"""WITH {LISTS} SELECT id, list_slice(list_filter(list, lambda x: list_contains(tracked[:30], x)), 1, 50) AS valid, CASE WHEN list_contains(list, ticker) OR len(list) >= 50 THEN list ELSE list_append(list, ticker) END AS added,
 CASE WHEN len(list_filter(list, lambda x: x <> ticker)) = 0 THEN list ELSE list_filter(list, lambda x: x <> ticker) END AS kept, list_filter(list_transform(string_split(coalesce(asked, ''), ','), lambda x: upper(trim(x))), lambda x: x <> '') AS parsed,
 CASE WHEN NOT list_contains(tracked, ticker) THEN 'not_tracked' WHEN list_contains(list, ticker) THEN 'present' WHEN len(list) >= 50 THEN 'full' ELSE 'added' END AS add_code, CASE WHEN NOT list_contains(list, ticker) THEN 'absent' WHEN len(list_filter(list, lambda x: x <> ticker)) = 0 THEN 'last' ELSE 'removed' END AS remove_code FROM lists""")
def _(s, d):
    w, t = F.col("list"), F.col("ticker")
    return _lists(s, d).select("id", catalog.only_valid(w, F.slice("tracked", 1, 30)).alias("valid"), catalog.added(w, t).alias("added"), catalog.removed(w, t).alias("kept"), catalog.parsed(F.coalesce("asked", F.lit(""))).alias("parsed"), catalog.add_code(w, t, F.col("tracked")).alias("add_code"), catalog.remove_code(w, t).alias("remove_code"))


@query("watchlist_replace", f"WITH {LISTS}, k AS (SELECT id, list_filter(list, lambda x: list_contains(tracked[:30], x)) AS k FROM lists) SELECT id, CASE WHEN len(k) BETWEEN 1 AND 50 THEN k END AS watchlist, CASE WHEN len(k) = 0 THEN 'no_valid' WHEN len(k) > 50 THEN 'too_many' ELSE 'ok' END AS code FROM k")
def _(s, d):
    return _lists(s, d).withColumn("r", catalog.replaced(F.transform("list", F.lower), F.slice("tracked", 1, 30))).select("id", "r.watchlist", "r.code")


@query("signals_wanted", f"""WITH {LISTS}, p AS (SELECT id, list, list_filter(list_transform(string_split(coalesce(asked, ''), ','), lambda x: upper(trim(x))), lambda x: x <> '') AS asked,
 list_filter(list, lambda t: list_contains(preferred, CASE WHEN CAST(substr(t, 2) AS INT) % 3 = 0 THEN 'LSE' WHEN CAST(substr(t, 2) AS INT) % 5 = 0 THEN 'TSE' ELSE 'US' END)) AS own FROM lists)
 SELECT id, list_sort(list_distinct(CASE WHEN len(asked) > 0 THEN asked WHEN len(own) > 0 THEN own ELSE list END)) AS wanted FROM p""")
def _(s, d):
    return _lists(s, d).select("id", catalog.wanted(F.col("asked"), F.col("list"), F.col("preferred"), _exchange_map()).alias("wanted"))


@query("watchlist_exchange", f"WITH {LISTS} SELECT id, list_sort(list_distinct(list_filter(list, lambda x: CAST(substr(x, 2) AS INT) % 3 = 0))) AS listed FROM lists")
def _(s, d):
    return _lists(s, d).select("id", catalog.on_exchange(F.col("list"), F.array(*(F.lit(f"T{i}") for i in range(0, 40, 3)))).alias("listed"))


@query("preferences_update", """WITH u AS (SELECT c_custkey AS user_id, ['US'] AS old, 'UTC' AS tz, CASE c_custkey % 4 WHEN 0 THEN ['lse', 'XXX'] WHEN 1 THEN ['nowhere'] WHEN 2 THEN ['TSE', 'us'] END AS new, CASE c_custkey % 5 WHEN 0 THEN 'Europe/Berlin' WHEN 1 THEN 'Mars/Base' WHEN 2 THEN 'Asia/Tokyo' END AS zone FROM customer),
 k AS (SELECT *, list_filter(list_transform(new, lambda x: upper(x)), lambda x: x IN ('US', 'NSE', 'LSE', 'XETRA', 'TSE', 'HKEX', 'ASX', 'TSX', 'CRYPTO')) AS k FROM u),
 c AS (SELECT *, CASE WHEN new IS NOT NULL AND len(k) = 0 THEN 'no_exchange' WHEN zone = 'Mars/Base' THEN 'bad_timezone' ELSE 'ok' END AS code FROM k)
 SELECT user_id, CASE WHEN code = 'ok' THEN coalesce(k, old) ELSE old END AS preferred_exchanges, CASE WHEN code = 'ok' THEN coalesce(zone, tz) ELSE tz END AS user_timezone, code FROM c""")
def _(s, d):
    import zoneinfo

    n = F.col("c_custkey")
    a = lambda *x: F.array(*map(F.lit, x))
    rows = src.table(s, d, "customer").select(n.alias("user_id"), a("US").alias("preferred_exchanges"), F.lit("UTC").alias("user_timezone"), F.when(n % 4 == 0, a("lse", "XXX")).when(n % 4 == 1, a("nowhere")).when(n % 4 == 2, a("TSE", "us")).alias("new_exchanges"), F.when(n % 5 == 0, "Europe/Berlin").when(n % 5 == 1, "Mars/Base").when(n % 5 == 2, "Asia/Tokyo").alias("new_timezone"))
    return catalog.preferences(rows, tuple(sorted(zoneinfo.available_timezones())))


@query("catalog_grouped_filter", f"WITH {TICKERS}, g AS (SELECT ticker, CASE WHEN ticker LIKE 'AUT%' THEN 'Cars' WHEN ticker LIKE 'BUI%' THEN 'Car homes' END AS label FROM cat) SELECT label, ticker FROM g WHERE label IS NOT NULL AND (contains(lower(ticker), 'cars') OR contains(lower(label), 'cars'))")
def _(s, d):
    c = _catalogue(s, d).select("ticker")
    groups = c.select("ticker", F.when(F.col("ticker").startswith("AUT"), "Cars").when(F.col("ticker").startswith("BUI"), "Car homes").alias("label")).where("label is not null")
    return catalog.grouped_filter(c, groups, " CARS ")


@query("catalog_visible", f"WITH {TICKERS} SELECT count(*) AS visible FROM cat WHERE contains(lower(ticker), 'mac') AND {EXCHANGE} = 'TSE'")
def _(s, d):
    return catalog.visible(_catalogue(s, d), "Mac", "TSE")


@query("orders_all", f"WITH {OB} SELECT * FROM ob ORDER BY submitted_at DESC, order_id DESC")
def _(s, d):
    return orders.newest_first(src.orders_book(s, d), "order_id", "submitted_at")


@query("keys_newest", f"WITH {KEYS} SELECT key_id, user_id, algorithm, created_at FROM keys ORDER BY created_at DESC, key_id DESC")
def _(s, d):
    return orders.newest_first(src.key_pairs(s, d), "key_id").select("key_id", "user_id", "algorithm", "created_at")


@query("order_point_read", f"WITH {OB} SELECT * FROM ob WHERE order_id = 7")
def _(s, d):
    return src.point_read(src.orders_book(s, d), "order_id", 7)


@query("order_payload", f"""WITH {CANDS}, {KEYS}, a AS (SELECT user_id, max(key_id) AS key_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, key_id DESC) AS r FROM keys WHERE is_active AND algorithm = 'ML-DSA-65') WHERE r = 1 GROUP BY 1),
 p AS (SELECT order_id, user_id, side || ':' || asset || ':' || CAST(quantity AS VARCHAR) || ':' || order_type || ':' || coalesce(CAST(round(limit_price, 4) AS VARCHAR), 'None') || ':' || coalesce(CAST(round(stop_price, 4) AS VARCHAR), 'None') || ':' || time_in_force AS payload FROM cands)
 SELECT order_id, payload, CASE WHEN key_id IS NOT NULL THEN sha256(key_id || '|' || payload) END AS signature FROM p LEFT JOIN a USING (user_id)""")
def _(s, d):
    keys = security.latest_keys(src.key_pairs(s, d).where("algorithm = 'ML-DSA-65'")).select("user_id", "key_id")
    priced = src.order_candidates(s, d).withColumns({c: F.round(c, 4) for c in ("limit_price", "stop_price")})
    return orders.signed(priced, keys, lambda key, text: F.sha2(F.concat_ws("|", key.cast("string"), text), 256))


@query("backtest_bounds", "WITH r AS (SELECT c_custkey AS request_id, c_custkey % 120 AS fast_window, c_custkey * 7 % 300 AS slow_window FROM customer) SELECT request_id, CASE WHEN fast_window NOT BETWEEN 2 AND 100 THEN 'fast_window' WHEN slow_window NOT BETWEEN 5 AND 250 THEN 'slow_window' WHEN slow_window <= fast_window THEN 'order' ELSE '' END AS error FROM r")
def _(s, d):
    n = F.col("c_custkey")
    return orders.window_bounds(src.table(s, d, "customer").select(n.alias("request_id"), (n % 120).alias("fast_window"), (n * 7 % 300).alias("slow_window")))


@query("backtest_last", "SELECT o_orderkey AS run_id, o_custkey % 20 AS user_id, CAST(row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderdate DESC, o_orderkey DESC) AS INT) AS place FROM orders QUALIFY place <= 20")
def _(s, d):
    runs = src.table(s, d, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 20).alias("user_id"), F.col("o_orderdate").alias("created_at"))
    return backtest.last_runs(runs).select("run_id", "user_id", "place")


@query("traded_assets", f"WITH {TRADES} SELECT user_id, list_sort(list_distinct(list(asset))) AS assets, CAST(count(DISTINCT asset) AS INT) AS n_assets FROM trades GROUP BY 1")
def _(s, d):
    return ledger.traded_assets(src.trades(s, d))


@query("key_rotation_applied", f"""WITH {KEYS}, w AS (SELECT user_id, algorithm, 1000000000 + user_id AS new_key_id FROM (SELECT DISTINCT user_id, algorithm FROM keys) WHERE user_id % 3 = 0 AND algorithm = 'ML-KEM-768'),
 l AS (SELECT user_id, algorithm, rotation_count FROM keys WHERE is_active QUALIFY row_number() OVER (PARTITION BY user_id, algorithm ORDER BY created_at DESC, key_id DESC) = 1)
 SELECT key_id, user_id, algorithm, is_active AND new_key_id IS NULL AS is_active, rotation_count, created_at, CASE WHEN is_active AND new_key_id IS NOT NULL THEN TIMESTAMP '{AS_OF}' END AS revoked_at FROM keys LEFT JOIN w USING (user_id, algorithm)
 UNION ALL SELECT new_key_id, user_id, algorithm, TRUE, coalesce(rotation_count + 1, 0), TIMESTAMP '{AS_OF}', NULL FROM w LEFT JOIN l USING (user_id, algorithm)""")
def _(s, d):
    keys = src.key_pairs(s, d)
    wanted = keys.where("user_id % 3 = 0 and algorithm = 'ML-KEM-768'").select("user_id", "algorithm").distinct().withColumn("new_key_id", F.lit(1_000_000_000).cast("long") + F.col("user_id"))
    return security.rotation(keys, wanted, AS_OF)


@query("secret_round_trip", "SELECT c_custkey AS id, TRUE AS marked, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'plain' END AS opened, CAST(NULL AS VARCHAR) AS with_other_key, base64(encode(c_name)) AS b64, c_name AS unb64 FROM customer")
def _(s, d):
    n, name, key = F.col("c_custkey"), F.col("c_name"), "0123456789abcdef"
    stored = F.when(n % 2 == 0, security.protected(name, key)).otherwise("plain")
    c = src.table(s, d, "customer").withColumn("stored", stored)
    shut = security.unprotected(security.protected(name, key), "fedcba9876543210")
    return c.select(n.alias("id"), ((n % 2 == 1) | F.col("stored").startswith("enc:")).alias("marked"), security.unprotected(F.col("stored"), key).alias("opened"), shut.alias("with_other_key"), F.base64(name.cast("binary")).alias("b64"), F.unbase64(F.base64(name.cast("binary"))).cast("string").alias("unb64"))


@query("snapshot_age", "SELECT c_custkey AS id, CASE WHEN c_custkey % 400 < 60 THEN '(' || (c_custkey % 400) || 's ago)' ELSE '(' || (c_custkey % 400 // 60) || 'm ' || (c_custkey % 400 % 60) || 's ago)' END AS age FROM customer")
def _(s, d):
    n = F.col("c_custkey")
    return src.table(s, d, "customer").select(n.alias("id"), catalog.age_label((n % 400).cast("double")).alias("age"))


@query("etag_conditional", "WITH t AS (SELECT c_custkey AS id, substr(sha1('2024-01-01' || (c_custkey % 50)), 1, 16) AS etag, c_custkey % 2 = 0 AS same, c_name AS body FROM customer) SELECT id, CASE WHEN same THEN 304 ELSE 200 END AS status, etag, CASE WHEN NOT same THEN body END AS body FROM t")
def _(s, d):
    n = F.col("c_custkey")
    b = src.table(s, d, "customer").select(n.alias("id"), F.lit("2024-01-01").alias("generated_at"), (n % 50).alias("n_assets"), F.col("c_name").alias("body"))
    old = security.etag(F.concat(F.lit("2024-01-01"), ((n + n % 2) % 50).cast("string")))
    held = b.join(src.table(s, d, "customer").select(n.alias("id"), F.when(n % 4 != 1, old).alias("held")), "id")
    return sinks.conditional(held, "held").select("id", "status", "etag", "body")
