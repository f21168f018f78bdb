"""Queries over tables in versions and over streams that run once, with the SQL of what they have to end in."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger, many_assets, scans, security, signals, sinks, versions
from ..functions import series
from ..sources import relations as src
from ..streaming import metrics, resting, sessions, stateful
from ..streaming.runs import run_once
from ..work import work_path
from . import queries as q

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def raw_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table as a stream, be it one file or a folder: a pattern stands for both."""
    return spark.readStream.schema(src.table(spark, sf_dir, table).schema).parquet(f"{sf_dir}/{table}.parque[t]")


def streamed(spark: SparkSession, sf_dir: str, table: str, time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    return raw_stream(spark, sf_dir, table).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


CUT = "2024-01-20"


@query("positions_replaced", f"WITH {q.POSITIONS} SELECT * FROM positions")
def _(s, d):
    """Positions as they were before a day, then replaced for the users who have traded since; who has sold all is gone."""
    t = src.trades(s, d)
    table = versions.Derived(s, work_path(s, "positions"), buckets=16)
    early = t.where(F.col("filled_at") < CUT)
    table.replace(ledger.positions(early), t.select("user_id"))
    table.replace(ledger.positions(t), t.where((F.col("filled_at") >= CUT) & (F.col("status") == "FILLED")).select("user_id"))
    return table.rows()


@query("orders_latest_state", f"WITH {q.CANDS}, l AS (SELECT (order_id % 500) AS key_id, order_id AS seq, status, asset FROM cands) SELECT key_id, max(seq) AS seq, arg_max(status, seq) AS status, arg_max(asset, seq) AS asset FROM l GROUP BY 1")
def _(s, d):
    """Events of orders appended in three parts, compacted after the second; base and tail together are the newest rows."""
    e = src.order_candidates(s, d).select((F.col("order_id") % 500).alias("key_id"), F.col("order_id").alias("seq"), "status", "asset", "submitted_at")
    table = versions.Latest(s, work_path(s, "orders"), "key_id", "seq", buckets=16)
    for begin, end in (("2024-01-01", "2024-01-10"), ("2024-01-10", CUT), (CUT, "2999-01-01")):
        table.append(e.where((F.col("submitted_at") >= begin) & (F.col("submitted_at") < end)).drop("submitted_at"))
        if begin != CUT:
            table.compact()
    return table.rows()


HOOKED = "hooks AS (SELECT DISTINCT user_id, user_id * 10 AS hook_id, user_id % 3 <> 0 AND user_id % 7 <> 0 AND user_id % 5 <> 0 AS ok, CASE WHEN user_id % 2 = 0 THEN ['purchase', 'signup'] ELSE ['purchase'] END AS kinds FROM events)"


@query("webhook_outbox_once", f"WITH {HOOKED} SELECT event_id, hook_id, '{{\"data\":' || event_id || ',\"event\":\"' || event_type || '\"}}' AS payload FROM events JOIN hooks USING (user_id) WHERE ok AND list_contains(kinds, event_type)")
def _(s, d):
    """A stream of events into the outbox, with hooks on plain HTTP (every seventh user) or private hosts (every fifth) left out; then the same stream from the start again, which adds nothing."""
    e = src.table(s, d, "events").select("user_id").distinct()
    u = F.col("user_id")
    url = F.concat(F.when(u % 7 == 0, "http").otherwise("https"), F.lit("://h"), u.cast("string"), F.lit(".example/in"))
    hooks = e.select(u, (u * 10).alias("hook_id"), (u % 3 != 0).alias("is_active"), url.alias("url"), F.when(u % 2 == 0, F.array(F.lit("purchase"), F.lit("signup"))).otherwise(F.array(F.lit("purchase"))).alias("event_types"))
    addresses = e.select(F.concat(F.lit("h"), u.cast("string"), F.lit(".example")).alias("host"), F.when(u % 5 == 0, "10.0.0.1").otherwise("93.184.216.34").alias("ip"))
    box = versions.Outbox(s, work_path(s, "outbox"))
    stream = streamed(s, d, "events").select("event_id", "user_id", F.col("event_type").alias("event_name"))
    for _ in range(2):
        security.deliver(stream, lambda: security.deliverable(hooks, addresses), box, work_path(s, "outbox-state")).trigger(availableNow=True).start().awaitTermination()
    return box.rows()


RESTING = f"""{q.CANDS}, {q.TRADES}, o AS (SELECT *, CASE WHEN status = 'CANCELLED' THEN submitted_at + INTERVAL 6 HOURS END AS gone FROM cands),
 seen AS (SELECT order_id, o.asset, o.side, order_type, limit_price, stop_price, gone, t.filled_at, submitted_at AS seen_at, t.filled_price AS last FROM o ASOF JOIN trades t ON o.asset = t.asset AND o.submitted_at >= t.filled_at
  UNION ALL SELECT order_id, o.asset, o.side, order_type, limit_price, stop_price, gone, t.filled_at, t.filled_at, t.filled_price FROM o JOIN trades t ON o.asset = t.asset AND t.filled_at > o.submitted_at AND (gone IS NULL OR t.filled_at < gone)),
 f AS (SELECT *, coalesce(CASE WHEN side = 'buy' THEN last <= limit_price ELSE last >= limit_price END, FALSE) AS reach, coalesce(CASE WHEN side = 'buy' THEN last >= stop_price ELSE last <= stop_price END, FALSE) AS hit FROM seen),
 px AS (SELECT *, CASE WHEN order_type = 'market' OR (order_type = 'stop' AND hit) THEN last WHEN (order_type = 'limit' AND reach) OR (order_type = 'stop_limit' AND hit AND reach) THEN limit_price END AS p FROM f)"""


@query("stream_fills", f"WITH {RESTING} SELECT order_id, any_value(asset) AS asset, min(seen_at) AS filled_at, round(arg_min(p, seen_at), 4) AS filled_price FROM px WHERE p IS NOT NULL GROUP BY 1")
def _(s, d):
    """Orders, ticks and cancellations (six hours after cancelled orders came) as one stream; each order fills once, at its first chance."""
    raw = raw_stream(s, d, "events")
    o = src.candidates_of(raw).withColumn("ts", F.col("submitted_at"))
    t = src.trades_of(raw).where("status = 'FILLED'").select("asset", F.col("filled_price").alias("price"), F.col("filled_at").alias("ts"), F.col("trade_id").alias("order_id"))
    gone = o.where("status = 'CANCELLED'").withColumn("ts", F.col("ts") + F.expr("INTERVAL 6 HOURS"))
    found = run_once(resting.fills_once(resting.events(o, t, gone)), "fills")
    return found.select("order_id", "asset", F.timestamp_micros(F.round(F.col("filled_at") * 1e6).cast("long")).cast("timestamp_ntz").alias("filled_at"), F.round("filled_price", 4).alias("filled_price"))


@query("stream_sessions", "WITH l AS (SELECT event_id AS session_id, user_id, ts AS created_at FROM events WHERE epoch(ts) > (SELECT max(epoch(ts)) FROM events) - 864000) SELECT * FROM l ORDER BY created_at DESC, session_id DESC LIMIT 1500")
def _(s, d):
    """Sessions opened by events: ten days to live, at most 1,500 at once."""
    store = sessions.Sessions(s, work_path(s, "sessions"), 864_000, 1_500, 3_600)
    opened = raw_stream(s, d, "events").select(F.col("event_id").alias("session_id"), "user_id", F.col("ts").cast("timestamp").alias("created_at"))
    sessions.keep_sessions(opened, store).awaitTermination()
    return store.live().select("session_id", "user_id", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


@query("stream_rate_limit", "SELECT event_id AS request_id, count(*) OVER w AS seen, count(*) OVER w <= 3 AS allowed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW)")
def _(s, d):
    stream = streamed(s, d, "events").select("ts", F.col("event_id").alias("request_id"), F.col("user_id").cast("string").alias("key"))
    return run_once(stateful.sliding_windows(stream, 21_600, 3), "limits")


@query("stream_first_nonce", "SELECT user_id * 100 + CAST(props->>'$.k' AS INT) AS nonce, count(*) AS n FROM (SELECT DISTINCT user_id, props FROM events) GROUP BY 1")
def _(s, d):
    """The replay guard over all events: one request passes for each nonce."""
    stream = streamed(s, d, "events", delay="60 days").select("ts", (F.col("user_id") * 100 + src.key_of()).alias("nonce"))
    return run_once(stateful.replay_guard(stream).select("nonce"), "nonces").groupBy("nonce").agg(F.count("*").alias("n"))


@query("stream_request_metrics", "WITH r AS (SELECT event_type AS path, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, value AS latency FROM events), n AS (SELECT '' AS p, * FROM r UNION ALL SELECT 'GET click ', * FROM r WHERE path = 'click') SELECT p || unnest(['n', 'errors', 'le_10', 'le_50', 'le_100']) AS metric, unnest([count(*), count(*) FILTER (status >= 500), count(*) FILTER (latency <= 10), count(*) FILTER (latency <= 50), count(*) FILTER (latency <= 100)]) AS total FROM n GROUP BY p")
def _(s, d):
    """Counters that a listener gathers while a stream of requests runs."""
    r = streamed(s, d, "events").select(F.lit("GET").alias("method"), F.col("event_type").alias("path"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), F.col("value").alias("latency"))
    heard = metrics.Totals("http")
    s.streams.addListener(heard)
    try:
        metrics.observed(r, routes=(("GET", "click"),)).writeStream.format("noop").option("checkpointLocation", work_path(s, "metrics-state")).trigger(availableNow=True).start().awaitTermination()
        heard.ended.wait(60)
    finally:
        s.streams.removeListener(heard)
    rows = [(k, int(v)) for k, v in heard.totals().items() if not k.endswith("sum")]
    return s.createDataFrame(rows, "metric string, total long")


@query("order_sorted_read", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77")
def _(s, d):
    path = work_path(s, "orders-sorted")
    sinks.sorted_layout(src.table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), path, "o_orderkey", 8)
    return src.point_read(s.read.parquet(path), "o_orderkey", 77)


FRAMEWORKS = ("FIPS 203", "FIPS 204")
LOGS_SIGNED = f"{q.LOGS}, signed AS (SELECT *, sha256('{{\"action\":' || to_json(action) || ',\"log_id\":' || log_id || ',\"metadata\":' || to_json(metadata) || ',\"user_id\":' || user_id || '}}') AS right_, CASE WHEN log_id % 10 = 0 THEN 'x' ELSE right_ END AS signature FROM logs)"


def _verified(s, d):
    signed = security.audit_sign(src.audit_logs(s, d), lambda p: F.sha2(p, 256)).withColumn("signature", F.when(F.col("log_id") % 10 == 0, "x").otherwise(F.col("signature")))
    return security.audit_verify(signed, lambda p: F.sha2(p, 256))


@query("audit_list", f"WITH {LOGS_SIGNED}, o AS (SELECT * FROM signed WHERE user_id = 7 ORDER BY created_at DESC, log_id DESC LIMIT 50) SELECT log_id, action, metadata, c_name AS user_email, left(signature, 24) || '...' AS signature_preview, signature = right_ AS verified, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at FROM o LEFT JOIN customer ON user_id = c_custkey")
def _(s, d):
    users = src.table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("email"))
    return security.audit_list(_verified(s, d), users, 7)


@query("compliance_report", f"""WITH {q.HEALTH}, {LOGS_SIGNED}, a AS (SELECT count(*) AS n, count(*) FILTER (signature = right_) AS ok FROM (SELECT * FROM signed WHERE user_id = 7 ORDER BY created_at DESC, log_id DESC LIMIT 100)),
 h AS (SELECT coalesce(max(CASE level WHEN 'RED' THEN 3 WHEN 'YELLOW' THEN 2 ELSE 1 END), 1) AS worst, coalesce(round_even(100.0 * count(*) FILTER (level = 'GREEN') / nullif(count(*), 0), 0), 100) AS score, count(*) FILTER (level = 'RED' OR due < 15) AS expiring,
  coalesce(string_agg('{{"key_id":' || key_id || ',"algorithm":"' || algorithm || '","days_until_rotation_due":' || due || ',"status":"' || level || '"}}', ',' ORDER BY key_id), '') AS keys FROM health WHERE user_id = 7)
 SELECT CAST(7 AS BIGINT) AS user_id, '{{"generated_at":"{q.AS_OF}","frameworks":["FIPS 203","FIPS 204"],"key_health":{{"threat_level":"' || ['GREEN', 'YELLOW', 'RED'][worst] || '","safety_score":' || CAST(score AS INT) || ',"expiring_keys":' || expiring || ',"keys":[' || keys || ']}},"audit_log":{{"entries_reviewed":' || n || ',"signatures_verified":' || ok || ',"all_verified":' || (n = ok) || '}}}}' AS body FROM a, h""")
def _(s, d):
    return security.compliance_report(src.key_pairs(s, d), _verified(s, d), 7, q.AS_OF, FRAMEWORKS)


@query("signals_envelope", f"WITH {q.BARS}, l AS (SELECT asset, round(max(close), 2) AS high FROM bars GROUP BY 1), w AS (SELECT unnest(['Brand#11', 'Brand#23', 'Brand#99']) AS asset) SELECT '{{\"generated_at\":\"2024-01-01\",\"n_assets\":' || (SELECT count(*) FROM l SEMI JOIN w USING (asset)) || ',\"total_assets\":' || (SELECT count(*) FROM l) || ',\"watchlist\":[\"Brand#11\",\"Brand#23\",\"Brand#99\"]}}' AS head, (SELECT string_agg(asset, ',' ORDER BY asset) FROM l SEMI JOIN w USING (asset)) AS assets")
def _(s, d):
    found = src.bars(s, d).groupBy("asset").agg(F.round(F.max("close"), 2).alias("high"))
    watch = s.createDataFrame([(a,) for a in ("Brand#23", "Brand#99", "Brand#11")], "asset string")
    body = F.col("body")
    one = sinks.envelope(found, watch, "2024-01-01")
    listed = F.from_json(F.get_json_object(body, "$.signals"), "array<struct<asset string, high double>>")
    return one.select(F.concat(F.regexp_extract(body, r'^(.*),"signals":', 1), F.lit("}")).alias("head"), F.array_join(listed["asset"], ",").alias("assets"))


@query("signal_one_ticker", f"WITH {q.RSI}, {q.MOMENTUM}, p AS (SELECT asset, tanh(5 * momentum) AS spin, rsi FROM mom JOIN rsi USING (asset) WHERE asset = 'Brand#23') SELECT asset, {q.SCORED} FROM p")
def _(s, d):
    return signals.single_of(src.bars(s, d), " brand#23", normal=str.title)


TYPED = lambda sql: sql.replace("p_brand", "p_size")


@query("corr_matrix_tiles", f"WITH {TYPED(q.COUPLING)} SELECT i, j, round(v, 8) AS v FROM coupling")
def _(s, d):
    """The correlation of 50 assets by tiles of about 20."""
    return many_assets.coupling_in_tiles(signals.tail_returns(src.bars(s, d, by="p_size")), 20).select("i", "j", F.round("v", 8).alias("v"))


@query("spins_by_factors", f"WITH RECURSIVE {TYPED(q.SPINS)} SELECT asset, round(spin, 6) AS spin FROM spins")
def _(s, d):
    b = src.bars(s, d, by="p_size")
    m = series.closes(b).select("asset", series.momentum(F.col("closes")).alias("momentum"))
    return many_assets.spins_by_factors(many_assets.factors(signals.tail_returns(b)), signals.field(m)).select("asset", F.round("spin", 6).alias("spin"))


@query("stream_fixed_windows", "WITH RECURSIVE r AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), w AS (SELECT event_id, user_id, i, ts AS start, 1::BIGINT AS seen FROM r WHERE i = 1 UNION ALL SELECT r.event_id, r.user_id, r.i, CASE WHEN r.ts >= w.start + INTERVAL 6 HOURS THEN r.ts ELSE w.start END, CASE WHEN r.ts >= w.start + INTERVAL 6 HOURS THEN 1 ELSE w.seen + 1 END FROM w JOIN r ON r.user_id = w.user_id AND r.i = w.i + 1) SELECT event_id AS request_id, seen, seen <= 2 AS allowed FROM w")
def _(s, d):
    stream = streamed(s, d, "events").select("ts", F.col("event_id").alias("request_id"), F.col("user_id").cast("string").alias("key"))
    return run_once(stateful.fixed_windows(stream, 21_600, 2), "windows")


@query("stream_lockout", q.ORACLE_SQL["lockout"])
def _(s, d):
    """The lockout on a stream of attempts, counted by key as the batch query counts."""
    stream = streamed(s, d, "events").select("ts", F.col("event_id").alias("attempt_id"), F.col("user_id").cast("string").alias("key"), (F.col("event_type") == "error").alias("failed"))
    found = run_once(stateful.lockout(stream, 3, 86_400, 21_600), "lockout").join(src.table(s, d, "events").select(F.col("event_id").alias("attempt_id"), F.col("user_id").alias("key")), "attempt_id")
    return found.groupBy("key").agg(F.count_if(F.col("outcome") == "locked").cast("int").alias("locks"), F.count_if(F.col("outcome") == "refused").cast("int").alias("refused"))


@query("stream_push", f"WITH RECURSIVE {q.SIGNALS} SELECT * FROM signals")
def _(s, d):
    """The push on a stream of trades: its last snapshot, as the sink wrote it."""
    out = work_path(s, "push")
    ticks = streamed(s, d, "events").select("ts", "value")
    stateful.push(ticks, lambda found: found.write.mode("overwrite").parquet(out), lambda: src.bars(s, d)).option("checkpointLocation", work_path(s, "push-state")).trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(out)


@query("stream_request_counts", "SELECT date_trunc('day', ts) AS start, user_id AS key, count(*) AS n FROM events GROUP BY 1, 2")
def _(s, d):
    stream = streamed(s, d, "events").select("ts", F.col("user_id").alias("key"))
    end = src.table(s, d, "events").agg(F.max("ts")).first()[0]  # windows that the watermark hasn't closed are counted apart
    closed = run_once(stateful.request_counts(stream, "1 day"), "counts").withColumn("start", F.col("start").cast("timestamp_ntz"))
    open_ = src.table(s, d, "events").where(F.to_date("ts") >= F.lit(end - timedelta(minutes=10)).cast("date")).groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("start"), F.col("user_id").alias("key")).agg(F.count("*").alias("n"))
    return closed.unionByName(open_.join(closed.select("start").distinct(), "start", "left_anti"))


@query("trades_appended", f"WITH {q.TRADES} SELECT asset, count(*) AS n, round(sum(filled_price), 4) AS total FROM trades GROUP BY 1")
def _(s, d):
    path, t = work_path(s, "trades"), src.filled(src.trades(s, d))
    for part in (F.col("filled_at") < CUT, F.col("filled_at") >= CUT):
        sinks.append(t.where(part), path)
    return s.read.schema(t.schema).parquet(path).groupBy("asset").agg(F.count("*").alias("n"), F.round(F.sum("filled_price"), 4).alias("total"))


@query("prices_as_json", f"WITH {q.TRADES}, {q.PRICES} SELECT asset, price FROM prices")
def _(s, d):
    path, rows = work_path(s, "prices"), src.last_price(src.filled(src.trades(s, d)))
    sinks.json_lines(rows, path)
    return s.read.schema(rows.schema).json(path)


@query("snapshot_single_flight", f"WITH {q.TRADES}, {q.PRICES} SELECT asset, price FROM prices")
def _(s, d):
    """Two callers of one snapshot: the second reads what the first has computed."""
    path, ask = work_path(s, "snapshot"), lambda: versions.single_flight(s, path, 3600, lambda: src.last_price(src.filled(src.trades(s, d))))
    ask()
    return ask()


@query("api_keys_issued", "WITH k AS (SELECT c_custkey AS id, 'tk_' || replace(replace(rtrim(to_base64(unhex(sha256(CAST(c_custkey AS VARCHAR)))), '='), '+', '-'), '/', '_') AS raw FROM customer) SELECT id, raw, left(raw, 11) AS key_prefix, sha256(raw) AS key_hash FROM k")
def _(s, d):
    n = F.col("c_custkey")
    return src.table(s, d, "customer").select(n.alias("id"), security.api_key(F.unhex(F.sha2(n.cast("string"), 256))).alias("k")).select("id", "k.*")


@query("html_escaped", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS body FROM pages")
def _(s, d):
    return src.table(s, d, "pages").select("page_id", security.html_escaped(F.col("html")).alias("body"))


#: The curve by its rule: at each trade, the cash and what each asset of the user is worth.
EQUITY = f"""{q.TRADES}, {q.PRICES}, x AS (SELECT user_id, asset, price, CASE WHEN side = 'buy' THEN quantity ELSE -quantity END AS x, filled_price, row_number() OVER (PARTITION BY user_id ORDER BY filled_at, trade_id) AS seq FROM trades JOIN prices USING (asset)),
 own AS (SELECT DISTINCT user_id, asset, price FROM x),
 grid AS (SELECT x.user_id, x.seq, own.price, sum(CASE WHEN x.asset = own.asset THEN x.x ELSE 0 END) OVER (PARTITION BY x.user_id, own.asset ORDER BY x.seq) AS held FROM x JOIN own USING (user_id)),
 worth AS (SELECT user_id, seq, sum(greatest(0, held) * price) AS worth FROM grid GROUP BY 1, 2),
 equity AS (SELECT user_id, CAST(seq AS INT) AS seq, 100000.0 - sum(x * filled_price) OVER (PARTITION BY user_id ORDER BY seq) + worth AS equity FROM x JOIN worth USING (user_id, seq) UNION ALL SELECT DISTINCT user_id, 0, 100000.0 FROM x)"""
BLOCK = 16  # points a block, so that most users are cut


def _in_blocks(s: SparkSession, d: str) -> DataFrame:
    t = src.trades(s, d)
    return ledger.equity_curve(t, src.last_price(src.filled(t)), block_rows=BLOCK)


@query("equity_in_blocks", f"WITH {EQUITY} SELECT user_id, seq, round(equity, 4) AS equity FROM equity")
def _(s, d):
    """The equity curve with users cut in blocks."""
    return _in_blocks(s, d).select("user_id", "seq", F.round("equity", 4).alias("equity"))


@query("falls_in_blocks", f"WITH {EQUITY}, z AS (SELECT user_id, list(equity ORDER BY seq) AS e FROM equity GROUP BY 1) SELECT user_id, round(list_max([1 - e[i] / list_max(e[1:i]) FOR i IN range(1, len(e) + 1)]), 6) AS max_drawdown FROM z")
def _(s, d):
    return ledger.max_drawdown(_in_blocks(s, d), BLOCK).select("user_id", F.round("max_drawdown", 6).alias("max_drawdown"))


@query("return_places", f"WITH {EQUITY}, r AS (SELECT b.user_id, CASE WHEN a.equity = 0 THEN 0 ELSE b.equity / a.equity - 1 END AS ret FROM equity a JOIN equity b ON a.user_id = b.user_id AND a.seq + 1 = b.seq), z AS (SELECT user_id, list_sort(list(ret)) AS r, count(*) AS n FROM r GROUP BY 1), p AS (SELECT * FROM (VALUES (0, 0.01), (1, 0.05), (2, 0.5)) p(level, share)) SELECT user_id, level, round(r[CAST(least(floor(n * share), n - 1) AS INT) + 1], 8) + 0.0 AS ret FROM z, p")
def _(s, d):
    """Historical quantiles of each user's returns, by selection."""
    found = scans.at_places(ledger.period_returns(_in_blocks(s, d), BLOCK), "user_id", "ret", (0.01, 0.05, 0.5))
    return found.select("user_id", "level", (F.round("ret", 8) + 0.0).alias("ret"))


@query("lockout_in_blocks", q.ORACLE_SQL["lockout"])
def _(s, d):
    """The lockout with keys cut in blocks."""
    return security.lockouts(src.table(s, d, "events").select(F.col("event_id").alias("attempt_id"), F.col("user_id").alias("key"), F.col("ts").alias("at"), (F.col("event_type") == "error").alias("failed")), 3, 86_400, 21_600, block_rows=BLOCK)
