"""Order rules: validation in order of precedence, fills, sweeps of resting orders, duplicates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import looked_up

OPEN = ("PENDING", "ACCEPTED", "SUBMITTED")
FINAL = ("FILLED", "CANCELLED", "REJECTED")


def marketable(side: Column, last: Column, limit: Column) -> Column:
    return F.coalesce(F.when(side == "buy", last <= limit).otherwise(last >= limit), F.lit(False))


def triggered(side: Column, last: Column, stop: Column) -> Column:
    return F.coalesce(F.when(side == "buy", last >= stop).otherwise(last <= stop), F.lit(False))


def limit_fill(side: Column, last: Column, limit: Column) -> Column:
    """The price at which a resting limit order fills, or null."""
    return F.when(marketable(side, last, limit), limit)


def fill(side: Column, kind: Column, last: Column, limit: Column, stop: Column) -> Column:
    """struct(status, filled_price): market and triggered stop orders fill at the last price; limit and triggered stop-limit orders at their limit, if the market reaches it."""
    at = lambda price: F.struct(F.lit("FILLED").alias("status"), price.cast("double").alias("filled_price"))
    rest = F.struct(F.lit("ACCEPTED").alias("status"), F.lit(None).cast("double").alias("filled_price"))
    hit, reach = triggered(side, last, stop), marketable(side, last, limit)
    return F.when(kind == "market", at(last)).when((kind == "stop") & hit, at(last)).when((kind == "limit") & reach, at(limit)).when((kind == "stop_limit") & hit & reach, at(limit)).otherwise(rest)


def event_name(status: Column) -> Column:
    return F.when(status == "FILLED", "order.filled").when(status == "REJECTED", "order.rejected").when(status == "CANCELLED", "order.cancelled")


def matched(candidates: DataFrame, prices: DataFrame) -> DataFrame:
    """order_id, status, filled_price, event: orders filled against last prices; what an immediate-or-cancel order doesn't fill expires."""
    c = looked_up(candidates, prices, "asset").withColumn("last", F.coalesce("price", F.lit(100.0)))
    c = c.withColumn("f", fill(F.col("side"), F.col("order_type"), F.col("last"), F.col("limit_price"), F.col("stop_price")))
    status = F.when((F.col("time_in_force") == "ioc") & (F.col("f.status") == "ACCEPTED"), "EXPIRED").otherwise(F.col("f.status"))
    return c.select("order_id", status.alias("status"), F.round("f.filled_price", 4).alias("filled_price"), event_name(status).alias("event"))


def sweep(candidates: DataFrame, prices: DataFrame) -> DataFrame:
    """Accepted orders without a broker's id that the last prices fill now: limit orders by the cheap check alone, a stop-limit order if it is triggered and marketable at once, and market orders left over at the last price."""
    c = looked_up(candidates.where("status = 'ACCEPTED' and broker_order_id is null"), prices, "asset").withColumn("last", F.coalesce("price", F.lit(100.0)))
    side, kind, last, limit, stop = (F.col(x) for x in ("side", "order_type", "last", "limit_price", "stop_price"))
    price = F.when(kind == "limit", limit_fill(side, last, limit)).otherwise(fill(side, kind, last, limit, stop)["filled_price"])
    return c.withColumn("filled", price).where("filled is not null").select("order_id", F.lit("FILLED").alias("status"), F.round("filled", 4).alias("filled_price"), event_name(F.lit("FILLED")).alias("event"))


def open_before(seconds: int) -> Column:
    """How many open orders with the same user, asset, side and quantity were stored within the seconds before (needs t, seconds of submitted_at, and order_id): a range window instead of a join of pairs. Orders of one instant are stored in order of their ids, so those that are stored later are taken off again."""
    same = Window.partitionBy("user_id", "asset", "side", "quantity")
    is_open = F.col("status").isin(*OPEN).cast("int")
    within = F.sum(is_open).over(same.orderBy("t").rangeBetween(-seconds, 0))
    at_once = Window.partitionBy("user_id", "asset", "side", "quantity", "t")
    later = F.sum(is_open).over(at_once) - F.sum(is_open).over(at_once.orderBy("order_id").rowsBetween(Window.unboundedPreceding, -1))
    return within - F.coalesce(later, F.sum(is_open).over(at_once))


def duplicates(orders: DataFrame, seconds: int = 30) -> DataFrame:
    """order_id of orders that repeat an open one within the seconds before."""
    return orders.withColumn("t", F.col("submitted_at").cast("timestamp").cast("double")).withColumn("near", open_before(seconds)).where("near > 0").select("order_id")


def precheck(candidates: DataFrame, held: DataFrame, accounts: DataFrame, prices: DataFrame, seconds: int = 30) -> DataFrame:
    """order_id, reject_code: the first rule that an order breaks. A price of 0 is none. Held quantities, accounts and last prices meet it by equality joins."""
    c = candidates.withColumn("t", F.col("submitted_at").cast("timestamp").cast("double")).withColumn("near", open_before(seconds))
    c = c.join(held.select("user_id", "asset", F.col("quantity").alias("held")), ["user_id", "asset"], "left").join(accounts.select("user_id", "cap"), "user_id", "left")
    c = looked_up(c, prices, "asset")
    limit, stop = F.expr("nullif(limit_price, 0D)"), F.expr("nullif(stop_price, 0D)")
    risk = F.coalesce(limit, stop, F.col("price"), F.lit(100.0))
    needs_limit, needs_stop = F.col("order_type").isin("limit", "stop_limit") & limit.isNull(), F.col("order_type").isin("stop", "stop_limit") & stop.isNull()
    code = (
        F.when(needs_limit, "limit_price_required").when(needs_stop, "stop_price_required").when((F.col("side") == "sell") & (F.col("quantity") > F.coalesce("held", F.lit(0.0))), "insufficient_position")
        .when((F.col("side") == "buy") & (F.col("quantity") * risk > F.coalesce("cap", F.lit(5000.0))), "concentration_limit").when(F.col("near") > 0, "duplicate").otherwise("accepted")
    )
    return c.select("order_id", code.alias("reject_code"), F.round(risk, 4).alias("risk_price"))


def text_of(number: Column) -> Column:
    """A number as it stands in the payload: shortest form with at least one decimal; None where there is none."""
    fixed = F.regexp_replace(number.cast("decimal(30,6)").cast("string"), "0+$", "")
    return F.coalesce(F.when(fixed.endswith("."), F.concat(fixed, F.lit("0"))).otherwise(fixed), F.lit("None"))


def payload(side: Column, asset: Column, quantity: Column, kind: Column, limit: Column, stop: Column, tif: Column) -> Column:
    """The canonical text of an order, which is signed before the order is taken."""
    return F.concat_ws(":", side, asset, text_of(quantity), kind, text_of(limit), text_of(stop), tif)


def signed(candidates: DataFrame, keys: DataFrame, sign: Callable[[Column, Column], Column]) -> DataFrame:
    """order_id, payload, signature: signed with the user's active signature key (keys: user_id, key_id); null where there is none. sign is a function of the key's id and the payload."""
    text = payload(*(F.col(c) for c in ("side", "asset", "quantity", "order_type", "limit_price", "stop_price", "time_in_force")))
    return candidates.withColumn("payload", text).join(keys, "user_id", "left").select("order_id", "payload", F.when(F.col("key_id").isNotNull(), sign(F.col("key_id"), F.col("payload"))).alias("signature"))


def bounds(candidates: DataFrame) -> DataFrame:
    """order_id, error: limits of numbers and of the asset's name."""
    q, name = F.col("quantity"), F.upper(F.trim("asset"))
    error = F.when((q <= 0) | (q > 1_000_000), "quantity").when(F.coalesce(F.col("limit_price") <= 0, F.lit(False)), "limit_price").when(F.coalesce(F.col("stop_price") <= 0, F.lit(False)), "stop_price").when(~name.rlike(r"^[A-Z0-9.\-]{1,20}$"), "asset").otherwise("")
    return candidates.select("order_id", error.alias("error"))


def window_bounds(requests: DataFrame) -> DataFrame:
    """request_id, error: limits of a backtest's windows; each has a range of its own, and the slow one must be the longer."""
    fast, slow = F.col("fast_window"), F.col("slow_window")
    error = F.when(~fast.between(2, 100), "fast_window").when(~slow.between(5, 250), "slow_window").when(slow <= fast, "order").otherwise("")
    return requests.select("request_id", error.alias("error"))


def cancel(orders: DataFrame) -> DataFrame:
    """The outcome of a request to cancel each order; expired ones may be cancelled."""
    return orders.select("order_id", F.when(F.col("status").isin(*FINAL), "refused").otherwise("CANCELLED").alias("outcome"))


def newest_first(rows: DataFrame, key: str, by: str = "created_at") -> DataFrame:
    """All rows, the newest first: a sort by ranges, not in one task."""
    return rows.orderBy(F.desc(by), F.desc(key))


def latest(orders: DataFrame, n: int) -> DataFrame:
    return orders.orderBy(F.desc("submitted_at"), F.desc("order_id")).limit(n)


def search(orders: DataFrame, text: str) -> DataFrame:
    """Orders with the text in asset, status or side, in any case."""
    has = lambda c: F.lower(F.col(c).cast("string")).contains(text.lower())
    return orders.where(has("asset") | has("status") | has("side"))
