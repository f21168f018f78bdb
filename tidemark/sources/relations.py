"""Relations of the engine, derived from the tables at hand. Each reads only the columns it needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scans import kept, same


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, by: str = "p_brand") -> DataFrame:
    """bars(asset, d, close): the volume-weighted price of each brand and ship day."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col(by).alias("asset"))
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("asset", F.to_date("l_shipdate").alias("d")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"))


def part_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of single parts: short series."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    return lines.groupBy(F.col("l_partkey").alias("asset"), F.to_date("l_shipdate").alias("d")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"))


def long_bars(wide: DataFrame, day: str = "d") -> DataFrame:
    """Wide closes (a column for each asset) to long bars, without nulls."""
    assets = [c for c in wide.columns if c != day]
    return wide.unpivot([day], assets, "asset", "close").na.drop(subset=["close"])


def history(bars_: DataFrame, as_of: str, months: int) -> DataFrame:
    """The trailing calendar range up to as_of."""
    return bars_.where((F.col("d") > F.add_months(F.lit(as_of).cast("date"), -months)) & (F.col("d") <= F.lit(as_of).cast("date")))


def key_of(props: str = "props") -> Column:
    return F.get_json_object(props, "$.k").cast("int")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades_of(table(spark, sf_dir, "events"))


def trades_of(events: DataFrame) -> DataFrame:
    """Trades of a table or stream of events."""
    return events.select(
        F.col("event_id").alias("trade_id"), "user_id", F.concat(F.lit("K"), (key_of() % 10).cast("string")).alias("asset"),
        F.when(F.col("event_type").isin("purchase", "click"), "buy").otherwise("sell").alias("side"), (1 + F.col("event_id") % 5).cast("double").alias("quantity"),
        F.col("value").alias("filled_price"), F.when(F.col("event_type") == "error", "REJECTED").otherwise("FILLED").alias("status"), F.col("ts").alias("filled_at"),
    )


def filled(trades_: DataFrame) -> DataFrame:
    return trades_.where("status = 'FILLED'")


def last_price(ticks: DataFrame, few: int = 200_000) -> DataFrame:
    """last_price(asset, price): the newest price of each asset; of equal times that of the largest id. First the newest time, then the price there, so that tasks hold one entry an asset: max_by over (time, id) sorts all rows
    that a task reads, which are those of a whole row group. The times of up to `few` assets are broadcast."""
    rows = ticks.select("asset", "filled_at", "trade_id", "filled_price")
    newest = kept(rows.groupBy("asset").agg(F.max("filled_at").alias("filled_at")), "newest")
    newest = F.broadcast(newest) if newest.count() <= few else newest.hint("merge")
    largest = F.max_by("filled_price", F.coalesce("trade_id", F.lit(-(2**63))))
    return same(rows, newest, ["asset", "filled_at"]).groupBy("asset").agg(largest.alias("price"))


def order_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates_of(table(spark, sf_dir, "events"))


def candidates_of(events: DataFrame) -> DataFrame:
    """Orders of a table or stream of events."""
    kind = F.element_at(F.array(*map(F.lit, ("market", "limit", "stop", "stop_limit"))), (F.col("event_id") % 4 + 1).cast("int"))
    missing = F.col("event_id") % 17 == 0
    return events.select(
        F.col("event_id").alias("order_id"), "user_id", F.concat(F.lit("K"), (key_of() % 10).cast("string")).alias("asset"),
        F.when(F.col("event_type").isin("purchase", "click"), "buy").otherwise("sell").alias("side"), (1 + F.col("event_id") % 5).cast("double").alias("quantity"), kind.alias("order_type"),
        F.when(kind.isin("limit", "stop_limit") & ~missing, F.col("value") * 1.02).alias("limit_price"), F.when(kind.isin("stop", "stop_limit") & ~missing, F.col("value") * 0.98).alias("stop_price"),
        F.element_at(F.array(*map(F.lit, ("day", "gtc", "ioc"))), (F.col("event_id") % 3 + 1).cast("int")).alias("time_in_force"), F.col("ts").alias("submitted_at"),
        F.element_at(F.array(*map(F.lit, ("ACCEPTED", "PENDING", "FILLED", "SUBMITTED", "CANCELLED", "ACCEPTED"))), (F.col("event_id") % 6 + 1).cast("int")).alias("status"), F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("b"), F.col("event_id").cast("string"))).alias("broker_order_id"),
    )


def orders_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "FILLED").when(F.col("o_orderstatus") == "O", "ACCEPTED").otherwise("PENDING")
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"), F.concat(F.lit("K"), (F.col("o_custkey") % 10).cast("string")).alias("asset"), status.alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("side"), F.col("o_orderdate").alias("submitted_at"))


def key_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("key_id"), (F.col("o_custkey") % 50).alias("user_id"), F.when(F.col("o_orderkey") % 2 == 0, "ML-KEM-768").otherwise("ML-DSA-65").alias("algorithm"),
        (F.col("o_orderstatus") != "F").alias("is_active"), (F.col("o_orderkey") % 7).alias("rotation_count"), F.col("o_orderdate").alias("created_at"),
    )


def audit_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    return e.select(F.col("event_id").alias("log_id"), "user_id", F.upper("event_type").alias("action"), F.col("props").alias("metadata"), F.col("ts").alias("created_at"))


def point_read(rows: DataFrame, key: str, value: int | str) -> DataFrame:
    """The row with the key: an equality that reaches the scan, so row groups without the value aren't read."""
    return rows.where(F.col(key) == F.lit(value))
