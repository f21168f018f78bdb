"""Catalogues: exchanges, tickers by exchange, search, market hours, watch lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.validate import time_zone

#: Code, time zone, opening and closing time in local minutes (null: always open).
EXCHANGES = (
    ("US", "America/New_York", 570, 960), ("NSE", "Asia/Kolkata", 555, 930), ("LSE", "Europe/London", 480, 990), ("XETRA", "Europe/Berlin", 540, 1050),
    ("TSE", "Asia/Tokyo", 540, 930), ("HKEX", "Asia/Hong_Kong", 570, 960), ("ASX", "Australia/Sydney", 600, 960), ("TSX", "America/Toronto", 570, 960), ("CRYPTO", "UTC", None, None),
)
#: Endings of tickers and their exchange; without any of them US.
SUFFIXES = ((".NS", "NSE"), (".L", "LSE"), (".T", "TSE"), (".HK", "HKEX"), (".AX", "ASX"), (".TO", "TSX"), (".DE", "XETRA"), ("-USD", "CRYPTO"))


def exchanges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EXCHANGES, "exchange string, tz string, opens int, closes int")


def exchange_of(ticker: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for ending, name in SUFFIXES:
        out = out.when(F.endswith(F.upper(ticker), F.lit(ending)), name)
    return out.otherwise("US")


def search(catalogue: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """The first matches in catalogue order whose ticker holds the query, with their exchange and how many come back; an empty query has none."""
    q = query.strip().upper()
    hits = catalogue.where(F.upper("ticker").contains(q)) if q else catalogue.limit(0)
    return hits.orderBy("ordinal").limit(limit).withColumn("total", F.count("*").over(Window.partitionBy(F.lit(1))))  # of at most limit rows


def filtered(catalogue: DataFrame, text: str, exchange: str | None) -> DataFrame:
    """Tickers that hold the text in any case and belong to the exchange (if one is given)."""
    hits = catalogue.where(F.lower("ticker").contains(text.lower()))
    return hits if exchange is None else hits.where(F.coalesce("exchange", F.lit("US")) == exchange)


def counts(exchanges_: DataFrame, catalogue: DataFrame) -> DataFrame:
    n = catalogue.groupBy("exchange").agg(F.count("*").alias("n"))
    return exchanges_.select("exchange").join(n, "exchange", "left").select("exchange", F.coalesce("n", F.lit(0)).cast("long").alias("n_assets"))


def market_status(rows: DataFrame, at: str = "at") -> DataFrame:
    """rows (with exchange, tz, opens, closes and a UTC time) with status, label, minutes and local_time (HH:mm; null for what never closes): pre before the opening, open up to and including the closing second, else closed; whole minutes to the opening or to the close."""
    local = F.convert_timezone(F.lit("UTC"), F.col("tz"), F.col(at).cast("timestamp_ntz"))
    second = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
    opens, closes = F.col("opens") * 60, F.col("closes") * 60
    weekend, always = F.weekday(local) >= 5, F.col("opens").isNull()
    case = lambda any_, week, pre, open_, after: F.when(always, any_).when(weekend, week).when(second < opens, pre).when(second <= closes, open_).otherwise(after)
    none = F.lit(None).cast("int")
    left = case(none, none, F.floor((opens - second) / 60), F.floor((closes - second) / 60), none)
    texts = (case(*map(F.lit, x)) for x in (("open", "closed", "pre", "open", "closed"), ("24/7 OPEN", "WEEKEND", "PRE-MARKET", "OPEN", "CLOSED")))
    return rows.withColumns(dict(zip(("status", "label"), texts, strict=True))).withColumn("minutes", left.cast("int")).withColumn("local_time", F.when(~always, F.date_format(local, "HH:mm")))


def grouped(catalogue: DataFrame, groups: DataFrame) -> DataFrame:
    """Each ticker with its group's label, leftovers as Other, in order within the group."""
    w = Window.partitionBy("label").orderBy("ticker")
    return catalogue.join(groups, "ticker", "left").withColumn("label", F.coalesce("label", F.lit("Other"))).withColumn("place", F.row_number().over(w)).select("label", "place", "ticker")


def grouped_filter(catalogue: DataFrame, groups: DataFrame, text: str) -> DataFrame:
    """label, ticker of what is in a group and holds the text in its ticker or in the group's label, in any case; all for an empty text."""
    t = text.strip().lower()
    j = catalogue.join(groups, "ticker").select("label", "ticker")
    return j if not t else j.where(F.lower("ticker").contains(t) | F.lower("label").contains(t))


def visible(catalogue: DataFrame, text: str, exchange: str | None) -> DataFrame:
    """One row: how many tickers the dashboard's filter leaves."""
    return filtered(catalogue, text, exchange).agg(F.count("*").alias("visible"))


def wanted(asked: Column, watched: Column, preferred: Column, exchanges_: Column) -> Column:
    """Tickers that a signal request is for: those asked for, else the watched ones on preferred exchanges (US where none is known), else all watched. exchanges_ is a map from ticker to exchange."""
    own = F.filter(watched, lambda t: F.array_contains(preferred, F.coalesce(F.try_element_at(exchanges_, t), F.lit("US"))))
    asked = parsed(F.coalesce(asked, F.lit("")))
    return F.array_sort(F.array_distinct(F.when(F.size(asked) > 0, asked).when(F.size(own) > 0, own).otherwise(watched)))


def on_exchange(watched: Column, listed: Column) -> Column:
    """The watched tickers that an exchange lists, sorted and once each."""
    return F.array_sort(F.array_intersect(watched, listed))


def replaced(wanted_: Column, valid: Column, cap: int = 50) -> Column:
    """struct(watchlist, code): a new watch list; refused if nothing valid is left or more than cap are."""
    kept = F.filter(F.transform(wanted_, F.upper), lambda x: F.array_contains(valid, x))
    code = F.when(F.size(kept) == 0, "no_valid").when(F.size(kept) > cap, "too_many").otherwise("ok")
    return F.struct(F.when(code == "ok", kept).alias("watchlist"), code.alias("code"))


def add_code(watched: Column, ticker: Column, tracked: Column, cap: int = 50) -> Column:
    return F.when(~F.array_contains(tracked, ticker), "not_tracked").when(F.array_contains(watched, ticker), "present").when(F.size(watched) >= cap, "full").otherwise("added")


def remove_code(watched: Column, ticker: Column) -> Column:
    return F.when(~F.array_contains(watched, ticker), "absent").when(F.size(F.array_remove(watched, ticker)) == 0, "last").otherwise("removed")


def preferences(rows: DataFrame, zones: tuple[str, ...]) -> DataFrame:
    """user_id, preferred_exchanges, user_timezone, code after the updates in new_exchanges and new_timezone (null: not given). The exchanges are upper-cased and known ones kept; without any, or with a zone that isn't known, nothing changes."""
    known = F.array(*(F.lit(e[0]) for e in EXCHANGES))
    kept = F.filter(F.transform("new_exchanges", F.upper), lambda x: F.array_contains(known, x))
    code = F.when(F.col("new_exchanges").isNotNull() & (F.size(kept) == 0), "no_exchange").when(F.col("new_timezone").isNotNull() & ~time_zone(F.col("new_timezone"), zones), "bad_timezone").otherwise("ok")
    new = lambda value, old: F.when(F.col("code") == "ok", F.coalesce(value, F.col(old))).otherwise(F.col(old)).alias(old)
    return rows.withColumn("code", code).select("user_id", new(kept, "preferred_exchanges"), new(F.col("new_timezone"), "user_timezone"), "code")


def age_label(seconds: Column) -> Column:
    """How old a snapshot is: seconds under a minute, else minutes and seconds."""
    s = F.round(seconds).cast("long")
    return F.when(s < 60, F.format_string("(%ds ago)", s)).otherwise(F.format_string("(%dm %ds ago)", F.floor(s / 60), s % 60))


def only_valid(wanted: Column, valid: Column, cap: int = 50) -> Column:
    """Upper-cased members that are valid, in order and with repeats, the first cap."""
    return F.slice(F.filter(F.transform(wanted, lambda x: F.upper(F.trim(x))), lambda x: F.array_contains(valid, x)), 1, cap)


def added(watched: Column, ticker: Column, cap: int = 50) -> Column:
    return F.when(F.array_contains(watched, ticker) | (F.size(watched) >= cap), watched).otherwise(F.concat(watched, F.array(ticker)))


def removed(watched: Column, ticker: Column) -> Column:
    """The list without the ticker; a list that would be empty stays as it is."""
    rest = F.array_remove(watched, ticker)
    return F.when(F.size(rest) == 0, watched).otherwise(rest)


def parsed(query: Column) -> Column:
    """A comma-separated list, trimmed, upper-cased, without empty parts."""
    return F.filter(F.transform(F.split(query, ","), lambda x: F.upper(F.trim(x))), lambda x: x != "")


def scopes_ok(scopes: Column, allowed: tuple[str, ...]) -> Column:
    return F.size(F.array_except(scopes, F.array(*map(F.lit, allowed)))) == 0
