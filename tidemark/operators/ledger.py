"""The ledger: filled trades folded into positions, cash, equity curves and risk figures. Trades are ordered by (filled_at, trade_id)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import decimal, edge
from ..work import work_path
from .orders import text_of
from .scans import at_places, cut, kept, looked_up, running, same

START = 100_000.0


#: Trades of one book that are folded in one row; longer books are cut in blocks of as many.
BLOCK_ROWS = 100_000
BOOK = ["user_id", "asset"]


def book(trades: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(user_id, asset, quantity, cost, realized, wins, closed): the average-cost fold of each book. A sell closes at most what is held; each sell while something is held is a closed trade. Books of more than block_rows trades are folded in blocks."""
    rows = trades.where("status = 'FILLED'").select("user_id", "asset", "filled_at", "trade_id", F.col("side").alias("s"), F.col("quantity").cast("double").alias("x"), F.coalesce(F.col("filled_price"), F.lit(0.0)).alias("p"))
    long_ = rows.groupBy(*BOOK).agg(F.count("*").alias("n")).where(F.col("n") > block_rows).select(*BOOK)
    if long_.isEmpty():
        return _named(_whole(rows))
    return _named(_whole(rows.join(long_, BOOK, "left_anti")).unionByName(_in_blocks(rows.join(long_, BOOK, "left_semi"), block_rows)))


def _named(folded: DataFrame) -> DataFrame:
    return folded.select(*BOOK, F.col("z.q").alias("quantity"), F.col("z.c").alias("cost"), F.col("z.r").alias("realized"), F.col("z.w").alias("wins"), F.col("z.n").alias("closed"))


def _step(a: Column, t: Column) -> Column:
    zero = F.lit(0.0)
    avg = F.when(a["q"] > 0, a["c"] / F.greatest(a["q"], F.lit(1e-300))).otherwise(0.0)
    sold = F.least(t["x"], a["q"])
    rest = a["q"] - sold
    bought = F.struct((a["q"] + t["x"]).alias("q"), (a["c"] + t["x"] * t["p"]).alias("c"), a["r"].alias("r"), a["w"].alias("w"), a["n"].alias("n"))
    held = a["q"] > 0
    after = F.struct(rest.alias("q"), (avg * F.greatest(rest, zero)).alias("c"), (a["r"] + (t["p"] - avg) * sold).alias("r"), (a["w"] + F.when(held & (t["p"] > avg), 1).otherwise(0)).alias("w"), (a["n"] + F.when(held, 1).otherwise(0)).alias("n"))
    return F.when(t["s"] == "buy", bought).otherwise(after)


def _fold(rows: Column, q: Column, c: Column) -> Column:
    return F.aggregate(rows, F.struct(q.alias("q"), c.alias("c"), F.lit(0.0).alias("r"), F.lit(0).alias("w"), F.lit(0).alias("n")), _step)


def _whole(rows: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    return rows.groupBy(*BOOK).agg(_fold(F.array_sort(F.collect_list(F.struct("filled_at", "trade_id", "s", "x", "p"))), zero, zero).alias("z"))


def _clamp(a: Column, t: Column) -> Column:
    """A block's effect on the quantity, q -> max(lo, q + add): such maps are closed under composition."""
    buy = t["s"] == "buy"
    return F.struct(F.when(buy, a["add"] + t["x"]).otherwise(a["add"] - t["x"]).alias("add"), F.when(buy, a["lo"] + t["x"]).otherwise(F.greatest(F.lit(0.0), a["lo"] - t["x"])).alias("lo"))


def _affine(a: Column, t: Column) -> Column:
    """A block's effect on the cost, c -> m * c + b, once the quantity at its start is known."""
    rest = a["q"] - F.least(t["x"], a["q"])
    share = F.when(a["q"] > 0, rest / F.greatest(a["q"], F.lit(1e-300))).otherwise(0.0)
    bought = F.struct((a["q"] + t["x"]).alias("q"), a["m"].alias("m"), (a["b"] + t["x"] * t["p"]).alias("b"))
    return F.when(t["s"] == "buy", bought).otherwise(F.struct(rest.alias("q"), (a["m"] * share).alias("m"), (a["b"] * share).alias("b")))


def _starts(blocks: DataFrame, step: Callable[[float, Any], float], name: str) -> DataFrame:
    """A value at the start of each block, from 0 at the first of a book: one row a block goes through one task a book."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, value, out = rows.sort_values("block"), 0.0, []
        for r in rows.itertuples():
            out.append(value)
            value = step(value, r)
        return rows[[*BOOK, "block"]].assign(**{name: out})

    kinds = ", ".join(f"{c} {blocks.schema[c].dataType.simpleString()}" for c in [*BOOK, "block"])
    return blocks.groupBy(*BOOK).applyInPandas(run, f"{kinds}, {name} double")


def _in_blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """The fold of long books. Trades are sorted by ranges of (book, time), so a book lies in many tasks, and cut into blocks by their place in that order. Three passes over the blocks: what each does to the quantity, what to
    the cost, and the fold proper from the state at its start. Between them only one row a block is gathered by book."""
    spark, key = rows.sparkSession, [*BOOK, "block"]

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = work_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    placed = kept(rows.orderBy(*BOOK, "filled_at", "trade_id").withColumn("row", F.monotonically_increasing_id()), "books")
    cut = placed.withColumn("block", F.floor(F.col("row") / block_rows)).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("row", "s", "x", "p"))).alias("rows"))
    cut = kept(cut, "book-blocks")
    clamps = cut.select(*key, F.aggregate("rows", F.struct(F.lit(0.0).alias("add"), F.lit(float("-inf")).alias("lo")), _clamp).alias("z")).select(*key, "z.add", "z.lo")
    with_q = cut.join(_starts(clamps, lambda q, r: max(r.lo, q + r.add), "q"), key)
    lines = with_q.select(*key, F.aggregate("rows", F.struct(F.col("q").alias("q"), F.lit(1.0).alias("m"), F.lit(0.0).alias("b")), _affine).alias("z")).select(*key, "z.m", "z.b")
    done = with_q.join(_starts(lines, lambda c, r: r.m * c + r.b, "c"), key).select(*key, _fold(F.col("rows"), F.col("q"), F.col("c")).alias("z"))
    total = F.struct(F.max_by("z.q", "block").alias("q"), F.max_by("z.c", "block").alias("c"), F.sum("z.r").alias("r"), F.sum("z.w").cast("int").alias("w"), F.sum("z.n").cast("int").alias("n"))
    return done.groupBy(*BOOK).agg(total.alias("z"))


def positions(trades: DataFrame) -> DataFrame:
    """Open positions; a book without quantity is left out, its realized result with it."""
    return book(trades).where("quantity > 0").select("user_id", "asset", F.round("quantity", 6).alias("quantity"), edge(F.col("cost") / F.col("quantity"), 4).alias("avg_entry_price"), edge(F.col("realized"), 2).alias("realized_pnl"))


def positions_pnl(trades: DataFrame, prices: DataFrame, default: float = 100.0) -> DataFrame:
    px = F.coalesce("price", F.lit(default))
    p = looked_up(positions(trades), prices, "asset").withColumn("px", px)
    return p.select("user_id", "asset", "quantity", "avg_entry_price", edge(F.col("px"), 4).alias("current_price"), edge(F.col("px") * F.col("quantity"), 2).alias("market_value"), edge((F.col("px") - F.col("avg_entry_price")) * F.col("quantity"), 2).alias("unrealized_pnl"), "realized_pnl")


def total_pnl(pnl: DataFrame) -> DataFrame:
    return pnl.groupBy("user_id").agg(edge(F.sum(decimal(F.col("unrealized_pnl")) + decimal(F.col("realized_pnl"))), 2).alias("total_pnl"), F.count("*").alias("n_positions"))


def signed(trades: DataFrame) -> DataFrame:
    x = F.when(F.col("side") == "buy", F.col("quantity")).otherwise(-F.col("quantity"))
    return trades.where("status = 'FILLED'").withColumn("x", x)


def cash(trades: DataFrame) -> DataFrame:
    """user_id, cash, cap: the account's cash, and 5 % of it (of 5,000 at least) as the limit of one order."""
    c = START - F.sum(F.col("x") * F.col("filled_price"))
    return signed(trades).groupBy("user_id").agg(c.alias("cash")).select("user_id", F.round("cash", 4).alias("cash"), F.round(F.greatest(F.lit(5000.0), F.col("cash")) * 0.05, 4).alias("cap"))


def equity_curve(trades: DataFrame, prices: DataFrame, start: float = START, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(user_id, seq, equity): the start and one point for each trade, cash plus holdings (never under 0) at the present price. A trade without a price moves no cash. Users of up to block_rows trades are two stacked windows, others are cut in blocks."""
    t = looked_up(signed(trades), prices, "asset").withColumns({"price": F.coalesce("price", F.lit(100.0)), "paid": F.col("x") * F.coalesce("filled_price", F.lit(0.0))}).select("user_id", "asset", "filled_at", "trade_id", "x", "paid", "price")
    long_ = t.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") > block_rows).select("user_id")
    points = _points(t, start) if long_.isEmpty() else _points(same(t, long_, ["user_id"], "left_anti"), start).unionByName(_points_in_blocks(same(t, long_, ["user_id"], "left_semi"), start, block_rows))
    return points.unionByName(points.select("user_id").distinct().select("user_id", F.lit(0).alias("seq"), F.lit(start).alias("equity")))


def _points(t: DataFrame, start: float) -> DataFrame:
    own, all_ = Window.partitionBy("user_id", "asset").orderBy("filled_at", "trade_id"), Window.partitionBy("user_id").orderBy("filled_at", "trade_id")
    run = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    value = F.greatest(F.lit(0.0), F.sum("x").over(run(own))) * F.col("price")
    t = t.withColumn("value", value).withColumn("delta", F.col("value") - F.lag("value", 1, 0.0).over(own))
    return t.select("user_id", F.row_number().over(all_).alias("seq"), (start - F.sum("paid").over(run(all_)) + F.sum("delta").over(run(all_))).alias("equity"))


def _points_in_blocks(t: DataFrame, start: float, block_rows: int) -> DataFrame:
    """The points of users with many trades: holdings, cash and places run within blocks of the user's trades, from what the blocks before leave."""
    worth = lambda q: F.greatest(F.lit(0.0), F.coalesce(q, F.lit(0.0))) * F.col("price")
    held = running(cut(t, ["user_id"], ["filled_at", "trade_id"], block_rows), ["user_id", "asset"], F.sum, F.col("x"), "q", "q0")
    last = F.lag(worth(F.col("q"))).over(Window.partitionBy("user_id", "asset", "block").orderBy("row"))
    moves = held.select("user_id", "block", "row", (worth(F.col("q")) - F.coalesce(last, worth(F.col("q0")))).alias("delta"), "paid")
    steps = kept(moves.withColumn("move", F.col("delta") - F.col("paid")).select("user_id", "block", "row", "move"), "moves")
    seq = running(running(steps, ["user_id"], F.sum, F.col("move"), "gain"), ["user_id"], F.sum, F.lit(1), "seq")
    return kept(seq.select("user_id", F.col("seq").cast("int").alias("seq"), (start + F.col("gain")).alias("equity")), "points")


def period_returns(curve: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(user_id, seq, ret): 0 where the point before is 0. Points are taken in blocks by seq; the last of a block also stands before the next."""
    block = F.floor(F.col("seq") / block_rows)
    both = F.when((F.col("seq") + 1) % block_rows == 0, F.array(block, block + 1)).otherwise(F.array(block))
    prev = F.lag("equity").over(Window.partitionBy("user_id", "block").orderBy("seq"))
    return curve.withColumn("block", F.explode(both)).withColumn("prev", prev).where("prev is not null").select("user_id", "seq", F.coalesce(F.try_divide(F.col("equity") - F.col("prev"), F.col("prev")), F.lit(0.0)).alias("ret"))


def max_drawdown(curve: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The largest fall from a peak, as a share of it; the peak runs on through blocks of points."""
    placed = curve.select("user_id", "equity", F.col("seq").alias("row"), F.floor(F.col("seq") / block_rows).alias("block"))
    peaked = running(placed, ["user_id"], F.max, F.col("equity"), "peak")
    return peaked.groupBy("user_id").agg(F.max(F.when(F.col("peak") > 0, (F.col("peak") - F.col("equity")) / F.col("peak")).otherwise(0.0)).alias("max_drawdown"))


def value_at_risk(returns: DataFrame, *levels: float) -> DataFrame:
    """Historical: the loss at 0-based place floor(p * n) of the ascending returns, 0 at least. Places are found by selection, so no user's returns are sorted or lie in one task."""
    found = at_places(returns, "user_id", "ret", levels)
    return found.groupBy("user_id").agg(*(F.greatest(F.lit(0.0), -F.max(F.when(F.col("level") == j, F.col("ret")))).alias(f"var_{round(100 - 100 * p)}") for j, p in enumerate(levels)))


def round_trips(trades: DataFrame) -> DataFrame:
    b = book(trades).groupBy("user_id").agg(F.sum("wins").cast("long").alias("wins"), F.sum("closed").cast("long").alias("closed"))
    return b.select("user_id", "wins", "closed", F.round(F.coalesce(F.try_divide("wins", "closed"), F.lit(0.0)), 3).alias("win_rate"))


def risk_metrics(trades: DataFrame, prices: DataFrame) -> DataFrame:
    """user_id, sharpe_ratio, max_drawdown, win_rate, total_trades, var_95, var_99; zeros but for the win rate and the count under two trades."""
    curve = kept(equity_curve(trades, prices), "curve")
    returns = period_returns(curve)
    stats = returns.groupBy("user_id").agg(F.count("*").alias("n"), F.avg("ret").alias("mean"), F.coalesce(F.stddev_samp("ret"), F.lit(0.0)).alias("sd"))
    counts = trades.where("status = 'FILLED'").groupBy("user_id").agg(F.count("*").alias("total_trades"))
    # One grouping instead of joins, each of which sorts both sides within the same task; no figure is null where a user has it.
    parts = (stats, counts, max_drawdown(curve), value_at_risk(returns, 0.05, 0.01), round_trips(trades).select("user_id", "win_rate"))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).where("user_id is not null")
    figures = [c for c in rows.columns if c != "user_id"]
    m = rows.groupBy("user_id").agg(*(F.max(c).alias(c) for c in figures)).na.drop(subset=figures)
    some = lambda c, digits: F.when(F.col("n") < 2, 0.0).otherwise(F.round(c, digits))
    return m.select("user_id", some(F.col("mean") / (F.col("sd") + 1e-9) * F.sqrt(F.lit(252.0)), 3).alias("sharpe_ratio"), some(F.col("max_drawdown"), 4).alias("max_drawdown"), "win_rate", "total_trades", some(F.col("var_95"), 4).alias("var_95"), some(F.col("var_99"), 4).alias("var_99"))


def scaled(curve: DataFrame) -> DataFrame:
    """The curve between its least (0) and largest (1) value."""
    ends = curve.groupBy("user_id").agg(F.min("equity").alias("low"), F.max("equity").alias("high"))
    width = F.when(F.col("high") == F.col("low"), 1.0).otherwise(F.col("high") - F.col("low"))
    return same(curve, ends, ["user_id"]).select("user_id", "seq", ((F.col("equity") - F.col("low")) / width).alias("scaled"))


def serialized(trades: DataFrame) -> DataFrame:
    """Rows for output: zero prices become null, the signature is cut, times are ISO text."""
    return trades.select("trade_id", "asset", "side", F.expr("nullif(filled_price, 0D)").alias("filled_price"), F.concat(F.left(F.sha2(F.col("trade_id").cast("string"), 256), F.lit(32)), F.lit("...")).alias("signature"), F.date_format("filled_at", "yyyy-MM-dd'T'HH:mm:ss").alias("filled_at"))


METRICS = ("sharpe_ratio", "max_drawdown", "win_rate", "total_trades", "var_95", "var_99")


def export_lines(pnl: DataFrame, metrics: DataFrame, user: int) -> DataFrame:
    """Lines of the CSV report of one user in order: header, positions (7 columns), metrics (3 columns); every value in quotes, numbers in plain form."""
    quoted = lambda *c: F.concat_ws(",", *(F.concat(F.lit('"'), x, F.lit('"')) for x in c))
    names = ("quantity", "avg_entry_price", "current_price", "market_value", "unrealized_pnl")
    spark = pnl.sparkSession
    head = spark.range(1).select(F.lit(0).alias("section_ord"), F.lit("").alias("k"), quoted(*map(F.lit, ("section", "asset", *names))).alias("line"))
    body = pnl.where(F.col("user_id") == user).select(F.lit(1).alias("section_ord"), F.col("asset").alias("k"), quoted(F.lit("position"), F.col("asset"), *(text_of(F.col(c)) for c in names)).alias("line"))
    texts = metrics.where(F.col("user_id") == user).select(*(F.col(c).cast("string").alias(c) if c == "total_trades" else text_of(F.col(c)).alias(c) for c in METRICS))
    long_ = texts.unpivot([], list(METRICS), "metric", "value")
    return head.unionByName(body).unionByName(long_.select(F.lit(2).alias("section_ord"), F.col("metric").alias("k"), quoted(F.lit("metric"), F.col("metric"), F.col("value")).alias("line")))


def traded_assets(trades: DataFrame) -> DataFrame:
    """user_id, assets, n_assets: the distinct assets of each user's filled trades, in order."""
    names = F.array_sort(F.collect_set("asset"))
    return trades.where("status = 'FILLED'").groupBy("user_id").agg(names.alias("assets")).withColumn("n_assets", F.size("assets"))


def asof_price(decisions: DataFrame, ticks: DataFrame, bucket: str = "1 day") -> DataFrame:
    """The newest tick of the asset at or before each decision's time: a union ordered by time and a running last value, so no pairs are made. Time is cut in buckets, so an asset isn't one task; the last tick of each bucket is carried into those after it."""
    d = decisions.select("asset", F.col("decided_at").alias("t"), F.lit(1).alias("o"), "decision_id", F.lit(None).cast("double").alias("px"))
    t = ticks.select("asset", F.col("filled_at").alias("t"), F.lit(0).alias("o"), F.lit(None).cast("long").alias("decision_id"), F.col("filled_price").alias("px"))
    rows = d.unionByName(t).withColumn("bucket", F.window("t", bucket)["start"])
    lasts = rows.groupBy("asset", "bucket").agg(F.max_by("px", F.when(F.col("px").isNotNull(), F.col("t"))).alias("px"))
    before = Window.partitionBy("asset").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row for each bucket
    carried = lasts.select("asset", "bucket", F.last("px", ignorenulls=True).over(before).alias("carried"))
    w = Window.partitionBy("asset", "bucket").orderBy("t", "o").rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("price", F.last("px", ignorenulls=True).over(w)).where("o = 1")
    return own.join(carried, ["asset", "bucket"], "left").select("decision_id", "asset", F.coalesce("price", "carried", F.lit(100.0)).alias("price"))
