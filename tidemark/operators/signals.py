"""Signals: tail returns, correlation, the optimizer's spins, scores and their filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series


def tail_returns(bars: DataFrame, k: int = 20) -> DataFrame:
    """(asset, k, ret): the last k returns of each asset, k = 1 the newest; 0 where the price before is 0. Assets meet by k, not by date."""
    by = Window.partitionBy("asset")
    prev = F.lag("close").over(by.orderBy("d"))
    rows = bars.select("asset", "d", "close", prev.alias("prev"), F.row_number().over(by.orderBy(F.desc("d"))).cast("int").alias("k"))
    return rows.where((F.col("k") <= k) & F.col("prev").isNotNull()).select("asset", "k", F.coalesce(F.try_divide(F.col("close") - F.col("prev"), F.col("prev")), F.lit(0.0)).alias("ret"))


def min_history(bars: DataFrame, least: int = 50) -> DataFrame:
    """Bars of assets with enough of them."""
    return bars.withColumn("_n", F.count("*").over(Window.partitionBy("asset"))).where(F.col("_n") >= least).drop("_n")


def coupling(returns: DataFrame) -> DataFrame:
    """(i, j, v): Pearson's correlation of the tail returns over the number of assets; 0 on the diagonal and where it isn't defined. Written as sums, for ANSI mode raises on zero variance."""
    a, b = returns.select(F.col("asset").alias("i"), "k", F.col("ret").alias("x")), returns.select(F.col("asset").alias("j"), "k", F.col("ret").alias("y"))
    stats = returns.groupBy("asset").agg(F.avg("ret").alias("mean"))
    centred = lambda df, key, value: df.join(stats.select(F.col("asset").alias(key), "mean"), key).withColumn(value, F.col(value) - F.col("mean")).drop("mean")
    a, b = centred(a, "i", "x"), centred(b, "j", "y")
    half = a.join(b, "k").where("i <= j").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    mirrored = F.explode(F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))))
    pairs = half.select(mirrored.alias("p"), "xy", "xx", "yy").select("p.i", "p.j", "xy", "xx", "yy")
    r = F.coalesce(F.try_divide("xy", F.sqrt(F.col("xx") * F.col("yy"))), F.lit(0.0))
    n = stats.agg(F.count("*").alias("n"))
    return pairs.join(F.broadcast(n)).select("i", "j", F.when(F.col("i") == F.col("j"), 0.0).otherwise(r / F.col("n")).alias("v"))  # n is one row


def field(momenta: DataFrame, clip: float = 3.0, scale: float = 0.35) -> DataFrame:
    """(asset, h): z-scores of momentum over all assets, clipped and scaled. The two figures of all assets are one row."""
    all_ = momenta.agg(F.avg("momentum").alias("mean"), F.greatest(F.coalesce(F.stddev_samp("momentum"), F.lit(1e-9)), F.lit(1e-9)).alias("sd"))
    z = (F.col("momentum") - F.col("mean")) / F.col("sd")
    return momenta.join(F.broadcast(all_)).select("asset", (F.greatest(F.least(z, F.lit(clip)), F.lit(-clip)) * scale).alias("h"))


def spins(j: DataFrame, h: DataFrame, steps: int = 200, dt: float = 0.05, strength: float = 0.5) -> DataFrame:
    """(asset, spin): the optimizer's end state. The matrix of all assets is one row, and each step moves all of y by the old x, then all of x. Meant for hundreds of assets."""
    rows = j.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda s: s["v"]).alias("row"))
    one = rows.join(h, F.col("i") == h.asset).agg(F.array_sort(F.collect_list(F.struct(F.col("i").alias("asset"), "row", "h"))).alias("m"))
    bounded = lambda x, m: F.greatest(F.least(x, F.lit(m)), F.lit(-m))
    index = F.sequence(F.lit(0), F.size("m") - 1)

    def step(state: Column, k: Column) -> Column:
        a = k.cast("double") / float(steps)

        def force(i: Column) -> Column:
            x, y, own = F.get(state["x"], i), F.get(state["y"], i), F.get(F.col("m"), i)
            pull = F.aggregate(F.zip_with(own["row"], state["x"], lambda v, z: v * z), F.lit(0.0), lambda s, v: s + v)
            return y + F.lit(dt) * ((a - 1.0) * x - x * x * x + F.lit(strength) * pull + own["h"])

        ys = F.transform(index, force)
        return F.transform(F.array(ys), lambda y: F.struct(F.zip_with(state["x"], y, lambda p, v: bounded(p + F.lit(dt) * v, 1.0)).alias("x"), y.alias("y")))[0]

    start = F.struct(F.transform("m", lambda s: bounded(F.lit(0.05) * s["h"], 0.05)).alias("x"), F.transform("m", lambda s: F.lit(0.0)).alias("y"))
    final = F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), start, step, lambda s: s["x"])
    done = one.where(F.size("m") > 0).select("m", final.alias("x"))
    return done.select(F.explode(F.arrays_zip(F.transform("m", lambda s: s["asset"]).alias("asset"), F.col("x").alias("spin"))).alias("s")).select("s.asset", "s.spin")


def score(spin: Column, rsi: Column) -> Column:
    """struct(signal_type, confidence): the type ignores the penalty for overbought and oversold."""
    penalty = F.when(((spin > 0) & (rsi > 70)) | ((spin < 0) & (rsi < 30)), 0.25).otherwise(0.0)
    kind = F.when(spin > 0.15, "BUY").when(spin < -0.15, "SELL").otherwise("HOLD")
    return F.struct(kind.alias("signal_type"), F.greatest(F.least(F.abs(spin) - penalty, F.lit(1.0)), F.lit(0.0)).alias("confidence"))


def compute(bars: DataFrame, least: int = 50) -> DataFrame:
    """The whole pipeline: a record for each asset with enough history."""
    enough = series.closes(bars).where(F.size("closes") >= least)
    f = series.features_of(enough)
    state = spins(coupling(series.tails_of(enough)), field(f.select("asset", "momentum")))
    return records(f, state)


def records(f: DataFrame, state: DataFrame) -> DataFrame:
    """The records of assets with their features and spins."""
    s = f.join(state, "asset").withColumn("s", score(F.col("spin"), F.col("rsi")))
    return s.select("asset", F.col("s.signal_type").alias("signal_type"), F.round("s.confidence", 4).alias("confidence"), F.round("spin", 4).alias("spin"), F.round("last_price", 2).alias("last_price"), F.round("rsi", 4).alias("rsi"), F.round("macd_histogram", 4).alias("macd_histogram"), F.round("momentum", 4).alias("momentum"), F.round("bb_width", 4).alias("bb_width"), F.lit(200).alias("sba_iterations"))


def single(bars: DataFrame, least: int = 50) -> DataFrame:
    """The proxy for single assets: the spin is tanh(5 * momentum), no other asset is looked at."""
    f = series.features(min_history(bars, least)).withColumn("spin", F.tanh(5.0 * F.col("momentum")))
    return f.withColumn("s", score(F.col("spin"), F.col("rsi"))).select("asset", F.col("s.signal_type").alias("signal_type"), F.round("s.confidence", 4).alias("confidence"), F.round("spin", 4).alias("spin"))


def single_of(bars: DataFrame, ticker: str, least: int = 50, normal: Callable[[str], str] = str.upper) -> DataFrame:
    """The signal of one ticker from its own bars: an equality on the normalised name that reaches the scan."""
    return single(bars.where(F.col("asset") == normal(ticker.strip())), least)


def watched(signals: DataFrame, watchlist: DataFrame) -> DataFrame:
    """(user_id, signal...) of the assets that each user watches; watchlist has user_id, asset, preferred. If no watched asset is preferred, the whole list holds."""
    w = Window.partitionBy("user_id")
    kept = watchlist.withColumn("_any", F.max(F.col("preferred").cast("int")).over(w)).where((F.col("_any") == 0) | F.col("preferred")).select("user_id", "asset")
    return kept.join(signals, "asset")


def flips(history: DataFrame) -> DataFrame:
    """Rows whose signal type differs from the asset's one before."""
    prev = F.lag("signal_type").over(Window.partitionBy("asset").orderBy("d"))
    return history.withColumn("previous", prev).where("previous is not null and previous <> signal_type")
