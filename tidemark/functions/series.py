"""Functions of one series of closes, given as an array in time order. Recurrences are folds that stay in the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edge(x: Column, digits: int) -> Column:
    """Rounded for output, as a decimal: what binary numbers leave beyond nine places is taken off, then halves go to the even side, below zero too. Not a number, infinite and what 29 digits don't hold is rounded as it is."""
    return F.coalesce(F.bround(decimal(x), digits).cast("double"), F.round(x, digits))


def decimal(x: Column) -> Column:
    """x with nine decimal places, of which sums are exact; null if it can't be held."""
    return x.try_cast("decimal(38,9)")


def closes(bars: DataFrame, key: str = "asset") -> DataFrame:
    """One row for each asset with its closes in time order (nulls left out)."""
    rows = F.array_sort(F.collect_list(F.struct("d", "close")))
    return bars.where("close is not null").groupBy(key).agg(F.transform(rows, lambda r: r["close"]).alias("closes"))


def differences(c: Column) -> Column:
    return F.zip_with(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), lambda a, b: a - b)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def wilder_rsi(c: Column, period: int = 14) -> Column:
    """Wilder's RSI: 50 under 3 * period closes; 100 where there are no losses."""
    d = differences(c)
    up, down = lambda x: F.greatest(x, F.lit(0.0)), lambda x: F.greatest(-x, F.lit(0.0))
    first = F.slice(d, 1, period)
    start = F.struct((total(F.transform(first, up)) / period).alias("g"), (total(F.transform(first, down)) / period).alias("l"))
    step = lambda s, x: F.struct(((s["g"] * (period - 1) + up(x)) / period).alias("g"), ((s["l"] * (period - 1) + down(x)) / period).alias("l"))
    rsi = F.aggregate(F.slice(d, period + 1, F.greatest(F.size(d) - period, F.lit(0))), start, step, lambda s: F.when(s["l"] < 1e-10, 100.0).otherwise(100.0 - 100.0 / (1.0 + s["g"] / F.greatest(s["l"], F.lit(1e-300)))))
    return F.when(F.size(c) < 3 * period, 50.0).otherwise(rsi)


def ema(values: Column, span: int) -> Column:
    """The last value of the exponential mean that starts at the first value."""
    a = 2.0 / (span + 1)
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, 0), lambda s, x: F.lit(a) * x + F.lit(1 - a) * s)


def macd_histogram(c: Column, fast: int = 12, slow: int = 26, signal: int = 9) -> Column:
    """MACD line less its signal line at the end, in one fold; 0 under slow + signal closes."""
    f, s, g = (2.0 / (n + 1) for n in (fast, slow, signal))
    zero = F.lit(0.0)

    def step(acc: Column, x: Column) -> Column:
        a, b = F.lit(f) * x + F.lit(1 - f) * acc["a"], F.lit(s) * x + F.lit(1 - s) * acc["b"]
        return F.struct(a.alias("a"), b.alias("b"), (F.lit(g) * (a - b) + F.lit(1 - g) * acc["s"]).alias("s"))

    start = F.struct(F.get(c, 0).alias("a"), F.get(c, 0).alias("b"), zero.alias("s"))
    folded = F.aggregate(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), start, step, lambda z: z["a"] - z["b"] - z["s"])
    return F.when(F.size(c) < slow + signal, 0.0).otherwise(folded)


def momentum(c: Column, lookback: int = 20) -> Column:
    n = F.size(c)
    return F.when(n <= lookback, 0.0).otherwise(F.get(c, n - 1) / F.get(c, n - 1 - lookback) - 1.0)


def bollinger_width(c: Column, window: int = 20) -> Column:
    """4 * sample deviation / mean of the last closes; 0 if there are too few or the mean is about 0."""
    tail = F.slice(c, F.greatest(F.size(c) - window + 1, F.lit(1)), window)
    mean = total(tail) / window
    spread = F.aggregate(tail, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean))
    return F.when((F.size(c) < window) | (mean < 1e-10), 0.0).otherwise(4.0 * F.sqrt(spread / (window - 1)) / F.greatest(mean, F.lit(1e-300)))


def features_of(series: DataFrame) -> DataFrame:
    """asset, n, last_price, rsi, macd_histogram, momentum, bb_width of series (asset, closes)."""
    c = F.col("closes")
    return series.select("asset", F.size(c).alias("n"), F.get(c, F.size(c) - 1).alias("last_price"), wilder_rsi(c).alias("rsi"), macd_histogram(c).alias("macd_histogram"), momentum(c).alias("momentum"), bollinger_width(c).alias("bb_width"))


def features(bars: DataFrame) -> DataFrame:
    """The features of bars: one shuffle by asset."""
    return features_of(closes(bars))


def tails_of(series: DataFrame, k: int = 20) -> DataFrame:
    """(asset, k, ret): the last k returns of series (asset, closes), k = 1 the newest; 0 where the price before is 0."""
    c, n = F.col("closes"), F.size("closes")
    ret = lambda i: F.coalesce(F.try_divide(F.get(c, n - i) - F.get(c, n - i - 1), F.get(c, n - i - 1)), F.lit(0.0))
    at = F.filter(F.sequence(F.lit(1), F.lit(k)), lambda i: i < n)
    return series.select("asset", F.explode(F.transform(at, lambda i: F.struct(i.alias("k"), ret(i).alias("ret")))).alias("r")).select("asset", "r.k", "r.ret")
