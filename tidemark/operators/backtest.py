"""Moving-average crossover backtests in window functions: each asset is one partition, and the position is a closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def by_day() -> WindowSpec:
    return Window.partitionBy("asset").orderBy("d")


def rolling_mean(bars: DataFrame, window: int, name: str) -> DataFrame:
    w = by_day().rowsBetween(1 - window, 0)
    return bars.withColumn(name, F.when(F.count("close").over(w) == window, F.avg("close").over(w)))


def crossings(bars: DataFrame, fast: int, slow: int) -> DataFrame:
    """asset, d, i (from 0), close, above, up: whether the fast mean is over the slow one, and whether it came to be so on this bar; from bar `slow` on."""
    b = rolling_mean(rolling_mean(bars, fast, "f"), slow, "s").withColumn("i", F.row_number().over(by_day()) - 1)
    b = b.withColumn("above", F.coalesce(F.col("f") > F.col("s"), F.lit(False)))
    b = b.withColumn("up", F.col("above") & ~F.coalesce(F.lag("above").over(by_day()), F.lit(False)))
    return b.where(F.col("i") >= slow).select("asset", "d", "i", "close", "above", "up")


def curve(bars: DataFrame, fast: int = 20, slow: int = 50, capital: float = 100_000.0) -> DataFrame:
    """asset, i, close, up, held, trip, equity: held after a bar if above and an up came before or on it; equity grows by the closes' ratio over bars that were entered held."""
    run = by_day().rowsBetween(Window.unboundedPreceding, 0)
    c = crossings(bars, fast, slow).withColumn("trip", F.sum(F.col("up").cast("int")).over(run)).withColumn("held", F.col("above") & (F.col("trip") > 0))
    before = F.coalesce(F.lag("held").over(by_day()), F.lit(False))
    ratio = F.when(before, F.col("close") / F.lag("close").over(by_day())).otherwise(1.0)
    return c.withColumn("before", before).withColumn("step", F.ln(ratio)).withColumn("equity", F.lit(capital) * F.exp(F.sum("step").over(run)))


def report(bars: DataFrame, fast: int = 20, slow: int = 50, capital: float = 100_000.0) -> DataFrame:
    """One row for each asset with more than slow + 2 bars: final equity, return, Sharpe ratio, drawdown, win rate, trades (an open one is closed at the last close)."""
    enough = bars.withColumn("_n", F.count("*").over(Window.partitionBy("asset"))).where(F.col("_n") > slow + 2).drop("_n")
    c = curve(enough, fast, slow, capital)
    prev = F.lag("equity").over(by_day())
    peak = F.greatest(F.lit(capital), F.max("equity").over(by_day().rowsBetween(Window.unboundedPreceding, 0)))
    c = c.withColumn("ret", (F.col("equity") - prev) / F.greatest(prev, F.lit(1e-9))).withColumn("dd", (peak - F.col("equity")) / peak)
    stats = c.groupBy("asset").agg(F.max_by("equity", "i").alias("final"), F.avg("ret").alias("mean"), F.coalesce(F.stddev_samp("ret"), F.lit(0.0)).alias("sd"), F.count("ret").alias("n"), F.max("dd").alias("dd"))
    trips = c.where("trip > 0 and (held or before)").groupBy("asset", F.col("trip").alias("t")).agg(F.min_by("close", "i").alias("entry"), F.max_by("close", "i").alias("exit"))
    wins = trips.groupBy("asset").agg(F.count_if(F.col("exit") > F.col("entry")).alias("wins"), F.count("*").alias("closed"))
    j = stats.join(wins, "asset", "left").na.fill(0, ["wins", "closed"])
    return j.select("asset", F.round("final", 2).alias("final_capital"), F.round(F.col("final") / capital - 1, 4).alias("total_return"), F.when(F.col("n") < 2, 0.0).otherwise(F.round(F.col("mean") / (F.col("sd") + 1e-9) * F.sqrt(F.lit(252.0)), 3)).alias("sharpe_ratio"), F.round("dd", 4).alias("max_drawdown"), F.round(F.col("wins") / F.greatest(F.col("closed"), F.lit(1)), 3).alias("win_rate"), (2 * F.col("closed")).alias("total_trades"))


def sampled(points: DataFrame, most: int = 100) -> DataFrame:
    """Every max(1, n // most)-th point from the first."""
    w = Window.partitionBy("asset")
    place = F.row_number().over(by_day()) - 1
    stride = F.greatest(F.lit(1), F.floor(F.count("*").over(w) / most).cast("int"))
    return points.withColumn("_p", place).withColumn("_s", stride).where("_p % _s = 0").drop("_p", "_s")


def last_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    """The newest n runs of each user."""
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("run_id"))
    return runs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
