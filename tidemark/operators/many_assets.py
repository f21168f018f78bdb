"""Correlation and the optimizer for many assets: the same figures as `signals.coupling` and `signals.spins`, without one row or twenty keys for all of them.

The correlation matrix is made by tiles: assets are dealt into groups, and each pair of groups is one small product of matrices, in a task of its own.

The optimizer needs no matrix at all. With z the centred returns of an asset over their norm, the correlation of two assets is z_i z_j, so the pull on an asset is (z_i W - |z_i|^2 x_i) / n with W = sum of z_j x_j: one vector
as long as the tail (20). A step is a sum over all assets, of which each task gives its part, and an update of each asset by itself. Tasks replay the steps since the state was last written, so the driver holds some vectors of 20 numbers and
a lost executor costs at most `save_every` steps of its assets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import series
from ..work import work_path
from . import signals

#: From so many assets on, `compute` takes the ways of this module.
MANY = 500


def coupling_in_tiles(returns: DataFrame, tile: int = 500) -> DataFrame:
    """(i, j, v) as signals.coupling gives it. tile: about how many assets a group holds; each asset is sent once to each pair that its group is in."""
    mean = F.avg("ret").alias("mean")
    rows = returns.groupBy("asset").agg(mean, F.map_from_entries(F.collect_list(F.struct("k", "ret"))).alias("tail"))
    n = rows.count()
    groups = max(1, -(-n // tile))
    own = F.pmod(F.xxhash64("asset"), F.lit(groups)).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt = dealt.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")}).drop("other")
    name = returns.schema["asset"].dataType.simpleString()

    def product(rows: pd.DataFrame) -> pd.DataFrame:
        a = rows["a"].iloc[0]
        left, right = rows[rows["own"] == a], rows[rows["own"] == rows["b"].iloc[0]]
        ks = sorted({k for t in rows["tail"] for k in dict(t)})

        def matrix(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
            tails = [dict(t) for t in part["tail"]]
            seen = np.array([[k in t for k in ks] for t in tails], float).reshape(len(part), len(ks))
            x = np.array([[t.get(k, m) - m for k in ks] for t, m in zip(tails, part["mean"])], float).reshape(len(part), len(ks))
            return x, seen

        (x, p), (y, q) = matrix(left), matrix(right)
        both = np.sqrt(((x * x) @ q.T) * (p @ (y * y).T))
        met = (p @ q.T) > 0  # assets meet where both have a return of that place
        with np.errstate(divide="ignore", invalid="ignore"):
            v = np.where(both > 0, (x @ y.T) / both, 0.0) / n
        i, j = (s.to_numpy() for s in (left["asset"], right["asset"]))
        v[i[:, None] == j[None, :]] = 0.0
        at, to = np.nonzero(met)
        out = pd.DataFrame({"i": i[at], "j": j[to], "v": v[at, to]})
        mirrored = out.rename(columns={"i": "j", "j": "i"})[["i", "j", "v"]]
        return out if a == rows["b"].iloc[0] else pd.concat([out, mirrored])

    return dealt.groupBy("a", "b").applyInPandas(product, f"i {name}, j {name}, v double")


def factors(returns: DataFrame, tail: int = 20) -> DataFrame:
    """(asset, z): the centred tail returns over their norm, zeros where they don't vary. Tails have to be whole."""
    r = F.transform(F.array_sort(F.collect_list(F.struct("k", "ret"))), lambda s: s["ret"])
    rows = returns.groupBy("asset").agg(r.alias("r")).where(F.size("r") == tail)
    mean = F.aggregate("r", F.lit(0.0), lambda s, x: s + x) / tail
    rows = rows.withColumn("mean", mean).select("asset", F.transform("r", lambda x: x - F.col("mean")).alias("c"))
    norm = F.sqrt(F.aggregate("c", F.lit(0.0), lambda s, x: s + x * x))
    return rows.withColumn("norm", norm).select("asset", F.transform("c", lambda x: F.coalesce(F.try_divide(x, F.col("norm")), F.lit(0.0))).alias("z"))


def spins_by_factors(z: DataFrame, h: DataFrame, steps: int = 200, dt: float = 0.05, strength: float = 0.5, save_every: int = 25, gathered: int = 100_000) -> DataFrame:
    """(asset, spin) as signals.spins gives it for the coupling of factors z(asset, z) and fields h(asset, h). Up to `gathered` assets (their factors are 16 MB then) one task takes all steps; more are stepped where they lie, with a job for each step."""
    bounded = F.greatest(F.least(F.lit(0.05) * F.col("h"), F.lit(0.05)), F.lit(-0.05))
    state = _kept(z.join(h, "asset").select("asset", "z", "h", bounded.alias("x"), F.lit(0.0).alias("y")), "spins")
    n, wide = state.count(), state.schema
    if n <= gathered:
        return state.coalesce(1).mapInArrow(_all_steps(steps, dt, strength), wide).select("asset", F.col("x").alias("spin"))
    for begin in range(0, steps, save_every):
        sums: list[np.ndarray] = []
        for _ in range(begin, min(begin + save_every, steps)):
            parts = state.mapInArrow(_replayed(sums, begin, n, steps, dt, strength, True), "place int, total double")
            total = parts.toPandas().groupby("place")["total"].sum()  # a vector as long as the tail from each task
            sums.append(total.sort_index().to_numpy())
        state = _kept(state.mapInArrow(_replayed(sums, begin, n, steps, dt, strength, False), wide), "spins")
    return state.select("asset", F.col("x").alias("spin"))


def _all_steps(steps: int, dt: float, strength: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if len(b)]
        if not rows:
            return
        batch = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        z, x0 = np.stack(batch.column(1).to_numpy(zero_copy_only=False)), batch.column(3).to_numpy()
        step, x, y = _stepped(z, batch.column(2).to_numpy(), len(batch), steps, dt, strength), x0, batch.column(4).to_numpy()
        for k in range(steps):
            x, y = step(k, x @ z, x, y)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(x), pa.array(y)], schema=batch.schema)

    return run


def _stepped(z: np.ndarray, h: np.ndarray, n: int, steps: int, dt: float, strength: float) -> Callable[..., tuple[np.ndarray, np.ndarray]]:
    """One step of some assets, given the sum over all: y moves by the old x, then x by y."""
    own = (z * z).sum(1)

    def step(k: int, w: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = y + dt * ((k / steps - 1.0) * x - x**3 + strength * (z @ w - own * x) / n + h)
        return np.clip(x + dt * y, -1.0, 1.0), y

    return step


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _replayed(sums: list[np.ndarray], begin: int, n: int, steps: int, dt: float, strength: float, partial: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Takes a task's assets through the steps whose sums are known; gives its part of the next sum, or the assets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not len(batch):
                continue
            z = np.stack(batch.column(1).to_numpy(zero_copy_only=False))
            h, x, y = (batch.column(i).to_numpy() for i in (2, 3, 4))
            step = _stepped(z, h, n, steps, dt, strength)
            for k, w in enumerate(sums):
                x, y = step(begin + k, w, x, y)
            if partial:
                part = x @ z
                total = part if total is None else total + part
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(x), pa.array(y)], schema=batch.schema)
        if partial and total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["place", "total"])

    return run


def compute(bars: DataFrame, least: int = 50, many: int = MANY) -> DataFrame:
    """signals.compute, by factors if there are many assets; the records are the same."""
    enough = series.closes(bars).where(F.size("closes") >= least)
    f = series.features_of(enough)
    if enough.count() < many:
        state = signals.spins(signals.coupling(series.tails_of(enough)), signals.field(f.select("asset", "momentum")))
    else:
        state = spins_by_factors(factors(series.tails_of(enough)), signals.field(f.select("asset", "momentum")))
    return signals.records(f, state)
