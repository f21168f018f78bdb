"""Tiles and factors against the one-row forms, and many assets against the dense loop in numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import many_assets, signals


def tails(spark, n, k=20, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(0, 0.02, (n, k))
    x[0] = 0.01  # a price that never varies
    rows = [(f"a{i:05d}", j + 1, float(x[i, j])) for i in range(n) for j in range(k)]
    return x, spark.createDataFrame(rows, "asset string, k int, ret double")


@pytest.mark.parametrize("tile", [3, 7, 500])
def test_tiles_equal_pairs(spark, tile):
    _, returns = tails(spark, 25)
    returns = returns.where("asset <> 'a00003' or k < 12")  # a short tail
    want = {(r["i"], r["j"]): r["v"] for r in signals.coupling(returns).collect()}
    got = {(r["i"], r["j"]): r["v"] for r in many_assets.coupling_in_tiles(returns, tile).collect()}
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p], abs=1e-12) for p in want)


@pytest.mark.parametrize("gathered", [0, 100])
def test_factors_equal_the_matrix(spark, gathered):
    _, returns = tails(spark, 25)
    h = spark.createDataFrame([(f"a{i:05d}", (i - 12) / 12) for i in range(25)], "asset string, h double")
    want = {r["asset"]: r["spin"] for r in signals.spins(signals.coupling(returns), h, steps=60).collect()}
    got = {r["asset"]: r["spin"] for r in many_assets.spins_by_factors(many_assets.factors(returns), h, steps=60, save_every=25, gathered=gathered).collect()}
    assert got == {a: pytest.approx(v, abs=1e-9) for a, v in want.items()} and len(got) == 25


def test_ten_thousand_assets(spark):
    """Against a loop over the whole matrix."""
    n, steps = 10_000, 12
    r = np.random.default_rng(2)
    x = r.normal(0, 0.02, (n, 20))
    returns = spark.createDataFrame(pd.DataFrame({"asset": np.repeat(np.arange(n), 20), "k": np.tile(np.arange(1, 21), n), "ret": x.ravel()})).withColumn("k", F.col("k").cast("int"))
    h = spark.range(n).select(F.col("id").alias("asset"), (F.sin("id") / 2).alias("h"))
    got = dict(map(tuple, many_assets.spins_by_factors(many_assets.factors(returns), h, steps=steps, save_every=5, gathered=0).collect()))
    c = x - x.mean(1, keepdims=True)
    z = (c / np.sqrt((c * c).sum(1, keepdims=True))).astype(np.float32)
    field, s, y = np.sin(np.arange(n)) / 2, None, np.zeros(n)
    s = np.clip(0.05 * field, -0.05, 0.05)
    j = z @ z.T
    np.fill_diagonal(j, 0.0)
    for k in range(steps):
        y = y + 0.05 * ((k / steps - 1) * s - s**3 + 0.5 * (j @ s.astype(np.float32)) / n + field)
        s = np.clip(s + 0.05 * y, -1, 1)
    assert len(got) == n and max(abs(got[i] - s[i]) for i in range(n)) < 1e-4


def test_records_are_the_same(spark):
    bars = spark.createDataFrame([(a, f"2024-{1 + i // 28:02d}-{1 + i % 28:02d}", 100.0 + (i * (7 + j) + j * 3) % 11) for j, a in enumerate("ABCDEF") for i in range(60)], "asset string, d string, close double")
    want, got = ({r["asset"]: tuple(r)[1:] for r in rows.collect()} for rows in (signals.compute(bars), many_assets.compute(bars, many=1)))
    assert got == want and len(got) == 6
