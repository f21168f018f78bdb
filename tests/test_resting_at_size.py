"""Resting orders in large triggers: few calls to the state, packs of open orders, and no tick that tries all that wait."""

import random

import pandas as pd
import pytest

from tests.test_resting import loop, made
from tidemark.streaming import resting
from tidemark.streaming.runs import run_once


@pytest.mark.parametrize("seed, cuts, many", [(2, 4, 3), (3, 5, 0), (4, 6, 5)])
def test_open_orders_in_packs(spark, tmp_path, seed, cuts, many):
    """Triggers that leave more than `many` open orders store them in packs, others one by one; later triggers fill and cancel orders of both."""
    rows, path = made(seed), str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    want, still = loop(rows)
    size = -(-len(rows) // cuts)
    stream = resting.fills_once(spark.readStream.schema(resting.EVENTS).parquet(path), many=many)
    for k in range(cuts):
        part = rows[k * size : (k + 1) * size]
        random.Random(k).shuffle(part)
        again = [r for r in rows[: k * size] if r[2] == resting.ORDER and r[3] in still]  # open orders that come again
        spark.createDataFrame(part + again[:5], resting.EVENTS).coalesce(1).write.mode("append").parquet(path)
        got = run_once(stream, "t", str(tmp_path / "state"), str(tmp_path / "out")).collect()
    assert {g["order_id"]: (g["filled_at"], g["filled_price"]) for g in got} == want and len(got) == len(want)
    state = lambda name: spark.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "state"))
    alone = [r[0] for r in state("open").select("user_map_key.order_id").collect()]
    packed = [x for r in state("packs").select("user_map_value.order_id").collect() for x in r[0]]
    assert sorted(alone + packed) == sorted(still) and packed


class Kept:
    """A state variable in memory that counts the calls to it."""

    def __init__(self):
        self.rows, self.calls = {}, 0

    def _call(self, out):
        self.calls += 1
        return out

    exists = lambda self: self._call(bool(self.rows))
    iterator = lambda self: self._call(iter(list(self.rows.items())))
    containsKey = lambda self, key: self._call(key in self.rows)
    getValue = lambda self, key: self._call(self.rows.get(key))
    updateValue = lambda self, key, value: self._call(self.rows.__setitem__(key, value))
    removeKey = lambda self, key: self._call(self.rows.pop(key, None))
    get = lambda self: self._call(self.rows[()])
    update = lambda self, value: self._call(self.rows.__setitem__((), value))


def test_large_triggers_make_few_calls(monkeypatch):
    """6,000 events of one asset in two triggers: the state is called some hundred times, and a tick doesn't try the stop-limit orders that wait beside it."""
    orders = [("A", 10.0 + i, resting.ORDER, i, "buy", "stop_limit", 10.0 + i % 7, 9.0, None) for i in range(1_500)]  # wait under the price
    orders += [("A", 10.5 + i, resting.ORDER, 1_500 + i, "buy", "limit", 100.0 if i % 2 else 1.0, None, None) for i in range(1_500)]
    ticks = [("A", 10.7 + i, resting.TICK, i, None, None, None, None, 99.0 + i % 5) for i in range(2_999)] + [("A", 2e4, resting.TICK, 0, None, None, None, None, 9.5)]
    rows = sorted(orders + ticks, key=lambda r: (r[1], r[2], r[3]))
    want, still = loop(rows)
    tried, price = [], resting.fill_price
    monkeypatch.setattr(resting, "fill_price", lambda *a: tried.append(1) or price(*a))
    names = [f.split()[0] for f in resting.EVENTS.split(", ")]
    at, got, state = resting.RestingOrders(many=100), {}, {n: Kept() for n in ("last", "best", "open", "packs", "gone")}
    vars(at).update(state)
    for part in (rows[:3_000], rows[3_000:]):
        for out in at.handleInputRows(("A",), iter([pd.DataFrame(part, columns=names)]), None):
            got |= {r.order_id: (r.filled_at, r.filled_price) for r in out.itertuples()}
    left = {k[0] for k in state["open"].rows} | {x for v in state["packs"].rows.values() for x in v[0]}
    assert got == want and left == still and len(left) == 750
    assert sum(s.calls for s in state.values()) < 1_000 and len(tried) < 6_000
