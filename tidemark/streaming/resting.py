"""Resting orders filled by price ticks, once each: orders, cancellations and ticks as streams, open orders as state of their asset.

An order is tried against the asset's last price when it comes in, then against each later tick; what fills it ends it. Within a trigger, events of an asset go by time; at one instant cancellations come first, then ticks, then orders.
An order that comes late (after ticks of a later time have been worked off) is tried against the last price that is known, at that price's time.

Open orders lie in books by what moves them: buys and sells by limit, buys and sells by stop. While a trigger runs, each book in use is a heap by price, so a tick looks at the orders that it fills and one more; stop-limit orders lie in
`Bands`. Between triggers the best price of each book is a state of its own: if no tick of a trigger reaches it, the orders themselves aren't read. Orders leave the state when they are filled or cancelled; a cancellation that comes before its
order is remembered for `remember` seconds of event time.

A call to the state costs as much as a hundred events. What a trigger needs of it is read at once if it is much; open orders lie one by one (`open`) or, where a trigger leaves many, in 256 packs (`packs`) by a hash of their ids."""

from __future__ import annotations

import bisect
import heapq
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import MapState, StatefulProcessor, StatefulProcessorHandle

EVENTS = "asset string, t double, kind int, order_id long, side string, order_type string, limit_price double, stop_price double, price double"
FILLS = "order_id long, asset string, filled_at double, filled_price double"
FIELDS = ["t", "kind", "order_id", "side", "order_type", "limit_price", "stop_price", "price"]
CANCEL, TICK, ORDER = 0, 1, 2
#: Over so many orders and cancellations of a batch, what is stored is read instead of asked for, and over so many new open orders they are stored in packs.
MANY = 1_000
#: Events that are taken as Python values at once, and fills that are sent at once.
CHUNK = 50_000
#: The book of an order by side and what moves it; the sign turns prices so that the order that moves first has the least key.
BOOKS = {("buy", "limit"): (0, -1), ("sell", "limit"): (1, 1), ("buy", "stop"): (2, 1), ("sell", "stop"): (3, -1)}
SIGN = {book: sign for book, sign in BOOKS.values()}


def events(orders: DataFrame, ticks: DataFrame, cancels: DataFrame | None = None) -> DataFrame:
    """One stream (or table) of orders(order_id, asset, side, order_type, limit_price, stop_price, ts), ticks(asset, price, ts; order_id, if there, orders ticks of one instant) and cancels(order_id, asset, ts)."""

    def shaped(df: DataFrame, kind: int) -> DataFrame:
        has = set(df.columns)
        seconds = F.col("ts").cast("timestamp").cast("double").alias("t")
        fixed = {"kind": F.lit(kind).alias("kind"), "t": seconds} | ({} if "order_id" in has else {"order_id": F.lit(0).cast("long").alias("order_id")})
        return df.select(*(fixed.get(f.name, (F.col(f.name) if f.name in has else F.lit(None)).cast(f.dataType).alias(f.name)) for f in T.StructType.fromDDL(EVENTS)))

    out = shaped(ticks, TICK).unionByName(shaped(orders, ORDER))
    return out if cancels is None else out.unionByName(shaped(cancels, CANCEL))


def placed(side: str, kind: str, limit: float, stop: float) -> tuple[int, float] | None:
    """The book of an order and its key in it; None if it can never fill (no price given). A market order waits for any tick."""
    if kind == "market":
        return 1, -math.inf
    moved_by, price = ("limit", limit) if kind == "limit" else ("stop", stop)
    if price is None or math.isnan(price) or (kind == "stop_limit" and (limit is None or math.isnan(limit))):
        return None
    book, sign = BOOKS[side, moved_by]
    return book, sign * price


def fill_price(side: str, kind: str, limit: float, stop: float, last: float) -> float | None:
    """The price at which an order fills at a last price."""
    if kind == "market":
        return last
    up = side == "buy"
    if kind == "limit":
        return limit if (last <= limit if up else last >= limit) else None
    if not (last >= stop if up else last <= stop):
        return None
    if kind == "stop":
        return last
    return limit if (last <= limit if up else last >= limit) else None


def filled(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=["order_id", "asset", "filled_at", "filled_price"]).astype({"order_id": "int64", "asset": "object", "filled_at": "float64", "filled_price": "float64"})


class Bands:
    """Stop-limit orders of a batch by the prices from stop to limit, as a segment tree over the prices that the batch's ticks have: a tick meets only orders that it fills, however many wait above or below it."""

    def __init__(self, prices: list[float]):
        self.prices, self.rank, self.n = prices, {p: i for i, p in enumerate(prices)}, len(prices)
        self.nodes: dict[int, list[int]] = {}

    def add(self, order: int, low: float, high: float) -> None:
        left, right = bisect.bisect_left(self.prices, low) + self.n, bisect.bisect_right(self.prices, high) + self.n
        while left < right:
            if left & 1:
                self.nodes.setdefault(left, []).append(order)
                left += 1
            if right & 1:
                right -= 1
                self.nodes.setdefault(right, []).append(order)
            left, right = left >> 1, right >> 1

    def taken(self, price: float) -> list[int]:
        """The orders whose band has the price, some of them perhaps a second time; they leave the nodes."""
        found, at = [], self.rank[price] + self.n
        while at:
            if at in self.nodes:
                found += self.nodes.pop(at)
            at >>= 1
        return found


class Stored:
    """The open orders that the state had before the batch: read as a whole, or asked for one by one, which costs calls for each."""

    def __init__(self, open_: MapState, packs: MapState, empty: bool):
        self.open, self.packs = open_, packs
        self.known: set[int] | None = set() if empty else None  # of those that lie one by one
        self.whole = empty or not packs.exists()
        self.held: dict[int, dict[int, tuple]] = {}

    def read(self) -> Iterator[tuple[int, tuple]]:
        self.known = set()
        for (order,), row in self.open.iterator():
            self.known.add(order)
            yield order, row
        if not self.whole:
            self.held, self.whole = {k[0]: unpacked(v) for k, v in self.packs.iterator()}, True
        for rows in self.held.values():
            yield from rows.items()

    def pack(self, order: int) -> dict[int, tuple]:
        """The orders of the pack that the order belongs to."""
        at = pack_of(order)
        if at not in self.held:
            self.held[at] = unpacked(None if self.whole else self.packs.getValue((at,)))
        return self.held[at]

    def alone(self, order: int) -> bool:
        return self.open.containsKey((order,)) if self.known is None else order in self.known

    def __contains__(self, order: int) -> bool:
        return self.alone(order) or order in self.pack(order)

    def change(self, ended: set[int], added: dict[int, tuple], many: int) -> None:
        """Takes orders out and puts orders in, more than `many` at once in packs."""
        packs = set()
        for order in ended:
            if self.alone(order):
                self.open.removeKey((order,))
            elif self.pack(order).pop(order, None):
                packs.add(pack_of(order))
        for order, row in added.items():
            if len(added) <= many:
                self.open.updateValue((order,), row)
            else:
                self.pack(order)[order] = row
                packs.add(pack_of(order))
        for at in packs:
            if self.held[at]:
                self.packs.updateValue((at,), (list(self.held[at]), *map(list, zip(*self.held[at].values()))))
            else:
                self.packs.removeKey((at,))


def pack_of(order: int) -> int:
    return ((int(order) * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> 56


def unpacked(value: tuple | None) -> dict[int, tuple]:
    return {} if value is None else dict(zip(value[0], zip(*value[1:])))


class RestingOrders(StatefulProcessor):
    def __init__(self, remember: int = 86_400, many: int = MANY):
        self.remember, self.many = remember, many

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "price double, t double")
        self.best = handle.getMapState("best", "book int", "key double")
        self.open = handle.getMapState("open", "order_id long", "side string, order_type string, limit_price double, stop_price double")
        self.packs = handle.getMapState("packs", "pack int", "order_id array<long>, side array<string>, order_type array<string>, limit_price array<double>, stop_price array<double>")
        self.gone = handle.getMapState("gone", "order_id long", "t double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asset = key[0]
        batch = pd.concat([r[FIELDS] for r in rows]).sort_values(["t", "kind", "order_id"], kind="stable", na_position="first")
        price, at = self.last.get() if self.last.exists() else (None, -math.inf)
        best = {k[0]: v[0] for k, v in self.best.iterator()}
        reached = batch.loc[batch["kind"] == TICK, "price"]
        low, high = (reached.min(), reached.max()) if len(reached) else (math.inf, -math.inf)
        touched = {b for b, k in best.items() if k <= (high if SIGN[b] > 0 else -low)}
        heaps: dict[int, list] = {b: [] for b in SIGN}
        bands, live = Bands(sorted(reached.dropna().unique().tolist())), {}

        def rest(order: int, row: tuple, book: int, k: float) -> None:
            live[order] = row
            side, type_, limit, stop = row
            if type_ in ("market", "limit", "stop"):
                heapq.heappush(heaps[book], (k, order))
            else:
                bands.add(order, *((stop, limit) if side == "buy" else (limit, stop)))

        asked = int((batch["kind"] != TICK).sum())
        opened = Stored(self.open, self.packs, not best)  # without a best price no order is open
        if touched or (best and asked > self.many):
            for order, row in opened.read():
                book, k = placed(*row)
                if book in touched:
                    rest(order, row, book, k)
        early = None if self.gone.exists() else {}
        if early is None and (asked > self.many or (batch["kind"] == CANCEL).any()):
            early = {k[0]: v[0] for k, v in self.gone.iterator()}
        came_early = lambda order: self.gone.containsKey((order,)) if early is None else order in early
        added, ended, cancelled, met = set(), set(), {}, set()  # of cancellations: those of this batch, and stored ones whose order came
        out = []

        def fill(order: int, t: float, p: float) -> None:
            del live[order]
            ended.add(order)
            out.append((order, asset, t, p))

        def tick(p: float, t: float) -> None:
            for b, sign in SIGN.items():
                heap = heaps[b]
                while heap and heap[0][0] <= sign * p:
                    order = heapq.heappop(heap)[1]
                    if order in live:
                        fill(order, t, fill_price(*live[order], p))
            if p == p:
                for order in bands.taken(p):
                    if order in live:
                        fill(order, t, live[order][2])

        for begin in range(0, len(batch), CHUNK):
            part = batch.iloc[begin : begin + CHUNK]
            for t, kind, order, side, type_, limit, stop, p in zip(*(part[c].tolist() for c in FIELDS)):
                if kind == TICK:
                    if t >= at:
                        price, at = p, t
                    tick(p, t)
                elif kind == CANCEL:
                    if order in added or order in opened:
                        live.pop(order, None)
                        ended.add(order)
                    else:
                        cancelled[order] = t
                else:
                    order, row = int(order), (side, type_, limit, stop)
                    if order in added or order in ended or order in opened:
                        continue  # an order that came before
                    if order in cancelled:
                        del cancelled[order]
                        met.add(order)
                        continue
                    if order not in met and came_early(order):
                        met.add(order)
                        continue
                    where = placed(*row)
                    found = fill_price(*row, price) if price is not None and where else None
                    if found is not None:
                        ended.add(order)
                        out.append((order, asset, max(t, at), found))
                    elif where is not None:
                        added.add(order)
                        rest(order, row, *where)
            if len(out) >= CHUNK:
                yield filled(out)
                out.clear()
        self._keep(price, at, best, touched, live, added, ended, opened)
        self._remember(batch, cancelled, met, early)
        yield filled(out)

    def _keep(self, price: float | None, at: float, best: dict, touched: set, live: dict, added: set, ended: set, opened: Stored) -> None:
        if price is not None:
            self.last.update((price, at))
        opened.change(ended - added, {order: row for order, row in live.items() if order in added}, self.many)
        least = dict.fromkeys(SIGN, math.inf)
        for row in live.values():
            book, k = placed(*row)
            least[book] = min(least[book], k)
        for b, k in least.items():
            k = k if b in touched else min(k, best.get(b, math.inf))  # a cancelled order's price may stay as a bound, which only costs a look
            if k != best.get(b, math.inf):
                if k == math.inf:
                    self.best.removeKey((b,))
                else:
                    self.best.updateValue((b,), (k,))

    def _remember(self, batch: pd.DataFrame, cancelled: dict, met: set, early: dict | None) -> None:
        """Cancellations without an order stay for a while; what is too old when the batch ends isn't written at all."""
        since = batch["t"].max() - self.remember if (batch["kind"] == CANCEL).any() else -math.inf
        stays = {order: t for order, t in cancelled.items() if not t < since}
        known = early or {}
        for order in (met | {o for o, t in known.items() if t < since} | (cancelled.keys() & known.keys())) - stays.keys():
            self.gone.removeKey((order,))
        for order, t in stays.items():
            self.gone.updateValue((order,), (t,))

    def close(self) -> None:
        pass


def fills_once(events_: DataFrame, remember: int = 86_400, many: int = MANY) -> DataFrame:
    """(order_id, asset, filled_at, filled_price) of a stream of `events`, each order once. Needs the RocksDB state store."""
    return events_.groupBy("asset").transformWithStateInPandas(RestingOrders(remember, many), FILLS, "Append", "None")
