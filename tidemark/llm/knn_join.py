"""Exact top-k search by a Voronoi kNN join under the inner product.

Queries and data are both grouped by their nearest pivot. Each data cell has a summary: its number of rows, the range of their
components along the pivot, the largest component across it, the largest distance to it, and a few witnesses, the rows that
reach farthest along the pivot. For a query the k-th best score among all witnesses of other ids bounds its k-th best score from below; the
summaries bound its scores with a cell's rows from above. A query meets a cell only if its upper bound there reaches its lower
one, and a row of the cell is sent on only if some group of queries may need it by the same bounds on the groups' summaries. What meets is multiplied locally, and the best k of each place are merged for each query.

Cells say what has to meet; what is shipped together is larger. There are about sqrt(n) cells (max_pivots at most), of which neighbours are
packed into a block until it holds as many rows as the queries of a part; a cell of more rows is dealt out over blocks, and a block that many
queries need over parts of them, so neither a common vector nor a dense cell comes to one task. A query is sent once to each block that holds a cell it
needs, a row once to each part of its block: where nothing can be excluded, n rows and q queries make n * q / part_queries and n * q / block rows
of them, which is least where both are equal and as large as a task may hold. Within a task the bounds of single cells are taken again, and a
query's own bound leaves few scores to be ordered. Vectors travel as the narrowest whole numbers that hold the table's largest component.

Pivots are a bounded sample (by a hash of the id) and decide speed alone, never the result; summaries are as many as pivots, witnesses too, or
max_witnesses. Where vectors have no structure (directions at random in many dimensions) no bound can exclude much, and the join compares all
queries with all data, in blocks.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part. Where lengths differ, missing components
count as 0. A null id takes no part. Ties go to the smaller id; repeated rows are candidates of their own, but none for
a query with its id; of queries that share an id the least vector is asked. Components beyond 2^20 in size are compared by exact whole numbers;
rows with components beyond 2^40 form a cell without bounds that every query meets. Scores beyond a long are held to its range.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

LARGE = float(1 << 20)
#: Components from which squares and sums aren't taken: such rows have no bounds.
HUGE = float(1 << 40)
#: Scores beyond it may be held to a long's range and tie there, so no bound tells them apart.
HELD_SCORE = 9.2e18
#: The cell of rows without bounds.
UNBOUNDED = -1
#: Numbers in a table of rows and pivots that is held at once.
HELD = 1 << 20
#: Queries that are multiplied with a block at once.
AT_ONCE = 64
#: Tasks that blocks and parts are dealt to at most; several share one beyond it.
MOST_TASKS = 20_000


def matrix(column: pa.Array, width: int) -> np.ndarray:
    sizes = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher score, then smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact."""
    if max(np.abs(q).max(initial=0), np.abs(x).max(initial=0)) <= LARGE and q.shape[1] < 4096:
        return q @ x.T
    whole = np.array([[int(v) for v in r] for r in q], object).reshape(q.shape) @ np.array([[int(v) for v in r] for r in x], object).reshape(x.shape).T
    return np.clip(whole, -(2**63), 2**63 - 1)


class Pivots:
    """The pivots, their directions, and how rows lie to them."""

    def __init__(self, vectors: np.ndarray):
        self.at = vectors
        size = np.sqrt((vectors**2).sum(1))
        self.towards = vectors / np.where(size > 0, size, 1)[:, None]
        self.half = size**2 / 2

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.at.T - self.half).argmax(1)

    def split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Components of each row along each pivot, across it (widened for rounding), and the rows' lengths."""
        along, squares = x @ self.towards.T, (x**2).sum(1)
        length = np.sqrt(squares)
        return along, np.sqrt(np.maximum(squares[:, None] - along**2, 0)) + 1e-7 * length[:, None], length


class Cells:
    """What is known of the rows of each cell that has bounds."""

    def __init__(self, pivots: Pivots, cells: pd.DataFrame):
        plain = cells[cells["cell"] != UNBOUNDED]
        self.number = plain["cell"].to_numpy()
        self.pivots = Pivots(pivots.at[self.number])
        self.low, self.high, self.across, self.far, self.long = (plain[c].to_numpy() for c in ("low", "high", "across", "far", "long"))

    def of(self, number: np.ndarray) -> Cells:
        """The cells among the numbers, in their order."""
        out = object.__new__(Cells)
        at = np.searchsorted(self.number, number)
        out.number, out.pivots = number, Pivots(self.pivots.at[at])
        out.low, out.high, out.across, out.far, out.long = (x[at] for x in (self.low, self.high, self.across, self.far, self.long))
        return out

    def ceilings(self, x: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner products of each of x with the rows of each cell."""
        along, across, length = self.pivots.split(x)
        scale = length[:, None] * (self.long + np.abs(self.pivots.at).sum(1))
        above = highest(along, across, self.low, self.high, self.across, scale)
        return np.minimum(above, x @ self.pivots.at.T + length[:, None] * self.far + 1e-9 * scale + 1e-6)


def pieces(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of which a table with so many columns can be held."""
    step = max(1, HELD // max(columns, 1))
    for batch in batches:
        for a in range(0, batch.num_rows, step):
            yield batch.slice(a, step)


def without_huge(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x with zeros for the rows that have no bounds, and which these are."""
    huge = np.abs(x).max(1, initial=0) > HUGE
    return np.where(huge[:, None], 0.0, x), huge


def highest(along: np.ndarray, across: np.ndarray, low: np.ndarray, high: np.ndarray, most_across: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Upper bounds of inner products of rows with what lies between low and high along a direction and at most most_across across it."""
    return np.maximum(along * low, along * high) + across * most_across + 1e-9 * scale + 1e-6


def valid(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    raw = F.col(vector_col).cast("array<double>")
    fine = F.col(id_col).isNotNull() & (F.size(raw) > 0) & F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    most = 1.7e308  # a component that the scale takes out of range stays the largest there is
    scaled = lambda x: F.greatest(F.least(x * scale, F.lit(most)), F.lit(-most))
    whole = F.transform(raw, lambda x: F.when(F.abs(x * scale) < 9e15, F.floor(x * scale).cast("double")).otherwise(scaled(x)))
    return df.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def assigned(rows: DataFrame, pivots: Pivots, width: int) -> DataFrame:
    """id, v, salt (a number of the row in its task), cell, and how the row lies to its pivot: along, across, far, long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in pieces(batches, len(pivots.at)):
            x, huge = without_huge(matrix(batch.column(1), width))
            cell = pivots.nearest(x)
            own = pivots.towards[cell]
            along, squares = np.einsum("ij,ij->i", x, own), (x**2).sum(1)
            length = np.sqrt(squares)
            across = np.sqrt(np.maximum(squares - along**2, 0)) + 1e-7 * length
            far = np.sqrt(((x - pivots.at[cell]) ** 2).sum(1)) + 1e-7 * length
            salt = np.arange(seen, seen + len(x))
            seen += len(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(salt), pa.array(np.where(huge, UNBOUNDED, cell), pa.int32()), *map(pa.array, (along, across, far, length))], ["id", "v", "salt", "cell", "along", "across", "far", "long"])

    return rows.transform(common.in_batches, run, "id long, v array<double>, salt long, cell int, along double, across double, far double, long double")


def summaries(rows: DataFrame) -> pd.DataFrame:
    """One row for each cell: as many as pivots at most."""
    of = {"low": F.min("along"), "high": F.max("along"), "across": F.max("across"), "far": F.max("far"), "long": F.max("long"), "n": F.count("*")}
    return rows.groupBy("cell").agg(*(c.alias(n) for n, c in of.items())).orderBy("cell").toPandas()


def packed(pivots: Pivots, cells: pd.DataFrame, block_rows: int) -> pd.DataFrame:
    """cell, pack, blocks: cells whose pivots are neighbours share a pack of block_rows rows at most; one of more rows is a pack of its own, in blocks."""
    leads = Pivots(pivots.at[:: max(1, isqrt(len(pivots.at)))])
    near = np.where(cells["cell"] == UNBOUNDED, UNBOUNDED, leads.nearest(pivots.at[np.maximum(cells["cell"], 0)]))
    pack, rows, found = -1, block_rows, []
    for i in np.lexsort((cells["cell"], near)):
        cell, n = int(cells["cell"].iloc[i]), int(cells["n"].iloc[i])
        if rows + n > block_rows or cell == UNBOUNDED:
            pack, rows = pack + 1, 0
        rows += n if cell != UNBOUNDED else block_rows
        found.append((cell, pack, n))
    out = pd.DataFrame(found, columns=["cell", "pack", "n"])
    return out.assign(blocks=-(-out.groupby("pack")["n"].transform("sum") // block_rows))[["cell", "pack", "blocks"]].astype("int32")


def bounded_queries(queries: DataFrame, pivots: Pivots, cells: pd.DataFrame, witnesses: tuple[np.ndarray, np.ndarray], k: int, width: int, packs: pd.DataFrame | None = None) -> DataFrame:
    """id, v, home (the query's own cell), least (what its k-th best score reaches), along, across, long, cells (those that it has to meet; the packs that hold them, if packs are given)."""
    known = Cells(pivots, cells)
    of = dict(zip(packs["cell"], packs["pack"], strict=True)) if packs is not None else {c: c for c in cells["cell"]}
    place = np.array([of[c] for c in known.number], np.int64)
    order = np.argsort(place, kind="stable")
    names, starts = np.unique(place[order], return_index=True)
    unbounded = [of[c] for c in cells["cell"] if c == UNBOUNDED]
    longest = known.long.max(initial=0)
    ids, vectors = witnesses

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, len(known.number) + len(ids)):
            own = batch.column(0).to_numpy()
            x, huge = without_huge(matrix(batch.column(1), width))
            least, length = np.full(len(x), -np.inf), np.sqrt((x**2).sum(1))
            if len(ids) >= k:
                scores = np.where(own[:, None] == ids[None, :], -np.inf, x @ vectors.T)
                least = -np.partition(-scores, k - 1, axis=1)[:, k - 1] - 1e-9 * length * longest - 1e-6
            least = np.where(huge | (least < -HELD_SCORE), -np.inf, np.minimum(least, HELD_SCORE))
            need = ~(known.ceilings(x) < least[:, None])
            met = np.logical_or.reduceat(need[:, order], starts, axis=1) if len(names) else need
            found = [pa.array([*names[m].tolist(), *unbounded], pa.int32()) for m in met]
            ends = np.cumsum([0, *map(len, found)])
            meets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(found) if found else pa.array([], pa.int32()))
            home = np.where(huge, UNBOUNDED, pivots.nearest(x))
            along = np.einsum("ij,ij->i", x, pivots.towards[np.maximum(home, 0)])
            across = np.sqrt(np.maximum(length**2 - along**2, 0)) + 1e-7 * length
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(home, pa.int32()), *map(pa.array, (least, along, across, length)), meets], ["id", "v", "home", "least", "along", "across", "long", "cells"])

    return queries.transform(common.in_batches, run, "id long, v array<double>, home int, least double, along double, across double, long double, cells array<int>")


def needed(rows: DataFrame, pivots: Pivots, groups: pd.DataFrame, width: int) -> DataFrame:
    """The rows that some group of queries may need, by the groups' summaries: the range of its queries along their pivot, the farthest across it, and the least of what they reach."""
    if (groups["home"] == UNBOUNDED).any():
        return rows
    home = groups["home"].to_numpy()
    homes = Pivots(pivots.at[home])
    low, high, across_, long_, least = (groups[c].to_numpy() for c in ("low", "high", "across", "long", "least"))
    size = np.sqrt((homes.at**2).sum(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, len(home)):
            x, huge = without_huge(matrix(batch.column(1), width))
            along, across, length = homes.split(x)
            above = highest(along, across, low, high, across_, length[:, None] * (long_ + size))
            keep = huge | ~(above < least).all(1)
            yield batch if keep.all() else batch.filter(pa.array(keep))

    return rows.transform(common.in_batches, run, rows.schema)


def knn_join(df: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, cell_rows: int = 2048, max_pivots: int = 32_768, max_witnesses: int = 8192, block_values: int = 1 << 22, part_queries: int = 65_536, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row that is_query holds for (a condition on `id`), its k highest inner products among all rows of other ids, of floor(scale * x) for each component x.

    cell_rows: rows of a cell aimed at, as long as that makes no more cells than sqrt(n) or max_pivots; block_values: components of a block, and of a part, at most; part_queries: queries that meet a block in one task at most.
    Blocks are as large as parts, as far as cell_rows and block_values allow.
    """
    spark = df.sparkSession
    rows = valid(df, id_col, vector_col, scale)
    shape = rows.agg(F.max(F.size("v")).alias("width"), F.count("*").alias("n"), F.count_if(is_query).alias("q"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).first()
    width, n = shape["width"] or 0, shape["n"]
    if not shape["q"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n_pivots = max(1, min(max_pivots, n // cell_rows, isqrt(n)))
    order = [F.xxhash64("id"), F.col("id"), F.col("v")]
    bounded = F.forall("v", lambda x: F.abs(x) <= HUGE)
    rate = min(1.0, 4.0 * n_pivots / n + 100 / n)  # the sort sees a few times as many rows as are taken
    some = rows.where(bounded & (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < 1_000_003 * rate)).orderBy(*order).limit(n_pivots).select("v").toPandas()["v"]
    at = np.zeros((max(1, len(some)), width))
    for i, v in enumerate(some):
        at[i, : len(v)] = v
    pivots = Pivots(np.unique(at, axis=0))
    data = common.saved(assigned(rows, pivots, width), "vectors")
    cells = summaries(data)
    narrow = next((t for t, most in (("smallint", 2**15), ("int", 2**31)) if shape["most"] < most), "double")
    limit = max(1, block_values // max(width, 1))
    part_rows = min(part_queries, limit)
    packs = packed(pivots, cells, max(1, min(limit, max(cell_rows, min(shape["q"], part_rows)))))
    best = Window.partitionBy("cell").orderBy(F.desc("along"), "id", "salt")
    seen = data.where(F.col("cell") != UNBOUNDED).withColumn("r", F.row_number().over(best)).where(F.col("r") <= max(1, min(k + 1, max_witnesses // len(cells)))).select("id", "v").toPandas()
    vectors = np.zeros((len(seen), width))
    for i, v in enumerate(seen["v"]):
        vectors[i, : len(v)] = v
    asked = data.where(is_query).groupBy("id").agg(F.min("v").alias("v"))
    queries = common.saved(bounded_queries(asked, pivots, cells, (seen["id"].to_numpy(np.int64), vectors), k, width, packs), "queries")
    of = {"low": F.min("along"), "high": F.max("along"), "across": F.max("across"), "long": F.max("long"), "least": F.min("least")}
    groups = queries.groupBy("home").agg(*(c.alias(n) for n, c in of.items())).toPandas()
    numbers = F.col("v").cast(f"array<{narrow}>").alias("v")
    met = queries.select("id", numbers, "least", F.explode("cells").alias("pack"))
    plan = packs.merge(met.groupBy("pack").count().toPandas(), on="pack")
    plan = plan.assign(parts=-(-plan["count"] // part_rows))[["cell", "pack", "blocks", "parts"]].astype("int32")
    once = plan.drop_duplicates("pack")
    tasks = int(min(MOST_TASKS, (once["blocks"].astype(int) * once["parts"]).sum()))
    by_cell, by_pack = (F.broadcast(spark.createDataFrame(x, ", ".join(f"{c} int" for c in x))) for x in (plan, once.drop(columns="cell")))  # max_pivots + 1 rows at most
    block, part = (F.pmod(F.xxhash64("id", x), F.col(y)).cast("int") for x, y in (("salt", "blocks"), ("id", "parts")))
    all_ = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    key = ["pack", "block", "part"]
    right = needed(data.select("id", "v", "salt", "cell"), pivots, groups, width).join(by_cell, "cell").select("pack", block.alias("block"), all_("parts").alias("part"), "id", numbers, "cell")
    left = met.join(by_pack, "pack").select("pack", all_("blocks").alias("block"), part.alias("part"), "id", "v", "least")
    known = Cells(pivots, cells)

    def solve(one: pa.Table, two: pa.Table) -> pa.Table:
        found: list[list] = [[], [], []]
        if one.num_rows and two.num_rows:
            q, x = (matrix(t.column("v").combine_chunks(), width) for t in (one, two))
            qid, least, xid, cell = one.column("id").to_numpy(), one.column("least").to_numpy(), two.column("id").to_numpy(), two.column("cell").to_numpy()
            here, number = np.unique(cell, return_inverse=True)
            bounds = known.of(here[here != UNBOUNDED])
            free = len(here) - len(bounds.number)  # the cell without bounds comes first
            step = max(1, min(AT_ONCE, 64 * HELD // max(len(x), len(here))))
            for a in range(0, len(q), step):
                need = ~(bounds.ceilings(without_huge(q[a : a + step])[0]) < least[a : a + step, None]).all(0)
                rows = np.flatnonzero(np.concatenate((np.ones(free, bool), need))[number])
                scores = products(q[a : a + step], x if len(rows) == len(x) else x[rows])
                for i, of_one in enumerate(scores, a):
                    near = np.flatnonzero(of_one >= least[i])
                    near = near[xid[rows[near]] != qid[i]]
                    best = near[top(xid[rows[near]], of_one[near], k)]
                    found[0] += [int(qid[i])] * len(best)
                    found[1] += xid[rows[best]].tolist()
                    found[2] += [int(v) for v in of_one[best]]
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.int64())})

    if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
        left, right = left.repartition(tasks, *key), right.repartition(tasks, *key)
    local = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(solve, "query_id long, vec_id long, score long")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
