"""Running values and places within one key's rows, for keys that may hold most of a table: no window covers more than a block of a key, and what passes between blocks is one row a block."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..work import work_path

#: How two neighbouring stretches' values of a running aggregate become that of both; a stretch without values is null.
JOINED: dict[Callable[[Column], Column], Callable[[Column, Column], Column]] = {
    F.sum: lambda a, b: F.coalesce(a + b, a, b),
    F.max: lambda a, b: F.greatest(a, b),
    F.min: lambda a, b: F.least(a, b),
}


def kept(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, so what follows doesn't compute them again."""
    path = work_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def cut(rows: DataFrame, keys: list[str], order: list[str], block_rows: int) -> DataFrame:
    """The rows with `row` (rising with keys and order, not gapless) and `block`. They are sorted by ranges, so a key with most rows lies in many tasks; a block has at most block_rows of them. `order` has to tell a key's rows apart."""
    placed = rows.orderBy(*keys, *order).withColumn("row", F.monotonically_increasing_id())
    return kept(placed, "cut").withColumn("block", F.floor(F.col("row") / block_rows))


def same(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """A join on equal columns, nulls being equal, with the left names only."""
    other = right.withColumnsRenamed({n: f"_of_{n}" for n in names})
    on = reduce(lambda a, b: a & b, (F.col(n).eqNullSafe(F.col(f"_of_{n}")) for n in names))
    return left.join(other, on, how).drop(*(f"_of_{n}" for n in names))


def looked_up(rows: DataFrame, facts: DataFrame, key: str, few: int = 200_000, parts: int = 16) -> DataFrame:
    """The rows with what `facts` say of their key (one row a key); nulls where they say nothing. A join by the key alone puts all rows of a key in one task, and windows by (something, key) stay there. So up to `few` facts are
    broadcast and the rows stay where they are; more are repeated for `parts` parts, over which each key's rows are dealt."""
    facts = kept(facts, "facts")
    if facts.count() <= few:
        return rows.join(F.broadcast(facts), key, "left")
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.lit(parts)))
    repeated = facts.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return dealt.join(repeated.hint("merge"), [key, "_part"], "left").drop("_part")


def running(placed: DataFrame, keys: list[str], kind: Callable[[Column], Column], value: Column, name: str, before: str | None = None) -> DataFrame:
    """Adds `name`: kind (F.sum, F.max or F.min) of value over the key's rows up to each, in the order of `row` through all blocks; and `before` if it is named: the same over the key's rows in earlier blocks. Nulls don't count."""
    held = before or "_before"
    totals = placed.groupBy(*keys, "block").agg(kind(value).alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    starts = totals.select(*keys, "block", kind(F.col("_total")).over(earlier).alias(held))
    own = kind(value).over(Window.partitionBy(*keys, "block").orderBy("row").rowsBetween(Window.unboundedPreceding, 0))
    out = same(placed.withColumn("_own", own), starts, [*keys, "block"]).withColumn(name, JOINED[kind](F.col(held), F.col("_own"))).drop("_own")
    return out if before else out.drop(held)


def at_places(values: DataFrame, key: str, value: str, levels: tuple[float, ...], accuracy: int = 10_000, salts: int = 32, margin: float = 2.0, busy_rows: int = 100_000) -> DataFrame:
    """(key, level, value): of each key's ascending values the one at 0-based place floor(level * n), n - 1 at most; level is the place in `levels`. Nulls don't count; NaN is the largest.

    Selection in two passes, without sorting a key: a histogram of equal depth (a mergeable sketch of bounded size for each key) gives an interval around the place; then values below it are counted and only those inside are put in order. What is
    wanted is one row a key, whatever the levels; only keys of more than busy_rows values are dealt over `salts` parts. An interval holds about 2 * margin / accuracy of a key's values. The sketch only steers: a place outside its interval is looked for again in a wider one, at last among all."""
    some = values.where(F.col(value).isNotNull()).select(F.col(key), F.col(value))
    e = margin / accuracy
    bounds = [x for p in levels for x in (max(0.0, p - e), min(1.0, p + e))]
    sketch = F.percentile_approx(value, [float(b) for b in bounds], accuracy)
    sums = some.groupBy(key).agg(F.count("*").alias("_n"), sketch.alias("_q"))
    everything = e >= 1
    per_level = [F.struct(F.lit(j).alias("level"), F.least(F.floor(F.col("_n") * p), F.col("_n") - 1).alias("rank"), F.get("_q", F.lit(2 * j)).alias("lo"), F.get("_q", F.lit(2 * j + 1)).alias("hi")) for j, p in enumerate(levels)]
    wanted = kept(sums.select(key, "_n", F.array(*per_level).alias("_w")), "places-wanted")
    met = _met(some, wanted, key, value, salts, busy_rows)
    here = F.col("_w") if everything else F.filter("_w", lambda w: F.col(value) <= w["hi"])
    each = met.select(key, value, "_m", F.explode(here).alias("_w")).select(key, value, "_m", "_w.*")
    # One row for all that lies below, one for each value inside.
    part = F.col(value) if everything else F.when(F.col(value) < F.col("lo"), F.lit(None)).otherwise(F.col(value))
    few = each.groupBy(key, "level", part.alias("_v")).agg(F.sum("_m").alias("_m"), F.first("rank").alias("rank"))
    upto = F.sum("_m").over(Window.partitionBy(key, "level").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    found = few.withColumn("_upto", upto).where((F.col("rank") < F.col("_upto")) & (F.col("rank") >= F.col("_upto") - F.col("_m")) & F.col("_v").isNotNull()).select(key, "level", F.col("_v").alias(value))
    found = kept(found, "places-found")
    left = same(wanted.select(key, F.explode("_w.level").alias("level")), found.select(key, "level").hint("merge"), [key, "level"], "left_anti").select(key).distinct()
    if everything or left.isEmpty():
        return found
    again = at_places(same(some, left, [key], "left_semi"), key, value, levels, accuracy, salts, margin * 64, busy_rows)
    return same(found, left, [key], "left_anti").unionByName(again)


def _met(some: DataFrame, wanted: DataFrame, key: str, value: str, salts: int, busy_rows: int) -> DataFrame:
    """Each value, or equal values with their count `_m`, with what is wanted of its key. Values of a key of more than busy_rows are dealt over `salts` parts; such keys are few, and no other key's row is repeated. Joins are by
    merging, as a table's size in files says little of the memory that a copy of it would take in the driver and each executor."""
    busy = wanted.where(F.col("_n") > busy_rows)
    if busy.isEmpty():
        return same(some.withColumn("_m", F.lit(1)), wanted.drop("_n").hint("merge"), [key])
    quiet = same(some.withColumn("_m", F.lit(1)), wanted.where(F.col("_n") <= busy_rows).drop("_n").hint("merge"), [key])
    tied = same(some, busy.select(key), [key], "left_semi").groupBy(key, value).agg(F.count("*").alias("_m")).withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(salts)))
    parts = busy.select(key, "_w", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("_salt"))
    return quiet.unionByName(same(tied, parts.hint("merge"), [key, "_salt"]).drop("_salt"))
