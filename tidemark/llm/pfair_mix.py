"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks. The target is a flow: at time v a source with weight w has sent min(w * v, its blocks), and the flow of all
sources together at v is the slot of v. Block k of a source (from 0) is released at the slot of k / w, rounded down, and due at the slot of (k + 1) / w,
rounded up; at each slot the released block with the earliest deadline goes first. The blocks that are released and due within some slots flow within them, so they are never more than these slots,
and the order keeps all deadlines: at every slot each source is within less than one block of its target. While no source has run out, a block's times are floor(k / share) and ceil((k + 1) / share);
from the moment at which one runs out, the others share its slots by their weights.

Weights are whole numbers, so at each whole time v all sources are exactly on target. The blocks of the time from v to v + 1 are a frame, frames are independent of each other, and one schedule is made for
each composition of a frame; all blocks find their slot by a join. There are no more than twice as many compositions as sources.
Frame f begins at the slot that is the sum over sources of min(blocks, f * weight). Sorted by the time at which they run out, the sources that a frame
still holds are the end of the list, so the driver keeps one row a source and one number a composition; the tasks read their part of that list.

A document's block comes from a running sum of its length within its source, in the order of a hash of its id. Sums are taken first over
hash ranges of each source, then within each range, so no task holds a source as a whole.

The mix lasts until the time at which the sources that still have blocks are less than min_live of the target weight; blocks released from then on are marked
in_mix = false. Nothing is dropped by the operator.

Defined cases: null text has length 0; null source is a source of its own (empty name). Sources without a target weight, or with
weight 0, are not in the mix: slot null. Repeated rows stay; ties of hash and id are broken by the text's hash. Empty tables give no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from fractions import Fraction
from heapq import heappop, heappush
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common


def flow(parts: dict[str, tuple[int, int]]) -> Callable[[int, int], tuple[int, int]]:
    """parts: weight and blocks of each source. A function of a time k / w in the frame: the slot of that time, as numerator and denominator."""
    ends = sorted((Fraction(n, w), w, n) for w, n in parts.values())
    times = [end for end, _, _ in ends]
    gone = [0, *accumulate(n for _, _, n in ends)]
    going = [0, *accumulate(w for _, w, _ in ends)]

    def slot(k: int, w: int) -> tuple[int, int]:
        i = bisect_right(times, Fraction(k, w))
        return gone[i] * w + (going[-1] - going[i]) * k, w

    return slot


def schedule(parts: dict[str, tuple[int, int]]) -> list[tuple[str, int]]:
    """(source, k) for each slot of a frame; parts: weight of each source, and how many blocks it has for the frame (its weight at most); k from 0. Whole-number arithmetic throughout."""
    total, slot = sum(n for _, n in parts.values()), flow(parts)
    waiting: list[list[tuple[int, str, int]]] = [[] for _ in range(total + 1)]  # by release: (deadline, source, k)
    for source, (w, n) in parts.items():
        upto, unit = slot(0, w)
        for k in range(n):
            release, (upto, unit) = upto // unit, slot(k + 1, w)
            waiting[release].append((-(-upto // unit), source, k))
    ready: list[tuple[int, str, int]] = []
    out = []
    for at in range(total):
        for block in waiting[at]:
            heappush(ready, block)
        deadline, source, k = heappop(ready)
        if deadline <= at:
            raise ValueError("the parts can't be scheduled")
        out.append((source, k))
    return out


def tempered(sizes: dict[str, float], power: float = 0.7, total: int = 1000) -> dict[str, int]:
    """Target weights in proportion to size ** power, as whole numbers that sum to about total; each source has 1 at least."""
    raised = {s: max(n, 0) ** power for s, n in sizes.items()}
    whole = sum(raised.values()) or 1.0
    return {s: max(1, round(total * v / whole)) for s, v in raised.items()}


def placed(docs: DataFrame, block_chars: int, ranges: int) -> DataFrame:
    """docs (doc_id, source, size, tie) with block, and index within the source's order."""
    key = F.xxhash64("doc_id", "tie")
    docs = docs.withColumn("range", F.shiftrightunsigned(key, 64 - ranges.bit_length() + 1).cast("int")).withColumn("key", key)
    sums = docs.groupBy("source", "range").agg(F.sum("size").alias("sum"))
    before = sums.withColumn("before", F.coalesce(F.sum("sum").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("sum")
    w = Window.partitionBy("source", "range").orderBy("key", "doc_id", "tie")
    own = docs.withColumns({"upto": F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)), "at": F.row_number().over(w)})
    # A document belongs to the block in which its first character lies; the first block of every source exists.
    start = F.col("before") + F.col("upto") - F.col("size")
    return own.join(before, ["source", "range"]).withColumn("chars", start).withColumn("raw", F.floor(start / block_chars).cast("long")).select("doc_id", "source", "size", "tie", "range", "at", "raw")


def mix(docs: DataFrame, weights: dict[str, int] | None = None, power: float = 0.7, total_weight: int = 1000, block_chars: int = 100_000, min_live: float = 0.5, ranges: int | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, source, tie (hash of the text), block, frame, slot, place (in the block), in_mix. weights: whole numbers by source; if None, from the sources' lengths to the power, summing to about total_weight. ranges: a power of two, by which sources are dealt; if None, enough for a
    million rows at most in each. The result doesn't depend on it."""
    spark = docs.sparkSession
    if ranges is None:
        ranges = 1 << max(8, (docs.count() // 500_000).bit_length())
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.coalesce(F.length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.col(text_col).cast("string")).alias("tie"))
    rows = common.saved(placed(slim, block_chars, ranges), "placed")
    # Long documents leave numbers without a document; blocks are numbered anew without gaps.
    used = rows.groupBy("source", "raw").agg(F.count("*").alias("n"))
    span = F.floor(F.col("raw") / 4096)
    per_span = used.withColumn("span", span).groupBy("source", "span").agg(F.count("*").alias("n"))
    before = per_span.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("source", "span", "before")
    w = Window.partitionBy("source", "span").orderBy("raw")
    numbered = common.saved(used.withColumn("span", span).withColumn("own", F.row_number().over(w) - 1).join(before, ["source", "span"]).select("source", "raw", (F.col("before") + F.col("own")).alias("block")), "blocks")
    counts = {r["source"]: r["n"] for r in numbered.groupBy("source").agg(F.count("*").alias("n")).collect()}  # one row for each source
    if weights is None:
        sizes = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()}
        weights = tempered(sizes, power, total_weight)
    live = {s: w for s, w in weights.items() if w > 0 and counts.get(s)}
    cuts = sorted({c for s, w in live.items() for c in (counts[s] // w, counts[s] // w + 1)} | {0}) if live else []
    whole = sum(weights[s] for s in live)
    # Sources by the time at which they run out, as blocks over weight: (time, weight, source, blocks).
    ends = sorted((Fraction(counts[s], w), w, s, counts[s]) for s, w in live.items())
    weights_gone, blocks_gone = [0, *accumulate(w for _, w, _, _ in ends)], [0, *accumulate(n for _, _, _, n in ends)]
    # The mix ends when too little weight is left; at 0 if there is nothing to mix.
    last = next((end for (end, _, _, _), gone in zip(ends, weights_gone[1:], strict=True) if whole - gone < min_live * whole), ends[-1][0] if ends else Fraction(0))

    times = [end for end, _, _, _ in ends]
    frames = []
    for f in cuts:
        at = bisect_right(times, f)  # sources from here on have blocks in the frame
        if at < len(ends):
            frames.append((f, blocks_gone[at] + f * (whole - weights_gone[at]), at))
    listed = spark.sparkContext.broadcast([(s, w, n) for _, w, s, n in ends])

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, begin, at in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                slots = schedule({s: (w, min(w, n - first * w)) for s, w, n in listed.value[at:]})
                n = len(slots)
                yield pa.RecordBatch.from_arrays([pa.array([first] * n, pa.int64()), pa.array([s for s, _ in slots], pa.string()), pa.array([k for _, k in slots], pa.int64()), pa.array(range(begin, begin + n), pa.int64()), pa.array([n] * n, pa.int64())], ["cut", "source", "k", "first_slot", "length"])

    work = spark.createDataFrame(frames, "cut long, begin long, at long").repartition(max(1, min(len(frames), 64)))
    slots = work.transform(common.in_batches, plan, "cut long, source string, k long, first_slot long, length long")

    # A frame is composed like the last cut at or before it.
    weight = spark.createDataFrame([(s, w, counts[s]) for s, w in live.items()], "source string, weight long, blocks long")
    framed = numbered.join(weight, "source").withColumns({"frame": F.floor(F.col("block") / F.col("weight")).cast("long"), "k": F.col("block") % F.col("weight")})
    starts = spark.sparkContext.broadcast(np.array(cuts, np.int64))

    def with_cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(starts.value, batch.column("frame").to_numpy(), side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts.value[at])], [*batch.schema.names, "cut"])

    framed = framed.transform(common.in_batches, with_cut, "source string, raw long, block long, weight long, blocks long, frame long, k long, cut long")
    slot = F.col("first_slot") + (F.col("frame") - F.col("cut")) * F.col("length")
    in_mix = F.col("block") * F.lit(last.denominator) < F.col("weight") * F.lit(last.numerator)
    slotted = framed.join(slots, ["cut", "source", "k"]).select("source", "raw", "block", "frame", slot.alias("slot"), in_mix.alias("in_mix"))
    # Order within a block: by range, then by place in it.
    place = F.col("range").cast("long") * (1 << 40) + F.col("at")
    return rows.join(slotted, ["source", "raw"], "left").select("doc_id", "source", "tie", "block", "frame", "slot", place.alias("place"), F.coalesce("in_mix", F.lit(False)).alias("in_mix"))


def mixed(docs: DataFrame, partitions: int = 0, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents in the order of their slots: over files and within each, past the end of the mix too. Only sources that the caller gave no weight are left out. All columns stay."""
    order = mix(docs, id_col=id_col, text_col=text_col, **options).where("slot is not null")
    own, tie, slot, place, text = common.fresh(docs, "_mix_id", "_mix_tie", "_mix_slot", "_mix_place", "_mix_hash")
    order = order.groupBy(F.col("doc_id").alias(own), F.col("tie").alias(tie)).agg(F.min(F.struct("slot", "place")).alias("at"))
    order = common.saved(order.select(own, tie, F.col("at.slot").alias(slot), F.col("at.place").alias(place)), "order")
    tied = docs.withColumn(text, F.xxhash64(F.col(text_col).cast("string")))
    found = tied.join(order, F.col(id_col).cast("long").eqNullSafe(F.col(own)) & (F.col(text) == F.col(tie)))
    found = found.repartitionByRange(partitions, slot, place) if partitions else found.repartitionByRange(slot, place)
    return found.sortWithinPartitions(slot, place).drop(own, tie, slot, place, text)
