"""Shards of near equal size by vector bin packing: bytes, tokens and rows are balanced together.

The things to place are groups of equal texts. Each has a vector (bytes, tokens, rows), as shares of what one shard should hold. Units are placed from
the largest down, each into the shard whose residual capacity has the highest dot product with the unit's vector, among those that still have room for it
in all measures, else among those with room for its bytes; if none has, into the one with most bytes left. As the smallest come last, the shards end with near equal bytes (the law that holds is `bytes`).

How it scales: only groups that hold at least 1 / `quanta` of all bytes, tokens or rows are units of their own, so there are at most 3 * quanta of
them whatever the input. All smaller groups are dealt over a fixed number of bundles by a hash of their text (a sixteenth of them over finer bundles, which come last and
even out the rest); a bundle is one unit. So the plan is of bounded size, equal texts stay together without a join on the text, and the documents themselves are never shuffled: the one
exchange over rows is the pre-aggregated count of equal digests. A group of more than half of a shard in one measure can't stay whole if sizes are to be near equal; it is cut into the fewest
pieces of about equal size that are each at most half a shard, dealt by row. Slots are numbered by blocks of rows: counts by block, running sums over blocks, ranks within a block.

Defined cases: null text: no bytes, no tokens, in one group with the empty text. Texts are compared by their SHA-256. Repeated rows and rows without an id are rows like others; texts are read whole; an empty table gives
an empty result; other columns are ignored. With fewer groups than shards some shards stay empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Groups with this share of a measure are placed by themselves; the smaller ones share as many bundles.
QUANTA = 4096
#: Bundles that take a sixteenth of the small groups, so that the last units are small.
FINE = 2048
#: Rows of a block in which slots are ranked.
BLOCK_BITS = 16
MEASURES = ("size", "tokens", "ones")
SCHEMA = "doc_id {id}, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"


def words() -> Column:
    """The default measure of tokens: words between ASCII white space."""
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def measured(docs: DataFrame, tokens: Column) -> DataFrame:
    """What packing needs of each document, without its text; `row` is a number of its own in table order."""
    data = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select("doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), tokens.alias("tokens"), F.lit(1).cast("long").alias("ones"), F.crc32(data).alias("text_crc32"), F.unhex(F.sha2(data, 256)).alias("digest"), F.monotonically_increasing_id().alias("row"))


def bundle(quanta: int, fine: int) -> Column:
    """The bundle of a small group."""
    h = F.xxhash64("digest")
    high = F.shiftrightunsigned(h, 8)
    return F.when(h % 16 == 0, quanta + F.pmod(high, F.lit(fine))).otherwise(F.pmod(high, F.lit(quanta)))


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unit (a row of bytes, tokens and rows), in the order of their summed shares, the largest first; ties in the order given."""
    shares = vectors / np.maximum(vectors.sum(0) / shards, 1e-300)
    residual, chosen = np.ones((shards, vectors.shape[1])), np.zeros(len(vectors), np.int32)
    for i in np.argsort(-shares.sum(1), kind="stable"):
        v = shares[i]
        for room in ((residual >= v).all(1), residual[:, 0] >= v[0]):
            if room.any():
                best = int(np.argmax(np.where(room, residual @ v, -np.inf)))
                break
        else:
            best = int(np.argmax(residual[:, 0]))
        residual[best] -= v
        chosen[i] = best
    return chosen


def pack(docs: DataFrame, shards: int = 16, tokens: Column | None = None, quanta: int = QUANTA, fine: int = FINE, block_bits: int = BLOCK_BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each document."""
    spark = docs.sparkSession
    rows = saved(measured(docs, words() if tokens is None else tokens), "shards-rows")
    totals = [float(x or 0) for x in rows.agg(*(F.sum(m) for m in MEASURES)).first()]
    if not totals[2]:
        return spark.createDataFrame([], SCHEMA.format(id=docs.schema["doc_id"].dataType.simpleString()))

    # Large groups, at most 3 * quanta of them, and the pieces that each is cut into.
    share = F.greatest(*(F.col(m) / max(t, 1.0) for m, t in zip(MEASURES, totals)))
    large = rows.groupBy("digest").agg(*(F.sum(m).alias(m) for m in MEASURES)).withColumn("share", share).where(share >= 1.0 / quanta)
    large = large.select("digest", F.greatest(F.lit(1), F.ceil(F.col("share") * (2 * shards))).cast("long").alias("pieces"))
    known = spark.createDataFrame([(bytes(r[0]), r[1]) for r in large.collect()], "digest binary, pieces long")

    piece = F.concat_ws(":", F.hex("digest"), F.pmod(F.xxhash64("row"), F.col("pieces")).cast("string"))
    units = rows.join(F.broadcast(known), "digest", "left").withColumn("unit", F.coalesce(F.when(F.col("pieces").isNotNull(), piece), bundle(quanta, fine).cast("string")))
    sums = units.groupBy("unit").agg(*(F.sum(m).alias(m) for m in MEASURES)).collect()
    sums.sort(key=lambda r: r["unit"])
    chosen = place(np.array([[r[m] for m in MEASURES] for r in sums], float), shards)
    plan = spark.createDataFrame([(r["unit"], int(s)) for r, s in zip(sums, chosen)], "unit string, shard int")
    placed = units.join(F.broadcast(plan), "unit").withColumn("block", F.shiftright("row", block_bits))

    counts = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    begins = counts.select("shard", "block", F.coalesce(before, F.lit(0)).alias("begin"))
    rank = F.row_number().over(Window.partitionBy("shard", "block").orderBy("row")) - 1
    slotted = placed.withColumn("rank", rank).join(begins, ["shard", "block"])
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("begin") + F.col("rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
