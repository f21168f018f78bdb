"""Product codes of vectors: each part of a vector is replaced by the index of the nearest entry of its part's codebook, in exact integers.

The nearest entry is found by segment means. For a segment of w components with sums s, t and residual norms r, q about the means, the squared distance
of two vectors is at least (s - t)^2 / w + (r - q)^2. A part is one segment first, then two, four and so on: entries whose bound exceeds the exact distance to the most
promising entry are out; what survives all levels gets exact integer distances. Bounds are lowered by more than their rounding can be, so the filter never drops the nearest entry nor one that ties with it.

Codebooks are trained by Lloyd's rounds over all vectors. In each round tasks add up counts and sums of the parts of each entry, so what reaches the driver is one codebook's size
(entries x components), whatever the number of vectors. Every round reads the table anew; nothing else is kept.

Defined cases: vectors that are null or hold null or non-finite components are dropped. Others of several lengths are filled up with zeros to the longest, rounded up to a multiple of the parts; an empty vector is all zeros.
Rows without an id are coded too, but come last as first entries; rows with equal ids follow in the order of their vectors. With fewer kept rows than entries the codebooks have
as many entries as there are rows. Components are held within bounds (`limit`: about +-32,768 for 64 components) so that all sums fit 64 bits. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, saved

#: Vectors that are worked on at once.
SLICE = 4096


def limit(dims: int) -> int:
    """The largest component whose squared distances over all components, and squared sums within a part, fit 62 bits."""
    return 1 << int((62 - math.log2(max(4 * dims, dims * dims / 64, 1))) // 2)


def whole(batch: pa.Array, dims: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(places of the kept rows, their integer components, as rows x dims)."""
    lists = batch.cast(pa.large_list(pa.float64()))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.to_numpy(zero_copy_only=False)  # null components become NaN
    lengths, ok = np.diff(offsets), np.asarray(pc.is_valid(lists))
    owner = np.repeat(np.arange(len(lengths)), lengths)
    flat = flat[offsets[0] : offsets[-1]]
    ok = ok & (np.bincount(owner[~np.isfinite(flat)], minlength=len(lengths)) == 0)
    out, used = np.zeros((len(lengths), dims), np.int64), ok[owner]
    at = np.arange(len(owner)) - np.repeat(offsets[:-1] - offsets[0], lengths)
    most = limit(dims)
    out[owner[used], at[used]] = np.clip(np.floor(scale * flat[used]), -most, most).astype(np.int64)
    return np.flatnonzero(ok), out[ok]


def segments(x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums, residual norms about the segment's mean, and widths of `count` consecutive segments of each row."""
    edges = np.linspace(0, x.shape[1], count + 1).astype(int)
    widths = np.diff(edges)
    sums = np.add.reduceat(x, edges[:-1], axis=1)
    spread = widths * np.add.reduceat(x * x, edges[:-1], axis=1) - sums * sums  # exact: width times the squared residual norm
    return sums.astype(float), np.sqrt(spread.astype(float) / widths), widths.astype(float)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index of the nearest entry, ties to the lower; its squared distance; how many exact distances that took) for each row of x."""
    n, d = x.shape
    if not d:
        return np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    slack = 1.0 + 1e-12 * ((x * x).sum(1).astype(float)[:, None] + (book * book).sum(1).astype(float))
    (s, r, w), (t, q, _) = segments(x, 1), segments(book, 1)
    bound = (s - t.T) ** 2 / w + (r - q.T) ** 2
    best = ((x - book[bound.argmin(1)]) ** 2).sum(1)  # the exact distance to the entry with the least coarse bound
    rows, entries = np.nonzero(bound - slack <= best[:, None])
    count = 2
    while 2 * count <= d:  # a level of single components would cost as much as the exact distances
        (s, r, w), (t, q, _) = segments(x, count), segments(book, count)
        bound = ((s[rows] - t[entries]) ** 2 / w + (r[rows] - q[entries]) ** 2).sum(1)
        open_ = bound - slack[rows, entries] <= best[rows]
        rows, entries, count = rows[open_], entries[open_], 2 * count
    exact = ((x[rows] - book[entries]) ** 2).sum(1)
    table = np.full((n, len(book)), np.iinfo(np.int64).max)
    table[rows, entries] = exact
    chosen = table.argmin(1)
    return chosen, table[np.arange(n), chosen], len(rows)


def cut(x: np.ndarray, parts: int) -> Iterator[np.ndarray]:
    return iter(np.split(x, parts, axis=1))


def summed(books: np.ndarray, dims: int, scale: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's counts and sums of components by place in the codebooks (part, entry, position)."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for i in range(0, len(batch), SLICE):
                _, x = whole(batch.slice(i, SLICE).column(0), dims, scale)
                for p, own in enumerate(cut(x, parts)):
                    chosen = nearest(own, books[p])[0]
                    for e in np.unique(chosen):
                        counts[p, e] += (chosen == e).sum()
                        sums[p, e] += own[chosen == e].sum(0)
        used = np.repeat(counts.ravel() > 0, width)
        place = np.flatnonzero(used)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.repeat(counts.ravel(), width)[used]), pa.array(sums.ravel()[used])], names=["place", "n", "total"])

    return run


def coded(books: np.ndarray, dims: int, scale: float, schema: T.StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """vec_id, label, code and error of each kept row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), SLICE):
                piece = batch.slice(i, SLICE)
                kept, x = whole(piece.column(0), dims, scale)
                codes, error = np.zeros((len(kept), len(books)), np.uint8), np.zeros(len(kept), np.int64)
                for p, own in enumerate(cut(x, len(books))):
                    chosen, distance, _ = nearest(own, books[p])
                    codes[:, p], error = chosen, error + distance
                at = pa.array(kept)
                yield pa.RecordBatch.from_arrays([piece.column(1).take(at), piece.column(2).take(at), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], names=schema.names)

    return run


def first_books(vectors: DataFrame, parts: int, entries: int, scale: float) -> tuple[np.ndarray, int] | None:
    """(codebooks from the kept rows with the smallest ids, padded number of components), or None without kept rows."""
    x = F.col("embedding")
    kept = vectors.where(x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    longest = kept.agg(F.max(F.size("embedding"))).first()[0]
    if longest is None:
        return None
    dims = -(-longest // parts) * parts
    seeds = kept.select("vec_id", "embedding").orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).collect()
    _, whole_ = whole(pa.array([r["embedding"] for r in seeds], pa.list_(pa.float64())), dims, scale)
    return np.stack(list(cut(whole_, parts))), dims


def train(vectors: DataFrame, parts: int, entries: int, rounds: int, scale: float) -> tuple[np.ndarray, int] | None:
    """(codebooks as parts x entries x positions, padded number of components)."""
    begun = first_books(vectors, parts, entries, scale)
    if begun is None:
        return None
    books, dims = begun
    for _ in range(rounds if dims else 0):
        found = in_batches(vectors.select("embedding"), summed(books, dims, scale), "place long, n long, total long")
        books = books.copy()
        for place, n, total in found.groupBy("place").agg(F.sum("n"), F.sum("total")).collect():
            books.ravel()[place] = total // n
    return books, dims


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each kept row."""
    vectors = vectors.select(F.col("embedding").cast("array<double>").alias("embedding"), "vec_id", "label")
    out = T.StructType([vectors.schema["vec_id"], vectors.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    trained = train(vectors, parts, entries, rounds, scale)
    if trained is None:
        empty = vectors.sparkSession.createDataFrame([], out)
        return empty.select("vec_id", "code", "error", F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    books, dims = trained
    rows = saved(in_batches(vectors, coded(books, dims, scale, out), out), "vector-codes")
    by_label = rows.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    both = rows.join(by_label, F.col("label").eqNullSafe(F.col("of_label")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
