"""N-gram Jaccard self-join by PartEnum signatures, and the groups that its links form.

A document is the set of its distinct k-word shingles. Two sets of sizes a <= b with 100 * |A & B| >= threshold * |A | B|
differ in at most (100 - threshold) * a / threshold elements, and b <= 100 * a / threshold. Sizes fall in bands, each
reaching from its least size to 100 / threshold times that, so a pair lies in one band or in two neighbouring ones; each set signs
for its own band and for the one below. For a band, the domain of hashed shingles is cut into n1 partitions of n2 cells.
At least n1 - floor(k / (k2 + 1)) partitions hold at most k2 of the k differences, so there the two sets agree on some
n2 - k2 cells. A signature is the content of such a subset of cells. (Small bands enumerate the pairs out of three cells with
k2 = 1; in larger ones single cells are selective enough, k2 = 0.)

Nearly empty subsets would bring unrelated sets together. So there are more partitions than k alone asks for, and of the m that
must agree each set leaves out its m - 1 smallest subsets, in the order of their sizes, then of their places. Subsets that agree are equally
large in both sets, and the largest of m or more can't be among the m - 1 smallest of either, so no pair is lost. Bands in which
linked sets are equal need no signature.

Sets that are equal are one node from the start. What meets in buckets of equal signatures falls into clusters around the
sets that share most with others. Each member of a cluster is compared with its centre first, which is linear; only members that aren't linked to
it are then compared with the others, in blocks within tasks, which return only the edges of a spanning forest.
Before that, sizes and small sketches of the sets rule out most members that share a signature by chance, by exact lower bounds, so few texts are read again.
Then what buckets hold across clusters is compared, unless it is joined already: small buckets as pairs, others in blocks again. So no group is expanded into rows for all its pairs, and no link is lost.

A signature that many sets of one task share is dealt over keys of its own, one for each task's buffer, with one row for the common key; what is said of
a bucket is pre-aggregated and joined, so that adaptive plans can split it. No signature or bucket is in one task as a whole.
Shingles are compared by 64-bit hashes, and sets are taken as equal by 64-bit digests: among 10^9 different sets the chance of a wrong merge is 3 %.

Defined cases: null or empty text, or no words: size 0, a component of its own. Fewer words than k: the whole sequence
is the one shingle. Rows with equal doc_id count as texts of one document id; a null doc_id is linked like others and is
passed over by the minimum, unless the whole component has none. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Ids of texts to compare that are sent to all executors at most (8 bytes each); beyond it the join shuffles.
BROADCAST_IDS = 1_000_000
#: Parts of the domain that a sketch counts; a power of two.
SKETCH = 64
#: Members of a bucket beyond which it is passed on without a look at its sketches. (A parameter of speed alone, as are all of these.)
SKETCHED = 4096
#: Sets in a task's buffer that share a signature, from which on it is dealt over keys of its own.
HOT = 64
#: Signatures that a task holds back to find such ones.
BUFFER = 1_000_000
#: Digests of sets that a task remembers so as not to sign equal ones again.
REMEMBERED = 200_000
#: Members of a bucket whose pairs across clusters are compared as rows; those of larger buckets are compared in blocks.
PAIRED = 32


class Bands:
    """For each size the band, and for each band the number of cells and differences."""

    def __init__(self, threshold: int, enumerated: int = 8):
        """enumerated: differences up to which a band enumerates pairs of cells (k2 = 1)."""
        self.threshold, self.enumerated, self.highs = threshold, enumerated, [0]

    def band(self, size: int) -> int:
        while self.highs[-1] < size:
            self.highs.append((self.highs[-1] + 1) * 100 // self.threshold)
        return int(np.searchsorted(self.highs, size))

    def shape(self, band: int) -> tuple[int, int, int, int, int]:
        """(differences at most, n1, n2, k2, partitions that agree at least)."""
        self.band(self.highs[-1] + 1) if band >= len(self.highs) else None
        most = (100 - self.threshold) * self.highs[band] // self.threshold
        k2, n2 = (1, 3) if most <= self.enumerated else (0, 1)
        lost = most // (k2 + 1)
        agree = 1 + lost // 4
        return most, lost + agree, n2, k2, agree


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct shingle hashes."""
    for i, j, data, offsets in common.slices(column):
        data = common.lower_ascii(data)
        starts, ends, first = common.words(data, offsets)
        hashes = common.word_hashes(data, starts, ends)
        for r in range(j - i):
            yield np.unique(common.windows(hashes[first[r] : first[r + 1]], k))


def digest(shingles: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        h = common.mix(common.mix(shingles + np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64, keepdims=True) ^ np.uint64(len(shingles)))
    return int(h.view(np.int64)[0])


def signatures(shingles: np.ndarray, bands: Bands) -> np.ndarray:
    """The signatures of one set, for its own band and the one below."""
    n, out = len(shingles), []
    own = bands.band(n)
    mixed = common.mix(shingles ^ np.uint64(0x5851F42D4C957F2D))
    for band in (own, own - 1) if own > 1 else (own,):
        most, n1, n2, k2, agree = bands.shape(band)
        if not most:
            continue
        cells = n1 * n2
        cell = ((shingles >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)  # not decreasing, as shingles are sorted
        edges = np.searchsorted(cell, np.arange(cells + 1, dtype=np.uint64))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)))
        content = (sums[edges[1:]] - sums[edges[:-1]]).reshape(n1, n2)
        count = np.diff(edges).reshape(n1, n2)
        subsets = list(combinations(range(n2), n2 - k2))
        order = np.stack([count[:, s].sum(1) for s in map(list, subsets)]).ravel() * (n1 * len(subsets)) + np.arange(n1 * len(subsets))
        salt, found = np.arange(n1, dtype=np.uint64), []
        for c, s in enumerate(subsets):
            h = salt + np.uint64(1 + band * 1_000_003 + c * 500_009_003)
            for x in s:
                h = common.mix(h) + content[:, x]
            found.append(common.mix(h))
        out.append(np.concatenate(found)[np.argpartition(order, agree - 1)[agree - 1 :]])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sketch(shingles: np.ndarray) -> bytes:
    """How many shingles fall in each of SKETCH parts of the domain (255 at most): for two sets, the differences of these counts sum to no more than the elements in which they differ."""
    part = (common.mix(shingles) >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64)
    return np.minimum(np.bincount(part, minlength=SKETCH), 255).astype(np.uint8).tobytes()


def row_key(id_col: str, text_col: str) -> Column:
    """A hash of a row's id and text."""
    text = F.col(text_col).cast("string")
    return F.xxhash64(F.col(id_col).cast("long"), F.col(id_col).isNull(), text, text.isNull())


def sets(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document its key, its number of shingles, the digest of its set and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shingle_sets(batch.column(2), k))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in found], pa.int64()), pa.array([digest(s) for s in found], pa.int64()), pa.array([sketch(s) for s in found], pa.binary())], ["doc_id", "key", "n_shingles", "node", "sketch"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    return slim.transform(common.in_batches, run, "doc_id long, key long, n_shingles long, node long, sketch binary")


def signed(docs: DataFrame, k: int, threshold: int, text_col: str = "text", hot: int = HOT, enumerated: int = 8) -> DataFrame:
    """(sig, salt, mark, node) of all distinct sets; equal sets met in one task sign once. salt is 0, but for signatures that `hot` sets or more of a task's buffer share: their rows have a salt of the buffer's own (taken from them, so that a task that runs again gives the same), and one of them comes again without salt but with a mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(threshold, enumerated), set()
        sig, node, rows = [], [], 0
        for batch in batches:
            for s in shingle_sets(batch.column(0), k):
                if not len(s) or (d := digest(s)) in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(d)
                sig.append(signatures(s, bands))
                node.append(np.full(len(sig[-1]), d, np.int64))
                rows += len(sig[-1])
                if rows > BUFFER:
                    yield from salted(np.concatenate(sig).view(np.int64), np.concatenate(node))
                    sig, node, rows = [], [], 0
        if sig:
            yield from salted(np.concatenate(sig).view(np.int64), np.concatenate(node))

    def salted(sig: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(sig, kind="stable")
        first = np.flatnonzero(np.diff(sig[order], prepend=sig[order[:1]] - 1))
        count = np.diff(first, append=len(sig))
        again = order[first[count >= hot]]
        salt = np.empty_like(node)  # rows keep their order, in which a set's are together and compress well
        salt[order] = np.where(np.repeat(count, count) >= hot, np.repeat(node[order[first]] | 1, count), 0)
        mark = np.arange(len(sig) + len(again)) >= len(sig)
        sig, node, salt = np.concatenate((sig, sig[again])), np.concatenate((node, node[again])), np.concatenate((salt, np.zeros(len(again), np.int64)))
        for i in range(0, len(sig), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in (sig, salt, mark, node)], ["sig", "salt", "mark", "node"])

    return docs.select(F.col(text_col).cast("string").alias("text")).transform(common.in_batches, run, "sig long, salt long, mark boolean, node long")


def buckets(signed_rows: DataFrame) -> DataFrame:
    """(bucket, node) of the buckets with two nodes or more. Buckets with the same members become one; should others fall together too, that only adds comparisons.
    Where some rows of a signature have a salt, its rows without one hold a mark, and the signature itself names the bucket of all of them."""
    w = Window.partitionBy("sig", "salt")
    rows = signed_rows.withColumns({"low": F.min("node").over(w), "high": F.max("node").over(w), "all": F.bit_xor(F.xxhash64("node")).over(w), "hot": (F.col("salt") != 0) | F.max("mark").over(w)})
    return rows.where("low < high or hot").select(F.when(F.col("hot"), F.xxhash64("sig")).otherwise(F.xxhash64("all", "low", "high")).alias("bucket"), "node").distinct()


def may_link(sizes: np.ndarray, counts: np.ndarray, threshold: int) -> np.ndarray:
    """For each member of a bucket whether its size and sketch leave room for a link to another."""
    n, out = len(sizes), np.zeros(len(sizes), bool)

    def fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.minimum(sizes[a][:, None], sizes[b][None, :]), np.maximum(sizes[a][:, None], sizes[b][None, :])
        apart = np.abs(counts[a][:, None, :] - counts[b][None, :, :]).sum(2, dtype=np.int64)
        return (100 * low >= threshold * high) & ((100 + threshold) * apart <= (100 - threshold) * (low + high)) & (a[:, None] != b[None, :])

    some = np.arange(min(n, 64))
    for others in (some, np.arange(n)):  # most members of a large bucket fit one of a few
        left = np.flatnonzero(~out)
        for i in range(0, len(left), 64):
            for j in range(0, len(others), 2048):
                f = fits(left[i : i + 64], others[j : j + 2048])
                out[left[i : i + 64]] |= f.any(1)
                out[others[j : j + 2048]] |= f.any(0)
        if n <= len(some):
            break
    return out


def viable(members: DataFrame, sketched: DataFrame, threshold: int, most: int = SKETCHED) -> DataFrame:
    """(bucket, node) of the members that may be linked to another member of their bucket, by the lower bounds of sizes and sketches (node, n_shingles, sketch). Buckets of more than `most` members stay whole, and aren't brought into one task."""

    def judge(bucket: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        edges = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
        length, out = np.diff(edges), np.ones(len(bucket), bool)
        two = edges[:-1][length == 2]
        low, high = np.minimum(sizes[two], sizes[two + 1]), np.maximum(sizes[two], sizes[two + 1])
        apart = np.abs(counts[two] - counts[two + 1]).sum(1, dtype=np.int64)
        out[two] = out[two + 1] = (100 * low >= threshold * high) & ((100 + threshold) * apart <= (100 - threshold) * (low + high))
        out[edges[:-1][length == 1]] = False
        for g in np.flatnonzero(length > 2):
            a, b = edges[g], edges[g + 1]
            out[a:b] = may_link(sizes[a:b], counts[a:b], threshold)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the rows of the last bucket, which may go on in the next batch
        for batch in batches:
            counts = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, SKETCH).astype(np.int16)
            now = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), counts]
            if held is not None:
                now = [np.concatenate((h, x)) for h, x in zip(held, now, strict=True)]
            last = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            done, held = [x[:last] for x in now], [x[last:] for x in now]
            if len(done[0]):
                keep = judge(done[0], done[2], done[3])
                yield pa.RecordBatch.from_arrays([pa.array(done[0][keep]), pa.array(done[1][keep])], ["bucket", "node"])
        if held is not None and len(held[0]):
            keep = judge(held[0], held[2], held[3])
            yield pa.RecordBatch.from_arrays([pa.array(held[0][keep]), pa.array(held[1][keep])], ["bucket", "node"])

    sizes = members.groupBy("bucket").agg(F.count("*").alias("size"))
    sized = members.join(sizes, "bucket")
    rows = sized.where(F.col("size") <= most).join(sketched.select("node", "n_shingles", "sketch"), "node").select("bucket", "node", "n_shingles", "sketch")
    judged = rows.repartition("bucket").sortWithinPartitions("bucket").transform(common.in_batches, run, "bucket long, node long")
    return judged.unionByName(sized.where(F.col("size") > most).select("bucket", "node"))


def shingles_of(docs: DataFrame, reps: DataFrame, k: int, id_col: str, text_col: str, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """(node, shingles), one row for each node of the documents that stand for theirs, however often rows repeat. (Another text of such an id comes along as a node of its own.)"""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    wanted = reps.select("doc_id")
    if wanted.count() <= broadcast_ids:
        wanted = F.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            found = {}
            for s in shingle_sets(batch.column(0), k):
                if (d := digest(s)) not in seen:
                    found[d] = s
                    seen.add(d)
            if len(seen) >= REMEMBERED:
                seen.clear()
            if not found:
                continue
            ends, values = np.cumsum([0, *map(len, found.values())]), pa.array(np.concatenate(list(found.values())).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), values).cast(pa.list_(pa.int64()))], ["node", "shingles"])

    found = slim.join(wanted, slim.doc_id.eqNullSafe(wanted.doc_id), "left_semi").select("text").transform(common.in_batches, run, "node long, shingles array<long>")
    return found.dropDuplicates(["node"])


def compared(pairs: DataFrame, shingles: DataFrame, threshold: int) -> DataFrame:
    """pairs (a, b) with linked: whether the sets of a and b are similar enough."""
    left, right = shingles.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), shingles.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", (100 * both >= threshold * (F.size("sa") + F.size("sb") - both)).alias("linked"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of edges (a, b): root is the smallest node that can be reached. Each round takes the least root of the neighbours, then follows it twice."""
    both = common.saved(edges.select("a", "b").union(edges.select("b", "a")), "edges")
    roots = common.saved(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "roots")
    while True:
        near = both.join(roots, both.b == roots.node).groupBy("a").agg(F.min("root").alias("near"))
        better = roots.join(near, roots.node == near.a, "left").select("node", "root", F.least("root", "near").alias("next"))
        hop = roots.select(F.col("node").alias("next"), F.col("root").alias("far"))
        after = common.saved(better.join(hop, "next", "left").select("node", F.least("next", "far").alias("root"), (F.least("next", "far") < F.col("root")).alias("moved")), "roots")
        roots = after.select("node", "root")
        if after.where("moved").isEmpty():
            return roots


def clusters(members: DataFrame) -> DataFrame:
    """(node, cluster): each node goes to the node that shares most with others among all that it meets in its buckets; that one is in its own cluster too."""
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size"))
    weight = members.join(sizes, "bucket").groupBy("node").agg(F.sum("size").alias("weight"))
    tops = members.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node")).alias("top"))
    own = members.join(tops, "bucket").groupBy("node").agg(F.max("top").alias("top")).select("node", F.col("top.node").alias("cluster"))
    return own.union(own.select(F.col("cluster").alias("node"), "cluster")).distinct()


def linked_in_block(nodes: list[int], sets_: list[np.ndarray], threshold: int) -> list[tuple[int, int]]:
    """Edges that join the linked among the sets: each set's edge leads to the least of its component."""
    sizes = np.array([len(s) for s in sets_])
    n = len(sets_)
    _, inverse, count = np.unique(np.concatenate(sets_), return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(n), sizes), count[inverse] > 1  # an element of one set alone is in no intersection
    column = np.cumsum(count > 1)[inverse[shared]] - 1
    row = row[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((n, n), np.float32)
    width = 4096
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (lo, lo + width))
        part = np.zeros((n, width), np.float32)
        part[row[a:b], column[a:b] - lo] = 1
        both += part @ part.T
    linked = 100 * both.astype(np.int64) >= threshold * (sizes[:, None] + sizes[None, :] - both.astype(np.int64))
    np.fill_diagonal(linked, True)
    label = np.arange(n)
    while True:
        after = np.where(linked, label[None, :], n).min(1)
        after = np.minimum(after, after[after])
        if (after == label).all():
            return [(nodes[i], nodes[k]) for i, k in enumerate(label) if i != k]
        label = after


def against_centres(clustered: DataFrame, plan: DataFrame, shingles: DataFrame, threshold: int) -> DataFrame:
    """(cluster, own, node, centre, linked) of all members but the centres. Members stay where they are dealt to, and the centre comes to each block of its cluster."""
    members = clustered.join(plan, "cluster").where("node <> centre").select("cluster", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own"), "node", F.lit(1).alias("place"))
    centres = plan.where("n > 1").select("cluster", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"), F.col("centre").alias("node"), F.lit(0).alias("place"))
    rows = members.unionByName(centres).join(shingles, "node").select("cluster", "own", "node", "place", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, np.zeros(0, np.int64)
        for batch in batches:
            cluster, block, node, place = (batch.column(c).to_pylist() for c in range(4))
            values, ends = batch.column(4).flatten().to_numpy(), np.cumsum(batch.column(4).value_lengths().to_numpy())
            out: list[list] = [[], [], [], [], []]
            for r, end in enumerate(ends):
                found = values[ends[r - 1] if r else 0 : end]
                if not place[r]:
                    centre, own = node[r], found.copy()
                    continue
                both = len(np.intersect1d(own, found, assume_unique=True)) if min(len(own), len(found)) * 100 >= threshold * max(len(own), len(found)) else 0
                for column, x in zip(out, (cluster[r], block[r], node[r], centre, 100 * both >= threshold * (len(own) + len(found) - both)), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["cluster", "own", "node", "centre", "linked"])

    return rows.repartition("cluster", "own").sortWithinPartitions("cluster", "own", "place").transform(common.in_batches, run, "cluster long, own int, node long, centre long, linked boolean")


def links_in_blocks(placed: DataFrame, shingles: DataFrame, threshold: int) -> DataFrame:
    """Edges (a, b) that join what is linked among the members of each block (cluster, i, j, node), the same ones each time they are computed."""
    rows = placed.join(shingles, "node").select("cluster", "i", "j", "node", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, found, edges = None, [], [], []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
            values, ends = batch.column(4).flatten().to_numpy(), np.cumsum(batch.column(4).value_lengths().to_numpy())
            for r, (k, node) in enumerate(zip(keys, batch.column(3).to_pylist(), strict=True)):
                if k != key:
                    if len(nodes) > 1:
                        edges += linked_in_block(nodes, found, threshold)
                    key, nodes, found = k, [], []
                if not nodes or nodes[-1] != node:  # a member of both sides of a block comes twice
                    nodes.append(node)
                    found.append(values[ends[r - 1] if r else 0 : ends[r]])
            if len(edges) > 10_000:
                yield edge_batch(edges)
                edges = []
        if len(nodes) > 1:
            edges += linked_in_block(nodes, found, threshold)
        if edges:
            yield edge_batch(edges)

    def edge_batch(edges: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])

    return rows.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "node").transform(common.in_batches, run, "a long, b long")


def links_in_clusters(clustered: DataFrame, shingles: DataFrame, sizes: DataFrame, threshold: int, block_sets: int = 1000, block_shingles: int = 1_000_000) -> DataFrame:
    """Edges (a, b) that join what is linked within each cluster. All members are compared with the centre (the node that names the cluster, else its least member). Those that it isn't linked to are
    compared with all members: dealt out in blocks of their own, each of which meets each block of the cluster, or, if they are most of it, each two blocks of the cluster meet."""
    sized = clustered.join(sizes.select("node", "n_shingles"), "node")
    blocks = lambda n, x: F.greatest(F.ceil(n / block_sets), F.ceil(x / block_shingles)).cast("int")
    centre = F.coalesce(F.max(F.when(F.col("node") == F.col("cluster"), F.col("node"))), F.min("node"))
    plan = common.saved(sized.groupBy("cluster").agg(F.count("*").alias("n"), blocks(F.count("*"), F.sum("n_shingles")).alias("blocks"), centre.alias("centre")), "plan")
    stars = common.saved(against_centres(clustered, plan, shingles, threshold), "stars")
    edges = stars.where("linked").select(F.col("centre").alias("a"), F.col("node").alias("b"))
    left = stars.where("not linked").select("cluster", "own", "node")
    if left.isEmpty():
        return edges
    lefts = left.join(sizes.select("node", "n_shingles"), "node").groupBy("cluster").agg(F.count("*").alias("m"), blocks(F.count("*"), F.sum("n_shingles")).alias("rows"))
    lefts = common.saved(plan.join(lefts, "cluster").where("n > 2").withColumn("most", 2 * F.col("m") > F.col("n")), "left")
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    open_ = stars.select("cluster", "own", "node").join(lefts, "cluster")  # the centre is settled
    two = open_.where("most").withColumn("other", F.explode(every("blocks"))).select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node")
    few = lefts.where("not most").select("cluster", "rows", "blocks")
    down = open_.where("not most").select("cluster", F.explode(every("rows")).alias("i"), F.col("own").alias("j"), "node")
    across = left.join(few, "cluster").select("cluster", F.pmod(F.xxhash64("node"), F.col("rows")).cast("int").alias("i"), F.explode(every("blocks")).alias("j"), "node")
    return edges.union(links_in_blocks(two.unionByName(down).unionByName(across), shingles, threshold))


def linked_components(members: DataFrame, shingles: DataFrame, sizes: DataFrame, clustered: DataFrame, threshold: int, paired: int = PAIRED) -> DataFrame:
    """(node, root) of the nodes that are linked to others. Clusters are settled first; then what buckets hold across clusters and components is compared: as pairs, or in blocks where more than paired members meet."""
    links = common.saved(links_in_clusters(clustered, shingles, sizes, threshold), "links")
    roots = components(links)
    own = clustered.groupBy("node").agg(F.max("cluster").alias("cluster"), F.min("cluster").alias("least"))
    named = members.join(own, "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    span = named.groupBy("bucket").agg(F.count("*").alias("n"), *(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("cluster", "root")))
    span = span.where("min_root < max_root and min_cluster < max_cluster").select("bucket", "n")
    open_ = common.saved(named.join(span, "bucket").select("bucket", "node", "root", "cluster", "least", "n"), "open")
    few, many = open_.where(F.col("n") <= paired), open_.where(F.col("n") > paired).select("node", F.col("bucket").alias("cluster"))
    left, right = (few.select("bucket", *(F.col(c).alias(c + x) for c in ("node", "root", "cluster", "least"))) for x in "ab")
    apart = "roota < rootb and clustera <> clusterb and clustera <> leastb and leasta <> clusterb and leasta <> leastb"
    pairs = left.join(right, "bucket").where(apart).select(F.col("nodea").alias("a"), F.col("nodeb").alias("b")).distinct()
    found = compared(pairs, shingles, threshold).where("linked").select("a", "b").union(links_in_clusters(many, shingles, sizes, threshold))
    across = common.saved(found, "across")
    return roots if across.isEmpty() else components(links.union(across))


def classified(docs: DataFrame, k: int, threshold: int, id_col: str = "doc_id", text_col: str = "text", enumerated: int = 8, sketched: int = SKETCHED, paired: int = PAIRED, hot: int = HOT, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """doc_id, key, n_shingles, root (of the row's class; null for a text without words), component_id."""
    per_doc = common.saved(sets(docs, k, id_col, text_col), "sets")
    equal = {"n_shingles": F.min("n_shingles"), "sketch": F.min("sketch")}  # the same for all documents of a node
    classes = common.saved(per_doc.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), *(c.alias(n) for n, c in equal.items())), "classes")
    members = common.saved(viable(common.saved(buckets(signed(docs, k, threshold, text_col, hot, enumerated)), "met"), classes, threshold, sketched), "buckets")
    reps = common.saved(classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "doc_id"), "reps")
    shingles = common.saved(shingles_of(docs, reps, k, id_col, text_col, broadcast_ids), "shingles")
    roots = linked_components(members, shingles, classes, common.saved(clusters(members), "clusters"), threshold, paired)
    named = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_node = named.join(least, "root").select("node", "root", "component_id")
    alone = per_doc.where("n_shingles = 0").select("doc_id", "key", "n_shingles", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id"))
    return per_doc.where("n_shingles > 0").join(of_node, "node").select("doc_id", "key", "n_shingles", "root", "component_id").unionByName(alone)


def jaccard_join(docs: DataFrame, k: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text", **speed: int) -> DataFrame:
    """doc_id, n_shingles, component_id: the classes of documents that links of threshold per cent or more form. speed: the parameters of `classified` from enumerated on (see Bands, viable, linked_components, signed, shingles_of), which never decide the result."""
    return classified(docs, k, threshold, id_col, text_col, **speed).select("doc_id", "n_shingles", "component_id")


def first_of_classes(docs: DataFrame, k: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text", **speed: int) -> DataFrame:
    """The rows of docs, one for each class: that with the smallest id, rows without one last, then by a hash of the text. Of rows with equal id and text one stays; texts without words are classes of their own. All columns stay."""
    found = classified(docs, k, threshold, id_col, text_col, **speed)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first")
    (key,) = common.fresh(docs, "_key")
    keep = found.groupBy("root", F.when(F.col("root").isNull(), F.col("key")).alias("own")).agg(first).select(F.col("first.key").alias(key)).distinct()
    same = Window.partitionBy(key, id_col).orderBy(key)
    (place,) = common.fresh(docs, "_place")
    kept = docs.withColumn(key, row_key(id_col, text_col)).join(keep, key, "left_semi")
    return kept.withColumn(place, F.row_number().over(same)).where(F.col(place) == 1).select(docs.columns)
