"""Sessions as a stream: each lives `ttl` seconds, and at most `cap` of all live at once, the newest.

The stream drops sessions that it has seen (state goes with the watermark) and hands each batch to a store. The store keeps sessions in folders by bucket of their time, and counts by bucket in its manifest, so which sessions live is settled on
the counts: buckets that are over as a whole, by age or by the cap, are no longer named, and only the bucket at the cap's edge is ranked. Nothing is rewritten, and the counts are at most ttl / width numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.versions import Versions
from ..work import work_path


class Sessions:
    def __init__(self, spark: SparkSession, path: str, ttl: int = 3600, cap: int = 10_000, width: int = 10):
        self.log, self.ttl, self.cap, self.width = Versions(spark, path), ttl, cap, width

    def take(self, batch: DataFrame, batch_id: int) -> None:
        """Adds a batch of new sessions (session_id, created_at, ...) once, and drops buckets that are over."""
        before = self.log.newest()
        if before.facts.get("batch", -1) >= batch_id:
            return
        second = F.floor(F.col("created_at").cast("timestamp").cast("double"))
        rows, folder = batch.withColumn("b", F.floor(second / self.width).cast("long")), self.log.new_folder()
        newest = rows.agg(F.max("created_at").cast("timestamp").cast("double")).first()[0]
        now = max(before.facts.get("now", 0.0), newest or 0.0)
        live = rows.where(F.col("b") >= int((now - self.ttl) // self.width))  # what is too old when it comes leaves no trace
        live.repartition("b", F.pmod(F.xxhash64("session_id"), F.lit(4))).write.partitionBy("b").parquet(f"{self.log.path}/{folder}")
        counts = {int(b): n for b, n in before.facts.get("counts", {}).items()}
        folders = dict(before.folders)
        written = self.log.spark.read.schema(live.schema).parquet(f"{self.log.path}/{folder}")
        for b, n in written.groupBy("b").count().collect():
            counts[b] = counts.get(b, 0) + n
            folders[str(b)] = [*folders.get(str(b), []), f"{folder}/b={b}"]
        kept, total = {}, 0
        for b in sorted(counts, reverse=True):
            if total >= self.cap or (b + 1) * self.width <= now - self.ttl:
                break
            kept[b], total = counts[b], total + counts[b]
        self.log.commit(before, {str(b): folders[str(b)] for b in kept}, {"batch": batch_id, "now": now, "counts": kept})

    def live(self, now: float | None = None) -> DataFrame | None:
        """The sessions that live at a time (in seconds; by default that of the newest session)."""
        version = self.log.newest()
        now = version.facts.get("now", 0.0) if now is None else now
        counts = {int(b): n for b, n in version.facts.get("counts", {}).items()}
        whole, edge, left = [], None, self.cap
        for b in sorted(counts, reverse=True):
            if counts[b] > left:
                edge = b
                break
            whole.append(b)
            left -= counts[b]
        young = now - F.col("created_at").cast("timestamp").cast("double") < self.ttl
        folders = lambda bs: [f for b in bs for f in version.folders[str(b)]]
        out = self.log.read(folders(whole))
        if edge is not None and left:
            ranked = self.log.read(folders([edge])).orderBy(F.desc("created_at"), F.desc("session_id")).limit(left)
            out = ranked if out is None else out.unionByName(ranked)
        return None if out is None else out.where(young)


def keep_sessions(opened: DataFrame, store: Sessions, checkpoint: str | None = None) -> StreamingQuery:
    """Starts the stream of opened sessions (session_id, created_at as a timestamp, ...) into the store; a session that comes twice counts once."""
    once = opened.withWatermark("created_at", f"{store.ttl} seconds").dropDuplicatesWithinWatermark(["session_id"])
    checkpoint = checkpoint or work_path(opened.sparkSession, "sessions-state")
    return once.writeStream.foreachBatch(store.take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
