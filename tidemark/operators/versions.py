"""Tables in versions behind manifests. A version is a small file that names the folders of Parquet which make up the table; readers take the newest whole one, so they see a change entirely or not at all, and a failed
writer leaves nothing but folders that no manifest names.

`Versions` is the manifest log with exclusive commits; on it stand
  * `Derived`: rows derived for users, replaced for some users at a time, users without rows included;
  * `Latest`: the newest row of each key, as a base and the tail of a log, merged by compaction;
  * `Outbox`: rows appended once for each batch id, whatever is replayed;
  * `single_flight`: a snapshot that one of many drivers computes while the others read the last.

Derived rows and bases lie in hash buckets, so a change rewrites the buckets that it touches and names the others' folders again."""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..work import Files

log = logging.getLogger(__name__)
#: Seconds after which a manifest that can't be read counts as a dead writer's.
STALE = 60.0


class Conflict(RuntimeError):
    """Another writer has committed meanwhile; read again and retry."""


@dataclass
class Version:
    number: int = 0
    #: Folders by what they hold: a bucket's number, or the number of a log segment.
    folders: dict[str, list[str]] = field(default_factory=dict)
    facts: dict = field(default_factory=dict)


class Versions:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)

    @staticmethod
    def _name(number: int) -> str:
        return f"manifests/{number:012d}.json"

    def _numbers(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names("manifests") if n.endswith(".json")]

    def _read(self, number: int) -> Version | None:
        try:
            found = json.loads(self.files.read(self._name(number)) or "")
        except ValueError:  # not whole yet, or never
            return None
        return Version(number, found["folders"], found["facts"])

    def newest(self) -> Version:
        """The newest whole version; number 0 if there is none."""
        return next((v for n in reversed(self._numbers()) if (v := self._read(n))), Version())

    def new_folder(self) -> str:
        return f"data/{uuid.uuid4().hex}"

    def read(self, folders: list[str]) -> DataFrame | None:
        return self.spark.read.parquet(*(f"{self.path}/{f}" for f in folders)) if folders else None

    def commit(self, before: Version, folders: dict[str, list[str]], facts: dict) -> Version:
        """The version that follows `before`; Conflict if there is another one already."""
        number = before.number + 1
        while True:
            if self.files.create(self._name(number), json.dumps({"folders": folders, "facts": facts})):
                return Version(number, folders, facts)
            dead = self._read(number) is None and time.time() - self.files.changed(self._name(number)) > STALE
            if not dead:
                raise Conflict(f"version {number} of {self.path} is taken")
            number += 1

    def clear(self, keep: int = 2) -> int:
        """Deletes all but the newest versions, and folders that none of these names; returns how many folders. Not to be called while a writer is at work."""
        numbers = self._numbers()
        kept = [v for n in numbers if (v := self._read(n))][-keep:]
        named = {f for v in kept for fs in v.folders.values() for f in fs}
        for n in numbers:
            if kept and n < kept[0].number:
                self.files.delete(self._name(n))
        gone = [f for f in (f"data/{n}" for n in self.files.names("data")) if f.split("/b=")[0] not in {x.split("/b=")[0] for x in named}]
        for f in gone:
            self.files.delete(f)
        return len(gone)


class Buckets:
    """Rows in hash buckets of a key."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.log, self.key, self.buckets = Versions(spark, path), key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[str]:
        """The buckets of the rows' keys: as many as there are buckets at most."""
        return sorted(str(r[0]) for r in rows.select(self.bucket()).distinct().collect())

    def rewritten(self, rows: DataFrame, touched: list[str], before: dict[str, list[str]]) -> dict[str, list[str]]:
        """Folders by bucket after the touched ones hold `rows` (and nothing else). Each bucket's rows may be written by several tasks."""
        folder = self.log.new_folder()
        rows.withColumn("b", self.bucket()).repartition("b", F.pmod(F.xxhash64(*rows.columns), F.lit(4))).write.partitionBy("b").parquet(f"{self.log.path}/{folder}")
        after = {b: f for b, f in before.items() if b not in touched}
        written = {n[2:] for n in self.log.files.names(folder) if n.startswith("b=")}
        return after | {b: [f"{folder}/b={b}"] for b in touched if b in written}

    def read(self, version: Version, only: list[str] | None = None) -> DataFrame | None:
        found = [f for b, fs in version.folders.items() for f in fs if b.isdigit() and (only is None or b in only)]
        return self.log.read(found)


class Derived(Buckets):
    """Rows derived for each user, such as positions. What `replace` is told of users replaces all that there was of them: a user without new rows is gone."""

    def __init__(self, spark: SparkSession, path: str, key: str = "user_id", buckets: int = 64):
        super().__init__(spark, path, key, buckets)

    def replace(self, rows: DataFrame, users: DataFrame) -> Version:
        """rows: what now holds for users (one row a user); rows of other users aren't allowed."""
        before = self.log.newest()
        users = users.select(self.key).distinct()
        touched = self.touched(users)
        old = self.read(before, touched)
        new = rows.join(users, self.key, "left_semi")
        if old is not None:
            new = old.join(users, self.key, "left_anti").unionByName(new)
        return self.log.commit(before, self.rewritten(new, touched, before.folders), before.facts)

    def rows(self) -> DataFrame | None:
        return self.read(self.log.newest())


class Latest(Buckets):
    """The newest row of each key by `order` (a column, ties by the row's content), kept as a base in buckets and the segments appended since."""

    def __init__(self, spark: SparkSession, path: str, key: str, order: str, buckets: int = 64):
        super().__init__(spark, path, key, buckets)
        self.order = order

    def newest_of(self, rows: DataFrame) -> DataFrame:
        """One row for each key: an aggregate with partial results, no sort of the log."""
        row = F.struct(self.order, *(c for c in rows.columns if c not in (self.key, self.order)))
        return rows.groupBy(self.key).agg(F.max(row).alias("r")).select(self.key, "r.*").select(rows.columns)

    def _segments(self, version: Version) -> list[str]:
        return [f for s, fs in version.folders.items() if s.startswith("log") for f in fs]

    def append(self, rows: DataFrame) -> Version:
        before, folder = self.log.newest(), self.log.new_folder()
        rows.write.parquet(f"{self.log.path}/{folder}")
        return self.log.commit(before, before.folders | {f"log{before.number + 1}": [folder]}, before.facts)

    def compact(self) -> Version:
        """Merges the tail into the buckets that it touches; all other buckets stay as they are and aren't read."""
        before = self.log.newest()
        tail = self.log.read(self._segments(before))
        if tail is None:
            return before
        touched, base = self.touched(tail), {b: f for b, f in before.folders.items() if b.isdigit()}
        old = self.read(before, touched)
        merged = self.newest_of(tail if old is None else old.unionByName(tail))
        return self.log.commit(before, self.rewritten(merged, touched, base), before.facts)

    def rows(self) -> DataFrame | None:
        """The newest rows, with what isn't compacted yet."""
        now = self.log.newest()
        base, tail = self.read(now), self.log.read(self._segments(now))
        if tail is None:
            return base
        return self.newest_of(tail if base is None else base.unionByName(tail))


class Outbox:
    """Rows appended exactly once for each (source, batch id) of a stream: what `foreachBatch` hands over again is left out."""

    def __init__(self, spark: SparkSession, path: str):
        self.log = Versions(spark, path)

    def put(self, rows: DataFrame, batch: int, source: str = "stream") -> bool:
        """False if the batch is there already. Batch ids of a source ascend."""
        before, folder = self.log.newest(), self.log.new_folder()
        done = before.facts.get("done", {})
        if done.get(source, -1) >= batch:
            return False
        rows.write.parquet(f"{self.log.path}/{folder}")
        self.log.commit(before, before.folders | {f"log{before.number + 1}": [folder]}, before.facts | {"done": done | {source: batch}})
        return True

    def rows(self) -> DataFrame | None:
        return self.log.read([f for fs in self.log.newest().folders.values() for f in fs])


def single_flight(spark: SparkSession, path: str, ttl: float, compute: Callable[[], DataFrame], lease: float = 600.0, now: Callable[[], float] = time.time, wait: float = 1.0, keep: int = 2) -> DataFrame:
    """The snapshot under path if it is younger than ttl seconds. Else one caller, the holder of a claim that runs out after `lease` seconds, computes the next version; the others get the last one meanwhile, or wait if there is none.
    If the computation fails, the claim is given back and the last snapshot is given; if there is none, the failure is raised."""
    log_ = Versions(spark, path)
    while True:
        last = log_.newest()
        stale = log_.read(last.folders.get("snapshot", []))
        if last.number and now() - last.facts["at"] < ttl:
            return stale
        claim = _claimed(log_, last.number + 1, lease, now)
        if claim is None:
            if stale is not None:
                return stale
            time.sleep(wait)
            continue
        try:
            folder = log_.new_folder()
            compute().write.parquet(f"{log_.path}/{folder}")
            done = log_.commit(last, {"snapshot": [folder]}, {"at": now()})
        except Conflict:  # the lease ran out and another caller was first
            continue
        except Exception:
            log_.files.delete(claim)
            if stale is None:
                raise
            log.exception("no new snapshot under %s; the last one stays", path)
            return stale
        log_.clear(keep)
        log_.files.delete(f"claims/{done.number:012d}")
        return log_.read([folder])


def _claimed(log_: Versions, number: int, lease: float, now: Callable[[], float]) -> str | None:
    """The file of the caller's own claim on a version, or None while another's holds. Each takeover of a claim that has run out is a file of its own."""
    folder = f"claims/{number:012d}"
    held = log_.files.names(folder)
    if held:
        try:
            until = float(log_.files.read(f"{folder}/{held[-1]}") or "")
        except ValueError:
            until = log_.files.changed(f"{folder}/{held[-1]}") + lease
        if now() < until:
            return None
    name = f"{folder}/{(int(held[-1]) if held else 0) + 1:06d}"
    return name if log_.files.create(name, str(now() + lease)) else None
