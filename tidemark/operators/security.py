"""Key health, rotation, audit trails, API keys, outgoing events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import validate
from .scans import cut, kept, running, same
from .versions import Outbox

MAX_AGE, WARN = 90, 14
LEVELS = ("GREEN", "YELLOW", "RED")


def due_days(created: Column, as_of: str) -> Column:
    seconds = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(created.cast("timestamp"))
    return (MAX_AGE - F.floor(seconds / 86400)).cast("int")


def key_health(keys: DataFrame, as_of: str) -> DataFrame:
    """key_id, user_id, due, level of active keys."""
    active = keys.where("is_active").withColumn("due", due_days(F.col("created_at"), as_of))
    return active.select("key_id", "user_id", "algorithm", "due", F.when(F.col("due") <= 0, "RED").when(F.col("due") <= WARN, "YELLOW").otherwise("GREEN").alias("level"))


def threat(health: DataFrame) -> DataFrame:
    """user_id, threat: the worst level of the user's keys; score: the green share in whole per cent, halves to even; expiring."""
    worst = F.max(F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))).cast("int")
    green = F.bround(100.0 * F.count_if(F.col("level") == "GREEN") / F.count("*"), 0).cast("int")
    return health.groupBy("user_id").agg(F.element_at(F.array(*map(F.lit, LEVELS)), worst).alias("threat"), green.alias("score"), F.count_if((F.col("level") == "RED") | (F.col("due") < 15)).alias("expiring"))


def latest_keys(keys: DataFrame) -> DataFrame:
    """The newest active key of each user and algorithm."""
    w = Window.partitionBy("user_id", "algorithm").orderBy(F.desc("created_at"), F.desc("key_id"))
    return keys.where("is_active").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def rotated(keys: DataFrame) -> DataFrame:
    """user_id, algorithm, next_rotation: the count that a new key gets, 0 where there was no active one."""
    users = keys.select("user_id", "algorithm").distinct()
    return users.join(latest_keys(keys).select("user_id", "algorithm", "rotation_count"), ["user_id", "algorithm"], "left").select("user_id", "algorithm", F.coalesce(F.col("rotation_count") + 1, F.lit(0)).cast("long").alias("next_rotation"))


def rotation(keys: DataFrame, wanted: DataFrame, as_of: str) -> DataFrame:
    """The key table after the rotations wanted(user_id, algorithm, new_key_id): active keys of these are deactivated and stamped, and a new one with the next count comes in."""
    w = wanted.select("user_id", "algorithm", "new_key_id")
    now = F.lit(as_of).cast("timestamp_ntz")
    old = keys.join(w, ["user_id", "algorithm"], "left")
    hit = F.col("is_active") & F.col("new_key_id").isNotNull()
    kept = old.select("key_id", "user_id", "algorithm", (F.col("is_active") & ~hit).alias("is_active"), F.col("rotation_count").cast("long").alias("rotation_count"), "created_at", F.when(hit, now).alias("revoked_at"))
    new = w.join(latest_keys(keys).select("user_id", "algorithm", "rotation_count"), ["user_id", "algorithm"], "left")
    new = new.select(F.col("new_key_id").alias("key_id"), "user_id", "algorithm", F.lit(True).alias("is_active"), F.coalesce(F.col("rotation_count") + 1, F.lit(0)).cast("long").alias("rotation_count"), now.alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("revoked_at"))
    return kept.unionByName(new)


def protected(secret: Column, key: str) -> Column:
    """Encrypted at rest (AES-GCM, base64) under a key of 16, 24 or 32 characters, with a mark that tells it from old plain rows."""
    return F.concat(F.lit("enc:"), F.base64(F.aes_encrypt(secret, F.lit(key))))


def unprotected(stored: Column, key: str) -> Column:
    """The secret; a row without the mark is plain, one that the key doesn't open is null."""
    plain = F.try_aes_decrypt(F.unbase64(F.substring(stored, 5, 1 << 30)), F.lit(key)).cast("string")
    return F.when(stored.startswith("enc:"), plain).otherwise(stored)


def audit_payload() -> Column:
    """Canonical JSON of an entry: fields in the order of their names."""
    return F.to_json(F.struct("action", "log_id", "metadata", "user_id"))


def audit_sign(logs: DataFrame, provider: Callable[[Column], Column]) -> DataFrame:
    return logs.withColumn("signature", provider(audit_payload()))


def audit_verify(logs: DataFrame, provider: Callable[[Column], Column]) -> DataFrame:
    return logs.withColumn("verified", F.coalesce(F.col("signature") == provider(audit_payload()), F.lit(False)))


def recent(logs: DataFrame, n: int = 50) -> DataFrame:
    return logs.orderBy(F.desc("created_at"), F.desc("log_id")).limit(n)


def enriched(logs: DataFrame, users: DataFrame) -> DataFrame:
    """Entries with the user's e-mail: one left join."""
    return logs.join(users, "user_id", "left")


def compliance(verified: DataFrame) -> DataFrame:
    return verified.agg(F.count("*").alias("entries"), F.sum(F.col("verified").cast("long")).alias("verified"), F.coalesce(F.every("verified"), F.lit(True)).alias("all_verified"))


def api_key_check(requests: DataFrame, keys: DataFrame, as_of: str) -> DataFrame:
    """request_id, allowed: the key's hash is known, not revoked, not expired, and has the scope or `admin`."""
    k = keys.select("key_hash", "scopes", "is_revoked", "expires_at")
    j = requests.withColumn("key_hash", F.sha2("raw", 256)).join(k, "key_hash", "left")
    ok = ~F.col("is_revoked") & (F.array_contains("scopes", F.col("scope")) | F.array_contains("scopes", "admin")) & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(as_of).cast("timestamp_ntz")))
    return j.select("request_id", F.coalesce(ok, F.lit(False)).alias("allowed"))


def api_key(entropy: Column, label: str = "tk_", shown: int = 11) -> Column:
    """struct(raw, key_prefix, key_hash) of a new key: its bytes as URL-safe base64 without padding after a label; the beginning that is shown, and the SHA-256 that is kept."""
    raw = F.concat(F.lit(label), F.translate(F.base64(entropy), "+/=", "-_"))
    return F.struct(raw.alias("raw"), F.left(raw, F.lit(shown)).alias("key_prefix"), F.sha2(raw, 256).alias("key_hash"))


def html_escaped(text: Column) -> Column:
    """Text that may stand in HTML, in quotes too."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def etag(text: Column) -> Column:
    """The entity tag: the first 16 hexadecimal digits of the SHA-1."""
    return F.left(F.sha1(text.cast("binary")), F.lit(16))


def deliverable(hooks: DataFrame, addresses: DataFrame) -> DataFrame:
    """Active hooks whose url is HTTPS and whose host resolves to public addresses only. addresses(host, ip): what hosts resolve to; a host without an address can't be reached."""
    known = addresses.groupBy("host").agg(F.every(validate.public_ip(F.col("ip"))).alias("public"))
    ours = hooks.where("is_active").where(validate.https_url(F.col("url"))).withColumn("host", F.lower(F.try_parse_url("url", F.lit("HOST"))))
    return ours.join(known.where("public").select("host"), "host", "left_semi").drop("host")


def deliver(events: DataFrame, hooks: Callable[[], DataFrame], outbox_: Outbox, checkpoint: str, sign: Callable[[Column], Column] | None = None, source: str = "webhooks"):
    """A stream of events into the outbox: each batch is matched with the hooks of its time and appended under its id, so a batch that is run again leaves the outbox as it is. The caller sets the trigger and starts it."""

    def put(batch: DataFrame, batch_id: int) -> None:
        outbox_.put(outbox(batch, hooks(), sign), batch_id, source)

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def audit_list(logs: DataFrame, users: DataFrame, user: int, n: int = 50) -> DataFrame:
    """One user's newest n entries (verified, with signature) as they are shown: e-mail, a preview of the signature, whether it holds, times as ISO text."""
    own = logs.where(F.col("user_id") == user).orderBy(F.desc("created_at"), F.desc("log_id")).limit(n)
    preview = F.concat(F.left(F.coalesce("signature", F.lit("")), F.lit(24)), F.lit("..."))
    return own.join(users, "user_id", "left").select("log_id", "action", "metadata", F.col("email").alias("user_email"), preview.alias("signature_preview"), "verified", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"))


def compliance_report(keys: DataFrame, logs: DataFrame, user: int, as_of: str, frameworks: tuple[str, ...], n: int = 100) -> DataFrame:
    """One row: the evidence about one user as a JSON document, the state of the keys and the newest n entries (verified) of the audit log."""
    health = key_health(keys.where(F.col("user_id") == user), as_of)
    key = F.struct("key_id", "algorithm", F.col("due").alias("days_until_rotation_due"), F.col("level").alias("status"))
    block = threat(health).select("threat", "score", "expiring")
    listed = health.agg(F.array_sort(F.collect_list(key)).alias("keys"))
    audit = compliance(logs.where(F.col("user_id") == user).orderBy(F.desc("created_at"), F.desc("log_id")).limit(n))
    one = listed.join(block, how="left").join(audit)  # one row each
    empty = F.struct(F.lit("GREEN").alias("threat_level"), F.lit(100).alias("safety_score"), F.lit(0).cast("long").alias("expiring_keys"))
    state = F.when(F.col("threat").isNotNull(), F.struct(F.col("threat").alias("threat_level"), F.col("score").alias("safety_score"), F.col("expiring").alias("expiring_keys"))).otherwise(empty)
    counts = F.struct(F.col("entries").alias("entries_reviewed"), F.coalesce("verified", F.lit(0).cast("long")).alias("signatures_verified"), "all_verified")
    body = F.struct(F.lit(as_of).alias("generated_at"), F.array(*map(F.lit, frameworks)).alias("frameworks"), F.struct(state["threat_level"].alias("threat_level"), state["safety_score"].alias("safety_score"), state["expiring_keys"].alias("expiring_keys"), "keys").alias("key_health"), counts.alias("audit_log"))
    return one.select(F.lit(user).cast("long").alias("user_id"), F.to_json(body).alias("body"))


def outbox(events: DataFrame, hooks: DataFrame, sign: Callable[[Column], Column] | None = None) -> DataFrame:
    """event_id, hook_id, payload (and signature) of events that active hooks of the user have subscribed to."""
    j = events.join(hooks.where("is_active"), "user_id").where(F.array_contains("event_types", F.col("event_name")))
    j = j.select("event_id", "hook_id", F.to_json(F.struct(F.col("event_id").alias("data"), F.col("event_name").alias("event"))).alias("payload"))
    return j if sign is None else j.withColumn("signature", sign(F.col("payload")))


def http_counts(requests: DataFrame) -> DataFrame:
    """The counter: requests by method, path and status."""
    return requests.groupBy("method", "path", "status").agg(F.count("*").alias("n"))


def http_latency(requests: DataFrame, buckets: tuple[float, ...] = (10.0, 50.0, 100.0)) -> DataFrame:
    """The cumulative histogram of latency by method and path, whatever the status."""
    return requests.groupBy("method", "path").agg(F.count("*").alias("n"), *(F.count_if(F.col("latency") <= b).alias(f"le_{int(b)}") for b in buckets))


def rate_limited(requests: DataFrame, seconds: int, limit: int, parts: int = 8) -> DataFrame:
    """request_id, seen, allowed: requests of the key in the trailing window, both ends included; refused ones count.

    Time is cut in buckets, `parts` a window, so a key with most of the rows is dealt over its buckets: a request sees those of its own bucket up to it, all of the parts - 1 buckets before (sums over one row a bucket), and of the bucket at the
    window's far edge those that are young enough. For these, each request is counted a second time, `seconds` later: it is out for the requests after that."""
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    width, odd = divmod(seconds * 1_000_000, parts)
    if odd:
        raise ValueError("parts has to divide the window's microseconds")
    bucket = lambda t: F.floor(t / width).cast("long")
    r = requests.select("request_id", "key", micros.alias("t"))
    counts = r.groupBy("key", bucket(F.col("t")).alias("b")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("key").orderBy("b").rangeBetween(-(parts - 1), -1))
    edge = F.sum("n").over(Window.partitionBy("key").orderBy("b").rangeBetween(-parts, -parts))
    # Buckets of the sums: those that hold requests.
    sums = counts.select(F.col("key").alias("of_key"), F.col("b").alias("of_b"), F.coalesce(before, F.lit(0)).alias("before"), F.coalesce(edge, F.lit(0)).alias("edge"))
    own = r.select("request_id", "key", "t", bucket(F.col("t")).alias("b"), F.lit(0).alias("out"))
    out = r.select(F.lit(None).cast(r.schema["request_id"].dataType).alias("request_id"), "key", (F.col("t") + seconds * 1_000_000).alias("t"), (bucket(F.col("t")) + parts).alias("b"), F.lit(1).alias("out"))
    both = Window.partitionBy("key", "b")
    upto = F.sum(1 - F.col("out")).over(both.orderBy("t").rangeBetween(Window.unboundedPreceding, 0))
    gone = F.sum("out").over(both.orderBy("t", "out").rowsBetween(Window.unboundedPreceding, 0))
    seen = own.unionByName(out).withColumns({"upto": upto, "gone": gone}).where("out = 0").join(sums, F.col("key").eqNullSafe(F.col("of_key")) & (F.col("b") == F.col("of_b")))
    return seen.select("request_id", (F.col("upto") + F.col("before") + F.col("edge") - F.col("gone")).alias("seen")).withColumn("allowed", F.col("seen") <= limit)


def lockouts(attempts: DataFrame, failures: int, window: int, lock: int, block_rows: int = 100_000) -> DataFrame:
    """key, locks, refused: the state machine of failed logins as one fold over the key's attempts in time order. While locked, attempts are refused and leave no trace; failures in the window lock and clear the list, a success clears it. Keys of more than block_rows attempts are cut in blocks."""
    long_ = attempts.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block_rows).select("key")
    if long_.isEmpty():
        return _lockouts(attempts, failures, window, lock)
    cut_ = _lockouts_in_blocks(same(attempts, long_, ["key"], "left_semi"), failures, window, lock, max(block_rows, failures))
    return _lockouts(same(attempts, long_, ["key"], "left_anti"), failures, window, lock).unionByName(cut_)


def _lockouts(attempts: DataFrame, failures: int, window: int, lock: int) -> DataFrame:
    t = F.col("at").cast("timestamp").cast("double")
    rows = F.array_sort(F.collect_list(F.struct(t.alias("t"), "attempt_id", F.col("failed").alias("f"))))
    none = F.expr("cast(array() as array<double>)")

    def step(a: Column, x: Column) -> Column:
        recent_ = F.filter(a["times"], lambda z: z > x["t"] - window)
        more = F.concat(recent_, F.array(x["t"]))
        state = lambda until, times, locks, refused: F.struct(until.alias("until"), times.alias("times"), locks.alias("locks"), refused.alias("refused"))
        locked = state(x["t"] + lock, none, a["locks"] + 1, a["refused"])
        failed = F.when(F.size(more) >= failures, locked).otherwise(state(a["until"], more, a["locks"], a["refused"]))
        return F.when(x["t"] < a["until"], state(a["until"], a["times"], a["locks"], a["refused"] + 1)).when(x["f"], failed).otherwise(state(F.lit(0.0), none, a["locks"], a["refused"]))

    start = F.struct(F.lit(0.0).alias("until"), none.alias("times"), F.lit(0).alias("locks"), F.lit(0).alias("refused"))
    return attempts.groupBy("key").agg(F.aggregate(rows, start, step).alias("z")).select("key", F.col("z.locks").alias("locks"), F.col("z.refused").alias("refused"))


def _lockouts_in_blocks(attempts: DataFrame, failures: int, window: int, lock: int, block_rows: int) -> DataFrame:
    """The lockout of busy keys. An attempt can lock if it ends `failures` failed ones in a row that lie in the window; it does if the first of them isn't before the end of the lock before. So locks are the greedy choice among runs (start, end),
    which needs the runs alone: they stream past in order, and nothing but the end of the last lock is held. Whether an attempt can lock, and whether it is refused, is told in blocks. Attempts without a time have no effect."""
    second = 1_000_000
    t = F.unix_micros(F.col("at").cast("timestamp"))
    rows = attempts.where("at is not null").select("key", "attempt_id", t.alias("t"), F.coalesce("failed", F.lit(False)).cast("int").alias("f"))
    counted = running(cut(rows, ["key"], ["t", "attempt_id"], block_rows), ["key"], F.sum, F.lit(1), "seq")
    placed = kept(counted.select("key", F.col("key").cast("string").alias("name"), "t", "f", (F.col("seq") - 1).alias("row")).withColumn("block", F.floor(F.col("row") / block_rows)), "attempts")
    # The last attempts of a block also stand before the next, as runs may reach over.
    tail = F.col("row") % block_rows > block_rows - failures
    both = placed.withColumn("part", F.explode(F.when(tail, F.array("block", F.col("block") + 1)).otherwise(F.array("block"))))
    run = Window.partitionBy("key", "part").orderBy("row")
    runs = both.withColumns({"start": F.lag("t", failures - 1).over(run), "fails": F.sum("f").over(run.rowsBetween(1 - failures, 0))}).where("part = block")
    runs = runs.where((F.col("fails") == failures) & ((F.col("start") > F.col("t") - window * second) | F.lit(failures == 1))).select("name", "row", "start", F.col("t").alias("stop"))

    def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, free = (), -(1 << 62)  # no key is ()
        for batch in batches:
            names, start, stop, found = batch["name"].to_numpy(), batch["start"].to_numpy(), batch["stop"].to_numpy(), []
            ends = [*(np.flatnonzero([not (x == y or x is y) for x, y in zip(names[:-1], names[1:], strict=True)]) + 1), len(names)] if len(names) else []
            for a, b in zip([0, *ends], ends):
                if names[a] != last:
                    last, free = names[a], -(1 << 62)
                at = a + np.searchsorted(start[a:b], free)
                while at < b:
                    found.append(at)
                    free = stop[at] + lock * second
                    at = a + np.searchsorted(start[a:b], free)
            yield pd.DataFrame({"name": names[found], "row": batch["row"].to_numpy()[found], "until": stop[found] + lock * second})

    locks = runs.repartition("name").sortWithinPartitions("name", "row").mapInPandas(chosen, "name string, row long, until long")
    held = running(same(placed, kept(locks, "locks"), ["name", "row"], "left"), ["key"], F.max, F.col("until"), "held")
    return held.groupBy("key").agg(F.count("until").cast("int").alias("locks"), F.count_if(F.col("until").isNull() & (F.col("t") < F.col("held"))).cast("int").alias("refused"))


def evicted(sessions: DataFrame, as_of: str, ttl: int = 3600, cap: int = 10_000) -> DataFrame:
    """Sessions that stay: younger than ttl seconds, and the newest cap of them. The cap is a rank over all, so it is taken by a top-n, not a window of one partition."""
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("created_at").cast("timestamp"))
    return sessions.where(age < ttl).orderBy(F.desc("created_at"), F.desc("session_id")).limit(cap)
