"""Repair of conversations by weighted finite-state composition.

Three machines: the input acceptor reads a conversation's messages in order; the edit transducer keeps a message (cost 0), gives it another role (3), deletes it (4) or inserts an empty one (3); the grammar
accepts the roles `(s?(ua)+)?`. They are composed lazily: an arc is made when a state of the composition is first visited, and remembered. Weights are pairs of a
cost and a string of edits, in lexicographic order. The composition is acyclic by position and by inserts in a row (more than two never pay, as they return to a state), so the shortest path is found in topological order: costs to
the end backwards, then from the beginning the least edit at each place that stays on a cheapest path, over all states that the edits so far may have led to. (Forward sums of the pairs would be wrong: strings of
different lengths don't keep their order when they are extended.) The edits fix the roles: what is left alternates, and begins with a system message if its number is odd.

How it scales: messages are sorted by ranges of (conversation, turn, role, text), so one conversation may lie in many tasks, and cut into blocks of consecutive rows of the sorted table. Of a block only one character a message is gathered. A block is summed up as a matrix of
costs between grammar states, (min, +); the matrices of a conversation with several blocks are multiplied up (one row a block), then each block tells for every set of states
where its edits lead, and at last writes its edits. Repeated messages are found by an aggregate over digests and a join on row numbers, so no key is hot. Only two things are bound to one task for each conversation, by the
contract: the string of all edits, one character a message, and the digest of the repaired text, for which rows stream past in bounded memory.

Defined cases: nulls are one space, also in the key that decides the damage; a null conversation id is a conversation of its own. Turns are in ascending order, nulls first; ties by role, then text (by its first 64 characters, then by hash). A role's initial
is its first character; a message with an empty role can't be kept. Rows without an id or a turn are rows like others; texts are read whole. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, saved

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Bits of the row number within a block: 4,096 messages.
BLOCK_BITS = 12
NEVER = 1 << 50
#: The grammar: states are 0 nothing yet, 1 after a system message, 2 after user, 3 after assistant.
STATES, FINAL = range(4), (0, 3)
GRAMMAR = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: A message's symbol is its role's initial (x: any other): small if it is whole, capital if truncated, a digit if it has to go.
SYMBOLS = {"s": "sS1", "u": "uU2", "a": "aA3", "x": "xX4"}
INITIAL = {c: initial for initial, three in SYMBOLS.items() for c in three}


def edits(symbol: str) -> Iterator[tuple[str, str, int]]:
    """The edit transducer's arcs that read the symbol ('': that read nothing): (label, output, cost)."""
    if not symbol:
        yield from (("I", x, INSERT) for x in "ua")
        return
    yield "D", "", DELETE
    if not symbol.isdigit():
        more = TRUNCATED if symbol.isupper() else 0
        yield "K", symbol.lower(), KEEP + more
        yield from (("R", x, REROLE + more) for x in "ua")


@cache
def arcs(symbol: str, state: int) -> tuple[tuple[str, int, int], ...]:
    """(label, next state, cost) of the composition at a grammar state, made when first asked for; in the order of labels."""
    made = ((label, state if not out else GRAMMAR.get((state, out)), cost) for label, out, cost in edits(symbol))
    return tuple(sorted(a for a in made if a[1] is not None))


def with_inserts(to_end: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to the end if messages may be inserted before going on: two at most."""
    now = to_end
    for _ in range(2):
        now = tuple(min([to_end[q], *(cost + now[t] for _, t, cost in arcs("", q))]) for q in STATES)
    return now


@lru_cache(1 << 16)
def _step(symbol: str, after: tuple[int, ...]) -> tuple[int, ...]:
    return with_inserts(tuple(min([NEVER, *(cost + after[t] for _, t, cost in arcs(symbol, q))]) for q in STATES))


def step(symbol: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to the end before a message, from those after it. Differences of costs are few, so they are looked up."""
    least = min(after)
    if least >= NEVER:
        return after
    return tuple(min(NEVER, least + c) for c in _step(symbol, tuple(min(NEVER, c - least) for c in after)))


END = with_inserts(tuple(0 if q in FINAL else NEVER for q in STATES))


def backwards(shape: str, after: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Costs to the end before each message, and after the last."""
    out = [after]
    for symbol in reversed(shape):
        out.append(step(symbol, out[-1]))
    return out[::-1]


def matrix(shape: str) -> list[int]:
    """Least costs from each state before the block to each after it (a row for each state after it)."""
    return [c for q in STATES for c in backwards(shape, tuple(0 if t == q else NEVER for t in STATES))[0]]


def times(block: list[int], after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to the end before a block, from those after it."""
    return tuple(min(min(NEVER, block[4 * t + q] + after[t]) for t in STATES) for q in STATES)


def walk(shape: str, after: tuple[int, ...], begin: int, last: bool) -> tuple[str, int]:
    """(the least edits over a block on cheapest paths, the set of states that they lead to, as bits), from a set of states of equal cost to the end."""
    costs, states, out = backwards(shape, after), [q for q in STATES if begin >> q & 1], []

    def onwards(symbol: str, here: tuple[int, ...], there: tuple[int, ...], label: str) -> list[int]:
        return sorted({t for q in states for name, t, cost in arcs(symbol, q) if name == label and cost + there[t] == here[q] < NEVER})

    for i, symbol in enumerate(shape):
        while True:
            for label in "DIKR":
                found = onwards("", costs[i], costs[i], label) if label == "I" else onwards(symbol, costs[i], costs[i + 1], label)
                if found:
                    break
            else:
                return "".join(out), 0
            states = found
            out.append(label)
            if label != "I":
                break
    while last and not any(q in FINAL and after[q] == 0 for q in states):
        states = onwards("", after, after, "I")
        out.append("I")
    return "".join(out), sum(1 << q for q in states)


@lru_cache(1 << 14)
def audit(shape: str) -> str:
    """The least string of edits among the cheapest of a whole conversation."""
    return walk(shape, END, 1, True)[0]


def crc(conv: Column, turn: Column) -> Column:
    text = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    return F.crc32(F.concat(text(conv), F.lit(":"), text(turn)).cast("binary"))


def damaged(rows: DataFrame, modulus: int = 20) -> DataFrame:
    """conv_id, turn, role, text, gone: nulls as one space; by the key's remainder a row is dropped (0; it stays as gone, without content), loses its text (1), loses its sentence ends (2), comes twice (3) or gets the role user (4)."""
    what = F.col("what")
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    d = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (crc(F.col("conv_id"), F.col("turn")) % modulus).alias("what"))
    text = F.when(what.isin(0, 1), "").when(what == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(what == 0, "").when(what == 4, "user").otherwise(F.col("role"))
    d = d.select("conv_id", "turn", role.alias("role"), text.alias("text"), (what == 0).alias("gone"), F.when(what == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"))
    return d.select("conv_id", "turn", "role", "text", "gone", F.explode("copies").alias("copy")).drop("copy")


def in_order(rows: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """The rows in order of conversation and turn, with a number `row` that ascends in that order, their block, and what the text alone says of each. Ranges are dealt by short keys and a number of the row, so equal rows don't meet in one task."""
    text = F.col("text")
    bare = F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    told = rows.withColumns({"key": F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), "id": F.monotonically_increasing_id(), "head": F.left(text, F.lit(64)), "hash": F.xxhash64("text"), "last_char": bare})
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.left("role", F.lit(64)), "head", "hash", "id"]
    done = told.orderBy(*order).withColumn("row", F.monotonically_increasing_id())
    done = done.withColumn("block", F.shiftright("row", block_bits)).withColumn("digest", F.unhex(F.sha2("text", 256)))
    return done.select("key", "conv_id", "turn", "role", "text", "gone", "row", "block", "digest", (F.col("last_char") == "").alias("blank"), F.col("last_char").isin(".", "!", "?").alias("ended"))


def symbols(rows: DataFrame) -> DataFrame:
    """key, turn, block, row, gone, fault and symbol of each ordered row. A repeated message is one that isn't the first row of its conversation, role and digest."""
    firsts = rows.where("not gone").groupBy("key", "role", "digest").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("is_first"))
    r = rows.select("key", "turn", "block", "row", "gone", "role", "blank", "ended").join(firsts, "row", "left")
    fault = F.when(F.col("gone"), "").when(F.col("blank"), "blank").when(F.col("is_first").isNull(), "duplicate").when(~F.col("ended"), "truncated").otherwise("")
    initial = F.left("role", F.lit(1))
    kind = F.when(F.col("fault").isin("blank", "duplicate"), 2).when(F.col("fault") == "truncated", 1).otherwise(0)
    table = F.lit("".join(SYMBOLS.values()))
    place = F.when(initial == "s", 0).when(initial == "u", 3).when(initial == "a", 6).otherwise(9)
    return r.withColumn("fault", fault).select("key", "turn", "block", "row", "gone", "fault", F.when(F.col("gone"), "").otherwise(F.substr(table, place + kind + 1, F.lit(1))).alias("symbol"))


def blocks_of(marked: DataFrame) -> DataFrame:
    """key, block, shape, and counts of faults: the part of a conversation in a block, 4,096 messages at most."""
    seq = F.array_sort(F.collect_list(F.struct("row", "symbol")))
    faults = (F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated"))
    return marked.groupBy("key", "block").agg(F.array_join(F.transform(seq, lambda s: s["symbol"]), "").alias("shape"), *faults)


TEXT, LONG = pa.string(), pa.int64()


def mapped(df: DataFrame, add: Callable[[dict], dict], **fields: pa.DataType) -> DataFrame:
    """df's rows, each as a dictionary, through add, which gives the fields."""
    schema = pa.schema(list(fields.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [add(r) for r in batch.to_pylist()]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return in_batches(df, run, df.sparkSession.createDataFrame(schema.empty_table()).schema)


def edited(blocks: DataFrame) -> DataFrame:
    """key, block, edits: each block's part of its conversation's edits."""
    n = F.count("*").over(Window.partitionBy("key"))
    sized = saved(blocks.select("key", "block", "shape").withColumn("n", n), "turns-blocks")
    whole = mapped(sized.where("n = 1"), lambda r: {"key": r["key"], "block": r["block"], "edits": audit(r["shape"])}, key=TEXT, block=LONG, edits=TEXT)

    # Conversations of several blocks: costs after each block, then states before it, then its edits.
    cut = sized.where("n > 1").select("key", "block", "shape")
    matrices = mapped(cut, lambda r: {"key": r["key"], "block": r["block"], "matrix": matrix(r["shape"])}, key=TEXT, block=LONG, matrix=pa.list_(LONG))

    def from_the_end(r: dict) -> dict:
        after, out = END, []
        for b in sorted(r["found"], key=lambda b: -b["block"]):
            out.append({"block": b["block"], "after": list(after), "last": not out})
            after = times(b["matrix"], after)
        return {"key": r["key"], "costs": out}

    listed = matrices.groupBy("key").agg(F.collect_list(F.struct("block", "matrix")).alias("found"))
    costs = mapped(listed, from_the_end, key=TEXT, costs=pa.list_(pa.struct({"block": LONG, "after": pa.list_(LONG), "last": pa.bool_()}))).select("key", F.inline("costs"))
    ready = saved(cut.join(costs, ["key", "block"]), "turns-costs")

    def leads(r: dict) -> dict:
        after = tuple(r["after"])
        return {"key": r["key"], "block": r["block"], "to": [0] + [walk(r["shape"], after, s, r["last"])[1] if equal(r["shape"], after, s) else 0 for s in range(1, 16)]}

    def from_the_beginning(r: dict) -> dict:
        states, out = 1, []
        for b in sorted(r["found"], key=lambda b: b["block"]):
            out.append({"block": b["block"], "begin": states})
            states = b["to"][states]
        return {"key": r["key"], "begins": out}

    to = mapped(ready, leads, key=TEXT, block=LONG, to=pa.list_(LONG)).groupBy("key").agg(F.collect_list(F.struct("block", "to")).alias("found"))
    begins = mapped(to, from_the_beginning, key=TEXT, begins=pa.list_(pa.struct({"block": LONG, "begin": LONG}))).select("key", F.inline("begins"))
    parts = mapped(ready.join(begins, ["key", "block"]), lambda r: {"key": r["key"], "block": r["block"], "edits": walk(r["shape"], tuple(r["after"]), r["begin"], r["last"])[0]}, key=TEXT, block=LONG, edits=TEXT)
    return whole.unionByName(parts)


def equal(shape: str, after: tuple[int, ...], states: int) -> bool:
    """Whether all states of the set have one finite cost to the end before the block, as those that equal edits have led to."""
    found = {backwards(shape, after)[0][q] for q in STATES if states >> q & 1}
    return len(found) == 1 and min(found) < NEVER


def digests(rows: DataFrame, parts: DataFrame, odd: DataFrame) -> DataFrame:
    """key, conv_id, repaired_sha256. Rows stream by in order, each block's edits ahead of its messages; nothing but a running digest is held."""
    plan = parts.join(odd, "key").select("key", "block", F.lit(-1).cast("long").alias("row"), F.col("edits"), "system", F.lit("").alias("role"), F.lit("").alias("text"), F.lit(False).alias("gone"), F.lit(None).cast(rows.schema["conv_id"].dataType).alias("conv_id"))
    own = rows.select("key", "block", "row", F.lit("").alias("edits"), F.lit(False).alias("system"), "role", "text", "gone", "conv_id")
    n = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    sorted_ = own.unionByName(plan).repartition(int(n), "key").sortWithinPartitions("key", "block", "row")
    kind = rows.schema["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, conv, sha, lines, labels, system, done = None, None, None, 0, iter(()), False, []

        def line(role: str | None, text: str) -> None:
            nonlocal lines
            role = role or ("user", "assistant")[(lines - system) % 2]
            sha.update(("\n" if lines else "").encode() + f"{role}:{text}".encode())
            lines += 1

        def rest() -> None:
            for _ in labels:  # inserts after a block's last message
                line(None, "")

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], conv_type), pa.array([d[2] for d in done], pa.string())], names=["key", "conv_id", "repaired_sha256"])
            done.clear()
            return out

        conv_type = None
        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            for k, _, row, found, first, role, text, gone, c in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                if k != key:
                    if key is not None:
                        rest()
                        done.append((key, conv, sha.hexdigest()))
                    key, conv, sha, lines, labels = k, None, hashlib.sha256(), 0, iter(())
                if row < 0:
                    rest()
                    labels, system = iter(found), first
                    continue
                conv = c
                if gone:
                    continue
                for label in labels:
                    if label == "I":
                        line(None, "")
                        continue
                    if label != "D":
                        line(role if label == "K" else None, text)
                    break
            if len(done) >= 1024:
                yield flush()
        if key is not None:
            rest()
            done.append((key, conv, sha.hexdigest()))
            yield flush()

    return in_batches(sorted_, run, f"key string, conv_id {kind.dataType.simpleString()}, repaired_sha256 string")


def repair(conversations: DataFrame, damage: Callable[[DataFrame], DataFrame] = damaged, block_bits: int = BLOCK_BITS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation. `damage` gives conv_id, turn, role, text and gone of the rows to repair."""
    rows = saved(in_order(damage(conversations.select("conv_id", "turn", "role", "text")), block_bits), "turns-rows")
    marked = saved(symbols(rows), "turns-symbols")
    blocks = saved(blocks_of(marked), "turns-shapes")
    parts = saved(edited(blocks), "turns-edits")

    turns = marked.where("not gone").groupBy("key").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.count_distinct("turn").alias("distinct"))
    gaps = turns.select("key", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct"), F.lit(0)).cast("long").alias("gaps"))
    at_blocks = blocks.join(parts, ["key", "block"])
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", c))), lambda s: s[c]), "")
    sums = (F.sum(f).cast("long").alias(f) for f in ("blank", "duplicate", "truncated"))
    found = at_blocks.groupBy("key").agg(*sums, ordered("shape").alias("shape"), ordered("edits").alias("audit"))
    found = mapped(found, lambda r: r | counted(r.pop("shape"), r["audit"]), key=TEXT, blank=LONG, duplicate=LONG, truncated=LONG, audit=TEXT, illegal=LONG, cost=LONG, system=pa.bool_())
    found = saved(found, "turns-found")
    hashes = digests(rows, parts, found.select("key", "system"))
    whole = hashes.join(found, "key").join(gaps, "key", "left")
    return whole.select("conv_id", F.coalesce("gaps", F.lit(0).cast("long")).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def counted(shape: str, labels: str) -> dict:
    """illegal pairs of neighbours before the repair, the cost of the edits, and whether what is left begins with a system message."""
    data = np.frombuffer(shape.encode(), np.uint8)
    table = np.full(256, ord("x"), np.uint8)
    for c, initial in INITIAL.items():
        table[ord(c)] = ord(initial)
    pairs = table[data].astype(np.int64)
    legal = [ord(a) * 256 + ord(b) for a, b in ("su", "ua", "au")]
    illegal = int((~np.isin(pairs[:-1] * 256 + pairs[1:], legal)).sum())
    edits_ = np.frombuffer(labels.encode(), np.uint8)
    read = edits_[edits_ != ord("I")]
    cost = DELETE * int((read == ord("D")).sum()) + REROLE * int((read == ord("R")).sum()) + INSERT * (len(edits_) - len(read))
    capital = (data >= ord("A")) & (data <= ord("Z"))
    cost += TRUNCATED * int((capital & (read != ord("D"))).sum())
    return {"illegal": illegal, "cost": cost, "system": bool((edits_ != ord("D")).sum() % 2)}
