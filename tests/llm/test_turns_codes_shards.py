"""Conversation repair, product codes and shards against plain restatements of their contracts, on small tables with hard cases and through the registered queries."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import oracle, queries, sharding, turn_repair, vector_codes

SPACE = re.compile(r"[^\x20\x09-\x0D]")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def write(spark, tmp_path, table, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / f"{table}.parquet"))
    return str(tmp_path)


# --- conversations


def repaired_plainly(rows):
    """Per conversation, from (conv_id, turn, role, text): the contract read literally, with a search from the end."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        own = convs[conv]
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        what = zlib.crc32(key.encode()) % 20
        if what == 0:
            continue
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        role = "user" if what == 4 else role
        own += [(turn, role, text)] * (2 if what == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in own:
            last = SPACE.findall(text)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
            seen.add((role, text))
        best = {}
        nexts = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
        for i in range(len(own), -1, -1):
            ways = {q: [] for q in range(4)}
            for q in range(4):
                if i == len(own):
                    if q in (0, 3):
                        ways[q].append((0, "", ()))
                    continue
                _, role, text = own[i]
                more = 3 * (faults[i] == "truncated")
                ways[q] += [(4 + c, "D" + s, t) for c, s, t in best[i + 1, q]]
                if faults[i] in ("", "truncated"):
                    for label, new, cost in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                        to = nexts.get((q, new[:1]))
                        if to is not None:
                            ways[q] += [(cost + more + c, label + s, ((new, text), *t)) for c, s, t in best[i + 1, to]]
            for _ in range(3):
                for q, new in itertools.product(range(4), ("user", "assistant")):
                    to = nexts.get((q, new[0]))
                    if to is not None and ways[to]:
                        c, s, t = min(ways[to])
                        ways[q].append((3 + c, "I" + s, ((new, ""), *t)))
            for q in range(4):
                best[i, q] = [min(ways[q])] if ways[q] else []
        cost, audit, lines = best[0, 0][0] if own else (0, "", ())
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [(a[1][:1] + b[1][:1]) for a, b in zip(own, own[1:])]
        counts = Counter(faults)
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha("\n".join(f"{r}:{t}" for r, t in lines)))
    return out


def conversations(seed=1):
    r, rows = random.Random(seed), []
    for conv in range(70):
        for turn in range(r.randrange(1, 14)):
            role = r.choice(("user", "assistant", "user", "assistant", "system", "tool", "User", "", None))
            text = r.choice((f"Word {r.randrange(6)}.", f"Ask {r.randrange(9)}?", f"cut {r.randrange(9)}", "", " \t\n", None, "Yes! ", "ünï\x1c", "x" * 9000 + "."))
            rows.append((conv, turn if r.random() < 0.9 else r.choice((0, turn + 2, None)), role, text))
    rows += [(None, None, None, None), (None, 1, "user", "Hm."), (None, 2, "assistant", "Yes."), (-5, 7, "user", "Same."), (-5, 7, "user", "Same."), (-5, 7, "user", "Same.")]
    rows += [(500, t, ("user", "assistant")[t % 2], f"Message {t}.") for t in range(600)]  # a long one
    return rows


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("block_bits", [12, 3])
def test_turn_repair(spark, block_bits):
    """Whole blocks, and blocks of eight messages so that most conversations are put together out of several."""
    rows = conversations()
    df = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], "conv_id long, turn long, role string, text string, key string, block int, row string").repartition(5)
    got = turn_repair.repair(df, block_bits=block_bits).collect()
    assert len(got) == len({r[0] for r in rows})
    assert {g["conv_id"]: tuple(g[f] for f in FIELDS) for g in got} == repaired_plainly(rows)


def test_turn_repair_is_least_of_all_edit_strings():
    """Short shapes against all strings of edits up to a length."""
    table = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def cost_of(shape, labels):
        i, states, cost = 0, {0}, 0
        for label in labels:
            if label == "I":
                states, cost = {table[q, x] for q in states for x in "ua" if (q, x) in table}, cost + 3
                continue
            if i == len(shape):
                return None
            c, i = shape[i], i + 1
            if label == "D":
                cost += 4
                continue
            if c.isdigit():
                return None
            cost += 3 * c.isupper() + 3 * (label == "R")
            states = {table[q, x] for q in states for x in (c.lower() if label == "K" else "ua") if (q, x) in table}
        return cost if i == len(shape) and states & {0, 3} else None

    for n in range(4):
        for shape in itertools.product("sSuUaAxX1", repeat=n):
            shape = "".join(shape)
            found = turn_repair.audit(shape)
            mine = cost_of(shape, found)
            assert mine is not None
            if n == 3 and zlib.crc32(shape.encode()) % 12:
                continue
            for length in range(n, n + 4):
                for labels in itertools.product("DIKR", repeat=length):
                    c = cost_of(shape, labels)
                    assert c is None or (mine, found) <= (c, "".join(labels))


def test_turn_repair_long_shapes_agree_with_their_blocks():
    r = random.Random(5)
    for _ in range(30):
        shape = "".join(r.choice("sSuUaAxX1uaua") for _ in range(r.randrange(1, 90)))
        cuts = sorted(r.sample(range(len(shape) + 1), min(4, len(shape))))
        blocks = [shape[a:b] for a, b in zip([0, *cuts], [*cuts, len(shape)])]
        after, ends = turn_repair.END, []
        for b in reversed(blocks):
            ends.append(after)
            after = turn_repair.times(turn_repair.matrix(b), after)
        states, out = 1, ""
        for k, (b, end) in enumerate(zip(blocks, reversed(ends))):
            labels, states = turn_repair.walk(b, end, states, k == len(blocks) - 1)
            out += labels
        assert out == turn_repair.audit(shape)


def test_turn_repair_query(spark, tmp_path):
    rows = conversations(3)
    folder = write(spark, tmp_path, "conversations", rows, "conv_id long, turn long, role string, text string")
    got = {g["conv_id"]: tuple(g[f] for f in FIELDS) for g in queries.op11_turn_repair(spark, folder).collect()}
    assert got == repaired_plainly(rows)


def test_turn_repair_empty(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turn_repair.repair(empty).count() == 0


# --- product codes


def coded_plainly(rows, parts=8, entries=16, rounds=6):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dims = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    if not kept:
        return Counter()
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([[int(np.floor(4096 * np.float64(np.float32(c)))) for c in v] + [0] * (dims - len(v)) for _, v, _ in kept], np.int64).reshape(len(kept), parts, dims // parts)
    books = x[:entries].transpose(1, 0, 2).copy()

    def assign():
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(3)
        return d.argmin(2), d.min(2).sum(1)

    for _ in range(rounds):
        chosen, _ = assign()
        for p in range(parts):
            for e in range(books.shape[1]):
                own = x[chosen[:, p] == e, p]
                if len(own):
                    books[p, e] = [int(s) // len(own) for s in own.sum(0)]
    chosen, error = assign()
    by_label = Counter()
    for (_, _, label), e in zip(kept, error):
        by_label[label] += int(e)
    text = sha(",".join(str(int(c)) for c in books.ravel()))
    return Counter((i, "".join(f"{c:02x}" for c in own), int(e), by_label[label], text) for (i, _, label), own, e in zip(kept, chosen, error))


def vectors(n, seed=1, dims=16):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(9)]
    rows = [(i, [float(np.float32(c + r.gauss(0, 0.2))) for c in r.choice(centres)], r.choice((1, 2, 3, None))) for i in r.sample(range(5 * n), n)]
    rows += [(3, None, 1), (4, [1.0] * (dims - 1) + [None], 1), (5, [float("nan")] * dims, 2), (6, [float("inf")] * dims, None), (None, rows[0][1], 2), (rows[5][0], rows[6][1], 9), rows[7], rows[7], (10**6, [0.0] * dims, 4), (10**6 + 1, [-7.5] * dims, 4)]
    return rows


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("rows", [vectors(150), vectors(40, 2, 64), vectors(60)[:7], [(1, None, 1)], [], vectors(30) + [(77777, [1.0, 2.0], 5), (77778, [], 5), (77779, [100.0] * 19, 5)]], ids=["plain", "wide", "few", "none", "empty", "lengths"])
def test_vector_codes(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], VECTORS + ", code string, error int").repartition(3)
    assert Counter(map(tuple, vector_codes.compress(df).collect())) == coded_plainly(rows)


def test_vector_codes_query(spark, tmp_path):
    rows = vectors(90, 4)
    folder = write(spark, tmp_path, "embeddings", rows, VECTORS)
    assert Counter(map(tuple, queries.op12_vector_codes(spark, folder).collect())) == coded_plainly(rows)


@pytest.mark.parametrize("scale", [1, 1 << 10, 1 << 26])
def test_segment_bounds_lose_nothing(scale):
    """The filtered search equals the full one, also with ties and at the largest components, and skips most exact distances on clustered parts."""
    r = np.random.default_rng(7)
    for d in (1, 2, 7, 8, 12):
        book = r.integers(-scale, scale + 1, (16, d))
        book[9] = book[3]
        x = np.concatenate([book[r.integers(0, 16, 300)] + r.integers(-1 - scale // 50, 2 + scale // 50, (300, d)), r.integers(-scale, scale + 1, (200, d)), np.zeros((3, d), int), (book[:1] + book[1:2]) // 2])
        full = ((x[:, None] - book[None]) ** 2).sum(2)
        chosen, distance, exact = vector_codes.nearest(x, book)
        assert (chosen == full.argmin(1)).all() and (distance == full.min(1)).all()
        if d >= 7 and scale > 1:
            assert exact < 0.6 * full.size


# --- shards


def text_rows(n=400, seed=1):
    r = random.Random(seed)
    rows = [(i, " ".join(r.choice(("stone", "river", "ß", "light,")) + str(r.randrange(99)) for _ in range(r.choice((1, 5, 40, 40, 300))))) for i in range(n)]
    rows += [(n + i, rows[5][1]) for i in range(60)] + [(n + 100, None), (n + 101, ""), (n + 102, None), (None, "no id"), (7, rows[7][1]), (7, rows[7][1]), (n + 103, " ".join(f"stone{i % 97}" for i in range(2000)))]
    rows += [(n + 200 + i, "a copy " * 9) for i in range(n // 2)]  # a third of all rows
    return rows


def shards_hold(rows, got, shards):
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "bytes", None) for i, t in rows)
    assert Counter((g["doc_id"], g["size"], g["text_crc32"], g["law"], g["grown_shard"]) for g in got) == want
    by = defaultdict(list)
    for g in got:
        by[g["shard"]].append(g)
    assert set(by) <= set(range(shards))
    for own in by.values():
        assert sorted(g["slot"] for g in own) == list(range(len(own)))
    return {k: (sum(g["size"] for g in own), len(own)) for k, own in by.items()}


@pytest.mark.parametrize("quanta, fine, block_bits", [(4096, 2048, 16), (64, 32, 33), (16, 8, 1)])
def test_shards(spark, quanta, fine, block_bits):
    rows = text_rows()
    df = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], "doc_id long, text string, digest string, row int, unit string").repartition(4)
    got = sharding.pack(df, 4, quanta=quanta, fine=fine, block_bits=block_bits).collect()
    sums = shards_hold(rows, got, 4)
    sizes, counts = zip(*sums.values())
    if quanta > 16:
        assert max(sizes) - min(sizes) <= 0.02 * max(sizes) and max(counts) <= 1.6 * sum(counts) / 4  # a third of all rows has few bytes
    of = defaultdict(set)
    for g in got:
        of[g["size"], g["text_crc32"]].add(g["shard"])
    assert sum(len(s) > 1 for s in of.values()) <= 1  # only the group that holds a third of all rows is cut


def test_shards_query(spark, tmp_path):
    rows = text_rows(300, 2)
    folder = write(spark, tmp_path, "documents", rows, "doc_id long, text string")
    sizes = [b for b, _ in shards_hold(rows, queries.op13_sharding(spark, folder).collect(), 16).values()]
    assert len(sizes) == 16 and sorted(sizes)[-2] - min(sizes) <= 0.2 * sum(sizes) / 16  # one text alone is nearly a shard


def test_shards_of_nothing(spark):
    assert sharding.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = sharding.pack(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert sorted(g["doc_id"] for g in got) == [1, 2]


def test_placing_takes_the_best_dot_product():
    """Against a plain loop over units and shards."""
    r = np.random.default_rng(3)
    vectors_ = r.integers(1, 1000, (200, 3)).astype(float)
    cap = vectors_.sum(0) / 5
    left, want = [[1.0] * 3 for _ in range(5)], {}
    for i in sorted(range(200), key=lambda i: -sum(vectors_[i] / cap)):
        v = vectors_[i] / cap
        fits = [s for s in range(5) if all(a >= b for a, b in zip(left[s], v))] or [s for s in range(5) if left[s][0] >= v[0]]
        best = max(fits, key=lambda s: (sum(a * b for a, b in zip(v, left[s])), -s)) if fits else max(range(5), key=lambda s: (left[s][0], -s))
        left[best] = [a - b for a, b in zip(left[best], v)]
        want[i] = best
    assert sharding.place(vectors_, 5).tolist() == [want[i] for i in range(200)]


def test_oracles_are_stated():
    assert {"op11_turn_repair", "op12_vector_codes"} <= set(oracle.ORACLE_SQL)
