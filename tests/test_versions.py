"""Tables in versions: replacement, latest state, exactly-once appends, single flight."""

import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import versions
from tidemark.work import Files

POSITION = "user_id long, asset string, quantity double"


def held(table):
    rows = table.rows()
    return set() if rows is None else {(r["user_id"], r["asset"], r["quantity"]) for r in rows.select("user_id", "asset", "quantity").collect()}


def test_replaced_users_may_end_without_rows(spark, tmp_path):
    table, r, want = versions.Derived(spark, str(tmp_path / "t"), buckets=8), random.Random(1), {}
    for step in range(4):
        users = r.sample(range(30), 30 if step == 0 else 7)
        new = [(u, a, float(r.randrange(9))) for u in users for a in "ABC" if r.random() < 0.4]
        before, folders = held(table), dict(table.log.newest().folders)
        reader = table.rows()
        table.replace(spark.createDataFrame(new, POSITION), spark.createDataFrame([(u,) for u in users], "user_id long"))
        want = {k: v for k, v in want.items() if k[0] not in users} | {(u, a): q for u, a, q in new}
        assert held(table) == {(u, a, q) for (u, a), q in want.items()}
        if step:  # who read before still reads the old version, and untouched buckets keep their folders
            assert {(x["user_id"], x["asset"], x["quantity"]) for x in reader.collect()} == before
            assert sum(table.log.newest().folders.get(b) == f for b, f in folders.items()) >= 1
    everyone = spark.range(30).withColumnRenamed("id", "user_id")
    table.replace(spark.createDataFrame([], POSITION), everyone)
    assert held(table) == set()


def test_a_dead_writer_changes_nothing(spark, tmp_path):
    table = versions.Derived(spark, str(tmp_path / "t"), buckets=4)
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    table.replace(spark.createDataFrame([(1, "A", 1.0)], POSITION), users)
    spark.range(3).write.parquet(str(tmp_path / "t/data/orphan"))  # written, never committed
    (tmp_path / "t/manifests/000000000002.json").write_text('{"folders": {"1"')  # cut off while it was written
    assert held(table) == {(1, "A", 1.0)}
    with pytest.raises(versions.Conflict):
        table.replace(spark.createDataFrame([], POSITION), users)
    import os

    os.utime(tmp_path / "t/manifests/000000000002.json", (0, 0))
    (tmp_path / "t/manifests/.000000000002.json.crc").unlink(missing_ok=True)
    table.replace(spark.createDataFrame([(2, "B", 2.0)], POSITION), users)
    assert held(table) == {(2, "B", 2.0)} and table.log.newest().number == 3
    assert table.log.clear(keep=1) == 3 and held(table) == {(2, "B", 2.0)}


def test_two_writers_conflict(spark, tmp_path):
    log = versions.Versions(spark, str(tmp_path / "t"))
    first = log.newest()
    log.commit(first, {}, {"a": 1})
    with pytest.raises(versions.Conflict):
        log.commit(first, {}, {"a": 2})
    assert log.newest().facts == {"a": 1}


def test_latest_equals_the_whole_log(spark, tmp_path):
    table, r, whole = versions.Latest(spark, str(tmp_path / "t"), "order_id", "seq", buckets=8), random.Random(2), []
    for step in range(5):
        rows = [(r.randrange(40 if step < 4 else 3), r.randrange(6), r.choice("XYZ"), None) for _ in range(50)]
        whole += rows
        table.append(spark.createDataFrame(rows, "order_id long, seq long, status string, note string"))
        want = {}
        for k, s, v, _ in whole:
            want[k] = max(want.get(k, (-1, "")), (s, v))
        now = lambda: {x["order_id"]: (x["seq"], x["status"]) for x in table.rows().collect()}
        assert now() == want
        if step in (1, 3, 4):
            before = dict(table.log.newest().folders)
            table.compact()
            after = table.log.newest().folders
            assert now() == want and all(b.isdigit() for b in after)
            if step == 4:  # three keys touch three buckets at most: the others were neither read nor written
                assert sum(after[b] != before.get(b) for b in after) <= 3
    assert table.compact().number == table.log.newest().number


def test_outbox_takes_a_batch_once(spark, tmp_path):
    box = versions.Outbox(spark, str(tmp_path / "o"))
    batch = lambda n: spark.createDataFrame([(n, i) for i in range(3)], "batch int, i int")
    assert box.put(batch(0), 0) and box.put(batch(1), 1) and not box.put(batch(1), 1) and not box.put(batch(0), 0)
    assert box.put(batch(7), 0, "other") and box.rows().count() == 9


def test_one_driver_computes(spark, tmp_path):
    path, calls, got = str(tmp_path / "s"), [], []

    def compute():
        calls.append(1)
        time.sleep(1.0)
        return spark.createDataFrame([(len(calls),)], "n int")

    def ask():
        got.append(versions.single_flight(spark, path, 1000, compute, wait=0.2).first()["n"])

    threads = [threading.Thread(target=ask) for _ in range(4)]
    for t in threads:
        t.start()
        time.sleep(0.2)
    for t in threads:
        t.join(60)
    assert got == [1, 1, 1, 1] and len(calls) == 1


def test_snapshots_age_fail_and_are_cleared(spark, tmp_path):
    path, clock, calls = str(tmp_path / "s"), [100.0], []

    def compute():
        calls.append(1)
        if len(calls) in (1, 4):
            raise ValueError("no prices")
        return spark.createDataFrame([(len(calls),)], "n int")

    def ask(t):
        clock[0] = t
        return versions.single_flight(spark, path, 30, compute, lease=50, now=lambda: clock[0]).first()["n"]

    with pytest.raises(ValueError, match="no prices"):
        ask(100)
    assert [ask(101), ask(120), ask(140), ask(175), ask(176), ask(300)] == [2, 2, 3, 3, 5, 6]
    assert len(Files(spark, path).names("data")) == 2
    # A driver that died with its claim: others read the last snapshot until the lease has run out.
    log = versions.Versions(spark, path)
    assert versions._claimed(log, log.newest().number + 1, 50, lambda: 400.0)
    assert [ask(401), ask(449), ask(451)] == [6, 6, 7]
