import dataclasses
import json
import random

import pytest
from pyspark.sql import functions as F

from tests import world
from tidewater.runtime import new_dir
from tidewater.streaming import boundary, cdc
from tidewater.table.snapshots import CommitConflict, SnapshotTable


def messages(spark, rows):
    return spark.createDataFrame(rows, cdc.MESSAGES)


ALL = [world.message(*e) for e in world.EVENTS]


def test_replay_adds_nothing_and_order_does_not_matter(spark):
    ledger = cdc.ledger_at(spark, new_dir(spark, "ledger"))
    rows = ALL + ALL[:3]
    random.Random(1).shuffle(rows)
    assert cdc.write_batch(ledger, messages(spark, rows[:10])) == len({r[:3] for r in rows[:10]})
    cdc.write_batch(ledger, messages(spark, rows[5:]))
    assert cdc.write_batch(ledger, messages(spark, ALL)) == 0
    got = ledger.read()
    assert got.count() == 26 and got.select("event_id").distinct().count() == 26
    r = got.filter(F.col("event_id") == world.event_id("customers", 3)).first()
    assert json.loads(r.after_json)["segment"] == "vip" and list(json.loads(r.after_json)) == sorted(json.loads(r.after_json))
    assert r.source_timestamp == (world.BASE - world.dt.timedelta(minutes=3)).replace(tzinfo=None) and r.key_json == '{"customer_id":9910001}'


def broken(name):
    t, p, o, ts, k, v = ALL[0]
    e = json.loads(v)
    change = {
        "not UTF-8": (t, p, o, ts, k, b"\xff\xfe"),
        "no JSON envelope": (t, p, o, ts, k, b"{nope"),
        "unknown operation": (t, p, o, ts, k, json.dumps(e | {"op": "x"}).encode()),
        "route": (t.replace("customers", "orders"), p, o, ts, k, v),
        "key shape": (t, p, o, ts, b'{"customer_id":1,"x":2}', v),
        "no row after": (t, p, o, ts, k, json.dumps(e | {"after": None}).encode()),
        "row after a delete": (t, p, o, ts, k, json.dumps(e | {"op": "d"}).encode()),
        "key differs from row": (t, p, o, ts, b'{"customer_id":5}', v),
        "coordinate": (t, p, None, ts, k, v),
    }
    return change[name]


RULES = ["not UTF-8", "no JSON envelope", "unknown operation", "route", "key shape", "no row after", "row after a delete", "key differs from row", "coordinate"]


def test_broken_messages_are_named_and_stop_the_batch(spark):
    df = messages(spark, [broken(n) for n in RULES]).coalesce(1)
    got = [r.errors for r in cdc.parsed(df).collect()]
    for name, errors in zip(RULES, got, strict=True):
        assert name in errors, (name, errors)
    assert all(r.errors == [] for r in cdc.parsed(messages(spark, ALL)).collect())
    ledger = cdc.ledger_at(spark, new_dir(spark, "ledger"))
    with pytest.raises(cdc.InvalidMessages):
        cdc.write_batch(ledger, messages(spark, ALL[:3] + [broken("route")]))
    assert ledger.read().count() == 0


def test_epoch_units(spark):
    t, p, o, ts, k, v = ALL[0]
    e = json.loads(v)
    us = e["source"].pop("ts_us")
    rows = [(t, p, i, ts, k, json.dumps(e | {"source": e["source"] | x}).encode()) for i, x in enumerate([{"ts_ns": us * 1000 + 7}, {"ts_ms": us // 1000}, {}])]
    got = [r.source_timestamp for r in cdc.parsed(messages(spark, rows)).orderBy("kafka_offset").collect()]
    assert got[0] == got[1] and got[2] is None


def test_stream_from_files(spark, tmp_path):
    src, root = tmp_path / "in", new_dir(spark, "ledger")
    for k in range(2):
        messages(spark, ALL[k * 13 : k * 13 + 13] + ALL[:2]).coalesce(1).write.mode("append").parquet(str(src))
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(spark.createDataFrame([], cdc.MESSAGES).schema).option("maxFilesPerTrigger", 1).parquet(str(src))
        q = cdc.start(stream, root, str(tmp_path / "checkpoint"), f"{root}-beat")
        q.awaitTermination(120)
    assert cdc.ledger_at(spark, root).read().count() == 26
    assert cdc.is_healthy(spark, f"{root}-beat", 600) and not cdc.is_healthy(spark, f"{root}-none", 600)


def test_bounded_runs(spark, tmp_path):
    src, root = tmp_path / "in", new_dir(spark, "ledger")
    for k in range(4):
        messages(spark, ALL[k * 6 : k * 6 + 6]).coalesce(1).write.mode("append").parquet(str(src))
    read = lambda: spark.readStream.schema(spark.createDataFrame([], cdc.MESSAGES).schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    one = cdc.run_bounded(read(), root, str(tmp_path / "c"), max_batches=1)
    assert one["batches"] >= 1 and one["messages"] >= 6
    two = cdc.run_bounded(read(), root, str(tmp_path / "c"), max_messages=7, idle_s=60)
    assert two["messages"] >= 7
    cdc.run_bounded(read(), root, str(tmp_path / "c"), idle_s=1.5)
    assert cdc.ledger_at(spark, root).read().count() == 24


def test_ledger_rejects_duplicates_and_races(spark, monkeypatch):
    root = new_dir(spark, "ledger")
    a, b = cdc.ledger_at(spark, root), cdc.ledger_at(spark, root)
    events = cdc.parsed(messages(spark, ALL[:4])).drop("errors").withColumn("ingested_at", F.current_timestamp())
    with pytest.raises(cdc.DuplicateEvents):
        cdc.append_new(a, events.union(events.limit(1)))
    assert cdc.append_new(a, events.limit(1)) == 1
    append = SnapshotTable.append

    def overtaken(self, df, parent=None):
        monkeypatch.setattr(SnapshotTable, "append", append)
        cdc.append_new(other, events)
        return append(self, df, parent)

    fresh = [cdc.ledger_at(spark, new_dir(spark, "ledger"))] * 2  # so far empty
    for a, other in ((a, b), fresh):
        monkeypatch.setattr(SnapshotTable, "append", overtaken)
        with pytest.raises(CommitConflict):
            cdc.append_new(a, events)
        assert cdc.append_new(a, events) == 0 and a.read().count() == 4
    twice = messages(spark, [ALL[5], (*ALL[5][:3], ALL[5][3] - world.dt.timedelta(hours=1), *ALL[5][4:])])
    assert cdc.write_batch(a, twice) == 1
    kept = a.read().filter(F.col("event_id") == world.event_id("customers", ALL[5][2])).first()
    assert kept.kafka_timestamp == (ALL[5][3] - world.dt.timedelta(hours=1)).replace(tzinfo=None)


def test_retry():
    slept, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("again")
        return "done"

    assert cdc.retrying(call, 3, lambda e: isinstance(e, OSError), slept.append) == "done" and slept == [1, 2]
    with pytest.raises(ZeroDivisionError):
        cdc.retrying(lambda: 1 / 0, 3, lambda e: isinstance(e, OSError), slept.append)


# -- boundary -------------------------------------------------------------------

GOOD = {t: {"partition": 0, "offset_exclusive": 5} for t in boundary.TOPICS}


def test_frontier_follows_the_last_offsets(spark):
    a, b, c = boundary.TOPICS
    shape = "kafka_topic string, kafka_partition int, kafka_offset bigint"
    feed = spark.createDataFrame([(a, 0, 7), (a, 0, 9_000), (b, 0, 0)], shape)
    at = boundary.frontier(feed)
    assert {t: at[t]["offset_exclusive"] for t in at} == {a: 9_001, b: 1, c: 0}
    assert feed.filter(boundary.boundary_filter(at, a) & (F.col("kafka_topic") == a)).count() == 2
    for lost in ((a, 1, 3), ("x", 0, 3), (a, 0, None)):
        with pytest.raises(boundary.BoundaryError):
            boundary.frontier(feed.unionByName(spark.createDataFrame([lost], shape)))


def test_boundary_is_validated():
    assert json.loads(boundary.serialized(GOOD)) == GOOD
    for bad in ([], {}, {**GOOD, "x": GOOD[boundary.TOPICS[0]]}, {**GOOD, boundary.TOPICS[0]: {"partition": 1, "offset_exclusive": 5}}, {**GOOD, boundary.TOPICS[0]: {"partition": 0, "offset_exclusive": True}}, {**GOOD, boundary.TOPICS[0]: {"partition": 0}}):
        with pytest.raises(boundary.BoundaryError):
            boundary.validated(bad)


def run_frontier(samples, window=2.0, deadline=30.0):
    clock = [0.0]
    feed = iter(samples)

    def probe():
        x = next(feed)
        if isinstance(x, Exception):
            raise x
        return x

    return boundary.wait_for_frontier(probe, window, deadline, clock=lambda: clock[0], sleep=lambda s: clock.__setitem__(0, clock[0] + s)), clock[0]


def sample(end, committed=None, problems=()):
    return boundary.Sample(dict.fromkeys(boundary.TOPICS, end), dict.fromkeys(boundary.TOPICS, end if committed is None else committed), problems)


def test_frontier_must_stand_still():
    got, took = run_frontier([sample(5)] * 9)
    assert got[boundary.TOPICS[0]]["offset_exclusive"] == 5 and took == 2
    got, took = run_frontier([sample(5), sample(6), sample(6, 4), OSError("down"), sample(7), sample(7, problems=("task failed",)), sample(7), sample(7), sample(7)])
    assert got[boundary.TOPICS[0]]["offset_exclusive"] == 7 and took == 8
    with pytest.raises(TimeoutError, match="behind"):
        run_frontier([sample(5, 3)] * 99)


def test_health():
    running = boundary.Connector("RUNNING", ("RUNNING",))
    sound = boundary.Sample(dict.fromkeys(boundary.TOPICS, 5), dict.fromkeys(boundary.TOPICS, 3), (), dict.fromkeys(boundary.TOPICS, (0,)), running, ("g", 1))
    assert boundary.health(sound, "g") == [] and boundary.complaints(sound)[0].endswith("2 behind")
    t = boundary.TOPICS[0]
    bad = {
        "connector is PAUSED": {"connector": boundary.Connector("PAUSED", ("RUNNING",))}, "task 1 is FAILED": {"connector": boundary.Connector("RUNNING", ("RUNNING", "FAILED"))}, "connector without tasks": {"connector": boundary.Connector("RUNNING", ())},
        "group x instead of g": {"group": ("x", 1)}, "group g has no members": {"group": ("g", 0)}, f"{t}[0] is missing": {"partitions": {u: (0,) for u in boundary.TOPICS[1:]}}, f"{t}[1] is not expected": {"partitions": sound.partitions | {t: (0, 1)}},
        f"{t}: negative offsets -1 of 5": {"committed": sound.committed | {t: -1}}, f"{t}: committed beyond its end": {"committed": sound.committed | {t: 9}}, f"{t}: offsets are missing": {"ends": {u: 5 for u in boundary.TOPICS[1:]}},
    }
    for why, change in bad.items():
        assert boundary.health(dataclasses.replace(sound, **change), "g") == [why]
