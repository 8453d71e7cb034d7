"""Problems 1 to 6: edge cases and brute force."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import cdc_fold, deliveries, hierarchy, pit_asof, rejects, relational, satellites, segments
from tidewater.runtime import new_dir
from tidewater.table.snapshots import CommitConflict

T0 = dt.datetime(2026, 1, 1, tzinfo=dt.UTC)


def mid(topic, p, o):
    return hashlib.sha256(f"{topic}:{p}:{o}".encode()).hexdigest()


# -- 1 ------------------------------------------------------------------------

_LEDGER = "event_id string, kafka_topic string, kafka_partition int, kafka_offset bigint, key_json string, event_date date, ingested_at timestamp, mid string, row string, copies int"


def delivery(eid, t, p, o, key, day, minute):
    at = None if minute is None else T0 + dt.timedelta(minutes=minute)
    return eid, t, p, o, key, None if day is None else dt.date(2026, 1, day), at, "clash", "clash", 7


def test_deliveries(spark):
    a, b = mid("t", 0, 1), mid("t", 1, 2)
    first = [
        delivery(a, "t", 0, 1, '{"id":1}', 1, 5),
        delivery(a.upper(), "t", 0, 1, '{"id":1}', 1, 3),
        delivery(b, "t", None, 2, '{"id":2}', 1, 9),
        delivery(None, "t", 1, 3, '{"id":2}', 2, None),
        delivery(None, None, None, None, None, None, None),
    ]
    late = [
        delivery(None, "t", 1, 2, '{"id":2}', 2, 1),  # same message, ingested earlier, on another day
        delivery(" " + mid("t", 0, 9) + " ", "t", None, 9, '{"id":1}', 3, 50),
        delivery(None, "t", None, 3, '{"id": 2}', 2, 60),  # partition known from its key in this batch
        delivery(None, None, None, None, None, None, None),
    ]
    schema = spark.createDataFrame([], _LEDGER).schema
    t = deliveries.DeliveryTable(spark, new_dir(spark, "p1"), schema)
    t.apply(spark.createDataFrame(first, _LEDGER))
    before = {d for ds in t.kept.snapshot().parts.values() for d in ds}
    did = t.apply(spark.createDataFrame(late, _LEDGER))
    got = {r.event_id: r for r in t.rows().collect()}
    assert {k: r.copies for k, r in got.items() if k in (a, b, mid("t", 1, 3), mid("t", 0, 9))} == {a: 2, b: 2, mid("t", 1, 3): 2, mid("t", 0, 9): 1}
    assert got[a].row.ingested_at.minute == 3 and got[a].row.copies == 7
    assert got[b].row.event_date == dt.date(2026, 1, 2) and got[b].row.ingested_at.minute == 1
    assert len(got) == 5 and sum(r.copies for r in got.values()) == 9
    assert set(did["affected"]) >= {"2026-01-01", "2026-01-02"} and "2026-01-03" not in did["affected"]
    assert {d for ds in t.kept.snapshot().parts.values() for d in ds}.isdisjoint({d for d in before if "2026-01-01" in d})
    again = t.apply(spark.createDataFrame(late[:2], _LEDGER))
    assert again["affected"] and {r.event_id: r.copies for r in t.rows().collect()}[b] == 3


def test_deliveries_leave_other_partitions_alone(spark):
    schema = spark.createDataFrame([], _LEDGER).schema
    t = deliveries.DeliveryTable(spark, new_dir(spark, "p1"), schema)
    t.apply(spark.createDataFrame([delivery(None, "t", 0, o, "{}", 1 + o % 3, o) for o in range(30)], _LEDGER))
    parts = t.kept.snapshot().parts
    t.apply(spark.createDataFrame([delivery(None, "t", 0, 3, "{}", 1, 99)], _LEDGER))
    after = t.kept.snapshot().parts
    assert [p for p in parts if parts[p] != after[p]] == ["2026-01-01"]
    t.apply(spark.createDataFrame([], _LEDGER))
    assert t.rows().count() == 30


def test_messages_without_offset_keep_their_event_ids(spark):
    rows = [delivery(e, t, 0, o, "{}", 1, 5) for e in ("aa", "BB", "cc", "aa") for t, o in (("t", None), (None, 4))]
    rows += [delivery(None, "t", p, None, '{"id":1}', 1, 5) for p in (1, 2)]
    want = {"aa": 4, "bb": 2, "cc": 2, mid("t", 1, ""): 1, mid("t", 2, ""): 1}
    assert {r.event_id: r.copies for r in deliveries.replay(spark.createDataFrame(rows, _LEDGER)).rows().collect()} == want


def test_replay_of_empty_ledger(spark):
    assert deliveries.replay(spark.createDataFrame([], _LEDGER)).rows().count() == 0


def test_replay_sends_copies_through_the_index(spark):
    day = lambda o: 1 + o % 5
    rows = [delivery(None, "t", 0, o, f'{{"id":{o}}}', day(o), 10 * o + late) for o in range(40) for late in (0, 1, 45)]
    rows += [delivery(None, "t", None, 0, '{"id": 0}', 1, 600), delivery(None, "t", 0, 1, '{"id":1}', 2, None)]  # known by a key of the first batch; ingested at no known time
    for times in (1, 2):  # a batch that is sent again doesn't count again
        t = deliveries.replay(spark.createDataFrame(rows, _LEDGER), times=times)
        assert {r.event_id: r.copies for r in t.rows().collect()} == {mid("t", 0, o): 3 + (o < 2) for o in range(40)}
        assert all(r.row.ingested_at.minute == 10 * int(r.row.kafka_offset) % 60 for r in t.rows().collect())
        log = t.kept.log()
        assert len(log) == deliveries.BATCHES
    # every later batch replaces folders of the one before, which only the index leads to
    dirs = [{d for ds in s.parts.values() for d in ds} for s in sorted(log, key=lambda s: s.id)]
    assert all(a - b for a, b in zip(dirs, dirs[1:]))


def test_result_does_not_depend_on_how_rows_meet(spark, monkeypatch):
    """Places of keys may be told before, with or after the rows that lack one."""
    monkeypatch.setattr(deliveries, "INDEX_FOLDERS", 1)
    rows = [delivery(None, "t", p, o, f'{{"id":{k}}}', 1 + o % 2, m) for m, (p, o, k) in enumerate([(1, 5, 1), (None, 5, 1), (None, 6, 1), (1, 6, 1), (None, 7, 2), (None, 7, 2), (2, 8, 2), (None, 9, 3), (None, 9, 3), (0, 1, None), (None, 2, None)])]
    rows += [delivery(None, "t", None, 3, None, 1, 20), delivery(None, "t", 7, 4, None, 1, 21)]  # no key, so no place is told
    rows += [delivery("odd id", "t", None, 1, None, 1, 30), delivery(" ODD ID", None, None, None, None, 2, 31)]
    want = {mid("t", 1, 5): 2, mid("t", 1, 6): 2, mid("t", 2, 7): 2, mid("t", 2, 8): 1, hashlib.sha256(b't:{"id":3}:9').hexdigest(): 2, mid("t", 0, 1): 1, mid("t", 0, 2): 1, hashlib.sha256(b"t::3").hexdigest(): 1, mid("t", 7, 4): 1, "odd id": 2}
    schema = spark.createDataFrame([], _LEDGER).schema
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        t = deliveries.DeliveryTable(spark, new_dir(spark, "p1"), schema)
        for part in (rows,) if seed == 0 else (rows[:4], rows[4:9], rows[9:]):
            t.apply(spark.createDataFrame(part, _LEDGER))
        assert {r.event_id: r.copies for r in t.rows().collect()} == want
        assert len(t.kept.snapshot().aux["index"]) <= 2


def test_failed_and_racing_batches_leave_nothing(spark, monkeypatch):
    schema = spark.createDataFrame([], _LEDGER).schema
    root = new_dir(spark, "p1")
    t, other = (deliveries.DeliveryTable(spark, root, schema) for _ in "ab")
    batch = lambda o, late=0: spark.createDataFrame([delivery(None, "t", 0, o, "{}", 1, late)], _LEDGER)
    t.apply(batch(1), "w", 1)
    for step in ("_index_folders", "affected"):  # dies before the commit, however far it came
        with monkeypatch.context() as m:
            m.setattr(deliveries.DeliveryTable, step, lambda *_: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                t.apply(batch(2), "w", 2)
    assert t.apply(batch(2), "w", 2)["repeated"] is False and t.apply(batch(2), "w", 2)["repeated"] is True
    assert t.apply(batch(1), "w", 1)["repeated"] is True and t.apply(batch(3), "v", 1)["repeated"] is False
    look = deliveries.DeliveryTable.affected

    def overtaken(self, snap, staged):
        monkeypatch.setattr(deliveries.DeliveryTable, "affected", look)
        other.apply(batch(4))
        return look(self, snap, staged)

    monkeypatch.setattr(deliveries.DeliveryTable, "affected", overtaken)
    with pytest.raises(CommitConflict):
        t.apply(batch(4, 5), "w", 3)
    assert t.apply(batch(4, 5), "w", 3)["affected"] == ["2026-01-01"]
    assert {r.event_id: r.copies for r in t.rows().collect()} == {mid("t", 0, o): 1 + (o == 4) for o in (1, 2, 3, 4)}


# -- 2 ------------------------------------------------------------------------

_ORDERS = "order_id bigint, customer_id bigint, lifecycle_start_lsn bigint, is_snapshot_baseline boolean, updated_at timestamp, customer_key string, seg int, salt int"
_VERSIONS = "customer_key string, customer_id bigint, valid_from_lsn bigint, valid_to_lsn bigint, is_snapshot_baseline boolean, kafka_offset bigint, starts int, bucket int"


def in_force_by_hand(orders, versions):
    out = {}
    best = {}
    for o in orders:
        k = (o[4] or dt.datetime.min.replace(tzinfo=dt.UTC))
        if o[0] is not None and (o[0] not in best or k > best[o[0]][0]):
            best[o[0]] = (k, o)
    per = {}
    for key, c, f, t, base, off, *_ in versions:
        start = -1 if base else f
        if c is None or start is None or key is None:
            continue
        if (c, start) not in per or (off, key, -1 if t is None else t) > per[c, start][0]:
            per[c, start] = ((off, key, -1 if t is None else t), key, t)
    for _, (oid, c, lsn, base, *_) in best.values():
        if c is None or (not base and lsn is None):
            continue
        place = -1 if base else lsn
        starts = [s for cc, s in per if cc == c and s <= place]
        if starts:
            _, key, t = per[c, max(starts)]
            if base or t is None or t > lsn:
                out[oid] = key
    return out


@pytest.mark.parametrize("bucket_rows", [5, 200_000])
def test_in_force_against_brute_force(spark, bucket_rows):
    rng = random.Random(3)
    versions, orders = [], []
    for c in [1] * 40 + list(range(2, 12)):
        start = rng.randrange(0, 300)
        base = rng.random() < 0.15
        end = None if rng.random() < 0.3 else start + rng.randrange(1, 60)
        v = (f"k{len(versions)}", c, None if base else start, end, base, len(versions), 1, 2)
        versions += [v] * rng.randrange(1, 3)
    versions += [(None, 1, 5, None, False, 1, 0, 0), ("x", None, 5, None, False, 1, 0, 0), ("y", 1, None, None, False, 1, 0, 0)]
    for i in range(120):
        base = rng.random() < 0.2
        o = (i, rng.choice([1, 1, 1, *range(2, 13), None]), None if base or rng.random() < 0.05 else rng.randrange(0, 340), base, T0, "old", 3, 4)
        orders += [o, (*o[:4], T0 + dt.timedelta(days=1), *o[5:])] if i % 7 == 0 else [o]
    o, v = spark.createDataFrame(orders, _ORDERS), spark.createDataFrame(versions, _VERSIONS)
    got = {r.order_id: r.customer_key for r in pit_asof.in_force(o, v, bucket_rows).collect()}
    assert got == in_force_by_hand(orders, versions)
    assert pit_asof.in_force(o.limit(0), v).count() == 0 and pit_asof.in_force(o, v.limit(0)).count() == 0


def test_no_bucket_outgrows_its_bound_whoever_has_the_rows(spark):
    orders = spark.range(3_000).selectExpr("id order_id", "1L customer_id", "if(id < 2000, null, id) lifecycle_start_lsn", "id < 2000 is_snapshot_baseline", "timestamp'2026-01-01' updated_at")
    versions = spark.range(2_000).selectExpr("concat('k', id) customer_key", "1L customer_id", "if(id = 0, null, id * 2) valid_from_lsn", "cast(null as bigint) valid_to_lsn", "id = 0 is_snapshot_baseline", "id kafka_offset")
    sizes = [r["count"] for r in pit_asof.buckets(orders, versions, 100).groupBy("bucket").count().collect()]
    assert sum(sizes) >= 5_000 and max(sizes) <= 101
    got = {r.order_id: r.customer_key for r in pit_asof.in_force(orders, versions, 100).collect()}
    assert got == {i: "k0" if i < 2000 else f"k{i // 2}" for i in range(3_000)}


# -- 3 ------------------------------------------------------------------------

_CHANGES = "source_table string, operation string, source_lsn bigint, kafka_offset bigint, key_json string, after_json string, last string, entity_id string"


def change(op, lsn, offset, key=1, after="{}"):
    return "orders", op, lsn, offset, f'{{"order_id": {key}}}', after, "x", "y"


def test_fold_in_any_order_and_grouping(spark):
    rows = [change("r", 99, 0), change("c", 5, 3), change("u", 5, 4, after='{"a":1}'), change("D ", 7, 6, key=2), change("u", 6, 5, key=2), change("r", None, 1, key=3), change("R", 50, 2, key=3), change("u", None, 8, key=4), change("c", 1, 7, key=4)]
    rows += [("orders", "c", 1, 9, k, "{}", "", "") for k in (None, "", '{"order_id": null}', "junk")]
    rows += rows[:4]
    want = {(1, 4), (3, 2), (4, 7)}
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, _CHANGES)
        assert {(r.entity_id, r.kafka_offset) for r in cdc_fold.live(cdc_fold.fold(df)).collect()} == want
        half = cdc_fold.fold(spark.createDataFrame(rows[:8], _CHANGES))
        both = cdc_fold.fold(spark.createDataFrame(rows[8:], _CHANGES), base=half)
        assert {(r.entity_id, r.kafka_offset) for r in cdc_fold.live(both).collect()} == want
    late = cdc_fold.fold(spark.createDataFrame([change("u", 3, 1, key=2)], _CHANGES), base=cdc_fold.fold(df))
    assert 2 not in {r.entity_id for r in cdc_fold.live(late).collect()}
    assert cdc_fold.live(cdc_fold.fold(df.limit(0))).count() == 0


# -- 4 ------------------------------------------------------------------------

_CHANGED = "customer_id bigint, operation string, is_snapshot_baseline boolean, valid_from_lsn bigint, kafka_offset bigint, segment string, customer_status string, place string, hash_diff string, next_place int"


def periods_by_hand(rows):
    best = {}
    for c, op, base, lsn, off, s, t, *_ in rows:
        if c is None:
            continue
        place = -1 if base else (lsn or 0)
        norm = None if op == "d" else tuple(None if x is None else x.strip().lower() for x in (s, t))
        if (c, place) not in best or off >= best[c, place][0]:
            best[c, place] = (off, norm)
    out = set()
    for c in {c for c, _ in best}:
        places = sorted(p for cc, p in best if cc == c)
        now = None
        for p in [*places, None]:
            state = best[c, p][1] if p is not None else "end"
            if now and state != now[1]:
                out.add((c, max(now[0], 0), -1 if p is None else p))
                now = None
            if now is None and state not in (None, "end"):
                now = (p, state)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_history_against_brute_force(spark, seed, monkeypatch):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        c = rng.choice([1, 1, 1, 2, 3, None])
        op = rng.choice(["u", "u", "u", "u", "d", "c"]) if i % 29 else "r"
        gone = op == "d"
        rows.append((c, op, op == "r", None if op == "r" else rng.randrange(1, 250), i, None if gone else rng.choice(["Vip", " vip", "standard", None]), None if gone else rng.choice(["active", "ACTIVE\t", "churned"]), "x", "y", 1))
    df = spark.createDataFrame(rows + rows[:50], _CHANGED)
    s = satellites.CUSTOMER_SATELLITES[0]
    built = satellites.build(df, s)
    got = [tuple(r) for r in satellites.versions(built).select("customer_id", "valid_from_lsn", "valid_to_lsn").collect()]
    assert sorted(got) == sorted(periods_by_hand(rows))
    # insert-only loads in any order give the same view, and loading again adds nothing
    table = satellites.SatelliteTable(spark, new_dir(spark, "satellite"), s)
    order = [rows[:150] + rows[:9], rows[250:], rows[150:250]]
    for k, part in enumerate(order):
        table.append(spark.createDataFrame(part, _CHANGED), piece_rows=[200_000, 7, 50][k])
        view = satellites.satellite_view(table.rows(), s, 13).select("customer_id", "valid_from_lsn", "valid_to_lsn")
        assert sorted(tuple(r) for r in view.collect()) == sorted(periods_by_hand(sorted(sum(order[: k + 1], []), key=lambda r: r[4])))
    stored = table.rows().count()
    assert table.append(spark.createDataFrame(order[1], _CHANGED)) is None and table.rows().count() == stored < 350
    assert satellites.versions(satellites.build(df.limit(0), s)).count() == 0
    assert table.append(df.limit(0)) is None


def test_append_writes_in_proportion_to_the_batch(spark):
    s = satellites.CUSTOMER_SATELLITES[0]
    history = spark.range(2_000).selectExpr("id % 20 customer_id", "'u' operation", "false is_snapshot_baseline", "id valid_from_lsn", "id kafka_offset", "concat('s', (id div 20) % 3) segment", "'active' customer_status")
    table = satellites.SatelliteTable(spark, new_dir(spark, "satellite"), s)
    table.append(history)
    before = table.table.snapshot()
    table.append(history.limit(5).selectExpr("customer_id", "operation", "is_snapshot_baseline", "9000 valid_from_lsn", "9000 kafka_offset", "'new' segment", "customer_status"))
    after = table.table.snapshot()
    assert all(after.parts[k][: len(before.parts[k])] == before.parts[k] for k in before.parts)
    added = {k: spark.read.parquet(f"{table.table.root}/{after.parts[k][-1]}").count() for k in after.parts}
    assert added == {"satellite": 5, "tracking": 5}


def test_satellites_are_split_by_rate(spark):
    n = spark.range(300).selectExpr("1L customer_id", "'u' operation", "false is_snapshot_baseline", "id valid_from_lsn", "id kafka_offset", "string(id % 2) a", "string(id % 3) b", "string(id div 100) c", "'x' d")
    for size in (7, 200_000):
        rates = {r.attribute: r.versions for r in satellites.change_rates(n, ["a", "b", "c", "d"], size).collect()}
        assert rates == {"a": 300, "b": 300, "c": 3, "d": 1}
    assert satellites.split_by_rate(rates) == [("a", "b"), ("c",), ("d",)] and satellites.split_by_rate({}) == []


def test_no_satellite_of_customers_mixes_rates(spark):
    """The satellites in use are cut along the groups that the data's rates give."""
    changed = spark.read.parquet("/root/testdata/sf0.01/int_cdc_customer_versions.parquet")
    names = [a for s in satellites.CUSTOMER_SATELLITES for a in s.attributes]
    rates = {r.attribute: r.versions for r in satellites.change_rates(changed, names).collect()}
    groups = [set(g) for g in satellites.split_by_rate(rates)]
    assert len(groups) > 1 and all(any(set(s.attributes) <= g for g in groups) for s in satellites.CUSTOMER_SATELLITES), rates


@pytest.mark.parametrize("size", [1, 4, 1000])
def test_rows_beside_across_pieces(spark, size):
    rng = random.Random(size)
    rows = sorted({(rng.choice([None, 1, 1, 1, 2, 3]), rng.randrange(60)) for _ in range(90)}, key=str)
    df = spark.createDataFrame([(k, p, rng.choice("ab")) for k, p in rows], "k long, p long, s string")
    state = {(r.k, r.p): r.s for r in df.collect()}
    by = lambda key: sorted(p for k, p in state if k == key)
    after = {(k, p): next((q for q in by(k) if q > p), None) for k, p in state}
    got = {(r.k, r.p): r.n and r.n.p for r in segments.next_row(df, "k", "p", ["p"], "n", size).collect()}
    assert got == after
    back = {(r.k, r.p): r.n and r.n.p for r in segments.previous_row(df, "k", "p", ["p"], "n", size).collect()}
    assert back == {(k, p): next((q for q in reversed(by(k)) if q < p), None) for k, p in state}
    kept = {(k, p): s for (k, p), s in state.items() if back[k, p] is None or state[k, back[k, p]] != s}
    want = {(k, p): next((q for q in by(k) if q > p and (k, q) in kept), None) for k, p in kept}
    assert {(r.k, r.p): r.next_position for r in segments.changes(df, "k", "p", "s", size).collect()} == want
    pieces = segments.in_pieces(df, ["k", "p"], size)
    assert max(r["count"] for r in pieces.groupBy("__piece").count().collect()) <= size


@pytest.mark.parametrize("hot_rows", [3, 10_000])
def test_lookup_of_hot_keys(spark, hot_rows):
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(k, 0) for k in (2, 2, 3, None)], "k long, v long")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d"), (None, "n")], "r long, w string")
    got = sorted(((r.k, r.v, r.w) for r in relational.lookup(left, "k", right, "r", hot_rows=hot_rows).collect()), key=str)
    assert got == sorted([(1, i, "a") for i in range(50)] + [(2, 0, "b")] * 2 + [(3, 0, None), (None, 0, None)], key=str)
    assert relational.lookup(left, "k", right, "r", "inner", hot_rows).count() == 52


# -- 5 ------------------------------------------------------------------------


def roots_by_hand(parent):
    out = {}
    for n in parent:
        seen, at, depth = {}, n, 0
        while at not in seen:
            seen[at] = depth
            up = parent[at]
            if up is None or up not in parent:
                out[n] = (at, depth)
                break
            at, depth = up, depth + 1
        else:
            ring = [k for k, d in seen.items() if d >= seen[at]]
            out[n] = (min(ring), -1)
    return out


@pytest.mark.parametrize("bucket", [7, 1000])
def test_hierarchy_against_brute_force(spark, bucket):
    rng = random.Random(5)
    parent = {i: rng.choice([None, 999_999, *range(200)]) if rng.random() < 0.08 else rng.randrange(200) if rng.random() < 0.15 else max(0, i - rng.randrange(1, 4)) for i in range(200)}
    parent |= {i: i - 1 for i in range(301, 360)} | {300: None, 500: 501, 501: 502, 502: 500, 503: 502, 600: 600, 700: 701, 701: 700}
    parent |= {1000 + i: 1000 + (i + 1) % 40 for i in range(40)}
    nodes = spark.createDataFrame(list(parent.items()), "id long, parent long")
    found = hierarchy.roots(nodes, bucket)
    assert {r.id: (r.root, r.depth) for r in found.collect()} == roots_by_hand(parent)
    if bucket == 1000:
        p = hierarchy.paths(nodes, found)
        for r in p.collect():
            assert (r.path is None) == (r.depth < 0)
            if r.path:
                assert r.path[0] == r.root and r.path[-1] == r.id and len(r.path) == r.depth + 1
                assert all(parent[b] == a for a, b in zip(r.path, r.path[1:]))


@pytest.mark.parametrize("shape", ["star", "hub below a chain", "ring with tails"])
def test_no_bucket_of_links_outgrows_its_bound(spark, shape, monkeypatch):
    """However many nodes point at one, and however deep it lies."""
    n, bound = 3_000, 300
    parent = {
        "star": {i: 0 if i else None for i in range(n)},
        "hub below a chain": {i: i - 1 if 0 < i < 400 else 399 if i else None for i in range(n)},
        "ring with tails": {i: (i + 1) % 500 if i < 500 else 7 for i in range(n)},
    }[shape]
    sizes, pieces = [], hierarchy.in_pieces

    def watched(*args):
        out = pieces(*args)
        sizes.extend(r["count"] for r in out.groupBy("bucket").count().collect())
        return out

    monkeypatch.setattr(hierarchy, "in_pieces", watched)
    nodes = spark.createDataFrame(list(parent.items()), "id long, parent long")
    found = hierarchy.roots(nodes, bound, hot_rows=100)
    assert {r.id: (r.root, r.depth) for r in found.collect()} == roots_by_hand(parent)
    assert (max(sizes) <= bound and len(sizes) > 5) or shape == "star"
    if shape == "hub below a chain":
        assert all(r.path == [*range(400), r.id][: r.depth + 1] or r.id < 400 and r.path == [*range(r.id + 1)] for r in hierarchy.paths(nodes, found, hot_rows=100).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_paths_and_descendants_of_rings_against_brute_force(spark, seed):
    rng = random.Random(seed)
    parent = {i: rng.choice([None, 999, *range(60)]) for i in range(60)} | {70: 70, 71: 70, 81: 83, 82: 81, 83: 82, 84: 82, 85: 84}
    nodes = spark.createDataFrame(list(parent.items()), "id long, parent long")
    roots = roots_by_hand(parent)
    whole = hierarchy.whole_paths(nodes, hierarchy.roots(nodes))
    pairs, paths = set(), {}
    for n in parent:
        chain = [n]
        while parent[chain[-1]] in parent and parent[chain[-1]] not in chain:
            chain.append(parent[chain[-1]])
        pairs |= {(a, n, k) for k, a in enumerate(chain)}
        paths[n] = (*roots[n], chain[chain.index(roots[n][0]) :: -1])
    assert {r.id: (r.root, r.depth, r.path) for r in whole.collect()} == paths
    got = [tuple(r) for r in hierarchy.descendants(whole).collect()]
    assert len(got) == len(pairs) and set(got) == pairs
    assert {(83, 81, 1), (81, 83, 2), (81, 85, 3), (83, 85, 4)} <= pairs


def test_latest_category_rows(spark):
    d = lambda k: dt.date(2026, 1, k)
    rows = [(1, None, "old", d(1), T0, 0, "b", "o"), (1, 2, "new", d(2), T0, 0, "b", "o"), (1, 2, "new", d(2), T0, 0, "b", "o"), (2, None, "n", d(1), None, None, None, None), (None, 1, "x", d(1), T0, 0, "b", "o")]
    df = spark.createDataFrame(rows, "category_id bigint, parent_category_id bigint, name string, _batch_date date, _ingested_at timestamp, _source_object_row_position bigint, _batch_id string, _source_object string")
    got = {r.id: (r.parent, r.name) for r in hierarchy.latest(df).collect()}
    assert got == {1: (2, "new"), 2: (None, "n")}
    assert hierarchy.roots(hierarchy.latest(df.limit(0))).count() == 0


# -- 6 ------------------------------------------------------------------------

CSV = rejects.Contract("c", "csv", ";", (rejects.Field("a", "string"), rejects.Field("n", "integer"), rejects.Field("d", "date")))
JSON = rejects.Contract("j", "json", None, (rejects.Field("a", "string"), rejects.Field("b", "string")))

CASES = [
    ("c", 'x;1;2024-02-29', None), ("c", '"x;y";"-3";"2024-01-01"', None), ("c", '"a ""b""\nc";1;2024-01-01', None), ("c", 'x;1;2023-02-29', "value"), ("c", 'x;1.0;2024-01-01', "value"), ("c", ';1;2024-01-01', "value"),
    ("c", '"\t";1;2024-01-01', "value"), ("c", 'x;1', "columns"), ("c", 'x;1;2024-01-01;', "columns"), ("c", "", "columns"), ("c", 'x";1;2024-01-01', "syntax"), ("c", '"x;1;2024-01-01', "syntax"), ("c", '"x"y;1;2024-01-01', "syntax"),
    ("c", '"x" ;1;2024-01-01', "syntax"), ("c", None, "syntax"), ("c", 'x;1;2024-01-01\n', "value"), ("c", 'x;１;2024-01-01', "value"), ("c", 'x;1;0000-01-01', "value"), ("c", '"' + '""' * 200_000 + '";1;2024-01-01', None), ("c", "y" * 2_000_000 + ";1;2024-01-01", None),
    ("j", '{"a":"x","b":"y","c":{"d":[1,null]}}', None), ("j", '{"a":"x","b":1}', "value"), ("j", '{"a":"x","b":""}', "value"), ("j", '{"a":"x","b":null}', "value"), ("j", '{"a":"x"}', "columns"), ("j", '{"A":"x","b":"y"}', "columns"),
    ("j", '{"a":"x","b":"y",}', "syntax"), ("j", "{'a':'x','b':'y'}", "syntax"), ("j", '[{"a":"x","b":"y"}]', "syntax"), ("j", '{"a":"x","b":NaN}', "syntax"), ("j", '{"a":"x","b":"y"} x', "syntax"), ("j", '{"a":"x","b":"y', "syntax"), ("j", None, "syntax"), ("j", "[" * 100_000, "syntax"),
    ("unknown", "x", "columns"), (None, "x", "columns"),
]


def test_reject_cases(spark):
    df = spark.createDataFrame([(i, s, r, "e", "old") for i, (s, r, _) in enumerate(CASES)], "record_id int, source string, raw_record string, __v0 string, reason string")
    assert rejects.rejected(df, [CSV, JSON]).select("__v0").distinct().collect() == [("e",)]
    got = {r.record_id: r.reason for r in rejects.rejected(df, [CSV, JSON]).select("record_id", "reason").collect()}
    assert got == {i: why for i, (_, _, why) in enumerate(CASES) if why}
    good = rejects.typed(df, CSV).collect()
    assert {r.record_id for r in good} == {i for i, (s, _, why) in enumerate(CASES) if s == "c" and not why}
    assert [r.d for r in good if r.record_id == 0] == [dt.date(2024, 2, 29)] and [r.a for r in good if r.record_id == 2] == ['a "b"\nc']
    assert rejects.typed(df, JSON).select("a", "b").collect()[0] == ("x", "y")
    assert rejects.rejected(df.limit(0), [CSV, JSON]).count() == 0


def test_numbers_that_types_cannot_hold_are_kept_as_written(spark):
    c = rejects.Contract("n", "csv", ";", (rejects.Field("i", "integer"), rejects.Field("x", "decimal")))
    big, fine = "9" * 30, "1" * 33 + ".5"
    rows = [("9223372036854775807", "1.2500000"), (big, "1.5"), ("-1", "0.0000004"), ("2", fine), ("x", fine), ("-" + big, "1.12345678")]
    df = spark.createDataFrame([(k, "n", f"{i};{x}") for k, (i, x) in enumerate(rows)], "record_id int, source string, raw_record string")
    got = {(r.record_id, r.field, r.exact) for r in rejects.inexact(df, c).collect()}
    assert got == {(1, "i", big), (2, "x", "0.0000004"), (3, "x", fine), (5, "i", "-" + big), (5, "x", "1.12345678")}
    rows = {r.record_id: r for r in rejects.typed(df, c).collect()}
    assert set(rows) == {0, 1, 2, 3, 5} and {(k, f, t) for k, r in rows.items() for f, t in (r.as_written or {}).items()} == got
    assert rows[0].as_written is None and rows[0].i == 2**63 - 1 and str(rows[0].x) == "1.250000" and rows[2].x is None and rows[2].i == -1


def test_json_of_any_depth(spark):
    deep = lambda n, m: '{"a":"x","b":"y","c":' + "[" * n + "]" * m + "}"
    rows = [(0, deep(200_000, 200_000)), (1, deep(200_000, 199_999)), (2, '{"a":"x","c":' + '{"d":' * 50_000 + "1" + "}" * 50_000 + ',"b":"y"}'), (3, '{"a":' + "[" * 60_000 + "]" * 60_000 + ',"b":"y"}'), (4, deep(60_000, 60_000) + "x")]
    df = spark.createDataFrame([(i, "j", r) for i, r in rows], "record_id int, source string, raw_record string")
    assert {r.record_id: r.reason for r in rejects.rejected(df, [JSON]).collect()} == {1: "syntax", 3: "value", 4: "syntax"}


@pytest.mark.parametrize("seed", range(3))
def test_deep_parser_agrees_with_the_strict_one(seed):
    rng = random.Random(seed)
    parts = ['"a"', '"b\\n"', "1", "-0.5e3", "01", "true", "nul", "{", "}", "[", "]", ",", ":", " ", '"\\x"', "{}", "[]", '{"a":1}', '"k":']
    texts = ["{" + "".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) + "}" for _ in range(4000)] + ['{"a":"x","b":[1,{"c":null}],"d":-1.5}']
    agree = 0
    for t in texts:
        a, b = rejects.strict_object(t), rejects.deep_object(t)
        assert (a is None) == (b is None), t
        if a is not None:
            assert set(a) == set(b) and all((type(v) is str) == (type(b[k]) is str) and (type(v) is not str or v == b[k]) and (v is None) == (b[k] is None) for k, v in a.items())
            agree += 1
    assert agree > 10


def test_contract_table(spark):
    fields = spark.createDataFrame([("c", "csv", ";", "1", k, n, t, True) for k, (n, t) in enumerate([("a", "string"), ("n", "integer"), ("d", "date")])], "source string, file_format string, delimiter string, schema_version string, field_position int, field_name string, field_type string, required boolean")
    assert rejects.contracts(fields) == [CSV]
    with pytest.raises(ValueError):
        rejects.value_error(F.lit("x"), rejects.Field("a", "money"), False)
