import pytest
from pyspark.sql import functions as F

from tidewater.plans import bench
from tidewater.runtime import new_dir
from tidewater.table import maintenance as m
from tidewater.table import mutate
from tidewater.table.publish import SERVED, Serving, ServingStore, checksum
from tidewater.table.snapshots import CommitConflict, SnapshotTable

DDL = "k long, day date, v string"


def frame(spark, ks, day="2026-01-01", v="x"):
    return spark.createDataFrame([(k, v) for k in ks], "k long, v string").select("k", F.lit(day).cast("date").alias("day"), "v")


@pytest.fixture
def table(spark):
    t = SnapshotTable(spark, new_dir(spark, "table"))
    return t.create(spark.createDataFrame([], DDL).schema, "day")


def test_commits_and_time_travel(spark, table):
    assert table.snapshot() is None and table.read().count() == 0
    a = table.append(frame(spark, range(4)))
    b = table.append(frame(spark, [9], "2026-01-02"))
    c = table.overwrite(frame(spark, [100, 101]), ["2026-01-01"])
    d = table.append(frame(spark, [7], None))
    assert [s.parent for s in table.log()] == [None, a.id, b.id, c.id]
    assert table.read(a.id).count() == 4 and table.read(b.id).count() == 5
    assert sorted(r.k for r in table.read().collect()) == [7, 9, 100, 101]
    assert table.read(partitions=["2026-01-02"]).count() == 1 and table.read(partitions=["__null__"]).first().k == 7
    with pytest.raises(CommitConflict):
        table.commit({}, "late", b)
    assert table.snapshot().id == d.id
    with pytest.raises(KeyError):
        table.read(99)
    with pytest.raises(ValueError):
        SnapshotTable(spark, table.root).create(spark.createDataFrame([], "x int").schema)


def test_compaction(spark, table):
    for k in range(5):
        table.append(frame(spark, [k, k + 10]))
    table.append(frame(spark, [50], "2026-01-02"))
    inv = {r.partition: r for r in m.inventory(table).collect()}
    assert inv["2026-01-01"].is_candidate and not inv["2026-01-02"].is_candidate
    plan = m.compact(table)
    assert plan.partitions == 1 and plan.snapshot is None
    before = table.snapshot().id
    did = m.compact(table, confirm=True, unique="k")
    assert did.rewritten_files >= 5 and did.added_files == 1
    assert m.lost_rows(table, before).count() == 0 and table.read().count() == 11
    assert {r.partition: r.rows for r in m.rows_by_partition(table).select(F.col("partition").cast("string").alias("partition"), "rows").collect()} == {"2026-01-01": 10, "2026-01-02": 1}
    assert m.compact(table, confirm=True).rewritten_files == 0
    with pytest.raises(ValueError):
        m.inventory(table, 1000)
    with pytest.raises(ValueError):
        m.CompactionMetrics(1, 3, 0, None)


def test_expiry(spark, table):
    for k in range(6):
        table.overwrite(frame(spark, [k]))
    table.set_ref("audit", 2)
    later = table.log()[-1].committed_ms + 40 * 86_400_000
    assert [s.id for s in m.expirable(table, keep=2, now_ms=later)] == [1, 3, 4]
    assert m.expirable(table, keep=2) == []
    assert m.expire(table, keep=2, now_ms=later)["folders"] == []
    done = m.expire(table, keep=2, now_ms=later, confirm=True)
    assert done["snapshots"] == [1, 3, 4] and len(done["folders"]) == 3
    assert table.read(2).first().k == 1 and table.read().first().k == 5
    assert {r.name for r in m.refs(table).collect()} == {"audit", "main"} and m.snapshots(table).count() == 3
    assert {r.name: r.parent_id for r in m.ref_snapshots(table).collect()} == {"audit": 1, "main": 5}
    with pytest.raises(ValueError):
        m.expirable(table, older_than_days=1)
    with pytest.raises(RuntimeError, match="bad in compact.*good"):
        m.maintain({"bad": None, "good": table})
    (spark.sparkContext._jvm.java.io.File(table.files_.path(f"{table.root}/_log/0000000005.json").toUri().getPath())).delete()
    with pytest.raises(RuntimeError, match="broken"):
        m.expirable(table, keep=3)


def test_stages_and_command_line(spark, table, capsys):
    for k in range(3):
        table.append(frame(spark, [k]))
    plan = m.maintain({"t": table})["t"]
    assert plan["compact"].partitions == 1 and table.snapshot().id == 3
    assert m.main(["apply", table.root], spark) == 2 and table.snapshot().id == 3
    assert m.main(["plan", table.root], spark) == 0 and table.snapshot().id == 3
    assert m.main(["apply", "--confirm", "--stage", "compact", table.root], spark) == 0 and table.snapshot().operation == "compact"
    assert table.read().count() == 3 and "compact" in capsys.readouterr().out
    e = m.entries(table)
    assert e.filter("status = 'added'").count() == 4 and e.filter("snapshot_id = 4").count() == 1
    assert m.manifests(table).count() == 4 and m.manifests(table).filter("bytes > 0").count() == 4


def test_compaction_keeps_what_is_appended_meanwhile(spark, table, monkeypatch):
    for k in range(3):
        table.append(frame(spark, [k]))
    prove = m._prove_same

    def meanwhile(change):
        def run(*a):
            monkeypatch.setattr(m, "_prove_same", prove)
            change()
            prove(*a)

        monkeypatch.setattr(m, "_prove_same", run)

    meanwhile(lambda: (table.append(frame(spark, [7])), table.append(frame(spark, [8], "2026-01-02"))))
    assert m.compact(table, confirm=True).snapshot == 6
    assert sorted(r.k for r in table.read().collect()) == [0, 1, 2, 7, 8] and len(table.snapshot().parts["2026-01-01"]) == 2
    meanwhile(lambda: table.overwrite(frame(spark, [9]), ["2026-01-01"]))
    with pytest.raises(CommitConflict):
        m.compact(table, confirm=True)
    assert sorted(r.k for r in table.read().collect()) == [8, 9]


def test_publication(spark):
    store = ServingStore(spark, new_dir(spark, "serving"))
    spec = Serving("s", ("k",), "day", ("k",))
    df = frame(spark, range(20)).unionByName(frame(spark, range(20, 25), "2026-02-01"))
    assert store.read("s", df.schema).count() == 0
    one = store.publish(spec, df)
    again = store.publish(spec, df.orderBy(F.rand()))
    assert one["checksum"] == again["checksum"] and one["version"] != again["version"]
    assert checksum(store.read("s", df.schema)) == checksum(df) != checksum(df.limit(24))
    with pytest.raises(RuntimeError):
        store.publish(spec, frame(spark, [-1]))
    assert store.read("s", df.schema).count() == 25
    reader = store.reader()
    assert reader.read("s", df.schema).count() == 25 and not hasattr(reader, "publish") and not hasattr(reader, "prune")
    assert store.prune("s") == 1 and store.read("s", df.schema).count() == 25
    assert set(SERVED) == {"mart_daily_sales", "mart_customer_ltv", "mart_marketing_roi", "mart_delivery_performance"}


def test_latencies():
    ticks = iter([0, 5, 5, 6, 6, 8, 8, 11, 11, 15])
    got = bench.measure(lambda: None, 5, lambda: next(ticks))
    assert got == {"first_ms": 5000, "median_ms": 3000, "p95_ms": 4000, "max_ms": 5000, "min_ms": 1000}


def test_guarded_changes(spark, table, monkeypatch):
    assert mutate.update_where(table, F.lit(True), {"v": F.lit("y")}) == 0 and mutate.delete_where(table, F.lit(True)) == {table.root: 0}
    table.append(frame(spark, range(6)))
    table.append(frame(spark, range(6, 9), "2026-01-02"))
    child = SnapshotTable(spark, new_dir(spark, "child")).create(spark.createDataFrame([], "c long, parent long").schema)
    child.append(spark.createDataFrame([(i, i % 5) for i in range(20)] + [(99, None)], "c long, parent long"))
    parts = table.snapshot().parts
    assert mutate.update_where(table, (F.col("k") < 3) & (F.col("v") == "x"), {"v": F.lit("y")}) == 3
    assert mutate.update_where(table, (F.col("k") < 3) & (F.col("v") == "x"), {"v": F.lit("z")}) == 0  # the guard holds no more
    assert table.snapshot().parts["2026-01-02"] == parts["2026-01-02"] != table.snapshot().parts["2026-01-01"]
    assert mutate.delete_where(table, F.col("k").isin(1, 7), [(child, "parent", "k")]) == {table.root: 2, child.root: 4}
    assert sorted((r.k, r.v) for r in table.read().collect()) == [(k, "y" if k < 3 else "x") for k in (0, 2, 3, 4, 5, 6, 8)] and child.read().count() == 17
    look = mutate._affected

    def overtaken(*a):
        monkeypatch.setattr(mutate, "_affected", look)
        table.append(frame(spark, [50]))
        return look(*a)

    monkeypatch.setattr(mutate, "_affected", overtaken)
    with pytest.raises(CommitConflict):
        mutate.update_where(table, F.col("k") == 2, {"v": F.lit("late")})
