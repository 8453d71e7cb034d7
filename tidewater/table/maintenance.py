"""Maintenance of snapshot tables: inventory, compaction, expiry.

Everything has a plan that only reads; changes need ``confirm=True``. Compaction
rewrites partitions with at least two small files and proves that no row was
lost or changed. Appends that are committed meanwhile are kept; a commit that
took away what was being rewritten makes it fail.

Data files are listed by Spark, not on the driver; the log is one line per
(snapshot, partition, folder).
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import except_rows
from .snapshots import CommitConflict, Snapshot, SnapshotTable

MB = 1024 * 1024


@dataclass(frozen=True)
class CompactionMetrics:
    partitions: int
    rewritten_files: int
    added_files: int
    snapshot: int | None

    def __post_init__(self) -> None:
        if (self.rewritten_files == 0) != (self.added_files == 0):
            raise ValueError("files were rewritten without new ones, or the other way round")


def files(table: SnapshotTable, snapshot_id: int | None = None) -> DataFrame:
    """(partition, path, bytes) of a snapshot's data files."""
    snap = table.snapshot(snapshot_id)
    folders = [(p, d) for p, ds in (snap.parts if snap else {}).items() for d in ds]
    if not folders:
        return table.spark.createDataFrame([], "partition string, path string, bytes long")
    # without its content column this only lists, in parallel
    found = table.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load([f"{table.root}/{d}" for _, d in folders]).select("path", "length")
    folder = F.regexp_extract("path", r"(data/[0-9a-f]{32}.*)/[^/]*$", 1)
    named = table.spark.createDataFrame(folders, "partition string, folder string")
    joined = found.withColumn("at", folder).join(named, F.col("at") == F.col("folder"))
    return joined.select("partition", "path", F.col("length").alias("bytes")).orderBy("partition", "path")


def snapshots(table: SnapshotTable) -> DataFrame:
    rows = [(s.id, s.parent, s.committed_ms, s.operation) for s in table.log()]
    return table.spark.createDataFrame(rows, "snapshot_id long, parent_id long, committed_ms long, operation string").orderBy("committed_ms", "snapshot_id")


def refs(table: SnapshotTable) -> DataFrame:
    return table.spark.createDataFrame(list(table.ref_map().items()), "name string, snapshot_id long").orderBy("name")


def manifests(table: SnapshotTable) -> DataFrame:
    """(snapshot_id, path, bytes) of the log entries: what names the data of each
    snapshot."""
    rows = [(int(name[:-5]), f"_log/{name}", size) for name, is_dir, size in table.files_.list(f"{table.root}/_log") if not is_dir and name.endswith(".json")]
    return table.spark.createDataFrame(rows, "snapshot_id long, path string, bytes long")


def entries(table: SnapshotTable) -> DataFrame:
    """(snapshot_id, kind, name, folder, status) of every folder that a snapshot
    names: added by it, or there before."""
    log = {s.id: s for s in table.log()}
    rows = []
    for s in log.values():
        before = log[s.parent].folders() if s.parent in log else set()
        rows += [(s.id, kind, name, d, "existing" if d in before else "added") for kind, named in (("data", s.parts), ("aux", s.aux)) for name, ds in named.items() for d in ds]
    return table.spark.createDataFrame(rows, "snapshot_id long, kind string, name string, folder string, status string")


def ref_snapshots(table: SnapshotTable) -> DataFrame:
    """References with the snapshot each one names."""
    return refs(table).join(snapshots(table), "snapshot_id")


def inventory(table: SnapshotTable, threshold_mb: int = 128) -> DataFrame:
    """Per partition: files, bytes, files below the threshold, and whether it is
    a candidate for compaction."""
    if not 1 <= threshold_mb <= 512:
        raise ValueError("the threshold is between 1 and 512 MB")
    small = F.count_if(F.col("bytes") < threshold_mb * MB)
    return files(table).groupBy("partition").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), small.alias("small_files")).withColumn("is_candidate", F.col("small_files") >= 2)


def rows_by_partition(table: SnapshotTable) -> DataFrame:
    by = table.partition_by
    return table.read().groupBy(F.col(by).alias("partition") if by else F.lit("").alias("partition")).agg(F.count("*").alias("rows"))


def compact(table: SnapshotTable, threshold_mb: int = 128, confirm: bool = False, unique: str | None = None, attempts: int = 5) -> CompactionMetrics:
    """Rewrite the candidate partitions into files of about the threshold."""
    parent = table.snapshot()
    todo = {r.partition: (r.small_files, r.files, r.bytes) for r in inventory(table, threshold_mb).filter("is_candidate").collect()}
    if not confirm or not todo or parent is None:
        return CompactionMetrics(len(todo) if not confirm else 0, 0, 0, None)
    old = table.read(parent.id, todo)
    target = sum(-(-b // (threshold_mb * MB)) for _, _, b in todo.values())
    # partitions are packed by the table's own writer
    written = table._write(old if table.partition_by else old.repartition(max(1, target)))
    new = table.spark.read.schema(table.schema).parquet(*[f"{table.root}/{d}" for ds in written.values() for d in ds])
    _prove_same(old, new, unique)
    for n in range(attempts):
        now = table.snapshot()
        if any(set(parent.parts[p]) - set(now.parts.get(p, [])) for p in todo):
            raise CommitConflict("another commit replaced what was being compacted")
        parts = {p: [d for d in ds if p not in todo or d not in parent.parts[p]] for p, ds in now.parts.items()}
        for p, dirs in written.items():
            parts[p] = dirs + parts.get(p, [])
        try:
            snap = table.commit({p: ds for p, ds in parts.items() if ds}, "compact", now, {"rewritten": len(todo)})
            break
        except CommitConflict:
            if n + 1 == attempts:
                raise
    added = sum(1 for ds in written.values() for d in ds for name, _, _ in table.files_.list(f"{table.root}/{d}") if name.endswith(".parquet"))
    return CompactionMetrics(len(todo), sum(n for _, n, _ in todo.values()), added, snap.id)


def _prove_same(old: DataFrame, new: DataFrame, unique: str | None) -> None:
    n_old, n_new = old.count(), new.count()
    if n_old != n_new:
        raise RuntimeError(f"compaction changed the row count from {n_old} to {n_new}")
    if except_rows(old, new).limit(1).count():
        raise RuntimeError("compaction lost or changed rows")
    if unique and (r := new.agg(F.count("*").alias("n"), F.count_distinct(unique).alias("u")).first()).n != r.u:
        raise RuntimeError(f"{unique} is not unique")


def lost_rows(table: SnapshotTable, since: int) -> DataFrame:
    """Rows of an old snapshot that the current one lacks."""
    return except_rows(table.read(since), table.read())


def protected(table: SnapshotTable, keep: int) -> DataFrame:
    """(snapshot_id) of what expiry must leave: the last ``keep`` snapshots of
    main's line, found by looking up parents, and all that a reference names."""
    log, named = snapshots(table), refs(table)
    line = named.filter("name = 'main'").select("snapshot_id")
    out = named.select("snapshot_id")
    for _ in range(keep):
        out = out.union(line)
        up = line.join(log, "snapshot_id", "left").select("parent_id", F.col("committed_ms").isNull().alias("lost")).collect()  # one row
        if any(r.lost for r in up):
            raise RuntimeError(f"{table.root}: the line of main is broken")
        if not up or up[0].parent_id is None:
            break
        line = table.spark.createDataFrame([(up[0].parent_id,)], "snapshot_id long")
    return out.distinct()


def expirable(table: SnapshotTable, older_than_days: int = 30, keep: int = 10, now_ms: int | None = None) -> list[Snapshot]:
    """Snapshots older than the limit that nothing protects."""
    if older_than_days < 7 or keep < 2:
        raise ValueError("snapshots are kept for 7 days and the last two always")
    limit = (now_ms or int(time.time() * 1000)) - older_than_days * 86_400_000
    old = snapshots(table).filter(F.col("committed_ms") < limit)
    ids = {r.snapshot_id for r in old.join(protected(table, keep), "snapshot_id", "left_anti").collect()} if table.snapshot() else set()
    return [s for s in table.log() if s.id in ids]


def expire(table: SnapshotTable, older_than_days: int = 30, keep: int = 10, confirm: bool = False, now_ms: int | None = None) -> dict:
    """Drop expirable snapshots and the folders only they use."""
    gone = expirable(table, older_than_days, keep, now_ms)
    if not confirm:
        return {"snapshots": [s.id for s in gone], "folders": []}
    before = table.ref_map()
    ids = {s.id for s in gone}
    used = {d for s in table.log() if s.id not in ids for d in s.folders()}
    drop = sorted({d for s in gone for d in s.folders()} - used)
    for s in gone:
        table.files_.delete(f"{table.root}/_log/{s.id:010d}.json")
    for d in drop:
        table.files_.delete(f"{table.root}/{d}")
    after = table.ref_map()
    if after != before or any(table.snapshot(i) is None for i in after.values()):
        raise RuntimeError("expiry touched a reference")
    return {"snapshots": sorted(ids), "folders": drop}


#: What maintenance does to a table, in this order.
STAGES = {"compact": lambda t, confirm, o: compact(t, o.get("threshold_mb", 128), confirm), "expire": lambda t, confirm, o: expire(t, o.get("older_than_days", 30), o.get("keep", 10), confirm, o.get("now_ms"))}


def maintain(tables: dict[str, SnapshotTable], confirm: bool = False, stages: Sequence[str] = ("compact", "expire"), **options) -> dict[str, dict[str, object]]:
    """Every table through the stages; without ``confirm`` a plan of each. A
    stage that fails ends its table, not the others, and is reported at the end."""
    done: dict[str, dict[str, object]] = {}
    failed = {}
    for name, t in tables.items():
        for stage in stages:
            try:
                done.setdefault(name, {})[stage] = STAGES[stage](t, confirm, options)
            except Exception as e:
                failed[f"{name} in {stage}"] = str(e)
                break
    if failed:
        raise RuntimeError(f"maintenance failed for {failed}; done: { {k: sorted(v) for k, v in done.items()} }")
    return done


def main(argv: Sequence[str] | None = None, spark=None) -> int:
    """plan or apply over table folders; apply needs --confirm."""
    parser = argparse.ArgumentParser(prog="tidewater.table.maintenance")
    parser.add_argument("what", choices=("plan", "apply"))
    parser.add_argument("roots", nargs="+")
    parser.add_argument("--stage", choices=tuple(STAGES), action="append")
    parser.add_argument("--confirm", action="store_true")
    args = parser.parse_args(argv)
    if args.what == "apply" and not args.confirm:
        print("apply changes tables and needs --confirm; see the plan first")
        return 2
    if spark is None:
        from ..session import build_session

        spark = build_session("maintenance")
    for name, did in maintain({r: SnapshotTable(spark, r) for r in args.roots}, args.what == "apply", args.stage or tuple(STAGES)).items():
        print(name, did)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
