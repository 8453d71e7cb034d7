"""Loading archived batches into raw tables, and the extracts that feed them.

One load replaces one date of one table in one commit, so a load that is run
again, or broken off and run again, gives the same table. A batch is checked
against its manifest before anything is written and against the table after.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import distinct_rows
from ..operators.relational import after_watermark
from ..sources.readers import CONTRACTS, good_rows, read_pages, read_snapshot, read_vendor, with_reasons
from ..sources.specs import SPECS, Spec
from ..streaming.cdc import retrying
from ..table.snapshots import CommitConflict, SnapshotTable
from .archive import ObjectStore, Manifest, Watermark, days_of, load_watermark, manifest_key, manifests, page_key, purge_watermark, save_watermark, sha256, snapshot_prefix


class BatchMismatch(RuntimeError):
    """A batch isn't what its manifest says."""


def raw_table(spark: SparkSession, root: str, spec: Spec) -> SnapshotTable:
    return SnapshotTable(spark, f"{root}/{spec.name}").create(spec.schema, "_batch_date")


def source_name(spec: Spec) -> str:
    return f"postgres-{spec.source}" if spec.kind == "postgres" else spec.source


def digest(spark: SparkSession, paths: list[str]) -> tuple[int, str]:
    """(bytes, checksum) of objects, hashed where they are read, a block at a
    time, so an object may have any size. Of one object it is its SHA-256, of
    several that of their sums in name order, folded there too."""
    if not paths:
        return 0, sha256([])

    def hashed(batches):
        import hashlib

        import pyarrow as pa
        from pyarrow import fs

        for b in batches:
            sizes, sums = [], []
            for path in b.column(0).to_pylist():
                system, at = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
                h, n = hashlib.sha256(), 0
                with system.open_input_stream(at) as stream:
                    while block := stream.read(1 << 20):
                        h.update(block)
                        n += len(block)
                sizes.append(n)
                sums.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(sums)], names=["path", "bytes", "sum"])

    # Spark lists the objects and gives their full paths; contents aren't read
    found = spark.read.format("binaryFile").load(paths).select("path")
    sums = found.repartition(min(len(paths), 1000)).mapInArrow(hashed, "path string, bytes long, sum string")
    all_ = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "sum"))), lambda x: x["sum"]), "")
    r = sums.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.max("sum").alias("one"), F.sha2(all_, 256).alias("several")).first()
    return r.bytes, r.one if r.n == 1 else r.several if r.n else sha256([])


def read_batch(spark: SparkSession, store: ObjectStore, spec: Spec, m: Manifest) -> DataFrame:
    """Business and service columns of one archived batch, after its integrity
    has been checked: size and checksum of the objects."""
    keys = store.list(m.object_key) if m.object_key.endswith("/") else [m.object_key]
    paths = [store.path(k) for k in keys if store.exists(k)]
    if digest(spark, paths) != (m.size_bytes, m.checksum):
        raise BatchMismatch(f"{m.batch_id}: objects differ from the manifest")
    if m.row_count == 0:
        rows = spark.createDataFrame([], spec.business).withColumns({"_source_object": F.lit(""), "_source_object_row_position": F.lit(0).cast("bigint")})
    elif spec.kind == "postgres":
        rows = _positioned(spark, paths, spec)
    elif spec.kind == "api":
        rows = read_pages(spark, paths, spec)
    else:
        contract = CONTRACTS[spec.source]
        rows = good_rows(with_reasons(read_vendor(spark, paths, contract), contract, spec), contract, spec)
    day = datetime.date.fromisoformat(m.logical_date)
    at = datetime.datetime.fromisoformat(m.ingested_at)
    return rows.select(*spec.business.fieldNames(), F.lit(m.batch_id).alias("_batch_id"), F.lit(day).alias("_batch_date"), "_source_object", F.col("_source_object_row_position").cast("bigint").alias("_source_object_row_position"), F.lit(at).cast("timestamp").alias("_ingested_at"))


def _positioned(spark: SparkSession, paths: list[str], spec: Spec) -> DataFrame:
    """A snapshot with each row's object and its place in it."""
    read_snapshot(spark, paths, spec)  # the column set and types
    raw = spark.read.parquet(*paths).select("*", F.col("_metadata.file_path").alias("_source_object"), F.col("_metadata.row_index").alias("_source_object_row_position"))
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in spec.business], "_source_object", "_source_object_row_position")


def load_date(spark: SparkSession, store: ObjectStore, root: str, spec: Spec, day: datetime.date) -> int:
    """Replace one date of one raw table by its archived batches; returns rows."""
    found = list(manifests(store, source_name(spec), day))
    if not found:
        raise BatchMismatch(f"{spec.name}: no completed batch on {day}")
    rows, expected = None, 0
    for m in found:
        part = read_batch(spark, store, spec, m)
        rows = part if rows is None else rows.unionByName(part)
        expected += m.row_count - m.rejected_row_count
    table = raw_table(spark, root, spec)
    table.overwrite(rows, [day.isoformat()])
    _verify(table, day, expected)
    return expected


def _verify(table: SnapshotTable, day: datetime.date, expected: int) -> None:
    got = table.read(partitions=[day.isoformat()]).agg(F.count("*").alias("n"), distinct_rows("_source_object", "_source_object_row_position").alias("places")).first()
    if got.n != expected or got.places != expected:
        raise BatchMismatch(f"{table.root} on {day}: {got.n} rows in {got.places} places, expected {expected}")


def loaded_until(table: SnapshotTable) -> datetime.date | None:
    snap = table.snapshot()
    days = [p for p in (snap.parts if snap else {}) if not p.startswith("__")]
    return datetime.date.fromisoformat(max(days)) if days else None


def is_complete(table: SnapshotTable, day: datetime.date, batch_ids: set[str]) -> bool:
    have = {r[0] for r in table.read(partitions=[day.isoformat()]).select("_batch_id").distinct().collect()}
    return have == batch_ids


def load_new(spark: SparkSession, store: ObjectStore, root: str, spec: Spec) -> dict[datetime.date, int]:
    """Load dates not yet loaded, ascending, stopping at the first failure. Of
    snapshots and APIs only dates from the last loaded one on count; files may
    come late and are looked at on all dates."""
    table = raw_table(spark, root, spec)
    after = loaded_until(table) if spec.kind != "file" else None
    done = {}
    for day in days_of(store, source_name(spec)):
        if after and day < after:
            continue
        ids = {m.batch_id for m in manifests(store, source_name(spec), day) if m.row_count > m.rejected_row_count}
        if not is_complete(table, day, ids):
            done[day] = load_date(spark, store, root, spec, day)
    return done


#: Words in the message of a failure that another try may mend. Fixed values.
TRANSIENT = ("connection refused", "connection reset", "timed out", "timeout", "temporarily unavailable", "service unavailable", "too many requests", "broken pipe")


def is_transient(e: Exception) -> bool:
    """Another writer was first, or a service didn't answer; never a batch that
    isn't what its manifest says."""
    if isinstance(e, BatchMismatch):
        return False
    return isinstance(e, (CommitConflict, ConnectionError, TimeoutError)) or any(w in str(e).lower() for w in TRANSIENT)


def load_with_retry(call: Callable[[], object], attempts: int = 3, **kw):
    """Retry a whole load: it replaces one date in one commit, so it is safe to."""
    return retrying(call, attempts, transient=is_transient, **kw)


def delete_coordinates(table: SnapshotTable, day: datetime.date, places: DataFrame) -> int:
    """Take the rows at the given (object, first, last position) ranges out of
    one date, in one commit; returns how many. Parquet has no delete, so the
    date is rewritten without them."""
    rows = table.read(partitions=[day.isoformat()])
    p = places.select(F.col("_source_object").alias("__o"), F.col("first").alias("__a"), F.col("last").alias("__b"))
    hit = (F.col("_source_object") == F.col("__o")) & F.col("_source_object_row_position").between(F.col("__a"), F.col("__b"))
    before, kept = rows.count(), rows.join(p, hit, "left_anti")
    snap = table.overwrite(kept, [day.isoformat()])
    return before - table.read(snap.id, [day.isoformat()]).count()


def extract_snapshot(spark: SparkSession, source: DataFrame, store: ObjectStore, table: str, day: datetime.date, full: bool = False, now: datetime.datetime | None = None) -> Manifest:
    """Archive the rows after the table's watermark (all, if ``full`` or if
    there is none) as Parquet objects, written by the executors. Objects,
    manifest, watermark, in this order: a run broken off before the watermark
    extracts the same rows again. An empty increment leaves the watermark and a
    manifest of no rows."""
    spec, name = SPECS[table], f"postgres-{table}"
    if full:
        purge_watermark(store, table)
    mark = load_watermark(store, table)
    # in no order: the watermark is a maximum, so nothing is sorted
    rows = after_watermark(source.select(*spec.business.fieldNames()), "updated_at", spec.key[0], (mark.updated_at, mark.key) if mark else None)
    prefix = snapshot_prefix(table, day)
    rows.write.mode("overwrite").parquet(store.path(prefix))
    written = spark.read.schema(spec.business).parquet(store.path(prefix))
    seen = written.agg(F.count("*").alias("n"), F.max(F.struct("updated_at", spec.key[0])).alias("last")).first()
    for key in store.list(prefix):
        if seen.n == 0 or not key.endswith(".parquet"):
            store.delete(key)  # marker files, and the empty object of an empty increment
    size, checksum = digest(spark, [store.path(k) for k in store.list(prefix)])
    m = Manifest.of(name, "postgres", "completed", prefix, checksum, size, day, seen.n, now=now)
    for old in manifests(store, name, day):
        store.delete(manifest_key(name, day, old.batch_id))
    store.put(manifest_key(name, day, m.batch_id), m.dump())
    if seen.n:
        save_watermark(store, table, Watermark(seen["last"][0].replace(tzinfo=datetime.UTC), seen["last"][1]))
    return m


def archive_pages(store: ObjectStore, source: str, day: datetime.date, pages, field: str, now: datetime.datetime | None = None) -> Manifest:
    """Archive API pages under fixed keys with one manifest; no page is an error."""
    import json

    data, rows = [], 0
    for n, page in enumerate(pages, 1):
        data.append(json.dumps(page, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode())
        rows += len(page[field])
        store.put(page_key(source, day, n), data[-1])
    if not data:
        raise BatchMismatch(f"{source} gave no page on {day}")
    prefix = page_key(source, day, 1).rsplit("/", 1)[0] + "/"
    for key in store.list(prefix)[len(data) :]:
        store.delete(key)  # of an earlier, longer run
    m = Manifest.of(source, "api", "completed", prefix, sha256(data) if len(data) == 1 else sha256(sha256([x]).encode() for x in data), sum(map(len, data)), day, rows, now=now)
    for old in manifests(store, source, day):
        store.delete(manifest_key(source, day, old.batch_id))
    store.put(manifest_key(source, day, m.batch_id), m.dump())
    return m
