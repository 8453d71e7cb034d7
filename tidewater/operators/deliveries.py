"""Problem 1: messages delivered more than once, kept exactly once.

The table of kept messages is partitioned (by event date) and has an identifier
index: hash of the message id -> partition that holds it. A batch is applied by
looking its ids up in the index, reading only the partitions found, folding
those rows together with the incoming ones to a single winner per message, and
committing a snapshot in which exactly those partitions are replaced.

Commit. Rows and index are published by one log entry. Its parent is read
before the index, so a writer that commits in between makes this one fail with
CommitConflict and leaves nothing behind. A batch may carry (writer, number); one
whose number that writer has committed already does nothing, so a batch that is
sent again, after a failure or not, doesn't count twice.

Identity. A message is one Kafka coordinate and its id is the lower-case hex
SHA-256 of ``topic:partition:offset``. A row with a complete coordinate gets its
id from that; one that lacks any of the three keeps its event_id, trimmed and in
lower case. A row with neither takes the partition of its (topic, key), as a key
stays on one partition, whichever batch tells it: earlier ones are looked up in
the kept rows, and until one tells, the row waits in a partition of its own
under the id ``topic:key:offset``. So the result doesn't depend on how rows are
spread over batches.

Winner. The copy ingested first (null ``ingested_at`` last), then the smaller
event date, then the smaller row hash; equal rows are interchangeable.

Edge cases: null topics or offsets of rows without event_id count as empty text
in the id; an empty batch commits nothing; rows that repeat inside one batch
count as copies; input columns keep their names whatever they are, as they
travel inside one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import Files, cut, discard, scratch_dir
from ..table.snapshots import NULL_PARTITION, Snapshot, SnapshotTable
from .relational import in_time_order

#: Batches that a ledger is replayed in.
BATCHES = 8
#: Index folders that are merged into one when there are more.
INDEX_FOLDERS = 32
#: Most ids of a batch that are broadcast to the index instead of shuffled with it.
BROADCAST_IDS = 10_000
#: Partition of rows whose place nobody has told yet.
WAITING = "__waiting__"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _coordinate_id(topic: Column, middle: Column, offset: Column) -> Column:
    return F.unhex(F.sha2(F.concat_ws(":", topic, middle, offset), 256))


def packed(event_id: Column) -> Column:
    """A SHA-256 in hex as its 32 bytes; any other id as its text led by zero
    bytes, and never 32 bytes long."""
    text = F.encode(event_id, "UTF-8")
    lead = F.when(F.octet_length(text) == 31, F.lit(b"\0\0")).otherwise(F.lit(b"\0"))
    return F.when(event_id.rlike("^[0-9a-f]{64}$"), F.unhex(event_id)).otherwise(F.concat(lead, text))


def unpacked(mid: Column) -> Column:
    return F.when(F.octet_length(mid) == 32, F.lower(F.hex(mid))).otherwise(F.ltrim(F.decode(mid, "UTF-8"), F.lit("\0")))


def identified(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(mid, route, place, lost, row): every row of ``df`` with its message id.
    ``route`` is the hash of (topic, key), null without a key, and ``place`` the
    partition it tells.
    ``lost`` is null, or, where only the place of the route can tell the id, the
    id's parts; ``row`` holds the ``keep`` columns."""
    c = {n: F.col(n) for n in df.columns}
    event_id = F.lower(F.trim(c["event_id"]))
    whole = c["kafka_topic"].isNotNull() & c["kafka_partition"].isNotNull() & c["kafka_offset"].isNotNull()
    topic, place, offset = _text(c["kafka_topic"]), c["kafka_partition"].cast("int"), _text(c["kafka_offset"])
    key = F.translate(_text(c["key_json"]), " \t\r\n", "") if "key_json" in c else F.lit("")
    sure = F.when(whole, _coordinate_id(topic, _text(place), offset)).when(event_id != "", packed(event_id)).when(place.isNotNull(), _coordinate_id(topic, _text(place), offset))
    lost = F.struct(topic.alias("topic"), key.alias("key"), offset.alias("offset"))
    row = F.struct(*[c[n] for n in keep or df.columns]).alias("row")
    rows = df.select(sure.alias("mid"), F.when(key != "", F.xxhash64(topic, key)).alias("route"), place.alias("place"), lost.alias("lost"), row)
    return rows.select(F.coalesce("mid", _waiting_id()).alias("mid"), "route", "place", F.when(F.col("mid").isNull(), F.col("lost")).alias("lost"), "row")


def _waiting_id() -> Column:
    return _coordinate_id(F.col("lost.topic"), F.col("lost.key"), F.col("lost.offset"))


def settled(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Lost rows with the id that ``places`` (__route, __place) tells, or still
    lost where it tells none."""
    joined = rows.join(places, F.col("route") == F.col("__route"), "left")
    told = F.col("__place").isNotNull()
    mid = F.when(told, _coordinate_id(F.col("lost.topic"), F.col("__place").cast("string"), F.col("lost.offset"))).otherwise(F.col("mid"))
    return joined.select(mid.alias("mid"), "route", F.col("__place").alias("place"), F.when(~told, F.col("lost")).alias("lost"), "row", "copies", "part")


def fold(rows: DataFrame) -> DataFrame:
    """One row per ``mid``: the winner's ``row``, the sum of ``copies``, and in
    ``part`` the partition that had the message so far, null if none had.

    min_by has a map-side half, so a message sent a million times shuffles one
    row per map task."""
    when = F.coalesce(F.col("row.ingested_at").cast("timestamp"), F.lit("9999-12-31").cast("timestamp"))
    order = F.struct(when, F.coalesce(F.col("row.event_date").cast("string"), F.lit("~")), F.xxhash64("row"))
    out = rows.groupBy("mid").agg(F.min_by("row", order).alias("row"), F.sum("copies").cast("long").alias("copies"), F.max("route").alias("route"), F.max("place").alias("place"), F.max("lost").alias("lost"), F.max("part").alias("part"))
    return out.select("mid", "route", "place", "lost", "row", "copies", "part")


class DeliveryTable:
    """Kept messages with their identifier index, below ``root``."""

    def __init__(self, spark: SparkSession, root: str, row: T.StructType):
        self.spark, self.columns = spark, row.fieldNames()
        row = T.StructType([T.StructField(f.name, f.dataType, True) for f in row])
        text, long = T.StringType(), T.LongType()
        lost = T.StructType([T.StructField(n, text) for n in ("topic", "key", "offset")])
        names = [("mid", T.BinaryType()), ("route", long), ("place", T.IntegerType()), ("lost", lost), ("row", row), ("copies", long), ("part", text)]
        self.kept = SnapshotTable(spark, root).create(T.StructType([T.StructField(n, t) for n, t in names]), "part")

    # -- the index ------------------------------------------------------------
    def index(self, snap: Snapshot | None) -> DataFrame:
        """(h, part) of a snapshot: message hash and a partition that has it."""
        dirs, schema = snap.aux.get("index", []) if snap else [], "h long, part string"
        return self.spark.read.schema(schema).parquet(*[f"{self.kept.root}/{d}" for d in dirs]) if dirs else self.spark.createDataFrame([], schema)

    def affected(self, snap: Snapshot | None, staged: DataFrame) -> list[str]:
        """Partitions that the index names for the incoming ids. The list is as
        long as the table has partitions at most; ids stay distributed."""
        if snap is None:
            return []
        ids = staged.select(F.xxhash64("mid").alias("h"))
        ids = F.broadcast(ids) if staged.count() <= BROADCAST_IDS else ids.hint("merge")
        return sorted(r.part for r in self.index(snap).join(ids, "h", "left_semi").select("part").distinct().collect())

    def _index_folders(self, parent: Snapshot | None, fresh: list[str]) -> list[str]:
        """The parent's index and one more folder with what moved in or within
        the table; merged into one when there are too many."""
        rows = self.spark.read.schema(self.kept.schema).parquet(*[f"{self.kept.root}/{d}" for d in fresh]).filter(F.col("part") != WAITING) if fresh else None
        old = parent.aux.get("index", []) if parent else []
        if rows is None:
            return old
        entries = rows.select(F.xxhash64("mid").alias("h"), "part")
        if len(old) < INDEX_FOLDERS:
            return [*old, self.kept.stage(entries)]
        return [self.kept.stage(self.index(parent).unionByName(entries).distinct())]

    # -- batches --------------------------------------------------------------
    def apply(self, batch: DataFrame, writer: str = "", number: int | None = None) -> dict:
        """Apply one batch of deliveries; returns what the commit did. A batch
        whose ``number`` its ``writer`` has committed, or passed, does nothing."""
        return self.apply_identified(identified(batch, self.columns), writer, number)

    def apply_identified(self, rows: DataFrame, writer: str = "", number: int | None = None) -> dict:
        """The same for a batch that ``identified`` has been through."""
        parent = self.kept.snapshot()  # before anything of the table is looked at
        done = parent.state.get("writers", {}) if parent else {}
        if number is not None and done.get(writer, number - 1) >= number:
            return {"snapshot": parent.id, "affected": [], "repeated": True}
        staged, used = self._staged(parent, rows)
        if staged is None:
            return {"snapshot": parent.id if parent else None, "affected": [], "repeated": False}
        hit = self.affected(parent, staged)
        old = self.kept.read(parent.id, hit) if hit else None
        out = fold(staged.unionByName(old)) if hit else staged
        part = F.when(F.col("lost").isNotNull(), F.lit(WAITING)).otherwise(F.coalesce(F.col("row.event_date").cast("string"), F.lit(NULL_PARTITION)))
        out = out.withColumn("__new", part).withColumn("fresh", ~F.coalesce(F.col("part") == F.col("__new"), F.lit(False))).withColumn("part", F.col("__new")).drop("__new")
        written = self.kept._write(out, "fresh")
        fresh = [d for ds in written.values() for d in ds if d.endswith("fresh=true")]
        gone = {*hit, WAITING} if used else set(hit)
        parts = {k: list(v) for k, v in (parent.parts if parent else {}).items() if k not in gone}
        for p, dirs in written.items():
            parts[p] = parts.get(p, []) + dirs
        aux = {"index": self._index_folders(parent, fresh)}
        state = {"writers": done | ({writer: number} if number is not None else {})}
        try:
            snap = self.kept.commit(parts, "apply", parent, {"replaced": len(gone)}, aux, state)
        finally:
            discard(staged)
        return {"snapshot": snap.id, "affected": hit, "repeated": False}

    def _staged(self, parent: Snapshot | None, rows: DataFrame) -> tuple[DataFrame | None, bool]:
        """The batch folded to one row per message, written once; and whether the
        waiting rows of the table are among them."""
        path, no = scratch_dir(self.spark, "staged"), F.lit(None).cast("string")
        first = fold(rows.withColumn("copies", F.lit(1).cast("long")).withColumn("part", no))
        first.withColumn("__lost", F.col("lost").isNotNull()).write.partitionBy("__lost").parquet(path)
        there = {name for name, is_dir, _ in Files(self.spark, path).list(path) if is_dir}
        if not there:
            discard(path)
            return None, False
        take = lambda kind: self.spark.read.schema(first.schema).parquet(f"{path}/__lost={kind}") if f"__lost={kind}" in there else self.spark.createDataFrame([], first.schema)
        sure, lost = take("false"), take("true")
        waiting = self.kept.read(parent.id, [WAITING]) if parent and WAITING in parent.parts else None
        if "__lost=true" not in there and waiting is None:
            sure._scratch = path
            return sure, False
        told = sure.select("route", "place")
        if parent and "__lost=true" in there:  # what earlier batches tell of these routes
            told = told.unionByName(self.kept.read(parent.id).select("route", "place").join(lost.select("route"), "route", "left_semi"))
        places = told.filter("place is not null and route is not null").groupBy(F.col("route").alias("__route")).agg(F.min("place").alias("__place"))
        open_ = lost if waiting is None else lost.unionByName(waiting)
        staged = cut(fold(sure.unionByName(settled(open_, places))), "settled")
        discard(path)
        return staged, waiting is not None

    def rows(self) -> DataFrame:
        """event_id, copies, row."""
        return self.kept.read().select(unpacked(F.col("mid")).alias("event_id"), "copies", "row")


def replay(ledger: DataFrame, columns: list[str] | None = None, batches: int = BATCHES, times: int = 1) -> DeliveryTable:
    """Build the table from a ledger in ``batches`` of about as many rows, in
    the order they were ingested (null last), so that copies meet through the
    index. ``columns`` restricts what is kept of each row; each batch is sent
    ``times`` times."""
    spark = ledger.sparkSession
    keep = ledger.columns if columns is None else list(dict.fromkeys(["event_date", "ingested_at", *columns]))
    table = DeliveryTable(spark, scratch_dir(spark, "deliveries"), ledger.select(*keep).schema)
    parts = in_time_order(identified(ledger, keep), F.col("row.ingested_at"), batches)
    for k, rows in enumerate(parts):
        for _ in range(times):
            table.apply_identified(rows, "replay", k)
    discard(*parts[:1])
    return table
