"""Problem 4: history of changing entity attributes as insert-only satellites.

The attributes of an entity are split by how often they change into satellites.
A satellite gets a row only where the hash of its attributes (hash diff)
differs from the entity's row before; nothing is updated, and the end of a
version is computed in a view as the start of the next row. Batches are appended
(``SatelliteTable``), in whatever order they come.

Order of an entity's changes: the snapshot baseline, then streamed changes by
LSN. Of several changes at one LSN the one with the highest Kafka offset counts,
likewise among baselines. Values are compared in lower case without outer white
space. A delete is a row of its own, with the hash of "deleted", and ends a
version.

Edge cases: rows without an entity id belong to no entity and are left out; a
streamed change without LSN takes place 0, right after the baseline; a null
attribute is a value of its own, unlike the empty text; equal rows count once;
an empty table gives an empty history.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import cut, discard, scratch_dir
from ..table.snapshots import Snapshot, SnapshotTable
from .relational import in_time_order, lookup
from .segments import PIECE_ROWS, changes, previous_row

#: Place of a baseline: before every LSN.
BASELINE = -(2**63)
DELETED = "deleted"


@dataclass(frozen=True)
class Satellite:
    name: str
    attributes: tuple[str, ...]


#: Split along the groups of ``split_by_rate`` (a test holds them against the
#: data's rates): classification and place move alike, names much less often.
#: Classification is apart from place because it is asked for by itself.
CUSTOMER_SATELLITES = (
    Satellite("classification", ("segment", "customer_status")),
    Satellite("place", ("region", "city")),
    Satellite("identity", ("email", "first_name", "last_name")),
)


def normal(value: Column) -> Column:
    """Lower case, without outer white space of any script."""
    return F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""))


def hash_diff(attributes: list[Column]) -> Column:
    """MD5 over the attributes; null and every text stay apart, as each part is
    led by its length."""
    parts = [F.when(a.isNull(), F.lit("-")).otherwise(F.concat(F.length(a).cast("string"), F.lit(":"), a)) for a in attributes]
    return F.md5(F.concat_ws("|", *parts))


def staged(changed: DataFrame, satellite: Satellite) -> DataFrame:
    """One row per entity and place: customer_id, place, hash_diff, kafka_offset
    and the attributes. The maximum has a map-side half, so hot entities shuffle
    only what is left after it."""
    gone = F.coalesce(F.lower(F.trim("operation")) == "d", F.lit(False))
    base = F.coalesce(F.col("is_snapshot_baseline"), F.lower(F.trim("operation")) == "r", F.lit(False))
    place = F.when(base, F.lit(BASELINE)).otherwise(F.coalesce(F.col("valid_from_lsn"), F.lit(0))).cast("long")
    values = [F.when(~gone, normal(F.col(a).cast("string"))).alias(a) for a in satellite.attributes]
    best = F.max(F.struct(F.coalesce(F.col("kafka_offset"), F.lit(-1)).alias("kafka_offset"), gone.alias("gone"), *values)).alias("best")
    rows = changed.filter(F.col("customer_id").isNotNull()).groupBy("customer_id", place.alias("place")).agg(best)
    attributes = [F.col(f"best.{a}") for a in satellite.attributes]
    diff = F.when(F.col("best.gone"), F.lit(DELETED)).otherwise(hash_diff(attributes))
    return rows.select("customer_id", "place", diff.alias("hash_diff"), F.col("best.kafka_offset").alias("kafka_offset"), *attributes)


def build(changed: DataFrame, satellite: Satellite, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """The rows a satellite has after all of ``changed`` came in order, with
    ``next_place`` as the view computes it."""
    return changes(staged(changed, satellite), "customer_id", "place", "hash_diff", piece_rows).withColumnRenamed("next_position", "next_place")


def change_rates(changed: DataFrame, attributes: Sequence[str], piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(attribute, versions): how many versions each attribute alone would have,
    in one pass over all of them."""
    rows = staged(changed, Satellite("all", tuple(attributes))).withColumn("gone", F.col("hash_diff") == DELETED)
    marked = previous_row(rows.select("customer_id", "place", "gone", *attributes), "customer_id", "place", ["gone", *attributes], "before", piece_rows)
    opens = lambda a: F.col("before").isNull() | F.col("before.gone") | ~F.col(f"before.{a}").eqNullSafe(F.col(a))
    counted = marked.agg(*[F.count_if(~F.col("gone") & opens(a)).alias(a) for a in attributes])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).alias("versions")) for a in attributes])))


def split_by_rate(rates: Mapping[str, int], factor: float = 2.0) -> list[tuple[str, ...]]:
    """Attributes grouped into satellites: the fastest opens one, and takes those
    that change at least 1 / ``factor`` times as often; the next opens another."""
    out: list[list[str]] = []
    for a in sorted(rates, key=lambda a: (-rates[a], a)):
        if out and rates[a] * factor >= rates[out[-1][0]]:
            out[-1].append(a)
        else:
            out.append([a])
    return [tuple(g) for g in out]


class SatelliteTable:
    """A stored satellite, below ``root``. Both of its parts only ever grow.

    ``satellite`` has the rows that were changes when they came, with attributes.
    ``tracking`` has (entity, place, hash diff, offset) of every change received,
    changed or not: a change that comes late may make a row a change that was
    none, and only this tells. Both parts of a batch are one commit.
    """

    _KEYS = ("customer_id", "place", "hash_diff", "kafka_offset")

    def __init__(self, spark: SparkSession, root: str, satellite: Satellite):
        self.spark, self.satellite = spark, satellite
        kinds = [T.LongType(), T.LongType(), T.StringType(), T.LongType(), *[T.StringType() for _ in satellite.attributes]]
        names = [*self._KEYS, *satellite.attributes]
        self.table = SnapshotTable(spark, root).create(T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))

    def rows(self) -> DataFrame:
        return self.table.read(partitions=["satellite"])

    def _near(self, parent: Snapshot | None, new: DataFrame) -> DataFrame:
        """What is tracked of the batch's entities from its first place on, and
        the one row before that (``before``). No more can matter to the batch."""
        seen = self.table.read(parent.id if parent else None, ["tracking"] if parent else []).select(*self._KEYS)
        if parent is None:
            return seen.withColumn("before", F.lit(False))
        low = new.groupBy(F.col("customer_id").alias("__c")).agg(F.min("place").alias("__low"))
        near = lookup(seen, "customer_id", low, "__c", "inner", rows=seen.count()).drop("__c")
        place = F.struct("place", "kafka_offset", "hash_diff")
        last = near.filter(F.col("place") < F.col("__low")).groupBy("customer_id").agg(F.max(place).alias("p")).select("customer_id", "p.place", "p.hash_diff", "p.kafka_offset", F.lit(True).alias("before"))
        return near.filter(F.col("place") >= F.col("__low")).select(*self._KEYS, F.lit(False).alias("before")).unionByName(last)

    def append(self, changed: DataFrame, piece_rows: int = PIECE_ROWS) -> Snapshot | None:
        """Insert what a batch of changes adds. The work follows the batch and
        what is tracked at or after its places, not the satellite. A batch that
        was appended before adds nothing. Returns None if nothing was added."""
        attributes, parent = self.satellite.attributes, self.table.snapshot()
        new = cut(staged(changed, self.satellite), "staged")
        near = self._near(parent, new)
        # per place the highest offset counts; at one offset what is known already
        parts = new.withColumns({"known": F.lit(False), "before": F.lit(False)}).unionByName(near.withColumn("known", F.lit(True)), allowMissingColumns=True)
        best = F.max(F.struct("kafka_offset", "known", "hash_diff", "before", *attributes)).alias("b")
        rows = parts.groupBy("customer_id", "place").agg(best, F.max("known").alias("again"))
        rows = rows.select("customer_id", "place", "b.hash_diff", "b.kafka_offset", "b.known", "b.before", "again", *[f"b.{a}" for a in attributes])
        rows = cut(rows, "resolved")
        fresh = rows.filter(~F.col("known"))
        if fresh.isEmpty():
            discard(new, rows)
            return None
        changed_ = changes(rows, "customer_id", "place", "hash_diff", piece_rows).drop("next_position")
        names = [*self._KEYS, *attributes]
        insert = changed_.filter(~F.col("known")).select(*names)
        # a message that outranks one at its place counts, whether a change or not
        insert = insert.unionByName(fresh.filter("again").select(*names)).distinct()
        if parent:
            insert = insert.unionByName(self._revived(parent, changed_.filter("known and not before"), new))
        dirs = {k: list(v) for k, v in parent.parts.items()} if parent else {"satellite": [], "tracking": []}
        dirs["satellite"].append(self.table.stage(insert))
        dirs["tracking"].append(self.table.stage(fresh.select(*self._KEYS)))
        snap = self.table.commit(dirs, "append", parent)
        discard(new, rows)
        return snap

    def _revived(self, parent: Snapshot, rows: DataFrame, new: DataFrame) -> DataFrame:
        """Tracked rows that have become changes and that the satellite lacks,
        with their attributes, which an earlier row of equal hash diff has."""
        names = [*self._KEYS, *self.satellite.attributes]
        have = self.table.read(parent.id, ["satellite"])
        at = have.select(*[F.col(k).alias(f"__{k}") for k in self._KEYS])
        lacking = rows.select(*self._KEYS).join(at, [F.col(k) == F.col(f"__{k}") for k in self._KEYS], "left_anti")
        values = have.unionByName(new).groupBy(F.col("customer_id").alias("__c"), F.col("hash_diff").alias("__h")).agg(*[F.max(a).alias(a) for a in self.satellite.attributes])
        return lacking.join(values, (F.col("customer_id") == F.col("__c")) & (F.col("hash_diff") == F.col("__h"))).select(*names)


def load(changed: DataFrame, satellite: Satellite, batches: int = 4, stamp: str = "ingested_at") -> SatelliteTable:
    """A satellite filled by appending ``changed`` in batches by ``stamp``."""
    spark = changed.sparkSession
    needed = ["customer_id", "operation", "is_snapshot_baseline", "valid_from_lsn", "kafka_offset", stamp, *satellite.attributes]
    table = SatelliteTable(spark, scratch_dir(spark, "satellite"), satellite)
    parts = in_time_order(changed.select(*dict.fromkeys(needed)), F.col(stamp), batches)
    for b in parts:
        table.append(b)
    discard(*parts[:1])
    return table


def versions(satellite_rows: DataFrame) -> DataFrame:
    """The view with end dates: half-open LSN periods without the deletes.
    valid_from_lsn is 0 from the baseline on, valid_to_lsn -1 while it lasts."""
    return satellite_rows.filter(F.col("hash_diff") != DELETED).select(
        "customer_id",
        F.when(F.col("place") == BASELINE, 0).otherwise(F.col("place")).cast("long").alias("valid_from_lsn"),
        F.coalesce(F.col("next_place"), F.lit(-1)).cast("long").alias("valid_to_lsn"),
        *[c for c in satellite_rows.columns if c not in {"customer_id", "place", "hash_diff", "next_place", "kafka_offset"}],
    )


def satellite_view(satellite_rows: DataFrame, satellite: Satellite, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``versions`` of stored insert-only rows: of rows at one place the highest
    offset counts, and rows that repeat their predecessor are passed over."""
    attributes = satellite.attributes
    best = satellite_rows.groupBy("customer_id", "place").agg(F.max(F.struct("kafka_offset", "hash_diff", *attributes)).alias("b"))
    rows = best.select("customer_id", "place", "b.hash_diff", "b.kafka_offset", *[f"b.{a}" for a in attributes])
    return versions(changes(rows, "customer_id", "place", "hash_diff", piece_rows).withColumnRenamed("next_position", "next_place"))
