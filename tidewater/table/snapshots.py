"""A versioned Parquet table: immutable data folders and a log of snapshots.

A commit writes data folders first and then creates the next log entry with an
exclusive create, so readers see either the old or the new snapshot and of two
concurrent writers one loses and is told so. The log keeps one entry per
(partition, folder), never per row or file, so its size follows the number of
partitions.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import Files

NULL_PARTITION = "__null__"
_DIR = "__tw_partition"


class CommitConflict(RuntimeError):
    """Another writer committed on the same parent."""


@dataclass
class Snapshot:
    id: int
    parent: int | None
    committed_ms: int
    operation: str
    summary: dict = field(default_factory=dict)
    #: partition value -> data folders relative to the table root
    parts: dict[str, list[str]] = field(default_factory=dict)
    #: name -> folders of what belongs to the rows, such as an index
    aux: dict[str, list[str]] = field(default_factory=dict)
    #: what writers remember from commit to commit
    state: dict = field(default_factory=dict)

    def folders(self) -> set[str]:
        return {d for named in (self.parts, self.aux) for ds in named.values() for d in ds}


#: Stands for the snapshot that is current when it is asked for.
NEWEST = Snapshot(0, None, 0, "newest")


class SnapshotTable:
    """Table at ``root`` with one optional partition column."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files_ = spark, root.rstrip("/"), Files(spark, root)

    # -- metadata -----------------------------------------------------------
    def create(self, schema: T.StructType, partition_by: str | None = None) -> SnapshotTable:
        """CREATE IF NOT EXISTS with an explicit schema."""
        meta = {"schema": json.loads(schema.json()), "partition_by": partition_by}
        if not self.files_.create_text(f"{self.root}/_meta.json", json.dumps(meta)):
            if self.schema != schema or self.partition_by != partition_by:
                raise ValueError(f"{self.root} exists with another schema or partitioning")
        return self

    def exists(self) -> bool:
        return self.files_.exists(f"{self.root}/_meta.json")

    @property
    def _meta(self) -> dict:
        return json.loads(self.files_.read_text(f"{self.root}/_meta.json"))

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(self._meta["schema"])

    @property
    def partition_by(self) -> str | None:
        return self._meta["partition_by"]

    def log(self) -> list[Snapshot]:
        out = []
        for name, is_dir, _ in self.files_.list(f"{self.root}/_log"):
            if not is_dir and name.endswith(".json"):
                out.append(Snapshot(**json.loads(self.files_.read_text(f"{self.root}/_log/{name}"))))
        return sorted(out, key=lambda s: s.id)

    def snapshot(self, snapshot_id: int | None = None) -> Snapshot | None:
        """The named snapshot, or the current one; None for an empty table."""
        if snapshot_id is None:
            ids = [n for n, d, _ in self.files_.list(f"{self.root}/_log") if not d and n.endswith(".json")]
            if not ids:
                return None
            snapshot_id = int(max(ids)[:-5])
        path = f"{self.root}/_log/{snapshot_id:010d}.json"
        if not self.files_.exists(path):
            raise KeyError(f"no snapshot {snapshot_id} in {self.root}")
        return Snapshot(**json.loads(self.files_.read_text(path)))

    # -- references ---------------------------------------------------------
    def ref_map(self) -> dict[str, int]:
        """Named references; ``main`` is always the newest snapshot."""
        now, path = self.snapshot(), f"{self.root}/_refs.json"
        named = json.loads(self.files_.read_text(path)) if self.files_.exists(path) else {}
        return {**named, **({"main": now.id} if now else {})}

    def set_ref(self, name: str, snapshot_id: int) -> None:
        if name == "main":
            raise ValueError("main moves by commits only")
        self.snapshot(snapshot_id)
        refs = {k: v for k, v in self.ref_map().items() if k != "main"} | {name: snapshot_id}
        self.files_.replace_text(f"{self.root}/_refs.json", json.dumps(refs, sort_keys=True))

    # -- reads --------------------------------------------------------------
    def read(self, snapshot_id: int | None = None, partitions: Iterable[str] | None = None) -> DataFrame:
        """Rows of a snapshot (time travel by id), of the named partitions only
        if given. Partition pruning happens on the log; column pruning and
        filters reach the Parquet scan as for any other table."""
        snap = self.snapshot(snapshot_id)
        keep = None if partitions is None else set(partitions)
        dirs = [d for p, ds in (snap.parts if snap else {}).items() if keep is None or p in keep for d in ds]
        if not dirs:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{d}" for d in dirs])

    # -- writes -------------------------------------------------------------
    def stage(self, df: DataFrame) -> str:
        """Write ``df`` into a fresh data folder, not visible before a commit
        names it."""
        folder = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        return folder

    def _write(self, df: DataFrame, within: str | None = None) -> dict[str, list[str]]:
        """Data folders by partition, without making them visible; a folder for
        each value of the column ``within`` as well, if given."""
        names, by = self.schema.fieldNames(), self.partition_by
        folder = f"data/{uuid.uuid4().hex}"
        df = df.select(*names, *([within] if within else []))
        if by is None:
            df.write.parquet(f"{self.root}/{folder}")
            return {"": [folder]}
        key = F.coalesce(F.col(by).cast("string"), F.lit(NULL_PARTITION))
        # without this every shuffle partition would write a file into every
        # table partition; AQE splits the large ones and joins the small
        df.withColumn(_DIR, key).hint("rebalance", F.col(_DIR)).write.partitionBy(_DIR, *([within] if within else [])).parquet(f"{self.root}/{folder}")
        found = {}
        for name, is_dir, _ in self.files_.list(f"{self.root}/{folder}"):
            if is_dir and name.startswith(_DIR + "="):
                value = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(name[len(_DIR) + 1 :])
                found[value] = [f"{folder}/{name}/{sub}" for sub, d, _ in self.files_.list(f"{self.root}/{folder}/{name}") if d] if within else [f"{folder}/{name}"]
        return found

    def commit(self, parts: dict[str, list[str]], operation: str, parent: Snapshot | None, summary: dict | None = None, aux: dict[str, list[str]] | None = None, state: dict | None = None) -> Snapshot:
        """Publish ``parts`` as the successor of ``parent``, or raise
        CommitConflict. ``aux`` and ``state`` are the parent's unless given."""
        aux = (parent.aux if parent else {}) if aux is None else aux
        state = (parent.state if parent else {}) if state is None else state
        snap = Snapshot((parent.id if parent else 0) + 1, parent.id if parent else None, int(time.time() * 1000), operation, summary or {}, parts, aux, state)
        if not self.files_.create_text(f"{self.root}/_log/{snap.id:010d}.json", json.dumps(asdict(snap))):
            raise CommitConflict(f"snapshot {snap.id} of {self.root} was committed by another writer")
        return snap

    def append(self, df: DataFrame, parent: Snapshot | None = NEWEST) -> Snapshot:
        """Add rows, on top of ``parent`` (None: the empty table) if what is added
        was worked out from that."""
        parent = self.snapshot() if parent is NEWEST else parent
        parts = {k: list(v) for k, v in (parent.parts if parent else {}).items()}
        for p, dirs in self._write(df).items():
            parts[p] = parts.get(p, []) + dirs
        return self.commit(parts, "append", parent)

    def overwrite(self, df: DataFrame, partitions: Iterable[str] | None = None, parent: Snapshot | None = NEWEST) -> Snapshot:
        """Atomically replace the named partitions (all, if None) by the rows of
        ``df``; rows of other partitions in ``df`` are added to those."""
        parent = self.snapshot() if parent is NEWEST else parent
        replaced = None if partitions is None else set(partitions)
        parts = {} if replaced is None else {k: list(v) for k, v in (parent.parts if parent else {}).items() if k not in replaced}
        for p, dirs in self._write(df).items():
            parts[p] = parts.get(p, []) + dirs
        return self.commit(parts, "overwrite", parent, {"replaced": "all" if replaced is None else len(replaced)})
