"""The raw archive: object store, key layout, manifests, watermarks."""

from __future__ import annotations

import datetime
import hashlib
import json
import posixpath
import re
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field
from typing import Protocol

from pyspark.sql import SparkSession

from ..runtime import Files


class ObjectStore(Protocol):
    """What the archive needs of an object store."""

    def get(self, key: str) -> bytes: ...
    def put(self, key: str, data: bytes) -> None: ...
    def exists(self, key: str) -> bool: ...
    def copy(self, source: str, target: str) -> None: ...
    def delete(self, key: str) -> None: ...
    def list(self, prefix: str) -> list[str]: ...
    def size(self, key: str) -> int: ...
    def path(self, key: str) -> str: ...


class HadoopStore:
    """Objects below a root on any file system that the cluster knows; a put is
    visible whole or not."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self.files = root.rstrip("/"), Files(spark, root)

    def path(self, key: str) -> str:
        if posixpath.normpath(f"/{key}") != f"/{key.rstrip('/')}" and key:
            raise ValueError(f"{key} leaves the store")
        return f"{self.root}/{key}"

    def get(self, key: str) -> bytes:
        return self.files.read_bytes(self.path(key))

    def put(self, key: str, data: bytes) -> None:
        self.files.write_bytes(self.path(key), data)

    def exists(self, key: str) -> bool:
        return self.files.exists(self.path(key))

    def size(self, key: str) -> int:
        return self.files.size(self.path(key))

    def copy(self, source: str, target: str) -> None:
        self.files.copy(self.path(source), self.path(target))

    def delete(self, key: str) -> None:
        self.files.delete(self.path(key))

    def list(self, prefix: str) -> list[str]:
        folder = prefix.rpartition("/")[0]
        below = (f"{folder}/{k}" if folder else k for k in self.files.tree(self.path(folder)))
        return [k for k in below if k.startswith(prefix) and not k.endswith((".part", ".crc"))]


def sha256(chunks: Iterable[bytes]) -> str:
    h = hashlib.sha256()
    for c in chunks:
        h.update(c)
    return h.hexdigest()


def day_path(day: datetime.date) -> str:
    return f"{day:%Y/%m/%d}"


def snapshot_prefix(table: str, day: datetime.date) -> str:
    return f"postgres/{table}/{day_path(day)}/"


def page_key(source: str, day: datetime.date, page: int) -> str:
    return f"api/{source}/{day_path(day)}/page-{page:05d}.json"


def file_key(source: str, day: datetime.date, name: str) -> str:
    return f"files/{source}/{day_path(day)}/{name}"


def manifest_key(source: str, day: datetime.date, batch_id: str) -> str:
    return f"manifests/{source}/{day_path(day)}/{batch_id}.json"


def day_of(key: str) -> datetime.date | None:
    """The logical date in a key (yyyy/mm/dd or yyyymmdd); null if none is there."""
    for y, m, d in re.findall(r"(?<!\d)(\d{4})/(\d{2})/(\d{2})(?!\d)|$", key)[:1] + re.findall(r"(?<!\d)(\d{4})(\d{2})(\d{2})(?!\d)", key):
        try:
            return datetime.date(int(y), int(m), int(d))
        except ValueError:
            continue
    return None


_KINDS, _STATES = ("file", "api", "postgres"), ("completed", "rejected", "duplicate")


@dataclass(frozen=True)
class Manifest:
    """What is known of one batch of raw data."""

    batch_id: str
    source: str
    source_kind: str
    status: str
    object_key: str
    checksum: str
    size_bytes: int
    ingested_at: str
    logical_date: str | None
    row_count: int
    rejected_row_count: int
    schema_version: str
    rejection_reasons: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.source_kind not in _KINDS or self.status not in _STATES:
            raise ValueError(f"{self.source_kind} {self.status}")
        if not re.fullmatch(r"[0-9a-f]{64}", self.checksum) or self.batch_id != f"{self.source}-{self.checksum[:16]}":
            raise ValueError(f"batch id {self.batch_id} doesn't follow from checksum {self.checksum}")
        if min(self.size_bytes, self.row_count, self.rejected_row_count) < 0 or self.rejected_row_count > self.row_count:
            raise ValueError("counts don't fit")

    @classmethod
    def of(cls, source: str, kind: str, status: str, key: str, checksum: str, size: int, day: datetime.date | None, rows: int, rejected: int = 0, version: str = "1.0", reasons: Iterable[str] = (), now: datetime.datetime | None = None) -> Manifest:
        at = (now or datetime.datetime.now(datetime.UTC)).isoformat()
        return cls(f"{source}-{checksum[:16]}", source, kind, status, key, checksum, size, at, day.isoformat() if day else None, rows, rejected, version, list(reasons))

    def dump(self) -> bytes:
        return json.dumps(asdict(self), sort_keys=True).encode()

    @classmethod
    def load(cls, data: bytes) -> Manifest:
        return cls(**json.loads(data))


def manifests(store: ObjectStore, source: str, day: datetime.date | None = None, status: str = "completed") -> Iterator[Manifest]:
    prefix = f"manifests/{source}/" + (f"{day_path(day)}/" if day else "")
    for key in store.list(prefix):
        if key.endswith(".json"):
            m = Manifest.load(store.get(key))
            if m.status == status:
                yield m


def days_of(store: ObjectStore, source: str) -> list[datetime.date]:
    """Days that have a completed batch of ``source``, ascending."""
    return sorted({datetime.date.fromisoformat(m.logical_date) for m in manifests(store, source) if m.logical_date})


@dataclass(frozen=True)
class Watermark:
    """Where an incremental extract stopped: (updated_at, primary key)."""

    updated_at: datetime.datetime
    key: int

    def __post_init__(self) -> None:
        if self.updated_at.tzinfo is None:
            raise ValueError("a watermark needs a time zone")


def load_watermark(store: ObjectStore, table: str) -> Watermark | None:
    key = f"state/watermarks/{table}.json"
    if not store.exists(key):
        return None
    d = json.loads(store.get(key))
    return Watermark(datetime.datetime.fromisoformat(d["updated_at"]), d["key"])


def save_watermark(store: ObjectStore, table: str, mark: Watermark) -> None:
    store.put(f"state/watermarks/{table}.json", json.dumps({"updated_at": mark.updated_at.isoformat(), "key": mark.key}).encode())


def purge_watermark(store: ObjectStore, table: str) -> None:
    store.delete(f"state/watermarks/{table}.json")
