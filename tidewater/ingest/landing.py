"""Landing of vendor files: incoming -> processing -> archive or rejected.

Steps are ordered so that a crash at any point is mended by the next run: a
file stranded in processing goes back to incoming, the manifest is written
before the marker that makes a checksum known, and a marker without its manifest
doesn't count. The same content twice is a duplicate; other content under an
archived name is rejected.
"""

from __future__ import annotations

import datetime
import json
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.rejects import Contract
from ..runtime import cut, discard
from ..sources.readers import read_vendor, with_reasons
from ..sources.specs import SPECS
from .archive import Manifest, ObjectStore, file_key, manifest_key
from .bronze import digest

_SUFFIX = {"csv": ".csv", "json": ".json", "parquet": ".parquet", "xlsx": ".xlsx"}


@dataclass(frozen=True)
class Landed:
    name: str
    status: str
    manifest: Manifest | None


def recover(store: ObjectStore, source: str) -> list[str]:
    """Put files that a crashed run left in processing back to incoming."""
    back = []
    for key in store.list(f"processing/{source}/"):
        target = key.replace("processing/", "incoming/", 1)
        if not store.exists(target):
            store.copy(key, target)
        store.delete(key)
        back.append(target)
    return back


class RejectedRows(RuntimeError):
    """In strict mode: a landed file was rejected or holds rejected rows."""


def land(spark: SparkSession, store: ObjectStore, contract: Contract, day: datetime.date, limit: int | None = None, now: datetime.datetime | None = None, strict: bool = False) -> list[Landed]:
    """Land the incoming files of one source, oldest name first. ``strict`` still
    lands all of them, and then fails if any row or file was rejected."""
    recover(store, contract.source)
    done = [_land_one(spark, store, contract, key, day, now) for key in store.list(f"incoming/{contract.source}/")[:limit]]
    bad = [x.name for x in done if x.status == "rejected" or x.manifest.rejected_row_count]
    if strict and bad:
        raise RejectedRows(f"{contract.source}: rejected data in {', '.join(bad)}")
    return done


def _known(store: ObjectStore, source: str, checksum: str) -> str | None:
    """Key of the manifest of a checksum landed before. Evidence that contradicts
    itself is an error: a marker must lead to a manifest of its own checksum."""
    marker = f"state/checksums/{source}/{checksum}.json"
    if not store.exists(marker):
        return None
    key = json.loads(store.get(marker))["manifest"]
    if not store.exists(key):
        return None  # died between the two; landing again mends it
    if Manifest.load(store.get(key)).checksum != checksum:
        raise RuntimeError(f"{marker} leads to {key}, which is of another checksum")
    return key


def _land_one(spark: SparkSession, store: ObjectStore, contract: Contract, key: str, day: datetime.date, now) -> Landed:
    """One file. Its rows are read, checked and counted by Spark, with the rules
    that loading applies; the driver sees the counts."""
    name, source = key.rsplit("/", 1)[1], contract.source
    spec = SPECS[source.replace("-", "_")]
    size, checksum = digest(spark, [store.path(key)])
    working = f"processing/{source}/{name}"
    store.copy(key, working)
    store.delete(key)

    def finish(status: str, target: str, rows: int = 0, bad: int = 0, reasons=()) -> Landed:
        m = Manifest.of(source, "file", status, target, checksum, size, day, rows, bad, reasons=reasons, now=now)
        at = manifest_key(source, day, m.batch_id + ("" if status == "completed" else f"-{status}"))
        store.put(at, m.dump())
        if status == "completed":
            store.put(f"state/checksums/{source}/{checksum}.json", json.dumps({"manifest": at}).encode())
        store.delete(working)
        return Landed(name, status, m)

    def reject(reason: str) -> Landed:
        target = f"rejected/{source}/{checksum[:16]}-{name}"
        store.copy(working, target)
        store.put(f"{target}.rejection.json", json.dumps({"reason": reason, "checksum": checksum}).encode())
        return finish("rejected", target, reasons=[reason])

    if known := _known(store, source, checksum):
        return finish("duplicate", known)
    if not name.endswith(_SUFFIX[contract.format]):
        return reject(f"{name} is no {contract.format} file")
    target = file_key(source, day, name)
    if store.exists(target) and digest(spark, [store.path(target)])[1] != checksum:
        return reject(f"{target} holds other content")
    rows = cut(with_reasons(read_vendor(spark, [store.path(working)], contract), contract, spec), "landing")
    seen = rows.agg(F.max("file_error").alias("error"), F.count("_source_object_row_position").alias("n"), F.count("reasons").alias("bad")).first()
    if seen.error:
        discard(rows)
        return reject(seen.error)
    store.copy(working, target)
    if seen.bad:
        texts = [F.get(F.col("fields"), F.lit(k)).alias(f.name) for k, f in enumerate(contract.fields)]
        bad = rows.filter("reasons is not null").select(F.col("_source_object_row_position").alias("row_position"), *texts, "reasons")
        bad.write.mode("overwrite").option("header", True).csv(store.path(f"bad-rows/{source}/{checksum[:16]}-{name}"))
    discard(rows)
    return finish("completed", target, seen.n, seen.bad)
