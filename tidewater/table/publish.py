"""Serving copies: each publication is a new version folder, checked against its
source and made visible by replacing one pointer file. Readers never see a
half-written version, and a rebuild from the source is just a publication."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import month_key
from ..runtime import Files


@dataclass(frozen=True)
class Serving:
    """Layout of a served table: sort keys and, if given, a date column whose
    month partitions it."""

    name: str
    sort: tuple[str, ...]
    month_of: str | None = None
    not_negative: tuple[str, ...] = ()


SERVED = {
    s.name: s
    for s in (
        Serving("mart_daily_sales", ("order_date", "category_name", "region"), "order_date", ("orders_count", "items_sold")),
        Serving("mart_customer_ltv", ("customer_id",), None, ("orders_count",)),
        Serving("mart_marketing_roi", ("campaign_id",), None, ("impressions", "clicks")),
        Serving("mart_delivery_performance", ("carrier",), None, ("delivery_count",)),
    )
}


def _sums(df: DataFrame) -> list:
    h = F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")
    return [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("h")]


def checksum(df: DataFrame) -> tuple[int, str]:
    """(rows, order-free sum of row hashes); equal for equal multisets of rows."""
    r = df.agg(*_sums(df)).first()
    return r.n, r.h


class ServingReader:
    """What readers are given: published versions, and no way to change them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)
        self._frames: dict[str, tuple[str, DataFrame]] = {}

    def _pointer(self, name: str) -> str:
        return f"{self.root}/{name}/_current.json"

    def current(self, name: str) -> dict | None:
        p = self._pointer(name)
        return json.loads(self.files.read_text(p)) if self.files.exists(p) else None

    def read(self, name: str, schema) -> DataFrame:
        now = self.current(name)
        if now is None:
            return self.spark.createDataFrame([], schema)
        # a version never changes, so its files are listed once; one per name is kept
        if self._frames.get(name, ("",))[0] != now["version"]:
            self._frames[name] = now["version"], self.spark.read.schema(schema).parquet(now["version"]).select(*schema.fieldNames())
        return self._frames[name][1]


class ServingStore(ServingReader):
    """What the publisher has."""

    def reader(self) -> ServingReader:
        return ServingReader(self.spark, self.root)

    def publish(self, spec: Serving, df: DataFrame) -> dict:
        """Write, validate, swap. On a failed check the old version stays."""
        version = f"{self.root}/{spec.name}/v-{uuid.uuid4().hex}"
        source = Observation()  # the source is summed while it is written, not run again
        out = df.observe(source, *_sums(df))
        if spec.month_of:
            # rebalance splits a large month over tasks and joins small ones
            out = out.withColumn("__month", month_key(F.col(spec.month_of))).hint("rebalance", F.col("__month"))
            out.sortWithinPartitions("__month", *spec.sort).write.partitionBy("__month").parquet(version)
        else:
            out.hint("rebalance").sortWithinPartitions(*spec.sort).write.parquet(version)
        served = self.spark.read.schema(df.schema).parquet(version).select(*df.columns)
        try:
            want = (source.get["n"], source.get["h"])
        except Exception:  # a plan that is known to be empty leaves no sums
            want = checksum(df)
        got = checksum(served)
        bad = F.lit(False)
        for c in spec.not_negative:
            bad = bad | (F.col(c) < 0)
        if want != got or served.filter(bad).limit(1).count():
            self.files.delete(version)
            raise RuntimeError(f"{spec.name}: the written version has {got}, its source {want}")
        state = {"version": version, "rows": got[0], "checksum": got[1]}
        self.files.replace_text(self._pointer(spec.name), json.dumps(state))
        return state

    def prune(self, name: str) -> int:
        """Delete versions the pointer doesn't name (after readers are done)."""
        now, n = self.current(name), 0
        for child, is_dir, _ in self.files.list(f"{self.root}/{name}"):
            if is_dir and now and not now["version"].endswith(child):
                self.files.delete(f"{self.root}/{name}/{child}")
                n += 1
        return n
