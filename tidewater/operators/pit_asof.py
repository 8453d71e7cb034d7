"""Problem 2: each event gets the attribute version in force at its time.

Ties are resolved first: one row per order (the latest update), one version per
customer and start (the highest offset). Orders and versions then form one
sequence, customers by their hash, each customer's versions and orders by the
LSN at which they are known. The sequence is cut into buckets, and each bucket
is joined by an ASOF LEFT JOIN in an embedded DuckDB. A bucket also gets the
last version from before it, so a customer that lies in several buckets needs
nothing more than its own and that one.

A bucket holds at most ``bucket_rows`` orders and versions and one carried
version, however many rows there are and whichever customers have them.

Edge cases: an order without customer, or neither baseline nor with an LSN, has
no version; a version neither baseline nor with a start is never known to be in
force; a baseline order takes the baseline version even if that has ended; no
versions or no orders give no rows. Columns besides those named are not read, so
clashing names don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .segments import PIECE_ROWS, in_pieces

BASELINE = -(2**63)

_ASOF = """
select o.order_id, v.customer_key, v.ends, o.place
from (select * from rows where order_id is not null) o
asof left join (select * from rows where order_id is null) v
  on o.customer_id = v.customer_id and o.place >= v.place
"""


def asof_bucket(rows):
    """One bucket as an Arrow table of orders (with an order_id) and versions
    (without) -> order_id, customer_key."""
    import duckdb
    import pyarrow as pa

    # a bucket is small by construction: it never needs a folder to spill to
    with duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""}) as con:
        con.register("rows", rows)
        out = con.sql(f"select order_id, customer_key from ({_ASOF}) where customer_key is not null and (place = {BASELINE} or ends is null or ends > place)").to_arrow_table()
    return out.cast(pa.schema([("order_id", pa.int64()), ("customer_key", pa.string())]))


def resolved_orders(orders: DataFrame) -> DataFrame:
    """One row per order: order_id, customer_id, place."""
    best = F.max(F.struct("updated_at", "lifecycle_start_lsn", "is_snapshot_baseline", "customer_id")).alias("o")
    rows = orders.filter(F.col("order_id").isNotNull()).groupBy("order_id").agg(best)
    place = F.when(F.col("o.is_snapshot_baseline"), F.lit(BASELINE)).otherwise(F.col("o.lifecycle_start_lsn")).cast("long")
    rows = rows.select(F.col("order_id").cast("long").alias("order_id"), F.col("o.customer_id").cast("long").alias("customer_id"), place.alias("place"))
    return rows.filter("customer_id is not null and place is not null")


def resolved_versions(versions: DataFrame) -> DataFrame:
    """One row per customer and start: customer_id, place, customer_key, ends."""
    base = F.coalesce(F.col("is_snapshot_baseline"), F.lit(False))
    place = F.when(base, F.lit(BASELINE)).otherwise(F.col("valid_from_lsn")).cast("long")
    best = F.max(F.struct("kafka_offset", "customer_key", "valid_to_lsn")).alias("v")
    rows = versions.select(F.col("customer_id").cast("long").alias("customer_id"), place.alias("place"), "kafka_offset", "customer_key", "valid_to_lsn")
    rows = rows.filter("customer_id is not null and place is not null and customer_key is not null")
    return rows.groupBy("customer_id", "place").agg(best).select("customer_id", "place", "v.customer_key", F.col("v.valid_to_lsn").cast("long").alias("ends"))


def buckets(orders: DataFrame, versions: DataFrame, bucket_rows: int = PIECE_ROWS) -> DataFrame:
    """(bucket, customer_id, place, order_id, customer_key, ends): orders and
    versions in their buckets, each bucket led by the version it carries over."""
    v = resolved_versions(versions)
    o = resolved_orders(orders)
    no = F.lit(None)
    both = v.withColumn("order_id", no.cast("long")).unionByName(o.withColumns({"customer_key": no.cast("string"), "ends": no.cast("long")}))
    # null order ids come first: a version is known to orders at its own place
    placed = in_pieces(both, [F.xxhash64("customer_id"), "customer_id", "place", "order_id"], bucket_rows, "bucket", "asof")
    last = placed.filter("order_id is null").groupBy("bucket").agg(F.max_by(F.struct("customer_id", "place", "customer_key", "ends"), F.struct(F.xxhash64("customer_id"), "customer_id", "place")).alias("last"))
    every = placed.select("bucket").distinct().join(last, "bucket", "left")
    before = Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    carried = every.select("bucket", F.last("last", ignorenulls=True).over(before).alias("c")).filter("c is not null")
    carried = carried.select("bucket", "c.customer_id", "c.place", "c.customer_key", "c.ends", no.cast("long").alias("order_id"))
    return placed.unionByName(carried)


def in_force(orders: DataFrame, versions: DataFrame, bucket_rows: int = PIECE_ROWS) -> DataFrame:
    """(order_id, customer_key) of every order that has a version in force."""
    placed = buckets(orders, versions, bucket_rows)
    return placed.groupBy("bucket").applyInArrow(asof_bucket, "order_id long, customer_key string")
