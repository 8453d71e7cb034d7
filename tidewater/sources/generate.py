"""Deterministic test data: change feeds at scale, vendor files, API pages.

Change feeds come from ``spark.range`` and hashes of the row number, so any
number of rows is made in parallel and the same seed gives the same rows.
"""

from __future__ import annotations

import csv
import datetime
import io
import json
import random
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import quantized
from . import xlsx
from .specs import LEDGER, SPECS, TOPIC


def _unit(seed: int, name: str):
    """Uniform in [0, 1) by row and name."""
    return F.pmod(F.xxhash64("id", F.lit(name), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def change_feed(spark: SparkSession, n: int, keys: int, table: str = "customers", seed: int = 42, hot: float = 0.1, repeated: float = 0.03, partitions: int | None = None) -> DataFrame:
    """A ledger of ``n`` changes over ``keys`` entities: the first of a key is a
    snapshot read, some are deletes, ``hot`` of all fall on one key and
    ``repeated`` are delivered twice."""
    rows = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    key = F.when(F.col("id") < keys, F.col("id")).when(_unit(seed, "hot") < hot, 0).otherwise(F.floor(_unit(seed, "key") * keys)).cast("bigint")
    op = F.when(F.col("id") < keys, "r").when(_unit(seed, "op") < 0.04, "d").when(_unit(seed, "op") < 0.1, "c").otherwise("u")
    rows = rows.withColumns({"k": key, "operation": op})
    name = SPECS[table].key[0]
    values = F.to_json(F.struct(F.col("k").alias(name), F.concat(F.lit("c"), F.col("k").cast("string"), F.lit("@example.test")).alias("email"), F.element_at(F.array(*map(F.lit, ("standard", "premium", "vip"))), (1 + F.floor(_unit(seed, "seg") * 3)).cast("int")).alias("segment"), F.lit("active").alias("status")))
    at = F.timestamp_seconds(F.lit(1_767_225_600) + F.col("id"))
    out = rows.select(
        F.lit(TOPIC.format(table)).alias("kafka_topic"), F.lit(0).alias("kafka_partition"), F.col("id").alias("kafka_offset"), at.alias("kafka_timestamp"), F.lit("public").alias("source_schema"), F.lit(table).alias("source_table"), "operation",
        F.when(F.col("operation") != "r", F.lit(10_000) + F.floor(F.col("id") / 2)).cast("bigint").alias("source_lsn"), F.col("id").alias("source_tx_id"), at.alias("source_timestamp"),
        F.to_json(F.struct(F.col("k").alias(name))).alias("key_json"), F.lit("{}").alias("envelope_json"), F.lit(None).cast("string").alias("before_json"), F.when(F.col("operation") != "d", values).alias("after_json"),
        F.to_date(at).alias("event_date"), at.alias("ingested_at"), F.explode(F.when(_unit(seed, "twice") < repeated, F.sequence(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    out = out.withColumn("event_id", F.sha2(F.concat_ws(":", "kafka_topic", "kafka_partition", "kafka_offset"), 256)).withColumn("ingested_at", F.col("ingested_at") + F.make_dt_interval(hours=F.col("copy")))
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in LEDGER])


def initial_load(spark: SparkSession, customers: int = 10_000, products: int = 5_000, orders: int = 100_000, seed: int = 42, partitions: int | None = None) -> dict[str, DataFrame]:
    """Tables of a shop on its first day, columns as in ``SPECS``. Products are
    bought by ``power_weight`` of their rank: the inverse of its sum, so any
    number of lines is drawn without a table of weights."""
    ids = lambda n: spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    anchor = F.lit("2026-01-01").cast("timestamp")
    stamps = {"created_at": anchor - F.make_dt_interval(F.lit(30), F.lit(0), F.lit(0)), "updated_at": anchor}
    pick = lambda name, values: F.element_at(F.array(*[F.lit(v) for v in values]), (1 + F.floor(_unit(seed, name) * len(values))).cast("int"))
    customer = ids(customers).withColumns({"customer_id": F.col("id"), "email": F.concat(F.lit("c"), F.col("id").cast("string"), F.lit("@example.test")), "first_name": pick("first", "ABCDE"), "last_name": pick("last", "VWXYZ"), "region": pick("region", ("north", "south", "east", "west")), "city": pick("city", ("a", "b", "c")), "status": F.lit("active"), "segment": pick("segment", ("standard", "premium", "vip")), "registered_at": stamps["created_at"], **stamps})
    price = quantized(F.lit(5) + F.floor(_unit(seed, "price") * 49_500) / F.lit(100))
    product = ids(products).withColumns({"product_id": F.col("id"), "sku": F.concat(F.lit("S"), F.col("id").cast("string")), "name": F.concat(F.lit("product "), F.col("id").cast("string")), "category_id": F.col("id") % 40, "brand": pick("brand", ("k", "l", "m")), "unit_price": price, "is_active": F.lit(True), **stamps}).withColumn("unit_cost", quantized(F.col("unit_price") * F.lit("0.6").cast("decimal(2,1)")))
    # rank r with weight (r + 1) ** -0.7: its sum up to r grows like (r + 1) ** 0.3
    rank = F.least(F.floor(F.pow(_unit(seed, "rank"), F.lit(1 / 0.3)) * products), F.lit(products - 1)).cast("bigint")
    line = ids(orders).withColumns({"order_item_id": F.col("id"), "order_id": F.col("id"), "product_id": rank, "quantity": (1 + F.floor(_unit(seed, "quantity") * 4)).cast("bigint"), **stamps})
    line = line.join(product.select("product_id", "unit_price"), "product_id").withColumn("line_total", quantized(F.col("unit_price") * F.col("quantity")))
    order = line.select("order_id", F.floor(F.pmod(F.xxhash64("order_id", F.lit(seed)), F.lit(customers))).cast("bigint").alias("customer_id"), F.lit("pending").alias("status"), F.lit("EUR").alias("currency"), F.lit("4.90").cast("decimal(12,2)").alias("shipping_cost"), (F.col("line_total") + F.lit("4.90").cast("decimal(12,2)")).alias("order_total"), "created_at", "updated_at")
    made = {"customers": customer, "products": product, "orders": order, "order_items": line}
    return {n: df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SPECS[n].business]) for n, df in made.items()}


def order_states(orders: DataFrame, payments: DataFrame, shipments: DataFrame) -> DataFrame:
    """Orders joined to their payment, with the number of their shipments, of
    which there may be none."""
    paid = payments.select(F.col("order_id").alias("__p"), "payment_status")
    sent = shipments.groupBy(F.col("order_id").alias("__s")).agg(F.count("*").alias("shipments"))
    joined = orders.join(paid, F.col("order_id") == F.col("__p")).join(sent, F.col("order_id") == F.col("__s"), "left")
    return joined.withColumn("shipments", F.coalesce("shipments", F.lit(0))).drop("__p", "__s")


def vendor_file(source: str, day: datetime.date, rows: int = 50, seed: int = 42, bad: int = 0) -> bytes:
    """Bytes of a vendor file; the last ``bad`` rows break their contract."""
    from .readers import CONTRACTS

    rng, contract = random.Random(f"{source}-{day}-{seed}"), CONTRACTS[source]
    make = {
        "string": lambda f: f"{f[:3].upper()}-{rng.randrange(10_000):05d}",
        "integer": lambda f: str(rng.randrange(1_000_000)),
        "decimal": lambda f: f"{rng.randrange(100, 99_999) / 100:.2f}",
        "date": lambda f: (day - datetime.timedelta(days=rng.randrange(365))).isoformat(),
    }
    names = [f.name for f in contract.fields]
    data = [[make[f.type](f.name) for f in contract.fields] for _ in range(rows)]
    for r in data[len(data) - bad :]:
        r[-1] = ""
    if contract.format == "csv":
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([names, *data])
        return out.getvalue().encode()
    if contract.format == "json":
        return json.dumps([dict(zip(names, r, strict=True)) for r in data]).encode()
    if contract.format == "xlsx":
        return xlsx.write(names, data)
    import pyarrow as pa
    import pyarrow.parquet as pq

    cast = {"string": str, "integer": int, "decimal": Decimal, "date": datetime.date.fromisoformat}
    columns = {f.name: [cast[f.type](r[k]) if r[k] else None for r in data] for k, f in enumerate(contract.fields)}
    sink = io.BytesIO()
    pq.write_table(pa.table(columns), sink)
    return sink.getvalue()


def rate_page(day: datetime.date, base: dict[str, float] | None = None, jitter: float = 0.02) -> dict:
    """One page of exchange rates around ``base``, the same for the same day."""
    base = base or {"USD": 1.09, "GBP": 0.85, "CHF": 0.95}
    rng = random.Random(day.toordinal())
    rates = [{"currency": c, "rate": round(r * (1 + rng.uniform(-jitter, jitter)), 6)} for c, r in base.items()]
    return {"rates": rates, "total_count": len(rates)}


def faulty(get, every: int = 5, error: Exception | None = None):
    """``get`` that fails on every ``every``-th call, for trying retries."""
    calls = [0]

    def call(*args):
        calls[0] += 1
        if calls[0] % every == 0:
            raise error or TimeoutError("injected")
        return get(*args)

    return call
