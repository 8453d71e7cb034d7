"""Queries that take the driver's tables through capture, landing, loading,
maintenance and publication, with SQL for what must come out.

Tables that a query builds are scratch and go with the process.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..ingest import archive, bronze, landing
from ..operators.relational import in_time_order
from ..runtime import discard, scratch_dir
from ..sources import generate, readers, rest, xlsx
from ..sources.specs import CAPTURED, SPECS, TOPIC
from ..streaming import boundary, cdc
from ..table import maintenance, mutate
from ..table.publish import SERVED, ServingStore
from ..table.snapshots import SnapshotTable
from . import checks, warehouse
from .models import typed_changes
from .problems import table

DAY = dt.date(2018, 2, 1)

# -- capture --------------------------------------------------------------------


def messages(spark, d) -> DataFrame:
    """The ledger's rows as the messages they were; repeated ones still are."""
    rows = table(spark, d, "postgres_cdc_events").filter("kafka_partition is not null and kafka_timestamp is not null")
    return rows.select(F.col("kafka_topic").alias("topic"), F.col("kafka_partition").alias("partition"), F.col("kafka_offset").alias("offset"), F.col("kafka_timestamp").alias("timestamp"), F.encode("key_json", "UTF-8").alias("key"), F.encode("envelope_json", "UTF-8").alias("value"))


def messages_parsed(spark, d):
    p = cdc.parsed(messages(spark, d))
    return p.select("event_id", "source_table", "operation", "source_lsn", "source_tx_id", F.unix_micros("source_timestamp").alias("at_us"), "event_date", F.size("errors").alias("errors"), F.md5("after_json").alias("after_md5"))


def ledger_batches(spark, d):
    """Messages written to the ledger in batches, each sent twice."""
    ledger = cdc.ledger_at(spark, scratch_dir(spark, "ledger"))
    parts = in_time_order(messages(spark, d), F.col("timestamp"), 3)
    for b in parts:
        for _ in range(2):
            cdc.write_batch(ledger, b)
    discard(*parts[:1])
    return ledger.read().select("event_id", "event_date", "source_table", "kafka_offset")


def ledger_stream(spark, d):
    """The same through a stream of files that is stopped and started again."""
    src, root, marks = (scratch_dir(spark, n) for n in ("messages", "ledger", "marks"))
    parts = in_time_order(messages(spark, d), F.col("timestamp"), 2)
    for b in parts:
        b.write.mode("append").parquet(src)
        stream = spark.readStream.schema(b.schema).option("maxFilesPerTrigger", 4).parquet(src)
        query = cdc.start(stream, root, marks)
        query.awaitTermination()
        if query.exception():
            raise query.exception()
    return cdc.ledger_at(spark, root).read().groupBy("source_table", "operation").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


def boundary_changes(spark, d):
    """Changes of partition 0 before a boundary half way through each topic."""
    feed = warehouse.built(spark, d)["ledger"].filter("kafka_partition = 0")
    ends = boundary.frontier(feed)
    half = {t: {"partition": 0, "offset_exclusive": at["offset_exclusive"] // 2} for t, at in ends.items()}
    parts = [typed_changes(t)(feed, half).agg(F.count("*").alias("n"), F.max("kafka_offset").alias("last")).select(F.lit(t).alias("source_table"), F.lit(half[TOPIC.format(t)]["offset_exclusive"]).cast("bigint").alias("before"), "n", "last") for t in CAPTURED]
    return reduce(DataFrame.unionByName, parts)


# -- landing and loading ------------------------------------------------------------


def _vendor_lines(spark, d) -> DataFrame:
    part = table(spark, d, "part")
    return part.select(
        F.concat(F.lit("S"), F.col("p_size").cast("string")).alias("supplier_id"), F.concat(F.lit("P-"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 9 == 0, ', "x"').otherwise("")).alias("sku"),
        F.when(F.col("p_partkey") % 7 == 0, "about 5").otherwise(F.concat((F.col("p_partkey") % 300).cast("string"), F.lit(".5"))).alias("price"), F.when(F.col("p_partkey") % 11 == 0, " ").otherwise("EUR").alias("currency"),
        F.when(F.col("p_partkey") % 13 == 0, "2018-02-30").otherwise("2018-02-28").alias("valid_from"), (F.col("p_partkey") % 3).cast("string").alias("file"),
    )


def landed_files(spark, d):
    """Vendor files landed, sent again, and loaded: rows, rejected and loaded."""
    store, contract = archive.HadoopStore(spark, scratch_dir(spark, "store")), readers.CONTRACTS["supplier-prices"]
    out = scratch_dir(spark, "vendor")
    _vendor_lines(spark, d).repartition("file").write.partitionBy("file").options(header=True, escape='"').csv(out)
    made = archive.HadoopStore(spark, out)
    incoming = [(k, f"incoming/{contract.source}/prices-{k.split('=')[1][0]}.csv") for k in made.list("") if k.endswith(".csv")]
    for again in range(2):
        for source, target in incoming:
            store.files.copy(made.path(source), store.path(target if not again else target.replace("/prices-", "/again-")))
        landing.land(spark, store, contract, DAY)
    manifests = [(m.object_key.rsplit("/", 1)[1], m.row_count, m.rejected_row_count) for m in archive.manifests(store, contract.source)]
    root = scratch_dir(spark, "raw")
    bronze.load_with_retry(lambda: bronze.load_new(spark, store, root, SPECS["supplier_prices"]))
    loaded = bronze.raw_table(spark, root, SPECS["supplier_prices"]).read().groupBy(F.substring_index("_source_object", "/", -1).alias("file")).agg(F.count("*").alias("loaded_rows"), F.sum("price").alias("price"))
    landed = spark.createDataFrame(manifests, "file string, row_count long, rejected_row_count long")  # one row per file
    bad = spark.read.option("header", True).csv(store.path(f"bad-rows/{contract.source}/*")).groupBy(F.regexp_extract(F.col("_metadata.file_path"), r"-(prices-[0-9]\.csv)/", 1).alias("file")).agg(F.count("*").alias("bad_rows"))
    duplicates = len(list(archive.manifests(store, contract.source, status="duplicate")))
    return landed.join(loaded, "file", "left").join(bad, "file", "left").withColumn("duplicates", F.lit(duplicates))


def bronze_loads(spark, d):
    """Two extracts by watermark and one of everything, loaded date by date; the
    last replaces its date."""
    store, root, spec = archive.HadoopStore(spark, scratch_dir(spark, "store")), scratch_dir(spark, "raw"), SPECS["orders"]
    orders = warehouse.raw_rows(spark, d, "orders", 0)
    cutoff = F.lit("1998-01-01").cast("timestamp")
    for source, day in ((orders.filter(F.col("updated_at") < cutoff), DAY), (orders, DAY + dt.timedelta(1)), (orders, DAY + dt.timedelta(2))):
        bronze.extract_snapshot(spark, source, store, "orders", day)
    bronze.extract_snapshot(spark, orders.filter("customer_id % 2 = 0"), store, "orders", DAY + dt.timedelta(3), full=True)
    bronze.load_new(spark, store, root, spec)
    got = bronze.raw_table(spark, root, spec).read().groupBy(F.col("_batch_date").alias("batch_date"))
    return got.agg(F.count("*").alias("n"), S.distinct_rows("_source_object", "_source_object_row_position").alias("places"), F.max("order_id").alias("last_order"), F.sum("order_total").alias("total"))


def deleted_ranges(spark, d):
    """Rows taken out of a loaded table by ranges of their places."""
    spec = SPECS["fx_rates"]
    raw = bronze.raw_table(spark, scratch_dir(spark, "raw"), spec)
    part = table(spark, d, "part")
    rows = part.select(F.concat(F.lit("C"), F.col("p_partkey").cast("string")).alias("currency"), F.lit("1.5").cast("decimal(18,6)").alias("rate"), F.lit("b").alias("_batch_id"), F.lit(DAY).alias("_batch_date"), F.concat(F.lit("o"), (F.col("p_partkey") % 3).cast("string")).alias("_source_object"), F.col("p_partkey").alias("_source_object_row_position"), F.lit(None).cast("timestamp").alias("_ingested_at"))
    raw.append(rows)
    places = spark.createDataFrame([("o0", 0, 300), ("o1", 100, 150), ("none", 0, 9)], "_source_object string, first long, last long")
    bronze.delete_coordinates(raw, DAY, places)
    return raw.read().groupBy(F.col("_source_object").alias("source_object")).agg(F.count("*").alias("n"), F.min("_source_object_row_position").alias("first_place"))


def _nations(spark, d) -> list:
    """The nations, of which there are always 25, as what an API serves."""
    return table(spark, d, "nation").orderBy("n_nationkey").collect()


def api_pages(spark, d):
    """Pages by number from an API that fails now and then: archived, loaded."""
    records = [{"currency": f"C{r.n_nationkey}", "rate": (1_000_000 + r.n_nationkey) / 1e6} for r in _nations(spark, d)]
    pages = [records[k : k + 4] for k in range(0, len(records), 4)]
    send = generate.faulty(lambda path, p: rest.Response(200, _json({"rates": pages[p["page"] - 1] if p["page"] <= len(pages) else [], "total_count": len(records)}), {}), 3, rest.TransportError("injected"))
    client = rest.Client(send, sleep=lambda s: None)
    store, root, spec = archive.HadoopStore(spark, scratch_dir(spark, "store")), scratch_dir(spark, "raw"), SPECS["fx_rates"]
    bronze.archive_pages(store, "fx-rates", DAY, rest.offset_pages(lambda p: client.get("/rates", p), "rates", 4), "rates")
    bronze.load_date(spark, store, root, spec, DAY)
    return bronze.raw_table(spark, root, spec).read().select("currency", "rate", F.substring_index("_source_object", "/", -1).alias("page"), F.col("_source_object_row_position").alias("place"))


def api_cursor(spark, d):
    """Pages by cursor of what changed since the day before."""
    since = (DAY - dt.timedelta(1)).isoformat()
    made = [{"delivery_id": f"D{r.n_nationkey}", "order_id": r.n_name, "carrier": f"R{r.n_regionkey}", "status": "delivered", "shipped_at": f"{since}T08:00:00Z", "delivered_at": None, "updated_at": f"{since}T09:00:00Z", "more": 1} for r in _nations(spark, d)]
    pages = [made[k : k + 7] for k in range(0, len(made), 7)]

    def send(path, p):
        k = int(p.get("cursor", 0))
        found = pages[k] if p["updated_since"] == since else []
        return rest.Response(200, _json({"deliveries": found, "next_cursor": str(k + 1) if k + 1 < len(pages) else None}), {})

    client = rest.Client(send, sleep=lambda s: None)
    store, root, spec = archive.HadoopStore(spark, scratch_dir(spark, "store")), scratch_dir(spark, "raw"), SPECS["deliveries"]
    bronze.archive_pages(store, "deliveries", DAY, rest.cursor_pages(lambda p: client.get("/deliveries", p), "deliveries", DAY), "deliveries")
    bronze.load_date(spark, store, root, spec, DAY)
    return bronze.raw_table(spark, root, spec).read().select("delivery_id", "order_id", "carrier", F.date_format("shipped_at", "yyyy-MM-dd HH:mm").alias("shipped"), F.col("delivered_at").isNull().alias("under_way"), F.substring_index("_source_object", "/", -1).alias("page"))


def vendor_formats(spark, d):
    """Vendor files as a JSON array, Parquet and XLSX: rows and rejected rows."""
    store = archive.HadoopStore(spark, scratch_dir(spark, "store"))
    part = table(spark, d, "part")
    record = F.to_json(F.struct(F.lit("p").alias("partner_id"), F.concat(F.lit("S"), F.col("p_partkey").cast("string")).alias("sku"), F.when(F.col("p_partkey") % 8 != 0, F.col("p_name")).alias("title"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category")))
    # a file of this format is one text whoever writes it
    array = part.groupBy().agg(F.concat(F.lit("["), F.array_join(F.collect_list(record), ","), F.lit("]")).alias("value"))
    array.coalesce(1).write.text(store.path("json"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice").cast("decimal(14,2)")).alias("order_total"), F.col("o_orderdate").alias("order_date"))
    orders.write.parquet(store.path("parquet"))
    stock = [[f"R{r.n_regionkey}", r.n_name, "many" if r.n_nationkey % 6 == 0 else str(r.n_nationkey), "2018-01-31"] for r in _nations(spark, d)]
    store.put("xlsx/stock.xlsx", xlsx.write(["supplier_id", "sku", "quantity", "updated_at"], stock))
    parts = []
    for source, kind, ending in (("partner-products", "json", ".txt"), ("historical-orders", "parquet", ".parquet"), ("supplier-stock", "xlsx", ".xlsx")):
        paths = [store.path(k) for k in store.list(f"{kind}/") if k.endswith(ending)]
        rows = readers.with_reasons(readers.read_vendor(spark, paths, readers.CONTRACTS[source]), readers.CONTRACTS[source])
        parts.append(rows.groupBy().agg(F.lit(source).alias("source"), F.count("*").alias("n"), F.count("reasons").alias("rejected"), F.count_distinct("_source_object", "_source_object_row_position").alias("places"), F.count("file_error").alias("broken")))
    return reduce(DataFrame.unionByName, parts)


def _json(body: dict) -> bytes:
    import json

    return json.dumps(body).encode()


# -- maintenance and publication ---------------------------------------------------


def compacted(spark, d):
    """A table appended to in five steps, compacted: candidates before and after,
    and rows that are gone."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    t = SnapshotTable(spark, scratch_dir(spark, "table")).create(e.schema, "event_type")
    for k in range(5):
        t.append(e.filter(F.col("event_id") % 5 == k))
    before, old = maintenance.inventory(t).select("partition", F.col("is_candidate").alias("was_candidate"), (F.col("files") >= 5).alias("had_files")).collect(), t.snapshot().id
    maintenance.compact(t, confirm=True, unique="event_id")
    was = spark.createDataFrame(before, "partition string, was_candidate boolean, had_files boolean")  # one row per partition
    now = maintenance.inventory(t).select("partition", "is_candidate")
    lost = maintenance.lost_rows(t, old).groupBy(F.col("event_type").alias("partition")).agg(F.count("*").alias("lost"))
    return maintenance.rows_by_partition(t).join(was, "partition").join(now, "partition").join(lost, "partition", "left").fillna(0, ["lost"])


def mutated(spark, d):
    """Orders updated under a guard, and some deleted with their lines."""
    parts = {t: table(spark, d, t) for t in ("orders", "lineitem")}
    orders = SnapshotTable(spark, scratch_dir(spark, "orders")).create(parts["orders"].schema, "o_orderstatus")
    lines = SnapshotTable(spark, scratch_dir(spark, "lines")).create(parts["lineitem"].schema)
    orders.append(parts["orders"])
    lines.append(parts["lineitem"])
    mutate.update_where(orders, (F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 3 == 0), {"o_orderstatus": F.lit("F")})
    mutate.update_where(orders, F.col("o_orderstatus") == "none", {"o_orderstatus": F.lit("F")})
    mutate.delete_where(orders, F.col("o_orderkey") % 7 == 0, [(lines, "l_orderkey", "o_orderkey")])
    n = lines.read().groupBy(F.col("l_orderkey").alias("order")).agg(F.count("*").alias("n"))
    joined = orders.read().join(n, F.col("o_orderkey") == F.col("order"), "full")
    return joined.groupBy("o_orderstatus").agg(F.count("*").alias("orders"), F.sum("n").alias("lines"))


def expired_snapshots(spark, d):
    """Snapshots after expiry: six overwrites, one of them named, two to keep."""
    r = table(spark, d, "region").select("r_regionkey", "r_name")
    t = SnapshotTable(spark, scratch_dir(spark, "table")).create(r.schema)
    for _ in range(6):
        t.overwrite(r)
    t.set_ref("audit", 2)
    ids = [s.id for s in t.log()]
    later = t.log()[-1].committed_ms + 40 * 86_400_000
    maintenance.maintain({"t": t}, True, ("expire",), keep=2, now_ms=later)
    log = maintenance.snapshots(t).select("snapshot_id", "parent_id")
    all_ = spark.createDataFrame([(i,) for i in ids], "snapshot_id long")
    named = maintenance.refs(t).groupBy("snapshot_id").agg(F.max("name").alias("name"))
    files = maintenance.entries(t).groupBy("snapshot_id").agg(F.count("*").alias("folders"))
    return all_.join(log.withColumn("kept", F.lit(True)), "snapshot_id", "left").join(named, "snapshot_id", "left").join(files, "snapshot_id", "left").select("snapshot_id", F.coalesce("kept", F.lit(False)).alias("kept"), "parent_id", "name", F.coalesce("folders", F.lit(0)).alias("folders"))


_PUBLISHED: dict[tuple, ServingStore] = {}


def serving(spark, d) -> ServingStore:
    """The marts published once a session, as readers find them."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _PUBLISHED:
        store, m = ServingStore(spark, scratch_dir(spark, "serving")), warehouse.built(spark, d)
        for name, spec in SERVED.items():
            store.publish(spec, m[name])
        _PUBLISHED[key] = store
    return _PUBLISHED[key]


def served(spark, d, name: str) -> DataFrame:
    return serving(spark, d).read(name, warehouse.built(spark, d)[name].schema)


def published_sales(spark, d):
    s = served(spark, d, "mart_daily_sales")
    return s.select("date_key", "category_name", "region", "orders_count", "items_sold", warehouse._text("revenue_eur"), warehouse._text("margin_eur"))


def published_aggregate(spark, d):
    """The serving query: by day and region, in their order. A row per day and
    region is few enough to be sorted by one task, without a sample for ranges."""
    s = served(spark, d, "mart_daily_sales").groupBy("order_date", "region")
    out = s.agg(F.sum("revenue_eur").alias("revenue"), F.sum("orders_count").alias("orders_count"), F.sum("items_sold").alias("items_sold")).coalesce(1).orderBy(F.col("order_date").asc_nulls_last(), F.col("region").asc_nulls_last())
    return out.select("order_date", "region", F.round(F.col("revenue").cast("double"), 6).alias("revenue_eur"), "orders_count", "items_sold")


def published_states(spark, d):
    """What the pointers say of each published mart."""
    store = serving(spark, d)
    return spark.createDataFrame([(n, store.current(n)["rows"]) for n in SERVED], "mart string, n long")


# -- the rest -------------------------------------------------------------------------


def order_states(spark, d):
    """Orders with their payment and, if there is one, their shipment."""
    m = warehouse.built(spark, d)
    return generate.order_states(m["fact_orders"], m["fact_payments"], m["fact_shipments"]).select("order_id", "order_status", "payment_status", "shipments")


def scalars_pinned(spark, d):
    e = table(spark, d, "events")
    day = F.to_date("ts")
    return e.select(
        "event_id", S.json_scalar(F.col("props"), "$.k").alias("k"), S.json_scalar(F.concat(F.lit('{"a":'), F.col("props"), F.lit("}")), "$.a").alias("inner"), S.date_key(day).alias("date_key"), S.month_key(day).alias("month_key"), S.iso_weekday(day).alias("weekday"),
        S.complete_minutes(F.lit("2024-01-01 00:00:30").cast("timestamp"), F.col("ts").cast("timestamp")).alias("whole_minutes"), S.quantized(F.col("event_id") / F.lit(8).cast("decimal(3,0)")).alias("cents"), F.round(S.power_weight(F.col("event_id") % 50), 9).alias("weight"),
        F.unix_micros(S.epoch_timestamp(F.col("event_id") * 1_000_001, F.lit(None).cast("bigint"), F.lit(5).cast("bigint"))).alias("at_us"),
    )


def check_freshness(spark, d):
    e = table(spark, d, "events")
    parts = [checks.freshness(e, F.lit(now).cast("timestamp"), column="ts").select(F.lit(now).alias("checked_at"), "state") for now in ("2024-01-01 00:00:00", "2030-01-01 00:00:00")]
    return parts[0].unionByName(parts[1])


QUERIES = {f.__name__: f for f in (messages_parsed, ledger_batches, ledger_stream, boundary_changes, landed_files, bronze_loads, deleted_ranges, api_pages, api_cursor, vendor_formats, compacted, mutated, expired_snapshots, published_sales, published_aggregate, published_states, order_states, scalars_pinned, check_freshness)}

_SENT = "select *, sha256(kafka_topic || ':' || kafka_partition || ':' || kafka_offset) mid from postgres_cdc_events where kafka_partition is not null and kafka_timestamp is not null"
_DAY = "coalesce(cast(make_timestamp(cast(json_extract_string(envelope_json, '$.source.ts_us') as bigint)) as date), cast(kafka_timestamp as date))"
_LINES = "(select *, p_partkey % 7 = 0 or p_partkey % 11 = 0 or p_partkey % 13 = 0 bad from part)"
_FIRST = "(select max(o_orderdate) from orders where o_orderdate < timestamp '1998-01-01')"

ORACLE = {
    "messages_parsed": f"""select mid event_id, source_table, operation, cast(json_extract_string(envelope_json, '$.source.lsn') as bigint) source_lsn, cast(json_extract_string(envelope_json, '$.source.txId') as bigint) source_tx_id,
        cast(json_extract_string(envelope_json, '$.source.ts_us') as bigint) at_us, {_DAY} event_date, 0 errors, md5(after_json) after_md5 from ({_SENT})""",
    "ledger_batches": f"select distinct mid event_id, {_DAY} event_date, source_table, kafka_offset from ({_SENT})",
    "ledger_stream": f"select source_table, operation, count(distinct mid) n, count(distinct mid) ids from ({_SENT}) group by 1, 2",
    "boundary_changes": warehouse._BASE + """, z as (select source_table, kafka_offset, (max(kafka_offset) over (partition by source_table) + 1) // 2 half from led where kafka_partition = 0)
        select source_table, cast(max(half) as bigint) before, count(*) n, max(kafka_offset) last from z where kafka_offset < half group by 1""",
    "landed_files": f"""select 'prices-' || p_partkey % 3 || '.csv' file, count(*) row_count, count(*) filter (bad) rejected_row_count, count(*) filter (not bad) loaded_rows, cast(sum(p_partkey % 300 + 0.5) filter (not bad) as decimal(22,2)) price, count(*) filter (bad) bad_rows, 3 duplicates from {_LINES} group by 1""",
    "bronze_loads": f"""select date '2018-02-01' batch_date, count(*) n, count(*) places, max(o_orderkey) last_order, sum(cast(o_orderkey % 900 + 10 as decimal(12,2))) total from orders where o_orderdate < timestamp '1998-01-01'
        union all select date '2018-02-02', count(*), count(*), max(o_orderkey), sum(cast(o_orderkey % 900 + 10 as decimal(12,2))) from orders where o_orderdate >= timestamp '1998-01-01'
        union all select date '2018-02-04', count(*), count(*), max(o_orderkey), sum(cast(o_orderkey % 900 + 10 as decimal(12,2))) from orders where o_custkey % 2 = 0""",
    "deleted_ranges": """select 'o' || p_partkey % 3 source_object, count(*) n, min(p_partkey) first_place from part where not (p_partkey % 3 = 0 and p_partkey between 0 and 300) and not (p_partkey % 3 = 1 and p_partkey between 100 and 150) group by 1""",
    "api_pages": "select 'C' || n_nationkey currency, cast((1000000 + n_nationkey) / 1000000.0 as decimal(18,6)) rate, 'page-0000' || n_nationkey // 4 + 1 || '.json' page, n_nationkey % 4 place from nation",
    "api_cursor": "select 'D' || n_nationkey delivery_id, n_name order_id, 'R' || n_regionkey carrier, '2018-01-31 08:00' shipped, true under_way, 'page-0000' || n_nationkey // 7 + 1 || '.json' page from nation",
    "vendor_formats": """select 'partner-products' source, count(*) n, count(*) filter (p_partkey % 8 = 0) rejected, count(*) places, 0 broken from part union all select 'historical-orders', count(*), count(*) filter (o_orderkey % 5 = 0), count(*), 0 from orders
        union all select 'supplier-stock', count(*), count(*) filter (n_nationkey % 6 = 0), count(*), 0 from nation""",
    "compacted": "select event_type as partition, count(*) as rows, true was_candidate, true had_files, false is_candidate, 0 lost from events group by 1",
    "mutated": """select o_orderstatus, count(*) orders, cast(sum(n) as bigint) lines from (select o_orderkey, case when o_orderstatus = 'P' and o_orderkey % 3 = 0 then 'F' else o_orderstatus end o_orderstatus from orders where o_orderkey % 7 <> 0)
        full join (select l_orderkey, count(*) n from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderkey % 7 = 0) group by 1) on o_orderkey = l_orderkey group by 1""",
    "expired_snapshots": "select * from (values (1, false, null, null, 0), (2, true, 1, 'audit', 1), (3, false, null, null, 0), (4, false, null, null, 0), (5, true, 4, null, 1), (6, true, 5, 'main', 1)) t(snapshot_id, kept, parent_id, name, folders)",
    "published_sales": warehouse.ORACLE["mart_sales"],
    "published_aggregate": warehouse._BASE + "select order_date, region, round(sum(revenue)::double / 1e21, 6) revenue_eur, cast(sum(orders_count) as bigint) orders_count, cast(sum(items_sold) as bigint) items_sold from ms group by 1, 2",
    "published_states": warehouse._BASE + "select 'mart_daily_sales' mart, (select count(*) from ms) n union all select 'mart_customer_ltv', (select count(*) from ltv) union all select 'mart_marketing_roi', (select count(*) from roi) union all select 'mart_delivery_performance', (select count(*) from dp)",
    "order_states": warehouse._BASE + "select fo.order_id, order_status, payment_status, (select count(*) from sh where sh.order_id = fo.order_id) shipments from fo join fp on fp.order_id = fo.order_id",
    "scalars_pinned": """select event_id, json_extract_string(props, '$.k') k, cast(null as varchar) "inner", cast(strftime(ts, '%Y%m%d') as integer) date_key, cast(strftime(ts, '%Y%m') as integer) month_key, cast(isodow(ts) as integer) weekday,
        cast(trunc((epoch_us(ts) - epoch_us(timestamp '2024-01-01 00:00:30')) / 60000000) as bigint) whole_minutes, cast((event_id * 100 * 2 + 8) // 16 / 100.0 as decimal(12,2)) cents, round(1 / pow(event_id % 50 + 1, 0.7), 9) weight, event_id * 1000001 // 1000 at_us from events""",
    "check_freshness": "select '2024-01-01 00:00:00' checked_at, case when (select max(ts) from events) >= timestamp '2024-01-01 00:00:00' then 'pass' else 'error' end state union all select '2030-01-01 00:00:00', 'error'",
}
