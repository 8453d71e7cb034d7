import datetime as dt
import json

from pyspark.sql import functions as F

from tidewater.functions import scalars as S
from tidewater.ingest.archive import HadoopStore
from tidewater.operators import cdc_fold, deliveries, relational
from tidewater.runtime import new_dir
from tidewater.sources import generate, readers


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_scalars(spark):
    j = F.lit('{"a": "x", "n": 5, "o": {"b": 1}, "l": [1], "z": null, "s": "{no"}')
    assert one(spark, *[S.json_scalar(j, f"$.{k}") for k in "anolzs"]) == ("x", "5", None, None, None, "{no")
    ts = lambda s: F.lit(s).cast("timestamp")
    assert one(spark, S.complete_minutes(ts("2026-01-01 00:00:59"), ts("2026-01-01 00:01:58")), S.iso_weekday(F.lit("2026-09-20").cast("date"))) == (0, 7)
    assert one(spark, S.date_key(F.lit("2026-09-20").cast("date")), S.month_key(F.lit("2026-09-20").cast("date"))) == (20260920, 202609)
    none = F.lit(None).cast("bigint")
    got = one(spark, S.epoch_timestamp(F.lit(1_500_000_000_000_001_999), none, none), S.epoch_timestamp(none, F.lit(1_500_000_000_000_001), none), S.epoch_timestamp(none, none, F.lit(1_500_000_000_000)), S.epoch_timestamp(none, none, none))
    assert got[0] == got[1] and got[2].microsecond == 0 and got[3] is None
    assert one(spark, S.quantized(F.lit("1.005").cast("decimal(10,4)")).cast("string"), S.event_identity(F.lit("t"), none, F.lit(1))) == ("1.01", None)
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    assert df.agg(S.distinct_rows("a", "b"), S.filtered_sum(F.col("a"), F.col("a") > 5)).first()[:] == (2, 0)
    assert one(spark, F.round(S.power_weight(F.lit(1)), 6)) == (0.615572,)


def test_change_feed_through_the_operators(spark):
    feed = generate.change_feed(spark, 3_000, 100)
    assert sorted(feed.collect(), key=str) == sorted(generate.change_feed(spark, 3_000, 100, partitions=7).collect(), key=str)
    ids = feed.select("event_id").distinct().count()
    kept = deliveries.replay(feed, []).rows()
    assert ids == 3_000 and kept.count() == 3_000 and kept.agg(F.sum("copies")).first()[0] == feed.count() > 3_000
    typed = feed.select(F.get_json_object("key_json", "$.customer_id").cast("bigint").alias("customer_id"), "operation", "source_lsn", "kafka_offset", "event_id")
    window = relational.current_state(typed.distinct(), "customer_id").select("customer_id", "kafka_offset")
    folded = cdc_fold.live(cdc_fold.fold(feed)).select(F.col("entity_id").alias("customer_id"), "kafka_offset")
    assert window.exceptAll(folded).count() == 0 == folded.exceptAll(window).count()


def test_vendor_files_are_deterministic(spark):
    day, store = dt.date(2026, 9, 20), HadoopStore(spark, new_dir(spark, "vendor"))
    for source, contract in readers.CONTRACTS.items():
        data = generate.vendor_file(source, day, 20, bad=3)
        assert data == generate.vendor_file(source, day, 20, bad=3)
        store.put(source, data)
        rows = readers.read_vendor(spark, [store.path(source)], contract)
        assert rows.count() == 20 and readers.with_reasons(rows, contract).filter("reasons is not null").count() == 3
    page = generate.rate_page(day)
    assert page == generate.rate_page(day) and all(abs(r["rate"] / b - 1) <= 0.0201 for r, b in zip(page["rates"], (1.09, 0.85, 0.95)))
    assert json.dumps(page)


def test_operators_of_relations(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, 5, "b"), (2, 7, "c"), (None, 1, "d")], "k int, o int, v string")
    got = {r.k: r.v for r in relational.latest_by(df, ["k"], [F.col("o").desc_nulls_last()]).collect()}
    assert got == {1: "b", 2: "c", None: "d"}
    assert relational.orphans(df, df.filter("k = 1"), "k", "k").count() == 1 and relational.gated(df, df.filter("k = 1").limit(1), "k", "k").count() == 2
    assert relational.except_rows(df.union(df), df.filter("k = 1")).count() == 2
    page = relational.keyset_page(df, "o", "k", (5, 1), 5)
    assert [r.v for r in page.collect()] == ["c"]


def test_initial_load(spark):
    a, b = (generate.initial_load(spark, 50, 40, 2_000, partitions=p) for p in (2, 5))
    assert {n: df.count() for n, df in a.items()} == {"customers": 50, "products": 40, "orders": 2_000, "order_items": 2_000}
    for n in a:
        assert sorted(map(str, a[n].collect())) == sorted(map(str, b[n].collect()))
    lines = a["order_items"].join(a["products"].select("product_id", F.col("unit_price").alias("p")), "product_id")
    assert lines.filter("unit_price <> p or line_total <> quantity * p").count() == 0
    assert a["orders"].join(a["order_items"], "order_id").filter("order_total <> line_total + 4.90").count() == 0
    bought = {r.product_id: r["count"] for r in a["order_items"].groupBy("product_id").count().collect()}
    assert bought[0] > 3 * bought.get(20, 0) and len(bought) > 30  # power law
