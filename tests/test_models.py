import pytest
from pyspark.sql import functions as F

from tests import world
from tidewater.plans import checks
from tidewater.plans.models import MODELS, build, order_of_build
from tidewater.runtime import cut
from tidewater.streaming.boundary import TOPICS


@pytest.fixture(scope="module")
def built(spark):
    return build(world.bronze(spark), materialise=lambda name, df: cut(df, name))


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_forty_models_in_order():
    order = order_of_build()
    assert len(order) == len(MODELS) == 40
    assert all(order.index(u) < order.index(n) for n in order for u in MODELS[n].upstream if u in MODELS)


def test_customer_versions(built):
    d = built["dim_customer"]
    got = {(r.customer_id, r.valid_from_lsn): r for r in d.collect()}
    assert len([k for k in got if k[0] == 990001]) == 2
    assert got[990001, None].valid_to_lsn == 205 and got[990001, 205].region == "it-region-2" and got[990001, 205].is_current
    assert len([k for k in got if k[0] == 9910001]) == 3
    assert got[9910001, 200].segment == "vip" and got[9910001, 250].region == "cdc-later-version"
    assert got[9910002, None].valid_to_lsn == 201 and not got[9910002, None].is_current
    assert len([k for k in got if k[0] == 9910003]) == 2 and got[9910003, 204].region == "cdc-recreated"


def test_orders_keep_the_version_of_their_start(built):
    got = {r.order_id: r for r in built["fact_orders"].collect()}
    assert set(got) == {990001, 9920001}
    assert got[990001].customer_key == f"990001_{world.event_id('customers', 8)}"
    assert got[9920001].customer_key == f"9910001_{world.event_id('customers', 3)}"
    assert got[9920001].order_status == "paid"


def test_gates_and_dimensions(built):
    assert [built[n].count() for n in ("fact_order_items", "fact_shipments", "fact_payments")] == [2, 1, 2]
    assert rows(built["dim_date"], "date_key") == [(20260920,)]
    assert rows(built["dim_product"].filter("product_id = 910001"), "category_name", "parent_category_name") == [("it-leaf-cat", "it-root-cat")]
    assert built["dim_campaign"].count() == 1
    assert built["int_fx_rates_daily"].filter("currency = 'USD'").count() == 2
    assert rows(built["mart_delivery_performance"], "delivered_count", "in_transit_count", "avg_transit_hours") == [(1, 0, 18.5)]


def test_money_is_exact(built):
    s = {r.category_name: r for r in built["mart_daily_sales"].collect()}
    assert str(s["it-leaf-cat"].revenue_eur) == "45.821114369501466275660" and str(s["it-leaf-cat"].margin_eur) == "18.328446"
    assert str(s["it-root-cat"].revenue_eur) == "36.656891495601173020528" and s["it-root-cat"].items_sold == 1
    t = {r.customer_id: r for r in built["mart_customer_ltv"].collect()}
    assert set(t) == {990001, 9910001}
    assert str(t[990001].gmv_eur) == "85.227272727272727272727" and t[990001].segment == "vip"
    assert str(t[9910001].gmv_eur) == "38.947947214076246334311" and t[9910001].region == "cdc-later-version"
    kinds = dict(built["mart_daily_sales"].dtypes) | dict(built["mart_customer_ltv"].dtypes) | dict(built["mart_marketing_roi"].dtypes)
    assert (kinds["revenue_eur"], kinds["margin_eur"], kinds["gmv_eur"], kinds["avg_order_value_eur"], kinds["budget_utilization"]) == ("decimal(38,21)", "decimal(38,6)", "decimal(38,21)", "decimal(38,21)", "decimal(27,15)")


def test_checks_hold_and_find(built, spark):
    ledger = world.ledger(spark)
    # the fixture's LTV world and payments are whole, so every check holds
    assert checks.violations(checks.all_checks(built, ledger)) == {}
    bad = dict(built)
    bad["fact_orders"] = built["fact_orders"].withColumn("order_total", -F.col("order_total"))
    bad["dim_customer"] = built["dim_customer"].withColumn("is_current", F.lit(True)).withColumn("valid_to_lsn", F.lit(1).cast("bigint"))
    bad["fact_order_items"] = built["fact_order_items"].withColumn("line_total", F.col("line_total") + 1).withColumn("product_id", F.lit(5).cast("bigint"))
    bad["mart_marketing_roi"] = built["mart_marketing_roi"].withColumn("clicks", F.lit(10**9))
    broken = ledger.unionByName(ledger.limit(1)).withColumn("kafka_partition", F.lit(1))
    found = checks.violations({k: v for k, v in checks.all_checks(bad, broken).items() if k in {"non_negative", "one_current_version", "versions_do_not_overlap", "line_arithmetic", "product_of_items", "marketing_in_range", "routes_valid", "coordinates_unique", "orders_match_payments"}})
    assert len(found) == 9, found


def test_boundary_stops_the_build(spark):
    boundary = {t: {"partition": 0, "offset_exclusive": 1} for t in TOPICS}
    out = build(world.bronze(spark), boundary, ["int_cdc_orders_current", "dim_customer"])
    assert rows(out["int_cdc_orders_current"], "order_id", "status") == [(9920001, "pending")]
    assert out["dim_customer"].count() == 1


def test_empty_world(spark):
    empty = {k: v.limit(0) for k, v in world.bronze(spark).items()}
    out = build(empty)
    assert all(out[n].count() == 0 for n in ("dim_date", "fact_orders", "mart_daily_sales", "mart_customer_ltv"))


def test_freshness(spark):
    b = world.bronze(spark)["orders"]
    for now, state in (("2026-09-22", "pass"), ("2026-09-25", "warn"), ("2026-10-25", "error")):
        assert checks.freshness(b, F.lit(now).cast("timestamp")).first().state == state
    assert checks.freshness(b.limit(0), F.current_timestamp()).first().state == "error"
