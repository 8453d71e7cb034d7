"""The analytical models as pure functions of their upstream models, and the
registry that builds them in dependency order.

Models of raw tables come in three shapes, each made by one function: the typed
projection of a snapshot table, its latest row per key, and the typed projection
of a change feed. The others are written out. A build hands out lazy DataFrames
of staging and intermediate models, and core models and marts as written once.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import complete_minutes, filtered_sum, json_scalar
from ..operators import relational as R
from ..operators.pit_asof import in_force
from ..runtime import cut
from ..sources.specs import CAPTURED, SPECS, TOPIC
from ..streaming.boundary import boundary_filter

NOT_REALIZED = ("cancelled", "refunded")


@dataclass(frozen=True)
class Model:
    name: str
    layer: str  # staging, intermediate, core, mart
    upstream: tuple[str, ...]
    make: Callable[..., DataFrame]


MODELS: dict[str, Model] = {}


def model(layer: str, *upstream: str, name: str | None = None):
    def add(make):
        n = name or make.__name__
        MODELS[n] = Model(n, layer, upstream, make)
        return make

    return add


# -- shapes ---------------------------------------------------------------


def snapshot_projection(table: str):
    names = [f.name for f in SPECS[table].business] + ["_batch_date", "_ingested_at"]
    return lambda raw: raw.select(*names)


def latest_snapshot(table: str):
    keys = list(SPECS[table].key)
    return lambda staged: R.latest_by(staged, keys, [F.col("_batch_date").desc(), F.col("_ingested_at").desc()]).drop("_batch_date", "_ingested_at")


def typed_changes(table: str):
    """Casts are strict (ANSI): a payload that doesn't fit fails the build. A
    delete keeps only its key, as its other old values need not be complete."""
    fields = [f for f in SPECS[table].business]
    key = SPECS[table].key[0]
    meta = ["operation", "event_id", "source_lsn", "source_tx_id", "source_timestamp", "kafka_topic", "kafka_partition", "kafka_offset", "kafka_timestamp", "ingested_at"]

    def make(ledger: DataFrame, boundary: Mapping | None = None) -> DataFrame:
        route = (F.col("source_schema") == "public") & (F.col("source_table") == table) & (F.col("kafka_topic") == TOPIC.format(table))
        rows = ledger.filter(route & boundary_filter(boundary, TOPIC.format(table)))
        gone = F.col("operation") == "d"
        values = [F.when(~gone, json_scalar(F.col("after_json"), f"$.{f.name}")).cast(f.dataType).alias(f.name) for f in fields if f.name != key]
        return rows.select(json_scalar(F.col("key_json"), f"$.{key}").cast("bigint").alias(key), *values, gone.alias("is_deleted"), *meta)

    return make


_SNAPSHOT_MODELS = ("campaigns", "categories", "customers", "deliveries", "fx_rates", "order_items", "orders", "payments", "products", "shipments")
for _t in _SNAPSHOT_MODELS:
    model("staging", f"bronze.{_t}", name=f"stg_{_t}")(snapshot_projection(_t))
    if _t != "fx_rates":
        model("intermediate", f"stg_{_t}", name=f"int_{_t}")(latest_snapshot(_t))
for _t in CAPTURED:
    model("staging", "bronze.postgres_cdc_events", "boundary", name=f"stg_cdc_{_t}")(typed_changes(_t))
    _k = SPECS[_t].key[0]
    model("intermediate", f"stg_cdc_{_t}", name=f"int_cdc_{_t}_current")(lambda events, k=_k: R.current_state(events, k).drop("is_deleted"))


# -- intermediate ---------------------------------------------------------


@model("intermediate", "stg_fx_rates")
def int_fx_rates_daily(rates):
    newest = R.latest_by(rates, ["currency", "_batch_date"], [F.col("_ingested_at").desc()])
    return newest.select("currency", F.col("_batch_date").alias("rate_date"), "rate")


@model("intermediate", "stg_cdc_customers")
def int_cdc_customer_versions(events):
    return R.scd2_versions(events, "customer_id", "customer_key").withColumnRenamed("status", "customer_status").drop("is_deleted")


@model("intermediate", "fact_orders", "int_fx_rates_daily")
def int_orders_fx(orders, rates):
    day = F.to_date("created_at")
    last = orders.agg(F.max(day).alias("__last"))  # one row: rates are carried up to it
    rated = R.asof_rate(orders, rates.crossJoin(F.broadcast(last)), day, F.coalesce("__last", "rate_date"))
    per_eur = lambda c: (F.col(c) / F.col("rate_to_eur")).alias(f"{c}_eur")
    return rated.select("order_id", "customer_id", "customer_key", "currency", "order_status", "order_total", "shipping_cost", "created_at", "rate_to_eur", per_eur("order_total"), per_eur("shipping_cost"))


# -- core -----------------------------------------------------------------


@model("core", "int_cdc_customer_versions")
def dim_customer(versions):
    return versions.drop("operation", "kafka_topic", "kafka_partition", "kafka_timestamp", "ingested_at")


@model("core", "int_cdc_orders_current", "stg_cdc_orders", "dim_customer")
def fact_orders(current, events, customers):
    """Current attributes; the customer version is the one in force when the
    order's current lifecycle started, and none if there was none."""
    starts = R.lifecycles(events, "order_id").select("order_id", "lifecycle_start_lsn", "is_snapshot_baseline")
    owned = cut(current.join(starts, "order_id", "left"), "owned")  # read several times
    customers = cut(customers.select("customer_key", "customer_id", "valid_from_lsn", "valid_to_lsn", "is_snapshot_baseline", "kafka_offset"), "versions")
    keys = in_force(owned.select("order_id", "customer_id", "lifecycle_start_lsn", "is_snapshot_baseline", "updated_at"), customers)
    return current.join(keys, "order_id", "left").select("order_id", "customer_key", "customer_id", F.col("status").alias("order_status"), "currency", "shipping_cost", "order_total", "created_at", "updated_at")


@model("core", "fact_orders")
def dim_date(orders):
    days = orders.select(F.explode(F.array(F.to_date("created_at"), F.to_date("updated_at"))).alias("day"))
    return R.calendar(F.min("day"), F.max("day"), days)


@model("core", "int_products", "int_categories")
def dim_product(products, categories):
    c = categories.select("category_id", F.col("name").alias("category_name"), "parent_category_id")
    p = categories.select(F.col("category_id").alias("parent_category_id"), F.col("name").alias("parent_category_name"))
    return products.join(c, "category_id").join(p, "parent_category_id", "left").select("product_id", "sku", F.col("name").alias("product_name"), "brand", "unit_price", "unit_cost", "is_active", "category_id", "category_name", "parent_category_id", "parent_category_name")


@model("core", "int_campaigns")
def dim_campaign(campaigns):
    return campaigns.withColumnsRenamed({"name": "campaign_name", "status": "campaign_status"})


@model("core", "int_order_items", "fact_orders")
def fact_order_items(items, orders):
    return R.gated(items, orders, "order_id", "order_id").drop("updated_at")


@model("core", "int_shipments", "fact_orders")
def fact_shipments(shipments, orders):
    return R.gated(shipments, orders, "order_id", "order_id").withColumnRenamed("status", "shipment_status").drop("updated_at")


@model("core", "int_cdc_payments_current")
def fact_payments(payments):
    return payments.select("payment_id", "order_id", F.col("method").alias("payment_method"), F.col("status").alias("payment_status"), F.col("amount").alias("payment_amount"), "transaction_id", "created_at")


# -- marts ----------------------------------------------------------------


def realized() -> Column:
    return ~F.col("order_status").isin(*NOT_REALIZED)


def sum_if(condition: Column, value: Column) -> Column:
    return filtered_sum(value, condition)


@model("mart", "fact_order_items", "int_orders_fx", "dim_product", "dim_customer", "dim_date")
def mart_daily_sales(items, orders, products, customers, dates):
    o = orders.select("order_id", "customer_key", "order_status", "rate_to_eur", F.to_date("created_at").alias("order_date"))
    rows = (
        items.select("order_id", "product_id", "quantity", "unit_price", "line_total")
        .join(o, "order_id")
        .join(products.select("product_id", "category_name", "unit_cost"), "product_id")
        .join(customers.select("customer_key", "region"), "customer_key")
        .join(dates.select("date_key", F.col("full_date").alias("order_date")), "order_date")
    )
    revenue = F.col("line_total") / F.col("rate_to_eur")
    margin = (F.col("unit_price") - F.col("unit_cost")) * F.col("quantity") / F.col("rate_to_eur")
    return rows.groupBy("date_key", "order_date", "category_name", "region").agg(
        F.count_distinct("order_id").alias("orders_count"), sum_if(realized(), F.col("quantity")).alias("items_sold"), sum_if(realized(), revenue).alias("revenue_eur"), sum_if(realized(), margin).alias("margin_eur")
    )


@model("mart", "int_orders_fx", "dim_customer")
def mart_customer_ltv(orders, customers):
    day = F.to_date("created_at")
    a = orders.groupBy("customer_id").agg(
        F.min(day).alias("first_order_date"), F.max(day).alias("last_order_date"), F.count("*").alias("orders_count"), F.count_if(realized()).alias("realized_count"), sum_if(realized(), F.col("order_total_eur")).alias("gmv_eur")
    )
    now = customers.filter("is_current").select("customer_id", "customer_key", "region", "segment")
    average = F.when(F.col("realized_count") > 0, F.col("gmv_eur") / F.col("realized_count"))
    return a.join(now, "customer_id").select("customer_id", "customer_key", "region", "segment", "first_order_date", "last_order_date", "orders_count", "gmv_eur", average.alias("avg_order_value_eur"))


@model("mart", "int_deliveries")
def mart_delivery_performance(deliveries):
    transit = complete_minutes(F.col("shipped_at"), F.col("delivered_at"))
    counts = [F.count_if(F.col("status") == s).alias(f"{s}_count") for s in ("delivered", "in_transit", "delayed", "returned")]
    return deliveries.groupBy("carrier").agg(F.count("*").alias("delivery_count"), *counts, (F.avg(transit) / 60.0).alias("avg_transit_hours"), F.max("updated_at").alias("last_update_at"))


@model("mart", "dim_campaign")
def mart_marketing_roi(campaigns):
    views, clicks = (F.nullif(F.col(c).cast("double"), F.lit(0.0)) for c in ("impressions", "clicks"))
    return campaigns.withColumns({
        "ctr": F.col("clicks").cast("double") / views,
        "cpc_eur": F.col("spend_eur").cast("double") / clicks,
        "cpm_eur": F.col("spend_eur").cast("double") * 1000 / views,
        "budget_utilization": F.when(F.col("budget_eur") != 0, F.col("spend_eur") / F.col("budget_eur")),
    })


def channel_kpis(roi: DataFrame) -> DataFrame:
    """Campaign figures by channel: ratios of sums, not means of ratios."""
    a = roi.groupBy("channel").agg(F.count("*").alias("campaigns"), *[F.sum(c).alias(c) for c in ("impressions", "clicks", "spend_eur", "budget_eur")])
    views, clicks = (F.nullif(F.col(c).cast("double"), F.lit(0.0)) for c in ("impressions", "clicks"))
    spend = F.col("spend_eur").cast("double")
    used = F.when(F.col("budget_eur") != 0, F.col("spend_eur") / F.col("budget_eur"))
    return a.withColumns({"ctr": F.col("clicks").cast("double") / views, "cpc_eur": spend / clicks, "cpm_eur": spend * 1000 / views, "budget_utilization": used})


# -- building --------------------------------------------------------------


def order_of_build(wanted: list[str] | None = None) -> list[str]:
    """Models in dependency order; a cycle or an unknown name is an error."""
    done: list[str] = []
    state: dict[str, int] = {}

    def visit(name: str) -> None:
        if name.startswith("bronze.") or name == "boundary" or state.get(name) == 2:
            return
        if name not in MODELS:
            raise KeyError(f"unknown model {name}")
        if state.get(name) == 1:
            raise ValueError(f"models depend on each other through {name}")
        state[name] = 1
        for u in MODELS[name].upstream:
            visit(u)
        state[name] = 2
        done.append(name)

    for name in wanted or MODELS:
        visit(name)
    return done


def build(bronze: Mapping[str, DataFrame], boundary: Mapping | None = None, wanted: list[str] | None = None, materialise: Callable[[str, DataFrame], DataFrame] | None = lambda name, df: cut(df, name)) -> dict[str, DataFrame]:
    """Every model (or those wanted with what they need) over the bronze tables.
    Core models and marts, which several others read, pass through
    ``materialise`` and are written once, unless that is None."""
    out: dict[str, DataFrame] = {}
    for name in order_of_build(wanted):
        m = MODELS[name]
        args = [boundary if u == "boundary" else bronze[u[7:]] if u.startswith("bronze.") else out[u] for u in m.upstream]
        df = m.make(*args)
        out[name] = materialise(name, df) if materialise and m.layer in ("core", "mart") else df
    return out
