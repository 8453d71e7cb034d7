"""Data checks: each returns the rows that violate it; none means it holds.

Generic checks take any DataFrame. ``all_checks`` states the rules of the retail
models with them; rules that compare models are written out.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import relational as R
from ..operators.segments import next_row
from ..sources.specs import CAPTURED, SPECS, TOPIC
from .models import realized


def unique(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def not_null(df: DataFrame, *columns: str, where: Column | None = None) -> DataFrame:
    rows = df if where is None else df.filter(where)
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull()
    return rows.filter(bad)


def accepted(df: DataFrame, column: str, *values) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*values))


def relationship(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    return R.orphans(child, parent, key, parent_key)


def fails(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is true (null is no violation)."""
    return df.filter(F.coalesce(condition, F.lit(False)))


def freshness(df: DataFrame, now: Column, warn_hours: int = 48, error_hours: int = 168, column: str = "_ingested_at") -> DataFrame:
    """One row: age in hours and pass, warn or error; an empty table is an error."""
    age = df.agg(((F.unix_timestamp(now) - F.unix_timestamp(F.max(column))) / 3600).alias("age_hours"))
    return age.withColumn("state", F.when(F.col("age_hours").isNull() | (F.col("age_hours") > error_hours), "error").when(F.col("age_hours") > warn_hours, "warn").otherwise("pass"))


def _tagged(parts: Mapping[str, DataFrame], key: str) -> DataFrame:
    out = None
    for name, df in parts.items():
        rows = df.select(F.lit(name).alias("model_name"), F.col(key if key in df.columns else df.columns[0]).cast("string").alias("row_key"))
        out = rows if out is None else out.unionByName(rows)
    return out


def non_negative(m: Mapping[str, DataFrame]) -> DataFrame:
    below = lambda df, *cs: fails(df, F.least(*[F.coalesce(F.col(c).cast("decimal(38,6)"), F.lit(0).cast("decimal(38,6)")) for c in (cs * 2)]) < 0)
    return _tagged({
        "fact_orders": below(m["fact_orders"], "order_total", "shipping_cost"),
        "fact_order_items": below(m["fact_order_items"], "quantity", "unit_price", "line_total"),
        "fact_payments": below(m["fact_payments"], "payment_amount"),
        "dim_campaign": below(m["dim_campaign"], "budget_eur", "spend_eur", "impressions", "clicks"),
        "int_fx_rates_daily": fails(m["int_fx_rates_daily"], F.col("rate") <= 0),
    }, "row_key")


def gold_is_complete(m: Mapping[str, DataFrame]) -> DataFrame:
    parts = []
    for entity, key in (("orders", "order_id"), ("payments", "payment_id")):
        live = m[f"int_cdc_{entity}_current"].select(F.col(key).alias("a"))
        gold = m[f"fact_{entity}"].select(F.col(key).alias("b"))
        parts.append(live.join(gold, F.col("a") == F.col("b"), "full").filter("a is null or b is null").select(F.coalesce("a", "b").alias("business_key"), F.lit(entity).alias("entity")))
    return parts[0].unionByName(parts[1])


def routes_valid(ledger: DataFrame) -> DataFrame:
    route = F.lit(False)
    for t in CAPTURED:
        route = route | ((F.col("source_table") == t) & (F.col("kafka_topic") == TOPIC.format(t)))
    return ledger.filter(~F.coalesce(route & (F.col("source_schema") == "public") & (F.col("kafka_partition") == 0), F.lit(False))).select("event_id")


def streamed_have_lsn(m: Mapping[str, DataFrame]) -> DataFrame:
    return _tagged({t: m[f"stg_cdc_{t}"].filter((F.col("operation") != "r") & F.col("source_lsn").isNull()).select("event_id") for t in CAPTURED}, "event_id")


def typed_fields_present(m: Mapping[str, DataFrame]) -> DataFrame:
    return _tagged({t: not_null(m[f"stg_cdc_{t}"], *SPECS[t].business.fieldNames(), where=F.col("operation") != "d").select("event_id") for t in CAPTURED}, "event_id")


def line_arithmetic(items: DataFrame) -> DataFrame:
    return fails(items, F.col("line_total") != F.col("quantity") * F.col("unit_price")).select("order_item_id")


def ltv_reconciles(m: Mapping[str, DataFrame], tolerance: float = 0.01) -> DataFrame:
    a = m["mart_customer_ltv"].agg(F.sum("orders_count").alias("mart_orders"), F.sum("gmv_eur").alias("mart_gmv"))
    rated = m["int_orders_fx"].filter("rate_to_eur is not null")
    b = rated.agg(F.count("*").alias("true_orders"), F.coalesce(F.sum(F.when(realized(), F.col("order_total_eur"))), F.lit(0)).alias("true_gmv"))
    return fails(a.crossJoin(b), (F.col("mart_orders") != F.col("true_orders")) | (F.abs(F.col("mart_gmv") - F.col("true_gmv")) > tolerance))  # one row each


def daily_revenue_reconciles(m: Mapping[str, DataFrame], tolerance: float = 0.01) -> DataFrame:
    a = m["mart_daily_sales"].groupBy(F.col("order_date").alias("d1")).agg(F.sum("revenue_eur").alias("mart_eur"))
    orders = R.gated(m["int_orders_fx"].filter(realized() & F.col("rate_to_eur").isNotNull()), m["fact_order_items"], "order_id", "order_id")
    b = orders.groupBy(F.to_date("created_at").alias("d2")).agg(F.sum((F.col("order_total") - F.col("shipping_cost")) / F.col("rate_to_eur")).alias("true_eur"))
    j = a.join(b, F.col("d1") == F.col("d2"), "full")
    return j.filter(F.col("d1").isNull() | F.col("d2").isNull() | (F.abs(F.col("mart_eur") - F.col("true_eur")) > tolerance))


def delivery_statuses_add_up(mart: DataFrame) -> DataFrame:
    known = sum((F.col(f"{s}_count") for s in ("in_transit", "delayed", "returned")), F.col("delivered_count"))
    return fails(mart, (known != F.col("delivery_count")) | F.coalesce(F.col("avg_transit_hours") < 0, F.lit(False)))


def marketing_in_range(mart: DataFrame) -> DataFrame:
    return fails(mart, (F.col("clicks") > F.col("impressions")) | (F.col("clicks") < 0) | (F.col("spend_eur") < 0) | F.coalesce(~F.col("ctr").between(1e-300, 1.0), F.lit(False)))


def rates_cover(orders_fx: DataFrame) -> DataFrame:
    return orders_fx.filter((F.col("currency") != "EUR") & F.col("rate_to_eur").isNull()).select("order_id", "currency")


#: Payment status that goes with an order status. Fixed values.
STATUS_PAIRS = {"pending": ["pending"], "paid": ["captured"], "shipped": ["captured"], "delivered": ["captured"], "refunded": ["refunded"], "cancelled": ["cancelled", "refunded"]}


def orders_match_payments(m: Mapping[str, DataFrame]) -> DataFrame:
    pay = m["fact_payments"].groupBy(F.col("order_id").alias("paid_id")).agg(F.count("*").alias("n"), F.max("payment_amount").alias("amount"), F.max("payment_status").alias("payment_status"))
    j = m["fact_orders"].join(pay, F.col("order_id") == F.col("paid_id"), "full")
    pair = F.lit(False)
    for status, fits in STATUS_PAIRS.items():
        pair = pair | ((F.col("order_status") == status) & F.col("payment_status").isin(*fits))
    good = F.col("order_id").isNotNull() & (F.col("n") == 1) & (F.col("amount") == F.col("order_total")) & pair
    return j.filter(~F.coalesce(good, F.lit(False))).select(F.coalesce("order_id", "paid_id").alias("order_id"), "order_status", "n", "amount", "payment_status")


def versions_do_not_overlap(dim: DataFrame) -> DataFrame:
    """Versions that end after the customer's next one starts, end before they
    start, lack a start, or are a second baseline."""
    base, start, end = F.col("is_snapshot_baseline"), F.col("valid_from_lsn"), F.col("valid_to_lsn")
    place = F.when(base, F.lit(-(2**63))).otherwise(F.coalesce(start, F.lit(-(2**63) + 1))).cast("bigint")
    same = dim.groupBy("customer_id", place.alias("place")).agg(F.count("*").alias("n"), F.max(F.coalesce(end, F.lit(2**63 - 1))).alias("ends"), F.max(F.struct("customer_key")).alias("v"))
    chain = next_row(same, "customer_id", "place", ["place"], "after")
    crossing = chain.filter((F.col("n") > 1) | (F.col("after.place") < F.col("ends"))).select("customer_id", F.col("v.customer_key").alias("customer_key"))
    alone = fails(dim, (base & start.isNotNull()) | (~base & start.isNull()) | F.coalesce(end <= start, F.lit(False))).select("customer_id", "customer_key")
    return crossing.unionByName(alone)


def one_current_version(m: Mapping[str, DataFrame]) -> DataFrame:
    is_open = F.col("valid_to_lsn").isNull()
    dim = m["dim_customer"].groupBy("customer_id").agg(F.count_if("is_current").alias("n"), F.count_if(F.col("is_current") != is_open).alias("mismatched"))
    live = m["int_cdc_customers_current"].select(F.col("customer_id").alias("live_id"))
    j = dim.join(live, F.col("customer_id") == F.col("live_id"), "full")
    reason = F.when(F.coalesce("mismatched", F.lit(0)) > 0, "flags disagree with ends").when(F.col("live_id").isNotNull() & (F.coalesce("n", F.lit(0)) != 1), "live without one current version").when(F.col("live_id").isNull() & (F.col("n") > 0), "current but deleted")
    return j.select(F.coalesce("customer_id", "live_id").alias("customer_id"), reason.alias("reason")).filter("reason is not null")


def times_in_order(m: Mapping[str, DataFrame]) -> DataFrame:
    o = m["fact_orders"].select("order_id", F.col("created_at").alias("ordered_at"))
    return _tagged({
        "fact_shipments": fails(m["fact_shipments"], F.col("shipped_at") > F.col("delivered_at")).select("shipment_id"),
        "fact_orders": fails(m["fact_orders"], F.col("created_at") > F.col("updated_at")).select("order_id"),
        "fact_payments": fails(m["fact_payments"].join(o, "order_id"), F.col("created_at") < F.col("ordered_at")).select("payment_id"),
        "dim_campaign": fails(m["dim_campaign"], F.col("end_date") < F.col("start_date")).select("campaign_id"),
    }, "id")


def all_checks(m: Mapping[str, DataFrame], ledger: DataFrame) -> dict[str, DataFrame]:
    """Every check of the retail models by name."""
    out = {
        "non_negative": non_negative(m),
        "gold_is_complete": gold_is_complete(m),
        "routes_valid": routes_valid(ledger),
        "coordinates_unique": unique(ledger, "kafka_topic", "kafka_partition", "kafka_offset"),
        "streamed_have_lsn": streamed_have_lsn(m),
        "typed_fields_present": typed_fields_present(m),
        "line_arithmetic": line_arithmetic(m["fact_order_items"]),
        "ltv_reconciles": ltv_reconciles(m),
        "daily_revenue_reconciles": daily_revenue_reconciles(m),
        "delivery_statuses_add_up": delivery_statuses_add_up(m["mart_delivery_performance"]),
        "marketing_in_range": marketing_in_range(m["mart_marketing_roi"]),
        "rates_cover": rates_cover(m["int_orders_fx"]),
        "orders_match_payments": orders_match_payments(m),
        "versions_do_not_overlap": versions_do_not_overlap(m["dim_customer"]),
        "one_current_version": one_current_version(m),
        "times_in_order": times_in_order(m),
    }
    for name, key in {"dim_customer": "customer_key", "dim_date": "date_key", "dim_product": "product_id", "dim_campaign": "campaign_id", "fact_orders": "order_id", "fact_order_items": "order_item_id", "fact_payments": "payment_id", "fact_shipments": "shipment_id", "mart_customer_ltv": "customer_id", "mart_marketing_roi": "campaign_id", "mart_delivery_performance": "carrier"}.items():
        out[f"unique_{name}"] = unique(m[name], key)
        out[f"not_null_{name}"] = not_null(m[name], key)
    out["accepted_channel"] = accepted(m["dim_campaign"], "channel", "search", "display", "social", "email", "video")
    out["accepted_campaign_status"] = accepted(m["dim_campaign"], "campaign_status", "active", "paused", "completed", "scheduled")
    out["accepted_order_status"] = accepted(m["fact_orders"], "order_status", *STATUS_PAIRS)
    out["product_of_items"] = relationship(m["fact_order_items"], "product_id", m["dim_product"], "product_id")
    out["version_of_orders"] = relationship(m["fact_orders"], "customer_key", m["dim_customer"], "customer_key")
    out["category_of_products"] = relationship(m["dim_product"], "category_id", m["int_categories"], "category_id")
    out["ctr_where_seen"] = not_null(m["mart_marketing_roi"], "ctr", "cpm_eur", where=F.col("impressions") > 0)
    return out


def violations(checks: Mapping[str, DataFrame]) -> dict[str, int]:
    """Names of the failed checks with their numbers of violating rows."""
    counts = {n: df.count() for n, df in checks.items()}
    return {n: c for n, c in counts.items() if c}
