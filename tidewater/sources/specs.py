"""Schemas of the raw, ledger and serving tables, as DDL text. Fixed values."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from pyspark.sql import types as T

SERVICE = "_batch_id string, _batch_date date, _source_object string, _source_object_row_position bigint, _ingested_at timestamp"
#: Topic of a captured table. Fixed value: that of the given ledger; the prefix
#: is a setting.
TOPIC = os.environ.get("TIDEWATER_TOPIC_PREFIX", "omni.oltp.public") + ".{}"
CAPTURED = ("customers", "orders", "payments")


_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType(), "double": T.DoubleType()}


def schema_of(columns: str) -> T.StructType:
    """StructType of "name type, ..." text; works without a session. Types
    outside the closed list are an error."""
    out = T.StructType()
    for name, kind in re.findall(r"(\w+) ([a-z]+(?:\(\d+,\d+\))?)", columns):
        m = re.fullmatch(r"decimal\((\d+),(\d+)\)", kind)
        if m is None and kind not in _TYPES:
            raise ValueError(f"{name}: type {kind}")
        out.add(name, T.DecimalType(*map(int, m.groups())) if m else _TYPES[kind])
    return out


@dataclass(frozen=True)
class Spec:
    """A raw table: where it comes from, its key and its business columns."""

    name: str
    kind: str  # postgres, api or file
    key: tuple[str, ...]
    columns: str
    source: str
    envelope: str | None = None

    def __post_init__(self) -> None:
        schema = self.business
        if self.kind not in {"postgres", "api", "file"}:
            raise ValueError(f"{self.name}: kind {self.kind}")
        if missing := set(self.key) - set(schema.fieldNames()):
            raise ValueError(f"{self.name}: key columns {sorted(missing)} are not columns")
        if (self.kind == "api") != (self.envelope is not None):
            raise ValueError(f"{self.name}: an envelope goes with API sources")

    @property
    def business(self) -> T.StructType:
        return schema_of(self.columns)

    @property
    def schema(self) -> T.StructType:
        return schema_of(f"{self.columns}, {SERVICE}")


_STAMPS = "created_at timestamp, updated_at timestamp"
_MONEY = "decimal(12,2)"
SPECS = {
    s.name: s
    for s in (
        Spec("categories", "postgres", ("category_id",), f"category_id bigint, name string, parent_category_id bigint, {_STAMPS}", "categories"),
        Spec("products", "postgres", ("product_id",), f"product_id bigint, sku string, name string, category_id bigint, brand string, unit_price {_MONEY}, unit_cost {_MONEY}, is_active boolean, {_STAMPS}", "products"),
        Spec("customers", "postgres", ("customer_id",), f"customer_id bigint, email string, first_name string, last_name string, region string, city string, status string, segment string, registered_at timestamp, {_STAMPS}", "customers"),
        Spec("orders", "postgres", ("order_id",), f"order_id bigint, customer_id bigint, status string, currency string, shipping_cost {_MONEY}, order_total {_MONEY}, {_STAMPS}", "orders"),
        Spec("order_items", "postgres", ("order_item_id",), f"order_item_id bigint, order_id bigint, product_id bigint, quantity bigint, unit_price {_MONEY}, line_total {_MONEY}, {_STAMPS}", "order_items"),
        Spec("payments", "postgres", ("payment_id",), f"payment_id bigint, order_id bigint, method string, status string, amount {_MONEY}, transaction_id string, {_STAMPS}", "payments"),
        Spec("shipments", "postgres", ("shipment_id",), f"shipment_id bigint, order_id bigint, carrier string, tracking_number string, status string, shipped_at timestamp, delivered_at timestamp, {_STAMPS}", "shipments"),
        Spec("fx_rates", "api", ("currency",), "currency string, rate decimal(18,6)", "fx-rates", "rates"),
        Spec("campaigns", "api", ("campaign_id",), f"campaign_id string, name string, channel string, status string, start_date date, end_date date, budget_eur {_MONEY}, spend_eur {_MONEY}, impressions bigint, clicks bigint", "marketing-campaigns", "campaigns"),
        Spec("deliveries", "api", ("delivery_id",), "delivery_id string, order_id string, carrier string, status string, shipped_at timestamp, delivered_at timestamp, updated_at timestamp", "deliveries", "deliveries"),
        Spec("supplier_prices", "file", ("supplier_id", "sku"), "supplier_id string, sku string, price decimal(12,2), currency string, valid_from date", "supplier-prices"),
        Spec("partner_products", "file", ("partner_id", "sku"), "partner_id string, sku string, title string, brand string, category string", "partner-products"),
        Spec("historical_orders", "file", ("order_id",), "order_id bigint, customer_id bigint, status string, order_total decimal(12,2), order_date date", "historical-orders"),
        Spec("supplier_stock", "file", ("supplier_id", "sku"), "supplier_id string, sku string, quantity bigint, updated_at date", "supplier-stock"),
    )
}

LEDGER = schema_of(
    "event_id string, kafka_topic string, kafka_partition int, kafka_offset bigint, kafka_timestamp timestamp, source_schema string, source_table string, operation string, source_lsn bigint, source_tx_id bigint, "
    "source_timestamp timestamp, key_json string, envelope_json string, before_json string, after_json string, event_date date, ingested_at timestamp"
)
