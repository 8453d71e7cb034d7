"""The retail models and their checks over the driver's tables, with SQL.

The change ledger is the real input of the captured tables: it is delivered
exactly once by the operator of problem 1 and goes through the models as it is.
The other raw tables are projections of the star schema in two daily batches, of
which the second holds changed rows again. Their SQL is the same text for both
engines; what the models make of them is written anew for the oracle, money in
whole units of its last digit, so every digit of a decimal is compared.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import deliveries
from ..runtime import cut
from ..sources.specs import LEDGER, SPECS
from . import checks, models
from .problems import _MESSAGES, table

_LINES = "from (select l_orderkey, l_linenumber, max(l_partkey) l_partkey, max(l_suppkey) l_suppkey, max(l_quantity) l_quantity, max(l_shipdate) l_shipdate from lineitem group by 1, 2) x"

#: Raw tables as projections; {b} is 0 for the first daily batch, 1 for the second.
_RAW = {
    "order_items": """select cast(l_orderkey * 10 + l_linenumber as bigint) order_item_id, cast(50000000 + l_orderkey % 6000 as bigint) order_id, cast(l_partkey as bigint) product_id,
        cast(l_quantity + {b} as bigint) quantity, cast(l_partkey % 1000 + 0.99 as decimal(12,2)) unit_price, cast(cast(l_quantity + {b} as bigint) * (l_partkey % 1000 + 0.99) as decimal(12,2)) line_total,
        l_shipdate created_at, l_shipdate updated_at {lines} where {b} = 0 or l_orderkey % 3 = 0""",
    "products": """select p_partkey product_id, concat('S', p_partkey) sku, p_name name, cast(100 + p_size as bigint) category_id, p_brand brand,
        cast(p_partkey % 1000 + 0.99 as decimal(12,2)) unit_price, cast(floor((p_partkey % 1000) / 2.0) + 0.25 as decimal(12,2)) unit_cost, p_partkey % 7 > {b} is_active,
        timestamp '2018-01-01 00:00:00' created_at, timestamp '2018-01-01 00:00:00' updated_at from part where {b} = 0 or p_partkey % 5 = 0""",
    "categories": """select category_id, name, parent_category_id, timestamp '2018-01-01 00:00:00' created_at, timestamp '2018-01-01 00:00:00' updated_at from (
        select cast(100 + p_size as bigint) category_id, concat('leaf ', p_size, ' of {b}') name, cast(p_size % 5 as bigint) parent_category_id from part
        union select cast(p_size % 5 as bigint), concat('root ', p_size % 5), cast(null as bigint) from part) x where {b} = 0 or category_id % 2 = 0""",
    "shipments": """select cast(l_orderkey * 10 + l_linenumber as bigint) shipment_id, cast(50000000 + l_orderkey % 6000 as bigint) order_id, concat('carrier ', l_suppkey % 4) carrier, concat('T', l_partkey) tracking_number,
        case when {b} = 1 then 'delivered' when l_suppkey % 3 = 0 then 'shipped' else 'delivered' end status, l_shipdate shipped_at, l_shipdate delivered_at, l_shipdate created_at, l_shipdate updated_at
        {lines} where l_linenumber = 2 and ({b} = 0 or l_orderkey % 4 = 0)""",
    "fx_rates": "select currency, cast((1050000 + {b} * 3000 + length(currency)) / 1000000.0 as decimal(18,6)) rate from (select 'USD' currency union all select 'GBP') x",
    "campaigns": """select concat('CMP-', s_suppkey) campaign_id, s_name name, case s_suppkey % 5 when 0 then 'search' when 1 then 'display' when 2 then 'social' when 3 then 'email' else 'video' end channel,
        case when {b} = 1 then 'completed' else 'active' end status, date '2018-01-01' start_date, date '2018-02-01' end_date, cast(s_suppkey % 50 * 100 as decimal(12,2)) budget_eur, cast(s_suppkey % 90 * 10 + {b} as decimal(12,2)) spend_eur,
        cast(s_suppkey % 11 * 1000 as bigint) impressions, cast(s_suppkey % 11 * (s_suppkey % 40) as bigint) clicks from supplier where {b} = 0 or s_suppkey % 2 = 0""",
    "deliveries": """select concat('D', l_orderkey) delivery_id, cast(l_orderkey as varchar(20)) order_id, concat('carrier ', l_suppkey % 4) carrier,
        case when {b} = 1 then 'delivered' when l_partkey % 4 = 0 then 'in_transit' when l_partkey % 4 = 1 then 'delayed' when l_partkey % 4 = 2 then 'returned' else 'delivered' end status,
        l_shipdate shipped_at, case when {b} = 1 or l_partkey % 4 = 3 then l_shipdate + (l_partkey % 90) * interval '7' minute end delivered_at, l_shipdate updated_at {lines} where l_linenumber = 1 and ({b} = 0 or l_orderkey % 5 = 0)""",
    "customers": """select c_custkey customer_id, concat(c_custkey, '@example.test') email, 'A' first_name, 'B' last_name, concat('nation ', c_nationkey) region, 'c' city, case when {b} = 1 then 'inactive' else 'active' end status, lower(c_mktsegment) segment,
        timestamp '2017-01-01 00:00:00' registered_at, timestamp '2017-01-01 00:00:00' created_at, timestamp '2017-01-01 00:00:00' updated_at from customer where {b} = 0 or c_custkey % 6 = 0""",
    "orders": """select o_orderkey order_id, o_custkey customer_id, case when {b} = 1 then 'delivered' else 'paid' end status, 'EUR' currency, cast(5 as decimal(12,2)) shipping_cost, cast(o_orderkey % 900 + 10 as decimal(12,2)) order_total,
        o_orderdate created_at, o_orderdate updated_at from orders where {b} = 0 or o_orderkey % 6 = 0""",
    "payments": """select o_orderkey payment_id, o_orderkey order_id, 'card' method, case when {b} = 1 then 'captured' else 'pending' end status, cast(o_orderkey % 900 + 10 as decimal(12,2)) amount, concat('X', o_orderkey) transaction_id,
        o_orderdate created_at, o_orderdate updated_at from orders where {b} = 0 or o_orderkey % 6 = 0""",
}
_BATCH_DATES = ("2018-01-01", "2018-01-16")


def _raw_sql(name: str, batch: int) -> str:
    return _RAW[name].format(b=batch, lines=_LINES)


def ledger(spark, d) -> DataFrame:
    """The change ledger with each message once and its id filled in."""
    kept = deliveries.replay(table(spark, d, "postgres_cdc_events")).rows()
    return kept.select("event_id", *[F.col(f"row.{f.name}").cast(f.dataType).alias(f.name) for f in LEDGER if f.name != "event_id"])


def raw_rows(spark, d, name: str, batch: int) -> DataFrame:
    """Business rows of one daily batch of a raw table."""
    sql, used = _raw_sql(name, batch), {}
    for t in ("lineitem", "part", "supplier", "customer", "orders"):
        if re.search(rf"from {t}\b", sql):
            used[t] = table(spark, d, t)
            sql = re.sub(rf"from {t}\b", f"from {{{t}}}", sql)
    rows = spark.sql(sql, **used)
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SPECS[name].business])


def bronze(spark, d) -> dict[str, DataFrame]:
    out = {"postgres_cdc_events": cut(ledger(spark, d), "ledger")}
    for name in _RAW:
        parts = []
        for b, day in enumerate(_BATCH_DATES):
            service = {"_batch_id": F.lit(f"{name}-{b}"), "_batch_date": F.lit(day).cast("date"), "_source_object": F.lit(name), "_source_object_row_position": F.monotonically_increasing_id(), "_ingested_at": F.lit(f"{day} 01:00:00").cast("timestamp")}
            parts.append(raw_rows(spark, d, name, b).withColumns(service))
        out[name] = parts[0].unionByName(parts[1])
    return out


_BUILT: dict[tuple, dict[str, DataFrame]] = {}


def built(spark, d) -> dict[str, DataFrame]:
    """All models over ``d``; core models and marts are written once a session,
    as a refresh publishes them once for all who read them."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _BUILT:
        raw = bronze(spark, d)
        _BUILT[key] = {"ledger": raw["postgres_cdc_events"], **models.build(raw)}
    return _BUILT[key]


def _us(c: str):
    return F.unix_micros(c).alias(f"{c}_us")


def _text(c: str):
    """All digits of a decimal, however a session writes zero."""
    return F.when(F.col(c) == 0, "0").otherwise(F.col(c).cast("string")).alias(c)


# -- models -------------------------------------------------------------------


def model_changes(spark, d):
    """The typed changes of the captured orders."""
    return built(spark, d)["stg_cdc_orders"].select("order_id", "customer_id", "status", "currency", "shipping_cost", "order_total", _us("created_at"), "is_deleted", "operation", "event_id", "source_lsn", "kafka_offset")


def model_payments(spark, d):
    return built(spark, d)["fact_payments"].select("payment_id", "order_id", "payment_method", "payment_status", "payment_amount", _us("created_at"))


def model_customers(spark, d):
    """Versions of customers with their half-open periods."""
    return built(spark, d)["dim_customer"].select("customer_key", "customer_id", "email", "region", "city", "customer_status", "segment", "valid_from_lsn", "valid_to_lsn", "is_snapshot_baseline", "is_current", _us("opened_at_source_timestamp"), _us("closed_at_source_timestamp"))


def model_orders(spark, d):
    """Orders with the customer version frozen at the start of their lifecycle."""
    return built(spark, d)["fact_orders"].select("order_id", "customer_key", "customer_id", "order_status", "currency", "shipping_cost", "order_total", _us("created_at"))


def model_orders_fx(spark, d):
    return built(spark, d)["int_orders_fx"].select("order_id", _text("rate_to_eur"), _text("order_total_eur"), _text("shipping_cost_eur"))


def model_products(spark, d):
    return built(spark, d)["dim_product"].select("product_id", "sku", "unit_price", "is_active", "category_id", "category_name", "parent_category_id", "parent_category_name")


def model_items(spark, d):
    return built(spark, d)["fact_order_items"].select("order_item_id", "order_id", "product_id", "quantity", "unit_price", "line_total")


def model_shipments(spark, d):
    return built(spark, d)["fact_shipments"].select("shipment_id", "order_id", "carrier", "shipment_status")


def model_dates(spark, d):
    return built(spark, d)["dim_date"].select("date_key", "day_of_week", "month_name", "is_weekend")


def mart_sales(spark, d):
    """Daily sales by frozen version's region, to the last digit of the decimals."""
    return built(spark, d)["mart_daily_sales"].select("date_key", "category_name", "region", "orders_count", "items_sold", _text("revenue_eur"), _text("margin_eur"))


def mart_ltv(spark, d):
    """Lifetime value by the customer's current version."""
    return built(spark, d)["mart_customer_ltv"].select("customer_id", "customer_key", "region", "segment", "first_order_date", "orders_count", _text("gmv_eur"), _text("avg_order_value_eur"))


def mart_deliveries(spark, d):
    m = built(spark, d)["mart_delivery_performance"]
    return m.select("carrier", "delivery_count", "delivered_count", "in_transit_count", "delayed_count", "returned_count", F.round("avg_transit_hours", 6).alias("avg_transit_hours"))


def mart_campaigns(spark, d):
    m = built(spark, d)["mart_marketing_roi"]
    return m.select("campaign_id", "campaign_status", F.round("ctr", 9).alias("ctr"), F.round("cpc_eur", 9).alias("cpc_eur"), F.round("cpm_eur", 9).alias("cpm_eur"), _text("budget_utilization"))


def channel_spend(spark, d):
    """Campaign figures by channel, ratios of sums."""
    m = models.channel_kpis(built(spark, d)["mart_marketing_roi"])
    return m.select("channel", "campaigns", "impressions", "clicks", "spend_eur", *[F.round(c, 9).alias(c) for c in ("ctr", "cpc_eur", "cpm_eur")], _text("budget_utilization"))


def model_latest(spark, d):
    """Latest row per key of the snapshots of the captured tables, by status."""
    m = built(spark, d)
    parts = [m[f"int_{t}"].groupBy("status").agg(F.count("*").alias("n")).select(F.lit(t).alias("model"), "status", "n") for t in ("customers", "orders", "payments")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# -- checks, on models with planted faults ---------------------------------------


def broken(spark, d) -> dict[str, DataFrame]:
    """The models with faults in them, by the same rules as in the SQL."""
    m, nth = dict(built(spark, d)), lambda c, k: F.col(c) % k == 0
    bad = lambda name, column, rule, value: m.__setitem__(name, m[name].withColumn(column, F.when(rule, value).otherwise(F.col(column)).cast(dict(m[name].dtypes)[column]).alias(column)))
    bad("fact_orders", "order_total", nth("order_id", 17), -F.col("order_total"))
    bad("fact_orders", "customer_key", nth("order_id", 19), F.lit("nobody"))
    bad("fact_orders", "order_status", nth("order_id", 23), F.lit("odd"))
    m["fact_orders"] = m["fact_orders"].filter(F.col("order_id") % 29 != 0)
    bad("fact_order_items", "line_total", nth("order_item_id", 13), F.col("line_total") + 1)
    bad("fact_order_items", "product_id", nth("order_item_id", 11), F.lit(-1))
    bad("fact_shipments", "shipped_at", nth("shipment_id", 7), F.col("shipped_at") + F.expr("interval 1 day"))
    bad("dim_customer", "valid_to_lsn", nth("customer_id", 7), F.col("valid_to_lsn") + 10**10)
    bad("dim_customer", "is_current", nth("customer_id", 11), F.lit(True))
    m["dim_customer"] = m["dim_customer"].unionByName(m["dim_customer"].filter((F.col("customer_id") % 13 == 0) & F.col("is_current")))
    bad("dim_campaign", "campaign_status", F.col("campaign_id").endswith("3"), F.lit("unknown"))
    bad("mart_marketing_roi", "clicks", F.col("campaign_id").endswith("7"), F.col("impressions") + 1)
    bad("mart_marketing_roi", "ctr", F.col("campaign_id").endswith("4"), F.lit(None))
    bad("mart_delivery_performance", "delivered_count", F.col("carrier") == "carrier 1", F.col("delivered_count") + 1)
    bad("int_orders_fx", "rate_to_eur", nth("order_id", 31), F.lit(None))
    bad("mart_customer_ltv", "gmv_eur", nth("customer_id", 5), F.col("gmv_eur") + 1)
    bad("mart_daily_sales", "revenue_eur", F.col("date_key") % 3 == 0, F.col("revenue_eur") + 5)
    for t, column in (("orders", "order_id"), ("payments", "payment_id"), ("customers", "customer_id")):
        bad(f"stg_cdc_{t}", "source_lsn", nth("kafka_offset", 37), F.lit(None))
        bad(f"stg_cdc_{t}", "created_at", nth("kafka_offset", 41), F.lit(None))
    return m


def _check(name: str, make, keys: list[str]):
    def run(spark, d):
        rows = make(broken(spark, d)) if make else checks.all_checks(broken(spark, d), table(spark, d, "postgres_cdc_events"))[name]
        return rows.select(*[F.col(k).cast("string").alias(k) for k in keys])

    run.__doc__ = f"Rows that violate the check {name} on models with planted faults."
    return run


#: check -> columns of the rows it returns
_CHECKED = {
    "non_negative": ["model_name", "row_key"], "gold_is_complete": ["business_key", "entity"], "routes_valid": ["event_id"], "coordinates_unique": ["kafka_topic", "kafka_partition", "kafka_offset", "n"],
    "streamed_have_lsn": ["model_name", "row_key"], "typed_fields_present": ["model_name", "row_key"], "line_arithmetic": ["order_item_id"], "ltv_reconciles": ["mart_orders", "true_orders"], "daily_revenue_reconciles": ["d1", "d2"],
    "delivery_statuses_add_up": ["carrier"], "marketing_in_range": ["campaign_id"], "rates_cover": ["order_id", "currency"], "orders_match_payments": ["order_id", "n", "payment_status"], "versions_do_not_overlap": ["customer_id"],
    "one_current_version": ["customer_id", "reason"], "times_in_order": ["model_name", "row_key"], "unique_dim_customer": ["customer_key", "n"], "accepted_campaign_status": ["campaign_id"], "accepted_order_status": ["order_id"],
    "product_of_items": ["order_item_id"], "version_of_orders": ["order_id"], "ctr_where_seen": ["campaign_id"],
}

QUERIES = {f.__name__: f for f in (model_changes, model_payments, model_customers, model_orders, model_orders_fx, model_products, model_items, model_shipments, model_dates, model_latest, mart_sales, mart_ltv, mart_deliveries, mart_campaigns, channel_spend)}
QUERIES |= {f"check_{name}": _check(name, None, keys) for name, keys in _CHECKED.items()}

# -- the same in SQL ------------------------------------------------------------


def _latest(name: str, key: str) -> str:
    first, second = (_raw_sql(name, b) for b in (0, 1))
    return f"select * from ({second}) union all select * from ({first}) where {key} not in (select {key} from ({second}))"


def _changes_sql(t: str, key: str, fields: dict[str, str]) -> str:
    get = lambda n, kind: f"case when operation <> 'd' then cast(json_extract_string(after_json, '$.{n}') as {kind}) end {n}"
    return f"""select cast(json_extract_string(key_json, '$.{key}') as bigint) {key}, {', '.join(get(n, k) for n, k in fields.items())}, operation = 'd' is_deleted, operation, mid event_id, source_lsn, source_timestamp, kafka_offset,
        operation = 'r' base, case when operation <> 'r' then source_lsn end blsn from led where source_table = '{t}'"""


def _current_sql(source: str, key: str) -> str:
    return f"select * from (select *, row_number() over (partition by {key} order by base, source_lsn desc nulls last, kafka_offset desc) crn from {source}) where crn = 1 and operation <> 'd'"


def _digits(whole: str, scale: int) -> str:
    """Text of a decimal that is given in units of its last digit."""
    one = f"({10**scale}::hugeint)"
    return f"case when {whole} = 0 then '0' else (case when {whole} < 0 then '-' else '' end) || (abs({whole}) // {one})::varchar || '.' || lpad((abs({whole}) % {one})::varchar, {scale}, '0') end"


def _over(a: str, b: str) -> str:
    """a / b in whole numbers, half up; both positive."""
    return f"((2 * ({a})::hugeint + ({b})::hugeint) // (2 * ({b})::hugeint))"


_E4, _E10, _E15, _E25 = (f"{10**n}::hugeint" for n in (4, 10, 15, 25))
_REAL = "order_status not in ('cancelled', 'refunded')"
_BASE = f"""
with led as (select * exclude (rn) from (select *, row_number() over (partition by mid order by ingested_at) rn from ({_MESSAGES})) where rn = 1),
so as ({_changes_sql("orders", "order_id", {"customer_id": "bigint", "status": "varchar", "currency": "varchar", "shipping_cost": "decimal(12,2)", "order_total": "decimal(12,2)", "created_at": "timestamptz", "updated_at": "timestamptz"})}),
sp as ({_changes_sql("payments", "payment_id", {"order_id": "bigint", "method": "varchar", "status": "varchar", "amount": "decimal(12,2)", "transaction_id": "varchar", "created_at": "timestamptz", "updated_at": "timestamptz"})}),
sc as ({_changes_sql("customers", "customer_id", {"email": "varchar", "first_name": "varchar", "last_name": "varchar", "region": "varchar", "city": "varchar", "status": "varchar", "segment": "varchar", "registered_at": "timestamptz", "created_at": "timestamptz", "updated_at": "timestamptz"})}),
co as ({_current_sql("so", "order_id")}), cp as ({_current_sql("sp", "payment_id")}), cc as ({_current_sql("sc", "customer_id")}),
wc as (select *, row_number() over (partition by customer_id, base, blsn order by kafka_offset desc) rn from sc),
vc as (select *, lead(source_lsn) over q next_lsn, lead(source_timestamp) over q next_at, lead(event_id) over q next_id from wc where rn = 1 window q as (partition by customer_id order by base desc, source_lsn nulls first)),
dc as (select customer_id || '_' || event_id customer_key, customer_id, email, region, city, status customer_status, segment, case when not base then source_lsn end valid_from_lsn, next_lsn valid_to_lsn, base is_snapshot_baseline, next_id is null is_current,
    source_timestamp opened_at, next_at closed_at from vc where operation <> 'd'),
wo as (select *, row_number() over (partition by order_id, base, blsn order by kafka_offset desc) rn, count(*) filter (operation = 'c') over (partition by order_id, base, blsn) creates from so),
lo as (select order_id, base born_base, source_lsn born from (select *, row_number() over (partition by order_id order by base, source_lsn desc nulls last, kafka_offset desc) lrn from wo where rn = 1 and operation <> 'd' and (base or creates > 0)) where lrn = 1),
fo as (select co.order_id, dc.customer_key, co.customer_id, co.status order_status, co.currency, co.shipping_cost, co.order_total, co.created_at, co.updated_at from co left join lo on lo.order_id = co.order_id
    left join dc on dc.customer_id = co.customer_id and case when lo.born_base then dc.is_snapshot_baseline else (dc.is_snapshot_baseline or dc.valid_from_lsn <= lo.born) and (dc.valid_to_lsn is null or dc.valid_to_lsn > lo.born) end),
fp as (select payment_id, order_id, method payment_method, status payment_status, amount payment_amount, created_at from cp),
fx as (select fo.*, case when currency = 'EUR' then 1000000 when currency in ('USD', 'GBP') then case when cast(created_at as date) < date '2018-01-16' then 1050003 else 1053003 end end rm from fo),
oi as (select * from ({_latest("order_items", "order_item_id")}) where order_id in (select order_id from fo)),
sh as (select * from ({_latest("shipments", "shipment_id")}) where order_id in (select order_id from fo)),
cat as ({_latest("categories", "category_id")}),
pr as (select p.*, c.name category_name, c.parent_category_id, q.name parent_category_name from ({_latest("products", "product_id")}) p join cat c on c.category_id = p.category_id left join cat q on q.category_id = c.parent_category_id),
ca as ({_latest("campaigns", "campaign_id")}),
roi as (select *, clicks::double / nullif(impressions, 0) ctr, spend_eur::double / nullif(clicks, 0) cpc_eur, spend_eur::double * 1000 / nullif(impressions, 0) cpm_eur from ca),
de as ({_latest("deliveries", "delivery_id")}),
dp as (select carrier, count(*) delivery_count, count(*) filter (status = 'delivered') delivered_count, count(*) filter (status = 'in_transit') in_transit_count, count(*) filter (status = 'delayed') delayed_count, count(*) filter (status = 'returned') returned_count,
    avg(date_sub('minute', shipped_at, delivered_at)) / 60.0 avg_transit_hours from de group by 1),
dd as (select unnest(generate_series(a, b, interval 1 day))::date dy from (select least(min(cast(created_at as date)), min(cast(updated_at as date))) a, greatest(max(cast(created_at as date)), max(cast(updated_at as date))) b from fo)),
sl as (select cast(fx.created_at as date) dy, pr.category_name, dc.region, fx.order_id, fx.order_status, oi.quantity, {_over(f"cast(oi.line_total * 100 as hugeint) * {_E25}", "fx.rm")} rev,
    {_over(f"cast((oi.unit_price - pr.unit_cost) * 100 as hugeint) * oi.quantity * {_E10}", "fx.rm")} mar from oi join fx using (order_id) join pr using (product_id) join dc on dc.customer_key = fx.customer_key),
ms as (select cast(strftime(dy, '%Y%m%d') as integer) date_key, dy order_date, category_name, region, count(distinct order_id) orders_count, cast(coalesce(sum(quantity) filter ({_REAL}), 0) as bigint) items_sold,
    coalesce(sum(rev) filter ({_REAL}), 0)::hugeint revenue, coalesce(sum(mar) filter ({_REAL}), 0)::hugeint margin from sl group by dy, category_name, region),
lt as (select customer_id, min(cast(created_at as date)) first_order_date, count(*) orders_count, count(*) filter ({_REAL}) realized, coalesce(sum({_over(f"cast(order_total * 100 as hugeint) * {_E25}", "rm")}) filter ({_REAL}), 0)::hugeint gmv from fx group by 1),
ltv as (select lt.*, dc.customer_key, dc.region, dc.segment from lt join dc on dc.customer_id = lt.customer_id and dc.is_current)
"""


def _rows(select: str) -> str:
    return _BASE + select


_SQL = {
    "model_changes": "select order_id, customer_id, status, currency, shipping_cost, order_total, epoch_us(created_at) created_at_us, is_deleted, operation, event_id, source_lsn, kafka_offset from so",
    "model_payments": "select payment_id, order_id, payment_method, payment_status, payment_amount, epoch_us(created_at) created_at_us from fp",
    "model_customers": "select customer_key, customer_id, email, region, city, customer_status, segment, valid_from_lsn, valid_to_lsn, is_snapshot_baseline, is_current, epoch_us(opened_at) opened_at_source_timestamp_us, epoch_us(closed_at) closed_at_source_timestamp_us from dc",
    "model_orders": "select order_id, customer_key, customer_id, order_status, currency, shipping_cost, order_total, epoch_us(created_at) created_at_us from fo",
    "model_orders_fx": f"select order_id, {_digits('rm', 6)} rate_to_eur, {_digits(_over(f'cast(order_total * 100 as hugeint) * {_E25}', 'rm'), 21)} order_total_eur, {_digits(_over(f'cast(shipping_cost * 100 as hugeint) * {_E25}', 'rm'), 21)} shipping_cost_eur from fx",
    "model_products": "select product_id, sku, unit_price, is_active, category_id, category_name, parent_category_id, parent_category_name from pr",
    "model_items": "select order_item_id, order_id, product_id, quantity, unit_price, line_total from oi",
    "model_shipments": "select shipment_id, order_id, carrier, status shipment_status from sh",
    "model_dates": "select cast(strftime(dy, '%Y%m%d') as integer) date_key, cast(isodow(dy) as integer) day_of_week, monthname(dy) month_name, isodow(dy) > 5 is_weekend from dd",
    "model_latest": " union all ".join(f"select '{t}' model, status, count(*) n from ({_latest(t, k)}) group by 2" for t, k in (("customers", "customer_id"), ("orders", "order_id"), ("payments", "payment_id"))),
    "mart_sales": f"select date_key, category_name, region, orders_count, items_sold, {_digits('revenue', 21)} revenue_eur, {_digits('margin', 6)} margin_eur from ms",
    "mart_ltv": f"select customer_id, customer_key, region, segment, first_order_date, orders_count, {_digits('gmv', 21)} gmv_eur, case when realized > 0 then {_digits(_over('gmv', 'greatest(realized, 1)'), 21)} end avg_order_value_eur from ltv",
    "mart_deliveries": "select * replace (round(avg_transit_hours, 6) as avg_transit_hours) from dp",
    "mart_campaigns": f"select campaign_id, status campaign_status, round(ctr, 9) ctr, round(cpc_eur, 9) cpc_eur, round(cpm_eur, 9) cpm_eur, case when budget_eur <> 0 then {_digits(_over(f'cast(spend_eur * 100 as hugeint) * {_E15}', 'greatest(cast(budget_eur * 100 as hugeint), 1)'), 15)} end budget_utilization from roi",
    "channel_spend": f"""select channel, count(*) campaigns, cast(sum(impressions) as bigint) impressions, cast(sum(clicks) as bigint) clicks, sum(spend_eur) spend_eur, round(sum(clicks)::double / nullif(sum(impressions), 0), 9) ctr,
        round(sum(spend_eur)::double / nullif(sum(clicks), 0), 9) cpc_eur, round(sum(spend_eur)::double * 1000 / nullif(sum(impressions), 0), 9) cpm_eur,
        {_digits(_over(f'cast(sum(spend_eur) * 100 as hugeint) * {10**16}::hugeint', 'greatest(cast(sum(budget_eur) * 100 as hugeint), 1)'), 16)} budget_utilization from roi group by 1""",
}

_BROKEN = """,
xfo as (select * replace (case when order_id % 17 = 0 then -order_total else order_total end as order_total, case when order_id % 19 = 0 then 'nobody' else customer_key end as customer_key, case when order_id % 23 = 0 then 'odd' else order_status end as order_status)
    from fo where order_id % 29 <> 0),
xoi as (select * replace (case when order_item_id % 13 = 0 then line_total + 1 else line_total end as line_total, case when order_item_id % 11 = 0 then -1 else product_id end as product_id) from oi),
xsh as (select * replace (case when shipment_id % 7 = 0 then shipped_at + interval 1 day else shipped_at end as shipped_at) from sh),
ydc as (select * replace (case when customer_id % 7 = 0 then valid_to_lsn + 10000000000 else valid_to_lsn end as valid_to_lsn, case when customer_id % 11 = 0 then true else is_current end as is_current) from dc),
xdc as (select * from ydc union all select * from ydc where customer_id % 13 = 0 and is_current),
xroi as (select * replace (case when campaign_id like '%7' then impressions + 1 else clicks end as clicks, case when campaign_id like '%4' then null else ctr end as ctr) from roi),
xdp as (select * replace (case when carrier = 'carrier 1' then delivered_count + 1 else delivered_count end as delivered_count) from dp),
xfx as (select * from fx where order_id % 31 <> 0),
xst as (select 'orders' t, event_id, operation, kafka_offset, source_lsn, order_id is not null and customer_id is not null and status is not null and currency is not null and shipping_cost is not null and order_total is not null and created_at is not null and updated_at is not null whole from so
    union all select 'payments', event_id, operation, kafka_offset, source_lsn, payment_id is not null and order_id is not null and method is not null and status is not null and amount is not null and transaction_id is not null and created_at is not null and updated_at is not null from sp
    union all select 'customers', event_id, operation, kafka_offset, source_lsn, customer_id is not null and email is not null and first_name is not null and last_name is not null and region is not null and city is not null and status is not null and segment is not null and registered_at is not null
    and created_at is not null and updated_at is not null from sc),
pay as (select order_id, count(*) n, max(payment_amount) amount, max(payment_status) payment_status from fp group by 1),
pl as (select customer_id, case when is_snapshot_baseline then -9223372036854775808 else coalesce(valid_from_lsn, -9223372036854775807) end place, count(*) n, max(coalesce(valid_to_lsn, 9223372036854775807)) ends from xdc group by 1, 2),
curr as (select customer_id, count(*) filter (is_current) n, count(*) filter (is_current <> (valid_to_lsn is null)) odd from xdc group by 1)
"""
_CHECK_SQL = {
    "non_negative": "select 'fact_orders' model_name, order_id row_key from xfo where order_total < 0 or shipping_cost < 0",
    "gold_is_complete": "select order_id business_key, 'orders' entity from co where order_id not in (select order_id from xfo)",
    "routes_valid": "select event_id from postgres_cdc_events where not coalesce(kafka_partition = 0 and source_schema = 'public' and kafka_topic like '%.public.' || source_table, false)",
    "coordinates_unique": "select kafka_topic, kafka_partition, kafka_offset, count(*) n from postgres_cdc_events group by 1, 2, 3 having count(*) > 1",
    "streamed_have_lsn": "select t model_name, event_id row_key from xst where operation <> 'r' and (source_lsn is null or kafka_offset % 37 = 0)",
    "typed_fields_present": "select t model_name, event_id row_key from xst where operation <> 'd' and (not whole or kafka_offset % 41 = 0)",
    "line_arithmetic": "select order_item_id from xoi where line_total <> quantity * unit_price",
    "ltv_reconciles": f"select (select sum(orders_count) from ltv) mart_orders, (select count(*) from xfx where rm is not null) true_orders where mart_orders <> true_orders or abs((select sum(gmv)::double / 1e21 + count(*) filter (customer_id % 5 = 0) from ltv) - (select sum(order_total / (rm / 1e6)) from xfx where {_REAL})) > 0.01",
    "daily_revenue_reconciles": f""", a as (select order_date d1, sum(revenue::double / 1e21 + case when date_key % 3 = 0 then 5 else 0 end) x from ms group by 1),
        b as (select cast(created_at as date) d2, sum((order_total - shipping_cost)::double / (rm / 1e6)) y from xfx where {_REAL} and order_id in (select order_id from xoi) group by 1)
        select d1, d2 from a full join b on d1 = d2 where d1 is null or d2 is null or abs(x - y) > 0.01""",
    "delivery_statuses_add_up": "select carrier from xdp where delivered_count + in_transit_count + delayed_count + returned_count <> delivery_count or avg_transit_hours < 0",
    "marketing_in_range": "select campaign_id from xroi where clicks > impressions or clicks < 0 or spend_eur < 0 or ctr <= 0 or ctr > 1",
    "rates_cover": "select order_id, currency from fx where currency <> 'EUR' and (rm is null or order_id % 31 = 0)",
    "orders_match_payments": """select coalesce(xfo.order_id, pay.order_id) order_id, n, payment_status from xfo full join pay on pay.order_id = xfo.order_id where not coalesce(n = 1 and amount = order_total and xfo.order_id is not null and
        (order_status, payment_status) in (('pending', 'pending'), ('paid', 'captured'), ('shipped', 'captured'), ('delivered', 'captured'), ('refunded', 'refunded'), ('cancelled', 'cancelled'), ('cancelled', 'refunded')), false)""",
    "versions_do_not_overlap": """select customer_id from pl where n > 1 or exists (select 1 from pl q where q.customer_id = pl.customer_id and q.place > pl.place and q.place < pl.ends)
        union all select customer_id from xdc where is_snapshot_baseline <> (valid_from_lsn is null) or valid_to_lsn <= valid_from_lsn""",
    "one_current_version": """select coalesce(curr.customer_id, cc.customer_id) customer_id, case when odd > 0 then 'flags disagree with ends' when cc.customer_id is null then 'current but deleted' else 'live without one current version' end reason
        from curr full join cc on cc.customer_id = curr.customer_id where odd > 0 or (cc.customer_id is not null and coalesce(n, 0) <> 1) or (cc.customer_id is null and n > 0)""",
    "times_in_order": """select 'fact_shipments' model_name, shipment_id row_key from xsh where shipped_at > delivered_at union all select 'fact_orders', order_id from xfo where created_at > updated_at
        union all select 'fact_payments', payment_id from fp join xfo using (order_id) where fp.created_at < xfo.created_at""",
    "unique_dim_customer": "select customer_key, count(*) n from xdc group by 1 having count(*) > 1",
    "accepted_campaign_status": "select campaign_id from ca where campaign_id like '%3'",
    "accepted_order_status": "select order_id from xfo where order_status = 'odd'",
    "product_of_items": "select order_item_id from xoi where product_id not in (select product_id from pr)",
    "version_of_orders": "select order_id from xfo where customer_key not in (select customer_key from xdc)",
    "ctr_where_seen": "select campaign_id from xroi where impressions > 0 and (ctr is null or cpm_eur is null)",
}
ORACLE = {k: _BASE + s for k, s in _SQL.items()}
for _k, _sql in _CHECK_SQL.items():
    _with, _, _select = _sql.rpartition(")\n        select ") if _sql.startswith(",") else ("", "", _sql)
    _with, _select = (f"{_with})", f"select {_select}") if _with else ("", _select)
    _names = ", ".join(f"cast({c} as varchar) {c}" for c in _CHECKED[_k])  # all as text, as the queries give them
    ORACLE[f"check_{_k}"] = f"{_BASE}{_BROKEN}{_with}, found as ({_select}) select {_names} from found"
