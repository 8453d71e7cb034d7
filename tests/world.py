"""A two-day retail world with a change ledger of 26 events, built in code.

Fixed values, from FIXTURES.md: keys, operations, offsets, LSNs, segments, regions,
amounts and times that the expected results of the models follow from.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from decimal import Decimal

from tidewater.sources.specs import LEDGER, SPECS, TOPIC

D1, D2 = dt.date(2026, 9, 20), dt.date(2026, 9, 21)
BASE = dt.datetime(2026, 9, 22, 12, tzinfo=dt.UTC)


def event_id(table, offset):
    return hashlib.sha256(f"{TOPIC.format(table)}:0:{offset}".encode()).hexdigest()


def at(day, hour, minute=0):
    return dt.datetime(2026, 9, day, hour, minute, tzinfo=dt.UTC)


def customer(i, segment, region="anywhere", **extra):
    t = "2026-09-01T08:00:00.000000Z"
    return {"customer_id": i, "email": f"c{i}@shop.test", "first_name": "C", "last_name": "D", "region": region, "city": "somewhere", "status": "active", "segment": segment, "registered_at": t, "created_at": t, "updated_at": t} | extra


def order(i, customer_id, status, total="42.50", ship="2.50", currency="USD", hour=10):
    return {"order_id": i, "customer_id": customer_id, "status": status, "currency": currency, "shipping_cost": ship, "order_total": total, "created_at": f"2026-09-20T{hour}:00:00.000000Z", "updated_at": "2026-09-20T12:00:00.000000Z"}


def payment(i, order_id, status, amount="42.50"):
    return {"payment_id": i, "order_id": order_id, "method": "card", "status": status, "amount": amount, "transaction_id": f"T{i}", "created_at": "2026-09-20T10:01:00.000000Z", "updated_at": "2026-09-20T12:00:00.000000Z"}


#: (table, key, operation, offset, lsn, row)
EVENTS = [
    ("customers", 9910001, "u", 3, 200, customer(9910001, "vip", surplus=[1, 2])),
    ("customers", 9910001, "r", 0, None, customer(9910001, "standard")),
    ("customers", 9910001, "u", 2, 200, customer(9910001, "premium")),
    ("customers", 9910002, "r", 1, None, customer(9910002, "standard")),
    ("customers", 9910002, "d", 4, 201, None),
    ("customers", 9910003, "c", 5, 202, customer(9910003, "standard")),
    ("customers", 9910003, "d", 6, 203, None),
    ("customers", 9910003, "c", 7, 204, customer(9910003, "premium", "cdc-recreated")),
    ("customers", 990001, "r", 8, 9999, customer(990001, "premium", "it-region")),
    ("customers", 990002, "r", 9, None, customer(990002, "standard", "it-region-b")),
    ("customers", 990001, "u", 10, 205, customer(990001, "vip", "it-region-2")),
    ("customers", 9910001, "u", 11, 250, customer(9910001, "standard", "cdc-later-version")),
    ("orders", 9920001, "c", 0, 200, order(9920001, 9910001, "pending")),
    ("orders", 9920001, "u", 1, 301, order(9920001, 9910001, "paid")),
    ("orders", 9920002, "c", 2, 302, order(9920002, 9910003, "pending")),
    ("orders", 9920002, "d", 3, 303, None),
    ("orders", 990001, "r", 4, 9999, order(990001, 990001, "delivered", "93.00", "3.00")),
    ("orders", 990002, "r", 5, None, order(990002, 990002, "refunded", "42.00", "2.00", "EUR", 11)),
    ("orders", 990002, "d", 6, 303, None),
    ("payments", 9930001, "c", 0, 200, payment(9930001, 9920001, "pending")),
    ("payments", 9930001, "u", 1, 301, payment(9930001, 9920001, "captured")),
    ("payments", 9930002, "c", 2, 302, payment(9930002, 9920002, "pending")),
    ("payments", 9930002, "d", 3, 303, None),
    ("payments", 980001, "r", 4, 9999, payment(980001, 990001, "captured", "93.00")),
    ("payments", 980002, "r", 5, None, payment(980002, 990002, "refunded", "42.00")),
    ("payments", 980002, "d", 6, 303, None),
]


def message(table, key, op, offset, lsn, row):
    """(topic, partition, offset, timestamp, key, value) as a connector sends it."""
    when = BASE - dt.timedelta(minutes=offset)
    k = json.dumps({SPECS[table].key[0]: key}, separators=(",", ":"))
    source = {"schema": "public", "table": table, "lsn": lsn, "txId": lsn, "ts_us": int(when.timestamp() * 1_000_000)}
    v = json.dumps({"before": None, "after": row, "source": source, "op": op}, separators=(",", ":"))
    return TOPIC.format(table), 0, offset, when + dt.timedelta(seconds=1), k.encode(), v.encode()


def ledger(spark):
    rows = []
    for e in EVENTS:
        table, _, op, offset, lsn, row = e
        topic, p, o, ts, k, v = message(*e)
        when = ts - dt.timedelta(seconds=1)
        rows.append((event_id(table, offset), topic, p, o, ts, "public", table, op, lsn, lsn, when, k.decode(), v.decode(), None, json.dumps(row, sort_keys=True, separators=(",", ":")) if row else None, when.date(), BASE))
    return spark.createDataFrame(rows, LEDGER)


_C = at(1, 0)
SNAPSHOTS = {
    "categories": [(D1, (90001, "it-root-cat", None, _C, _C)), (D1, (90002, "it-leaf-cat", 90001, _C, _C))],
    "products": [(D1, (910001, "S1", "a", 90002, "b", Decimal("25.00"), Decimal("15.00"), True, _C, _C)), (D1, (910002, "S2", "b", 90001, "b", Decimal("40.00"), Decimal("22.00"), True, _C, _C))],
    "customers": [(D1, (990001, "e", "I", "O", "it-region", "c", "active", "premium", _C, _C, at(20, 9))), (D2, (990001, "e", "I", "O", "it-region-2", "c", "active", "premium", _C, _C, at(21, 9)))],
    "orders": [(D1, (990001, 990001, "delivered", "USD", Decimal("3.00"), Decimal("93.00"), at(20, 10), at(20, 12))), (D2, (990002, 990002, "refunded", "EUR", Decimal("2.00"), Decimal("42.00"), at(20, 11), at(21, 10)))],
    "order_items": [(D1, (9000001 + k, o, p, q, Decimal(u), Decimal(u) * q, at(20, 10), at(20, 10))) for k, (o, p, q, u) in enumerate([(990001, 910001, 2, "25.00"), (990001, 910002, 1, "40.00"), (990002, 910002, 1, "40.00")])],
    "payments": [(D1, (980001, 990001, "card", "captured", Decimal("93.00"), "T", at(20, 10, 5), at(20, 10, 5)))],
    "shipments": [(D1, (970001, 990001, "DHL", "T1", "delivered", at(20, 15), at(20, 18), at(20, 12), at(20, 18))), (D1, (970002, 990002, "UPS", "T2", "cancelled", None, None, at(20, 11, 30), at(20, 13)))],
    "fx_rates": [(D1, ("USD", Decimal("1.091200"))), (D1, ("GBP", Decimal("0.850100"))), (D2, ("USD", Decimal("1.102000")))],
    "campaigns": [(d, ("CMP-1", "Sale", "search", "active", dt.date(2026, 9, 1), dt.date(2026, 9, 30), Decimal("10000.00"), Decimal("2500.50"), 100000, 3200)) for d in (D1, D2)],
    "deliveries": [(D1, ("DLV-1", "O1", "DHL", "in_transit", at(20, 15), None, at(20, 16))), (D2, ("DLV-1", "O1", "DHL", "delivered", at(20, 15), at(21, 9, 30), at(21, 10)))],
}


def bronze(spark):
    out = {"postgres_cdc_events": ledger(spark)}
    for name, rows in SNAPSHOTS.items():
        data = [(*r, f"{name}-{d}", d, "obj", k, dt.datetime.combine(d, dt.time(23), dt.UTC)) for k, (d, r) in enumerate(rows)]
        out[name] = spark.createDataFrame(data, SPECS[name].schema)
    return out
