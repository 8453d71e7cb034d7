import csv
import datetime as dt
import io
import json
import random
from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests import world
from tidewater.ingest import archive, bronze, landing
from tidewater.runtime import new_dir
from tidewater.sources import external, readers, rest, xlsx
from tidewater.sources.specs import SPECS
from tidewater.table.snapshots import CommitConflict

DAY = dt.date(2026, 9, 20)
CSV = b"supplier_id,sku,price,currency,valid_from\nS1,A,1.50,EUR,2026-01-01\n\nS2,B,-1,EUR,2026-01-01\nS3,C,x,EUR,2026-13-01\nS4,D,1\nS5,E,1,EUR,2026-01-01,more\n\"S6\",\"q,\"\"r\"\"\",2,EUR,2026-01-02\n"


def table_bytes(**columns):
    out = io.BytesIO()
    pq.write_table(pa.table(columns), out)
    return out.getvalue()


PARQUET = table_bytes(order_id=[1, None], customer_id=[2, 3], status=["a", "b"], order_total=[Decimal("1.20"), Decimal("2.00")], order_date=[dt.date(2026, 1, 1)] * 2)
XLSX = xlsx.write(["supplier_id", "sku", "quantity", "updated_at"], [["S1", "A", "5", "2026-01-01"], ["", "", "", ""], ["S2", "B", "x", "2026-01-01"]])
JSON = json.dumps([{"partner_id": "p", "sku": "s", "title": "t", "brand": "b", "category": "c", "extra": 1}, {"partner_id": "p", "sku": 5, "title": "", "brand": "b", "category": "c"}, 7]).encode()
FILES = {"supplier-prices": ("a.csv", CSV, 6, 4), "partner-products": ("a.json", JSON, 3, 2), "historical-orders": ("a.parquet", PARQUET, 2, 1), "supplier-stock": ("a.xlsx", XLSX, 2, 1)}


@pytest.fixture
def store(spark):
    return archive.HadoopStore(spark, new_dir(spark, "store"))


@pytest.mark.parametrize("source", FILES)
def test_vendor_readers(spark, store, source):
    name, data, n, bad = FILES[source]
    store.put(name, data)
    contract = readers.CONTRACTS[source]
    rows = readers.with_reasons(readers.read_vendor(spark, [store.path(name)], contract), contract)
    got = rows.orderBy("_source_object_row_position").collect()
    assert [r._source_object_row_position for r in got] == list(range(n)) and sum(r.reasons is not None for r in got) == bad
    good = readers.good_rows(rows, contract, SPECS[source.replace("-", "_")])
    assert good.count() == n - bad


def test_csv_reasons(spark, store):
    store.put("a", CSV)
    c, spec = readers.CONTRACTS["supplier-prices"], SPECS["supplier_prices"]
    got = [r.reasons for r in readers.with_reasons(readers.read_vendor(spark, [store.path("a")], c), c, spec).orderBy("_source_object_row_position").collect()]
    assert got == [None, "price: no decimal", "price: no decimal; valid_from: no date", "currency: empty; valid_from: empty", "row has more values than the header", None]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_landing_and_loading_agree(spark, store, seed):
    """On whatever values: what landing counts as good is what is loaded."""
    rng = random.Random(seed)
    odd = ["", " ", "\u00a0", "\u3000", "1", "-1", "+1", "1.", ".5", "1.50", "1.005", "9" * 30, "1e3", "NaN", "\u0663", "0000-01-01", "2026-02-29", "2026-01-01", "2026-1-1", "x,y", 'q"r', "a\nb", "true"]
    lines = [["supplier_id", "sku", "price", "currency", "valid_from"]] + [[rng.choice(odd), "s", rng.choice([*odd, *["2.5"] * 9]), "EUR", rng.choice([*odd, *["2026-05-05"] * 20])] for _ in range(200)]
    out = io.StringIO()
    csv.writer(out).writerows(lines)
    store.put("incoming/supplier-prices/a.csv", out.getvalue().encode())
    landed = landing.land(spark, store, readers.CONTRACTS["supplier-prices"], DAY)[0].manifest
    root = new_dir(spark, "raw")
    assert landed.row_count == 200 and 0 < landed.rejected_row_count < 200
    assert bronze.load_new(spark, store, root, SPECS["supplier_prices"]) == {DAY: 200 - landed.rejected_row_count}
    good = bronze.raw_table(spark, root, SPECS["supplier_prices"]).read().collect()
    assert all(str(r.price) in ("1.00", "1.50", "2.50") for r in good)


def test_strict_landing_and_contradicting_evidence(spark, store):
    c = readers.CONTRACTS["supplier-prices"]
    store.put("incoming/supplier-prices/a.csv", CSV)
    store.put("incoming/supplier-prices/b.csv", CSV.replace(b"S1", b"S9"))
    with pytest.raises(landing.RejectedRows, match="a.csv, b.csv"):
        landing.land(spark, store, c, DAY, strict=True)
    assert not store.list("incoming/") and len(store.list("files/")) == 2  # landed all the same
    good = b"\n".join(CSV.split(b"\n")[:2]) + b"\n"
    store.put("incoming/supplier-prices/c.csv", good)
    assert landing.land(spark, store, c, DAY, strict=True)[0].status == "completed"
    marker = next(k for k in store.list("state/checksums/") if archive.sha256([good]) in k)
    store.put(marker, json.dumps({"manifest": next(k for k in store.list("manifests/") if archive.sha256([CSV])[:16] in k)}).encode())
    store.put("incoming/supplier-prices/c.csv", good)
    with pytest.raises(RuntimeError, match="another checksum"):
        landing.land(spark, store, c, DAY)


def test_store_and_digests(spark, store):
    for k, data in {"a/x": b"1", "a/b/y": b"", "ab": b"\x00\xff" * 600_000}.items():
        store.put(k, data)
    assert store.list("a") == ["a/b/y", "a/x", "ab"] and store.list("a/b") == ["a/b/y"] and store.list("z/") == []
    store.copy("ab", "c/d")
    store.put("a/x", b"2")
    store.delete("ab")
    assert store.get("c/d") == b"\x00\xff" * 600_000 and store.get("a/x") == b"2" and not store.exists("ab") and store.size("c/d") == 1_200_000
    one = bronze.digest(spark, [store.path("c/d")])
    assert one == (1_200_000, archive.sha256([b"\x00\xff" * 600_000]))
    assert bronze.digest(spark, [store.path("c/d"), store.path("a/x")]) == (1_200_001, archive.sha256(archive.sha256([store.get(k)]).encode() for k in ("a/x", "c/d")))
    assert bronze.digest(spark, []) == (0, archive.sha256([]))


def test_transient_failures():
    for e in (CommitConflict("x"), OSError("Connection refused"), TimeoutError(), RuntimeError("Read timed out")):
        assert bronze.is_transient(e)
    assert not bronze.is_transient(ValueError("bad")) and not bronze.is_transient(bronze.BatchMismatch("timeout"))


@pytest.mark.parametrize(("source", "data"), [("supplier-prices", b""), ("supplier-prices", b"\xff\xfe"), ("supplier-prices", b"a,b\n"), ("supplier-prices", CSV.replace(b"supplier_id,sku", b"sku,supplier_id")), ("partner-products", b"{}"), ("partner-products", b"[NaN]"), ("historical-orders", b"PAR1"), ("historical-orders", table_bytes(order_id=[1])), ("supplier-stock", b"PK"), ("supplier-stock", xlsx.write(["x"], []))])
def test_broken_files(spark, store, source, data):
    store.put("f", data)
    got = readers.read_vendor(spark, [store.path("f")], readers.CONTRACTS[source]).collect()
    assert len(got) == 1 and got[0].file_error


def test_header_only_file_is_sound():
    head = CSV.split(b"\n")[0] + b"\n"
    assert list(readers.parsed_rows("a", head, readers.CONTRACTS["supplier-prices"])) == []


def test_landing_and_loading(spark, store):
    root = new_dir(spark, "raw")
    for source, (name, data, n, bad) in FILES.items():
        contract = readers.CONTRACTS[source]
        store.put(f"incoming/{source}/{name}", data)
        store.put(f"processing/{source}/stranded-{name}", data)  # a crashed run
        store.put(f"incoming/{source}/x-wrong.txt", b"?")
        got = {x.name: x for x in landing.land(spark, store, contract, DAY)}
        assert got[name].status == "completed" and got[name].manifest.row_count == n and got[name].manifest.rejected_row_count == bad
        assert got[f"stranded-{name}"].status == "duplicate" and got["x-wrong.txt"].status == "rejected"
        assert not store.list(f"processing/{source}/") and not store.list(f"incoming/{source}/")
        assert len([k for k in store.list(f"bad-rows/{source}/") if k.endswith(".csv")]) == 1 and any(k.endswith(".rejection.json") for k in store.list(f"rejected/{source}/"))
        store.put(f"incoming/{source}/{name}", data + b" ")
        assert landing.land(spark, store, contract, DAY)[0].status in ("rejected",)
        spec = SPECS[source.replace("-", "_")]
        assert bronze.load_new(spark, store, root, spec) == {DAY: n - bad}
        assert bronze.load_new(spark, store, root, spec) == {}
        assert bronze.load_date(spark, store, root, spec, DAY) == n - bad
        assert bronze.raw_table(spark, root, spec).read().count() == n - bad
    key = store.list("files/supplier-prices/")[0]
    store.put(key, store.get(key) + b"tampered")
    with pytest.raises(bronze.BatchMismatch):
        bronze.load_date(spark, store, root, SPECS["supplier_prices"], DAY)
    assert bronze.raw_table(spark, root, SPECS["supplier_prices"]).read().count() == 2


def test_pages(spark, store):
    root, spec = new_dir(spark, "raw"), SPECS["fx_rates"]
    pages = [{"rates": [{"currency": "USD", "rate": 1.0912, "more": 1}, {"currency": "GBP", "rate": 0.8501}]}, {"rates": [{"currency": "CHF", "rate": 0.95}]}]
    m = bronze.archive_pages(store, "fx-rates", DAY, pages, "rates")
    assert m.row_count == 3 and bronze.load_date(spark, store, root, spec, DAY) == 3
    bronze.archive_pages(store, "fx-rates", DAY, pages[:1], "rates")
    assert bronze.load_date(spark, store, root, spec, DAY) == 2
    got = bronze.raw_table(spark, root, spec).read()
    assert {r.currency: r.rate for r in got.collect()} == {"USD": Decimal("1.091200"), "GBP": Decimal("0.850100")}
    with pytest.raises(bronze.BatchMismatch):
        bronze.archive_pages(store, "fx-rates", DAY, [], "rates")
    for k, bad in enumerate(({"x": []}, {"rates": [{"currency": "USD"}]}, {"rates": [{"currency": "USD", "rate": "no"}]})):
        store.put(f"bad{k}.json", json.dumps(bad).encode())
        with pytest.raises(Exception):
            readers.read_pages(spark, [store.path(f"bad{k}.json")], spec).collect()


def test_extract_by_watermark(spark, store):
    root, spec = new_dir(spark, "raw"), SPECS["orders"]
    source = world.bronze(spark)["orders"].select(*spec.business.fieldNames())
    first = bronze.extract_snapshot(spark, source.filter("order_id = 990001"), store, "orders", DAY)
    assert first.row_count == 1
    second = bronze.extract_snapshot(spark, source, store, "orders", world.D2)
    assert second.row_count == 1 and archive.load_watermark(store, "orders") == archive.Watermark(dt.datetime(2026, 9, 21, 10, tzinfo=dt.UTC), 990002)
    assert bronze.load_new(spark, store, root, spec) == {DAY: 1, world.D2: 1}
    third = bronze.extract_snapshot(spark, source, store, "orders", world.D2 + dt.timedelta(days=1))
    assert third.row_count == 0 and bronze.load_new(spark, store, root, spec) == {}
    assert bronze.extract_snapshot(spark, source, store, "orders", DAY, full=True).row_count == 2
    with pytest.raises(readers.SchemaMismatch):
        path = store.path("bad")
        source.drop("status").write.parquet(path)
        readers.read_snapshot(spark, [path], spec)


def test_archive_rules(store):
    assert archive.day_of("api/x/2026/09/20/page-1.json") == DAY and archive.day_of("a-20260920.csv") == DAY and archive.day_of("a/b") is None and archive.day_of("x/2026/13/99/y") is None
    with pytest.raises(ValueError):
        store.put("../out", b"")
    with pytest.raises(ValueError):
        archive.Manifest.of("s", "file", "completed", "k", "0" * 64, 1, DAY, 1, 2)
    with pytest.raises(ValueError):
        archive.Watermark(dt.datetime(2026, 1, 1), 1)


def test_delete_coordinates(spark):
    spec = SPECS["fx_rates"]
    table = bronze.raw_table(spark, new_dir(spark, "raw"), spec)
    rows = [(c, Decimal("1"), "b", DAY, o, k, None) for o in "xy" for k, c in enumerate(("USD", "GBP", "CHF"))]
    table.append(spark.createDataFrame(rows, spec.schema))
    places = spark.createDataFrame([("x", 0, 1), ("y", 2, 9), ("z", 0, 9)], "_source_object string, first long, last long")
    assert bronze.delete_coordinates(table, DAY, places) == 3
    assert sorted((r._source_object, r._source_object_row_position) for r in table.read().collect()) == [("x", 2), ("y", 0), ("y", 1)]


def test_external_requests():
    mark = archive.Watermark(dt.datetime(2026, 9, 20, tzinfo=dt.UTC), 7)
    sql = external.increment_sql(SPECS["orders"], mark)
    assert sql.startswith('select "order_id", "customer_id"') and sql.endswith("""where ("updated_at", "order_id") > (timestamptz '2026-09-20T00:00:00+00:00', 7)""")
    assert "where" not in external.increment_sql(SPECS["orders"], None)
    got = external.kafka_options("h:1", ["a", "b"])
    assert got["subscribe"] == "a,b" and got["maxOffsetsPerTrigger"] == "500" and "maxOffsetsPerTrigger" not in external.kafka_options("h:1", ["a"], None)


# -- REST ---------------------------------------------------------------------------


def client(responses, **kw):
    clock, log = [0.0], []
    feed = iter(responses)

    def send(path, params):
        log.append((clock[0], params))
        r = next(feed)
        if isinstance(r, Exception):
            raise r
        return r

    c = rest.Client(send, clock=lambda: clock[0], sleep=lambda s: clock.__setitem__(0, clock[0] + s), **kw)
    return c, log


def test_client_retries():
    ok = rest.Response(200, b'{"a":1}', {})
    c, log = client([rest.Response(500, b"", {}), rest.TransportError("x"), rest.Response(429, b"", {"Retry-After": "7"}), ok], rng=random.Random(1))
    assert c.get("/p", {}) == {"a": 1} and len(log) == 4 and log[3][0] - log[2][0] == pytest.approx(7)
    c, log = client([rest.Response(404, b"", {})])
    with pytest.raises(rest.ApiError):
        c.get("/p", {})
    c, log = client([rest.Response(500, b"", {"Retry-After": "soon"})] * 9)
    with pytest.raises(rest.ApiError, match="5 attempts"):
        c.get("/p", {})
    c, log = client([rest.Response(503, b"", {"Retry-After": "999"})] * 9, deadline_s=20)
    with pytest.raises(rest.ApiError, match="1 attempts"):
        c.get("/p", {})
    c, log = client([ok] * 3, per_second=2)
    [c.get("/p", {}) for _ in range(3)]
    assert [t for t, _ in log] == [0, 0.5, 1.0]


def test_paging():
    data = list(range(25))
    get = lambda p: {"r": data[(p["page"] - 1) * 10 : p["page"] * 10], "total_count": 25}
    assert sum((p["r"] for p in rest.offset_pages(get, "r", 10)), []) == data
    pages = {None: {"d": [1], "next_cursor": "a"}, "a": {"d": [2], "next_cursor": None}}
    seen = []
    got = list(rest.cursor_pages(lambda p: seen.append(p) or pages[p.get("cursor")], "d", DAY))
    assert [p["d"] for p in got] == [[1], [2]] and seen[0]["updated_since"] == "2026-09-19"
    for bad in ({"d": [], "next_cursor": "a"}, {"x": 1}):
        with pytest.raises(rest.ApiError):
            list(rest.cursor_pages(lambda p: bad, "d", DAY))


def test_page_data_source(spark):
    fetch = lambda n: {"r": [{"k": n * 10 + i, "v": "x"} for i in range(3)]}
    rest.register(spark, rest.page_source("demo_pages", "k int, v string", "r", fetch, 4))
    df = spark.read.format("demo_pages").load()
    assert df.count() == 12 and df.agg(F.sum("k")).first()[0] == sum(n * 10 + i for n in range(1, 5) for i in range(3))
