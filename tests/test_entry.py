"""Every query over the small tables; core ones against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings postgres_cdc_events int_cdc_customer_versions dim_customer fact_orders categories file_manifests file_source_fields vendor_records mix_targets".split():
        c.execute(f"create view {t} as from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    return "~" if v is None or v != v else str(v)


CORE = [n for m in entry._modules() if not m.__name__.startswith("tidewater.llm") for n in m.QUERIES]


@pytest.mark.parametrize("name", CORE)
def test_query_equals_its_sql(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    rows = df.collect()
    sql = entry.oracle_sql()[name]
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    k = sorted(names)
    assert sorted(tuple(plain(r[c]) for c in k) for r in rows) == sorted(tuple(plain(r[names.index(c)]) for c in k) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_keyset_extract_is_whole(spark):
    """More rows than a page follow the watermark here; all come, in order."""
    got = [(r.order_date, r.order_id) for r in entry.queries()["keyset_extract"](spark, "/root/testdata/sf0.01").collect()]
    want = duckdb.execute("select cast(o_orderdate as date) d, o_orderkey from '/root/testdata/sf0.01/orders.parquet' where (d, o_orderkey) > (date '1998-01-01', 500) order by all").fetchall()
    assert len(want) > 1000 and got == want


def test_cdc_frontier_reads_the_whole_ledger(spark):
    got = entry.queries()["cdc_frontier"](spark, "/root/testdata/sf0.01").collect()
    n, last = duckdb.execute("select count(*), max(event_id) from '/root/testdata/sf0.01/events.parquet'").fetchone()
    assert n > 5000 and sum(r.n for r in got) == n and max(r.last_offset for r in got) == last


def test_parents_of_product_categories_match(spark):
    rows = entry.queries()["dim_product_tree"](spark, DATA).collect()
    assert rows and all(r.category.startswith(f"{r.parent}/") and r.grand == "all" for r in rows)
