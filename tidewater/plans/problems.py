"""Queries of problems 1 to 6 and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cdc_fold, deliveries, hierarchy, pit_asof, rejects, relational, satellites
from ..runtime import cut, discard


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark, d):
    kept = deliveries.replay(table(spark, d, "postgres_cdc_events"), [])
    return kept.rows().filter("copies > 1").select("event_id")


def p1_kept(spark, d):
    kept = deliveries.replay(table(spark, d, "postgres_cdc_events"), ["kafka_topic", "kafka_offset", "key_json"])
    return kept.rows().select("event_id", "row.kafka_topic", "row.kafka_offset", "row.key_json", F.unix_micros("row.ingested_at").alias("ingested_us"), "copies")


def ledger_replay(spark, d):
    """The ledger sent batch by batch, each batch twice: nothing counts twice."""
    kept = deliveries.replay(table(spark, d, "postgres_cdc_events"), ["kafka_topic", "kafka_offset"], times=2)
    return kept.rows().select("event_id", "row.kafka_topic", "row.kafka_offset", "copies")


def p2_found(spark, d):
    return pit_asof.in_force(table(spark, d, "fact_orders"), table(spark, d, "dim_customer"))


def _state(spark, d):
    return cdc_fold.live(cdc_fold.fold(table(spark, d, "postgres_cdc_events")))


def p3_found(spark, d):
    return _state(spark, d).select("source_table", "entity_id", "kafka_offset")


def p3_rows(spark, d):
    return _state(spark, d).select("source_table", "entity_id", "source_lsn", F.md5("after_json").alias("after_md5"))


def p3_batches(spark, d):
    """The same, the feed folded batch by batch onto the stored state."""
    changes = table(spark, d, "postgres_cdc_events").select("source_table", "operation", "source_lsn", "kafka_offset", "key_json", "after_json", "ingested_at")
    parts, state = relational.in_time_order(changes, F.col("ingested_at"), 4), None
    for rows in parts:
        before, state = state, cut(cdc_fold.fold(rows, base=state), "state")
        discard(before)
    discard(*parts[:1])
    return cdc_fold.live(state).select("source_table", "entity_id", "kafka_offset", "source_lsn", F.md5("after_json").alias("after_md5"))


def _versions(spark, d, which):
    s = satellites.CUSTOMER_SATELLITES[which]
    return satellites.satellite_view(satellites.load(table(spark, d, "int_cdc_customer_versions"), s).rows(), s)


def p4_found(spark, d):
    return _versions(spark, d, 0).select("customer_id", "valid_from_lsn", "valid_to_lsn")


def p4_place(spark, d):
    return _versions(spark, d, 1)


_ATTRIBUTES = [a for s in satellites.CUSTOMER_SATELLITES for a in s.attributes]


def p4_change_rates(spark, d):
    return satellites.change_rates(table(spark, d, "int_cdc_customer_versions"), _ATTRIBUTES)


def _roots(spark, d):
    nodes = hierarchy.latest(table(spark, d, "categories"))
    return nodes, hierarchy.roots(nodes)


def p5_found(spark, d):
    return _roots(spark, d)[1].select(F.col("id").alias("category_id"), F.col("root").alias("root_category_id"), "depth")


def p5_paths(spark, d):
    """Paths of every category; on or before a ring from the ring's smallest id."""
    nodes, found = _roots(spark, d)
    return hierarchy.whole_paths(nodes, found).select(F.col("id").alias("category_id"), F.col("root").alias("root_category_id"), "depth", F.concat_ws("/", F.col("path").cast("array<string>")).alias("path"))


def p5_descendants(spark, d):
    """Descendants of every category, on rings too."""
    nodes, found = _roots(spark, d)
    return hierarchy.descendants(hierarchy.whole_paths(nodes, found))


def p6_found(spark, d):
    contracts = rejects.contracts(table(spark, d, "file_source_fields"))
    return rejects.rejected(table(spark, d, "vendor_records"), contracts).select("record_id", "reason")


def p6_files(spark, d):
    contracts = rejects.contracts(table(spark, d, "file_source_fields"))
    return rejects.file_counts(table(spark, d, "file_manifests"), table(spark, d, "vendor_records"), contracts)


def p6_inexact(spark, d):
    """Numbers of good records that the typed rows can't hold exactly, as written."""
    records = table(spark, d, "vendor_records").select("record_id", "source", "raw_record")
    parts = [rejects.inexact(records, c).select("record_id", "field", "exact") for c in rejects.contracts(table(spark, d, "file_source_fields"))]
    return reduce(DataFrame.unionByName, parts)


def _typed(source):
    def run(spark, d):
        contracts = {c.source: c for c in rejects.contracts(table(spark, d, "file_source_fields"))}
        c = contracts[source]
        return rejects.typed(table(spark, d, "vendor_records").select("record_id", "source", "raw_record"), c).select("record_id", *[f.name for f in c.fields])

    return run


QUERIES = {f.__name__: f for f in (p1_found, p1_kept, ledger_replay, p2_found, p3_found, p3_rows, p3_batches, p4_found, p4_place, p4_change_rates, p5_found, p5_paths, p5_descendants, p6_found, p6_files, p6_inexact)}
QUERIES |= {f"p6_typed_{s.replace('-', '_')}": _typed(s) for s in ("supplier-prices", "partner-products", "historical-orders", "supplier-stock")}

_MESSAGES = "select *, coalesce(sha256(kafka_topic || ':' || kafka_partition || ':' || kafka_offset), lower(trim(event_id))) mid from postgres_cdc_events"
_ENTITY = "cast(regexp_extract(key_json, '(-?[0-9]+)', 1) as bigint)"
_RANKED = f"""
select *, {_ENTITY} entity_id, row_number() over (
  partition by source_table, {_ENTITY}
  order by case when operation = 'r' then 0 else 1 end desc, case when operation = 'r' then null else source_lsn end desc nulls last, kafka_offset desc) rn
from postgres_cdc_events"""


def _satellite_sql(attributes: list[str]) -> str:
    texts = ", ".join(rf"lower(regexp_replace({a}, '^\s+|\s+$', '', 'g')) {a}" for a in attributes)
    same = " and ".join(f"{a} is not distinct from p_{a}" for a in ["gone", *attributes])
    lags = ", ".join(f"lag({a}) over w p_{a}" for a in ["gone", *attributes])
    place = "case when is_snapshot_baseline then -1 else valid_from_lsn end"
    return f"""
with s as (select customer_id, {place} p, operation = 'd' gone, {texts},
                  row_number() over (partition by customer_id, {place} order by kafka_offset desc) rn from int_cdc_customer_versions),
     l as (select *, {lags}, row_number() over w n from s where rn = 1 window w as (partition by customer_id order by p)),
     c as (select *, lead(p) over (partition by customer_id order by p) nx from l where n = 1 or not ({same}))
select customer_id, cast(greatest(p, 0) as bigint) valid_from_lsn, cast(coalesce(nx, -1) as bigint) valid_to_lsn{{}} from c where not gone"""


_TREE = """
with recursive r as (select *, row_number() over (partition by category_id order by _batch_date desc, _ingested_at desc) rn from categories),
n as (select category_id id, parent_category_id p from r where rn = 1),
m as (select n.id, q.id p from n left join n q on n.p = q.id),
w as (select id start, id cur, 0 d, cast(id as varchar) path from m where p is null
      union all select w.start, m.id, w.d + 1, w.path || '/' || m.id from w join m on m.p = w.cur),
"""
_RINGS = """
x as (select id, p cur from m where p is not null and id not in (select cur from w)
      union select x.id, m.p from x join m on m.id = x.cur),
ring as (select id, min(cur) lo from (select x.id, x.cur from x join x y on y.id = x.cur and y.cur = x.cur) group by id)
"""
_CHAINS = """,
k as (select m.id, m.p, ring.lo from m join ring on ring.id = m.id),
up as (select id, id cur, [id] chain from k union all select up.id, k.p, list_prepend(k.p, up.chain) from up join k on k.id = up.cur where not list_contains(up.chain, k.p)),
looped as (select id, arg_max(chain, len(chain)) chain from up group by id)
"""
_FIELD = r'("[^"]*(""[^"]*)*"|[^"{d}]*)'


def _delimited(d: str) -> str:
    d = "\\" + d
    field = _FIELD.replace("{d}", d)
    return f"""case when not regexp_full_match(raw_record, '{field}({d}{field})*', 's') then null
      else list_transform(regexp_extract_all(text, '{d}{field}', 1, 's'), lambda f: case when f[1] = '"' then replace(f[2:-2], '""', '"') else f end) end""".replace("text", f"'{d[1:]}' || raw_record")


def _bad(v: str, kind: str) -> str:
    rule = {"string": "false", "integer": f"not regexp_full_match({v}, '-?[0-9]+')", "decimal": f"not regexp_full_match({v}, '[0-9]+(\\.[0-9]+)?')", "date": f"(not regexp_full_match({v}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') or try_cast({v} as date) is null)"}[kind]
    return f"(coalesce(regexp_full_match({v}, '\\s*', 's'), true) or {rule})"


_CONTRACTS = {
    "supplier-prices": (",", [("supplier_id", "string"), ("sku", "string"), ("price", "decimal"), ("currency", "string"), ("valid_from", "date")]),
    "historical-orders": ("|", [("order_id", "integer"), ("customer_id", "integer"), ("status", "string"), ("order_total", "decimal"), ("order_date", "date")]),
    "supplier-stock": (";", [("supplier_id", "string"), ("sku", "string"), ("quantity", "integer"), ("updated_at", "date")]),
    "partner-products": (None, [(n, "string") for n in ("partner_id", "sku", "title", "brand", "category")]),
}
_TYPES = {"string": "varchar", "integer": "bigint", "decimal": "decimal(38,6)", "date": "date"}


def _checked_sql(source: str) -> str:
    d, fields = _CONTRACTS[source]
    if d is None:
        names = [n for n, _ in fields]
        missing = " or ".join(f"not list_contains(json_keys(j), '{n}')" for n in names)
        wrong = " or ".join(f"json_type(j, '$.{n}') <> 'VARCHAR' or {_bad(f'json_extract_string(j, {chr(39)}$.{n}{chr(39)})', 'string')}" for n in names)
        return f"""select record_id, object_key, raw_record, j, case when j is null then 'syntax' when {missing} then 'columns' when {wrong} then 'value' end reason
          from (select *, case when json_valid(raw_record) and not regexp_matches(raw_record, ',[[:space:]]*}}[[:space:]]*$') then case when json_type(raw_record) = 'OBJECT' then raw_record end end j from vendor_records where source = '{source}')"""
    wrong = " or ".join(_bad(f"f[{k}]", kind) for k, (_, kind) in enumerate(fields, 1))
    return f"""select record_id, object_key, raw_record, f, case when f is null then 'syntax' when len(f) <> {len(fields)} then 'columns' when {wrong} then 'value' end reason
      from (select *, {_delimited(d)} f from vendor_records where source = '{source}')"""


_REASONS = " union all ".join(f"select record_id, object_key, reason from ({_checked_sql(s)})" for s in _CONTRACTS)


def _typed_sql(source: str) -> str:
    d, fields = _CONTRACTS[source]
    get = (lambda k, n: f"json_extract_string(j, '$.{n}')") if d is None else (lambda k, n: f"f[{k}]")
    return f"select record_id, {', '.join(f'cast({get(k, n)} as {_TYPES[t]}) {n}' for k, (n, t) in enumerate(fields, 1))} from ({_checked_sql(source)}) where reason is null"


ORACLE = {
    "p1_found": f"select mid event_id from ({_MESSAGES}) group by mid having count(*) > 1",
    "p1_kept": f"""select mid event_id, arg_min(kafka_topic, ingested_at) kafka_topic, arg_min(kafka_offset, ingested_at) kafka_offset, min(key_json) key_json,
                   epoch_us(min(ingested_at)) ingested_us, count(*) copies from ({_MESSAGES}) group by mid""",
    "ledger_replay": f"select mid event_id, arg_min(kafka_topic, ingested_at) kafka_topic, arg_min(kafka_offset, ingested_at) kafka_offset, count(*) copies from ({_MESSAGES}) group by mid",
    "p2_found": """
with o as (select order_id, max(customer_id) cid, max(lifecycle_start_lsn) lsn, bool_or(is_snapshot_baseline) b from fact_orders group by 1),
v as (select distinct customer_id, customer_key, is_snapshot_baseline b, valid_from_lsn f, max(valid_to_lsn) over (partition by customer_key) t from dim_customer),
j as (select o.order_id, v.customer_key, v.t, o.lsn, row_number() over (partition by order_id order by case when v.b then -1 else v.f end desc) rn
      from o join v on o.cid = v.customer_id and (v.b or v.f <= o.lsn) where not o.b)
select order_id, customer_key from j where rn = 1 and (t is null or t > lsn)
union all select o.order_id, v.customer_key from o join v on o.cid = v.customer_id and v.b where o.b""",
    "p3_found": f"select source_table, entity_id, kafka_offset from ({_RANKED}) where rn = 1 and operation <> 'd'",
    "p3_rows": f"select source_table, entity_id, case when operation <> 'r' then source_lsn end source_lsn, md5(after_json) after_md5 from ({_RANKED}) where rn = 1 and operation <> 'd'",
    "p3_batches": f"select source_table, entity_id, kafka_offset, case when operation <> 'r' then source_lsn end source_lsn, md5(after_json) after_md5 from ({_RANKED}) where rn = 1 and operation <> 'd'",
    "p4_found": _satellite_sql(["segment", "customer_status"]).format(""),
    "p4_place": _satellite_sql(["region", "city"]).format(", region, city"),
    "p4_change_rates": " union all ".join(f"select '{a}' attribute, count(*) versions from ({_satellite_sql([a]).format('')})" for a in _ATTRIBUTES),
    "p5_found": f"{_TREE}{_RINGS} select cur category_id, start root_category_id, cast(d as bigint) depth from w union all select id, lo, -1 from ring",
    "p5_paths": f"""{_TREE}{_RINGS}{_CHAINS} select cur category_id, start root_category_id, cast(d as bigint) depth, path from w
                        union all select id, lo, -1, array_to_string(chain[list_position(chain, lo):], '/') from looped join ring using (id)""",
    "p5_descendants": f"""{_TREE}{_RINGS}{_CHAINS}, z as (select unnest(string_split(path, '/')) a, generate_subscripts(string_split(path, '/'), 1) k, cur, d from w)
                              select cast(a as bigint) ancestor, cur descendant, cast(d - k + 1 as bigint) distance from z
                              union all select unnest(chain), id, cast(len(chain) - generate_subscripts(chain, 1) as bigint) from looped""",
    "p6_found": f"select record_id, reason from ({_REASONS}) where reason is not null",
    "p6_files": f"""select m.batch_id, m.object_key, count(r.record_id) true_row_count, count(r.reason) true_rejected_row_count
                    from file_manifests m left join ({_REASONS}) r using (object_key) group by 1, 2""",
}
ORACLE["p6_inexact"] = " union all ".join(
    f"""select record_id, '{n}' field, f[{k}] exact from ({_checked_sql(s)}) where reason is null and {f"coalesce(try_cast(f[{k}] as hugeint) not between -9223372036854775808 and 9223372036854775807, true)" if t == "integer" else f"(length(ltrim(split_part(f[{k}], '.', 1), '0')) > 32 or length(rtrim(split_part(f[{k}], '.', 2), '0')) > 6)"}"""
    for s, (_, fields) in _CONTRACTS.items() for k, (n, t) in enumerate(fields, 1) if t in ("integer", "decimal"))
ORACLE |= {f"p6_typed_{s.replace('-', '_')}": _typed_sql(s) for s in _CONTRACTS}
