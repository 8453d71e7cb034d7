"""Readers of raw objects: Parquet snapshots, JSON API pages, vendor files.

A vendor file of text or XLSX is read as a binary file and parsed by the one task
that has it, so that rows keep their exact positions. A file that breaks
its contract as a whole (header, encoding, container) is one row with
``file_error``; a row that breaks it is one row with reasons.
"""

from __future__ import annotations

import csv
import io
import itertools
import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rejects import Contract, Field, _Number, _refuse, is_blank, value_error
from ..runtime import Files
from . import xlsx
from .specs import Spec

CONTRACTS = {
    c.source: c
    for c in (
        Contract("supplier-prices", "csv", ",", (Field("supplier_id", "string"), Field("sku", "string"), Field("price", "decimal"), Field("currency", "string"), Field("valid_from", "date"))),
        Contract("partner-products", "json", None, tuple(Field(n, "string") for n in ("partner_id", "sku", "title", "brand", "category"))),
        Contract("historical-orders", "parquet", None, (Field("order_id", "integer"), Field("customer_id", "integer"), Field("status", "string"), Field("order_total", "decimal"), Field("order_date", "date"))),
        Contract("supplier-stock", "xlsx", None, (Field("supplier_id", "string"), Field("sku", "string"), Field("quantity", "integer"), Field("updated_at", "date"))),
    )
}


class SchemaMismatch(ValueError):
    pass


# -- snapshots and pages ----------------------------------------------------


def read_snapshot(spark: SparkSession, paths: list[str], spec: Spec) -> DataFrame:
    """Parquet snapshot whose column set must equal the spec's; types are cast
    only where that loses nothing (a naive time is UTC)."""
    raw = spark.read.parquet(*paths)
    want = {f.name: f.dataType for f in spec.business}
    if set(raw.columns) != set(want):
        raise SchemaMismatch(f"{spec.name}: missing {sorted(set(want) - set(raw.columns))}, extra {sorted(set(raw.columns) - set(want))}")
    for f in raw.schema:
        a, b = f.dataType, want[f.name]
        same = a == b or isinstance(a, T.IntegralType) and isinstance(b, T.LongType) or isinstance(a, T.TimestampNTZType) and isinstance(b, T.TimestampType) or isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType) and a.scale <= b.scale
        if not same:
            raise SchemaMismatch(f"{spec.name}.{f.name}: {a.simpleString()} is no {b.simpleString()}")
    return raw.select(*[F.col(n).cast(t).alias(n) for n, t in want.items()])


def read_pages(spark: SparkSession, paths: list[str], spec: Spec) -> DataFrame:
    """Records of JSON pages with their page and position. A page without a list
    under the envelope, a record without a column, or a value that isn't of its
    type fails the read; more columns are ignored."""
    pages = spark.read.option("wholetext", True).text(paths).select(F.col("value").alias("page"), F.col("_metadata.file_path").alias("_source_object"))
    items = F.from_json(F.get_json_object("page", f"$.{spec.envelope}"), "array<string>")
    bad_page = F.raise_error(F.concat(F.lit(f"{spec.name}: no list of {spec.envelope} in "), F.col("_source_object")))
    rows = pages.select("_source_object", F.posexplode(F.when(items.isNull(), bad_page.cast("array<string>")).otherwise(items)).alias("_source_object_row_position", "record"))
    names = F.json_object_keys("record")
    need = F.array(*[F.lit(f.name) for f in spec.business])
    missing = F.size(F.array_except(need, F.coalesce(names, F.array().cast("array<string>")))) > 0
    checked = F.when(missing, F.raise_error(F.concat(F.lit(f"{spec.name}: a record lacks columns in "), F.col("_source_object"))).cast("string")).otherwise(F.col("record"))
    rows = rows.withColumn("record", checked)
    return rows.select(*[F.get_json_object("record", f"$.{f.name}").cast(f.dataType).alias(f.name) for f in spec.business], "_source_object", F.col("_source_object_row_position").cast("bigint").alias("_source_object_row_position"))


# -- vendor files -------------------------------------------------------------


def canonical(value: object) -> str | None:
    """Text of a JSON value, as contracts are checked on texts."""
    if value is None or isinstance(value, str):
        return value
    return "true" if value is True else "false" if value is False else json.dumps(value)


class _BadFile(Exception):
    pass


def _csv_rows(payload: bytes, contract: Contract) -> Iterator[tuple[list, str | None]]:
    try:
        text = payload.decode("utf-8-sig")
    except UnicodeDecodeError as e:
        raise _BadFile("not UTF-8") from e
    names = [f.name for f in contract.fields]
    lines = csv.reader(io.StringIO(text, newline=""), delimiter=contract.delimiter or ",", strict=True)
    try:
        _same_columns(next(lines, []), names)
        for values in lines:
            if values:  # blank lines are no rows
                yield values[: len(names)] + [None] * (len(names) - len(values)), "row has more values than the header" if len(values) > len(names) else None
    except csv.Error as e:
        raise _BadFile(f"broken CSV: {e}") from e


def _same_columns(found: list, names: list[str]) -> None:
    if sorted(found, key=str) != sorted(names):
        raise _BadFile(f"columns {found} are not {names}")
    if found != names:
        raise _BadFile("columns are in another order")


def _json_rows(payload: bytes, contract: Contract) -> Iterator[tuple[list, str | None]]:
    try:
        found = json.loads(payload.decode("utf-8"), parse_constant=_refuse, parse_int=_Number, parse_float=_Number)
    except (ValueError, RecursionError) as e:
        raise _BadFile("not strict JSON") from e
    if not isinstance(found, list):
        raise _BadFile("not a JSON array")
    for r in found:
        if not isinstance(r, dict):
            yield [None] * len(contract.fields), "not an object"
            continue
        wrong = [f.name for f in contract.fields if f.type == "string" and f.name in r and (not isinstance(r[f.name], str) or isinstance(r[f.name], _Number)) and r[f.name] is not None]
        yield [canonical(r.get(f.name)) for f in contract.fields], "; ".join(f"{n}: not a JSON string" for n in wrong) or None


def _xlsx_rows(payload: bytes, contract: Contract) -> Iterator[tuple[list, str | None]]:
    import zipfile
    from xml.etree.ElementTree import ParseError

    names = [f.name for f in contract.fields]
    try:
        lines = xlsx.rows(payload)
        _same_columns(next(lines, []), names)
        for values in lines:
            yield values[: len(names)] + [None] * (len(names) - len(values)), "row has more values than the header" if len(values) > len(names) else None
    except (zipfile.BadZipFile, KeyError, ParseError, StopIteration, IndexError) as e:
        raise _BadFile("not XLSX") from e


_PARSERS = {"csv": _csv_rows, "json": _json_rows, "xlsx": _xlsx_rows}
_PARSED = "_source_object string, _source_object_row_position bigint, fields array<string>, row_error string, file_error string"


def parsed_rows(path: str, payload: bytes, contract: Contract) -> Iterator[tuple]:
    """(object, position, texts, row error, file error); a broken file is one row.
    A file is gone through twice, first to learn that it isn't broken, so rows are
    handed on one by one and never listed."""
    parse = _PARSERS[contract.format]
    try:
        if not payload:
            raise _BadFile("empty file")
        for _ in parse(payload, contract):
            pass
    except _BadFile as e:
        yield path, None, None, None, str(e)
        return
    for position, (values, error) in enumerate(parse(payload, contract)):
        yield path, position, values, error, None


def read_vendor(spark: SparkSession, paths: list[str], contract: Contract) -> DataFrame:
    """Rows of vendor files as texts, with positions and errors. Parquet is read
    as any table is; of the other formats one task has a file."""
    if contract.format == "parquet":
        return reduce(DataFrame.unionByName, [_read_parquet(spark, p, contract) for p in paths])
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = parsed_rows(path, bytes(content), contract)
                while part := list(itertools.islice(rows, 5_000)):
                    yield pd.DataFrame(part, columns=["_source_object", "_source_object_row_position", "fields", "row_error", "file_error"]).astype({"_source_object_row_position": "Int64"})

    out = files.mapInPandas(parse, _PARSED)
    store = Files(spark, paths[0])  # Spark passes over empty files, so they are named here
    empty = [(p, None, None, None, "empty file") for p in paths if store.size(p) == 0]
    return out.unionByName(spark.createDataFrame(empty, _PARSED)) if empty else out


def _read_parquet(spark: SparkSession, path: str, contract: Contract) -> DataFrame:
    """One Parquet file; its footer is read here, its rows by the executors. Times
    come out as their day, other values as they are written."""
    names = [f.name for f in contract.fields]
    broken = lambda why: spark.createDataFrame([(path, None, None, None, why)], _PARSED)
    try:
        rows = spark.read.parquet(path)
    except Exception as e:  # what Spark raises for a footer it can't read differs
        if isinstance(e, AnalysisException) and "PATH_NOT_FOUND" in str(e):
            raise
        return broken("not Parquet")
    if set(rows.columns) != set(names):
        return broken(f"columns {rows.columns} are not {names}")
    text = {n: F.to_date(n).cast("string") if k.startswith("timestamp") else F.col(n).cast("string") for n, k in rows.dtypes}
    none = F.lit(None).cast("string")
    return rows.select(F.col("_metadata.file_path").alias("_source_object"), F.col("_metadata.row_index").alias("_source_object_row_position"), F.array(*[text[n] for n in names]).alias("fields"), none.alias("row_error"), none.alias("file_error"))


def with_reasons(rows: DataFrame, contract: Contract, spec: Spec | None = None) -> DataFrame:
    """``rows`` of read_vendor with ``reasons``: every broken rule of the row,
    joined by "; ", or null for a good row. A value that the column it is loaded
    into can't hold exactly breaks a rule too, if ``spec`` says what that is."""
    kinds = {f.name: f.dataType for f in spec.business} if spec else {}
    rules = [F.col("row_error")]
    for k, f in enumerate(contract.fields):
        v = F.get(F.col("fields"), F.lit(k))
        broken, blank = value_error(v, f, False), is_blank(v)
        rules.append(F.when(broken & blank, f"{f.name}: empty"))
        rules.append(F.when(broken & ~blank, f"{f.name}: no {f.type}"))
        if f.name in kinds and f.type in ("integer", "decimal"):
            held = v.try_cast(kinds[f.name])
            exact = held.cast("decimal(38,18)") == v.try_cast("decimal(38,18)")
            rules.append(F.when(~broken & ~blank & ~F.coalesce(exact, F.lit(False)), f"{f.name}: too long for {kinds[f.name].simpleString()}"))
    text = F.concat_ws("; ", *rules)
    return rows.withColumn("reasons", F.when(F.col("file_error").isNull() & (text != ""), text))


def good_rows(rows: DataFrame, contract: Contract, spec: Spec) -> DataFrame:
    """Typed columns of the good rows, with object and position."""
    good = rows.filter("file_error is null and reasons is null")
    kinds = {f.name: f.dataType for f in spec.business}
    return good.select(*[F.get(F.col("fields"), F.lit(k)).cast(kinds[f.name]).alias(f.name) for k, f in enumerate(contract.fields)], "_source_object", "_source_object_row_position")
