"""Problem 6: rows that fail to parse, with the first reason that applies.

Every column of a record is loaded as nullable text; rules give an array of
errors per record, in the order syntax, columns, value; a record is good where
that array is empty. Delimited records are checked and taken apart by possessive
patterns, which run in constant stack on fields of any length. JSON records go
through a strict parser in Arrow batches.

Edge cases: a null record is a syntax error; one of a source without contract
breaks ``columns``; an empty delimited record is one empty field; of a name
repeated in a JSON object the last holds; fields not required may be empty;
other columns of the input are carried in their places.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Contracts are configuration; more fields than this are a mistake.
MOST_FIELDS = 10_000

_BLANK = r"(?U)^\s*$"
_PATTERNS = {"integer": r"^-?[0-9]+\z", "decimal": r"^[0-9]+(\.[0-9]+)?\z", "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z", "boolean": r"^(?i)(true|false)\z"}


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    required: bool = True


@dataclass(frozen=True)
class Contract:
    source: str
    format: str
    delimiter: str | None
    fields: tuple[Field, ...]


def contracts(fields: DataFrame) -> list[Contract]:
    """Contracts from their table, one row per field."""
    rows = fields.orderBy("source", "field_position").limit(MOST_FIELDS + 1).collect()
    if len(rows) > MOST_FIELDS:
        raise ValueError("the contract table has more fields than a contract table can have")
    by: dict[str, list] = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    return [Contract(s, r[0].file_format, r[0].delimiter, tuple(Field(f.field_name, f.field_type, bool(f.required)) for f in r)) for s, r in by.items()]


def delimited_fields(record: Column, delimiter: str) -> Column:
    """Fields of a delimited record, or null if its quoting is broken."""
    d = "".join("\\" + c for c in delimiter)
    field = rf'(?:"[^"]*+(?:""[^"]*+)*+"|[^"{d}]*+)'
    led = F.concat(F.lit(delimiter), record)
    raw = F.regexp_extract_all(led, F.lit(f"{d}({field})"), F.lit(1))
    plain = F.transform(raw, lambda f: F.when(f.startswith('"'), F.replace(F.substr(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f))
    return F.when(led.rlike(rf"^(?:{d}{field})++\z"), plain)


def _refuse(token: str):
    raise ValueError(token)


class _Number(str):
    """A number's text, kept as written."""


def strict_object(text: str) -> dict | None:
    """A JSON object by the strict grammar, numbers as written; else None."""
    try:
        found = json.loads(text, parse_constant=_refuse, parse_int=_Number, parse_float=_Number)
    except ValueError:
        return None
    except RecursionError:
        found = deep_object(text)
    return found if isinstance(found, dict) else None


def deep_object(text: str) -> dict | None:
    """The same for any depth: one pass with a stack. Objects and arrays within
    the outer object are checked and come out as numbers do, as their text."""
    import regex

    token = regex.compile(r'[ \t\n\r]*+(?:("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")|(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?|true|false|null)|([{}\[\],:]))')
    end = len(text.rstrip(" \t\n\r"))
    stack: list[str] = []  # open objects and arrays
    want = "value"  # or key, colon, next; "first" allows the container to close
    out: dict = {}
    at, name, began = 0, None, 0
    while at < end:
        m = token.match(text, at)
        if m is None:
            return None
        string, scalar, mark = m.groups()
        start, at = m.start(m.lastindex), m.end()
        closes = mark in ("}", "]") and mark is not None
        if closes and (want == "next" or want in ("firstkey", "first")):
            if not stack or stack.pop() != {"}": "{", "]": "["}[mark]:
                return None
            want = "next"
            if len(stack) == 1:
                out[name] = _Number(text[began:at])
            if not stack:
                return out if at == end else None
        elif want in ("key", "firstkey") and string:
            name, want = (json.loads(string), "colon") if len(stack) == 1 else (name, "colon")
        elif want == "colon" and mark == ":":
            want, began = "value", at if len(stack) == 1 else began
        elif want == "next" and mark == ",":
            want = "key" if stack[-1] == "{" else "value"
        elif want in ("value", "first") and (string or scalar):
            if len(stack) == 1:
                out[name] = json.loads(string) if string else None if scalar == "null" else _Number(scalar)
            want = "next"
            if not stack:
                return None
        elif want in ("value", "first") and mark in ("{", "["):
            if not stack and mark == "[":
                return None
            if len(stack) == 1:
                began = start
            stack.append(mark)
            want = "firstkey" if mark == "{" else "first"
        else:
            return None
    return None


def json_fields(names: tuple[str, ...]):
    """Pandas UDF: record -> one text per name, marked s (JSON string) or x (any
    other value), null where the name is missing; null if not an object."""

    @F.pandas_udf("array<string>")
    def take(records: pd.Series) -> pd.Series:
        out = []
        for text in records:
            found = None if text is None else strict_object(text)
            if found is None:
                out.append(None)
                continue
            row = []
            for n in names:
                if n not in found:
                    row.append(None)
                    continue
                v = found[n]
                if isinstance(v, str) and not isinstance(v, _Number):
                    row.append("s" + v.encode("utf-8", "replace").decode("utf-8"))
                else:
                    row.append("x" + ("" if v is None else v if isinstance(v, _Number) else json.dumps(v)))
            out.append(row)
        return pd.Series(out, dtype=object)

    return take


def is_blank(value: Column) -> Column:
    """Null, empty, or white space of any script only."""
    return F.coalesce(value.rlike(_BLANK), F.lit(True))


def value_error(text: Column, field: Field, marked: bool) -> Column:
    """Whether a field's text breaks its type or its being required. These are
    the rules of landing and loading vendor files as well."""
    value = F.substr(text, F.lit(2)) if marked else text
    blank = is_blank(value)
    if field.type == "string":
        wrong = ~text.startswith("s") if marked else F.lit(False)
    elif field.type == "date":
        wrong = ~(value.rlike(_PATTERNS["date"]) & ~value.startswith("0000") & F.try_to_date(F.substr(value, F.lit(1), F.lit(10)), "yyyy-MM-dd").isNotNull())
    elif field.type in _PATTERNS:
        wrong = ~value.rlike(_PATTERNS[field.type])
    else:
        raise ValueError(f"field type {field.type!r} is not in the contract language")
    return F.coalesce(F.when(blank, F.lit(field.required)).otherwise(wrong), F.lit(True))


def once(record: Column) -> Column:
    """``record`` as an expression that Catalyst doesn't duplicate: a filter on
    the errors would else be pushed below the rules and evaluate them again."""
    return F.when(F.monotonically_increasing_id() >= 0, record)


def with_errors(records: DataFrame, contract: Contract, values: str, errors: str, record: Column) -> DataFrame:
    """``records`` with the contract's field texts in the column ``values`` and
    the array of its broken rules in ``errors``."""
    marked = contract.format == "json"
    fields = json_fields(tuple(f.name for f in contract.fields))(record) if marked else delimited_fields(record, contract.delimiter)
    records = records.withColumn(values, fields)
    v = F.col(values)
    syntax = v.isNull()
    columns = F.exists(v, lambda x: x.isNull()) if marked else F.size(v) != len(contract.fields)
    wrong = F.lit(False)
    for k, f in enumerate(contract.fields):
        wrong = wrong | value_error(F.get(v, F.lit(k)), f, marked)
    found = F.array(F.when(syntax, "syntax"), F.when(~syntax & columns, "columns"), F.when(~syntax & ~columns & wrong, "value"))
    return records.withColumn(errors, F.array_compact(found))


def free_prefix(names: list[str]) -> str:
    """A prefix that no input column has, for columns of our own."""
    prefix = "__"
    while any(n.startswith(prefix) for n in names):
        prefix += "_"
    return prefix


def rejected(records: DataFrame, table: list[Contract], record: str = "raw_record") -> DataFrame:
    """All input columns of the bad records, with ``reason`` (which replaces an
    input column of that name); one scan for all contracts, each of which sees
    only the records of its source."""
    names, own = records.columns, free_prefix(records.columns)
    errors = F.when(F.col(record).isNull(), F.array(F.lit("syntax")))
    out = records
    for k, c in enumerate(table):
        mine = F.col("source") == c.source
        out = with_errors(out, c, f"{own}v{k}", f"{own}e{k}", once(F.when(mine, F.col(record))))
        errors = errors.when(mine, F.col(f"{own}e{k}"))
    errors = errors.otherwise(F.array(F.lit("columns")))  # of no known source
    bad = out.withColumn(f"{own}errors", errors).filter(F.size(f"{own}errors") > 0)
    return bad.select(*[n for n in names if n != "reason"], F.element_at(f"{own}errors", 1).alias("reason"))


def typed(records: DataFrame, contract: Contract, record: str = "raw_record") -> DataFrame:
    """The good records of one contract as typed columns, besides those of the
    input (a field named like an input column gets the prefix ``value_``).
    An integer beyond 64 bits or a decimal of more than 32 digits before the
    point or 6 behind it doesn't fit its column: it is null there, never rounded,
    and stands as written in the map ``as_written`` (field -> text), which is null
    in other rows."""
    good, values = _good(records, contract, record)
    taken = {*records.columns, *[f.name for f in contract.fields]}
    rest = "value_as_written" if "as_written" in taken else "as_written"
    out = [F.when(~_lossy(text, f), _cast(text, f)).alias(f"value_{f.name}" if f.name in records.columns else f.name) for f, text in values]
    lost = F.array_compact(F.array(*[F.when(_lossy(text, f), F.struct(F.lit(f.name).alias("field"), text.alias("exact"))) for f, text in values]))
    return good.select(*records.columns, *out, F.when(F.size(lost) > 0, F.map_from_entries(lost)).alias(rest))


def inexact(records: DataFrame, contract: Contract, record: str = "raw_record") -> DataFrame:
    """The input columns, ``field`` and ``exact`` (the text as written) of every
    number in a good record that doesn't fit its column."""
    good, values = _good(records, contract, record)
    lost = [(f, text, _lossy(text, f)) for f, text in values if f.type in ("integer", "decimal")]
    found = [F.when(why, F.struct(F.lit(f.name).alias("field"), text.alias("exact"))) for f, text, why in lost]
    kind = "array<struct<field:string,exact:string>>"
    one = F.explode(F.array_compact(F.array(*found)) if found else F.array().cast(kind)).alias("__lost")
    return good.select(*records.columns, one).select(*records.columns, "__lost.field", "__lost.exact")


_KINDS = {"integer": "bigint", "decimal": "decimal(38,6)", "date": "date", "boolean": "boolean", "string": "string"}


def _cast(text: Column, field: Field) -> Column:
    return text if field.type == "string" else text.try_cast(_KINDS[field.type])


def _lossy(text: Column, field: Field) -> Column:
    """Whether the text is a number that its column can't hold exactly."""
    if field.type not in ("integer", "decimal"):
        return F.lit(False)
    wrong = _cast(text, field).isNull() & ~is_blank(text)
    return F.coalesce(wrong | text.rlike(r"\.[0-9]{6}[0-9]*[1-9]") if field.type == "decimal" else wrong, F.lit(False))


def _good(records: DataFrame, contract: Contract, record: str) -> tuple[DataFrame, list[tuple[Field, Column]]]:
    """Good records, and each field with its text."""
    own = free_prefix(records.columns)
    good = with_errors(records.filter(F.col("source") == contract.source), contract, f"{own}values", f"{own}errors", once(F.col(record)))
    texts = [F.get(F.col(f"{own}values"), F.lit(k)) for k in range(len(contract.fields))]
    if contract.format == "json":
        texts = [F.substr(t, F.lit(2)) for t in texts]
    return good.filter(F.size(f"{own}errors") == 0), list(zip(contract.fields, texts, strict=True))


def file_counts(manifests: DataFrame, records: DataFrame, table: list[Contract]) -> DataFrame:
    """Manifests with their true row and rejected row counts, by object."""
    n = records.groupBy("object_key").agg(F.count("*").alias("n"))
    bad = rejected(records, table).groupBy("object_key").agg(F.count("*").alias("bad"))
    true = n.join(bad, "object_key", "left").select(F.col("object_key").alias("__k"), "n", "bad")
    joined = manifests.join(true, F.col("object_key") == F.col("__k"), "left")
    return joined.select("batch_id", "object_key", F.coalesce("n", F.lit(0)).alias("true_row_count"), F.coalesce("bad", F.lit(0)).alias("true_rejected_row_count"))
