"""Scalar functions whose meaning differs between SQL engines, pinned down.

All are column expressions that stay inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_scalar(text: Column, path: str) -> Column:
    """Text of a JSON scalar; null for objects, arrays, null and broken JSON."""
    found = F.get_json_object(text, path)
    return F.when(~found.rlike(r"^\s*[\[{]") | F.get_json_object(text, path + ".x").isNull() & F.json_array_length(found).isNull() & F.json_object_keys(found).isNull(), found)


def iso_weekday(day: Column) -> Column:
    """Monday 1 to Sunday 7."""
    return F.weekday(day) + 1


def complete_minutes(start: Column, end: Column) -> Column:
    """Whole minutes between two times, not minute boundaries crossed."""
    return F.timestamp_diff("MINUTE", start, end)


def date_key(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd").cast("int")


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyyMM").cast("int")


def event_identity(topic: Column, partition: Column, offset: Column) -> Column:
    """Lower-case hex SHA-256 of topic:partition:offset; null if a part is null."""
    return F.sha2(F.concat(topic, F.lit(":"), partition.cast("string"), F.lit(":"), offset.cast("string")), 256)


def epoch_timestamp(ns: Column, us: Column, ms: Column) -> Column:
    """The finest given of three epoch fields, in whole microseconds."""
    whole = F.when(ns.isNotNull(), F.floor(ns.cast("decimal(20,0)") / 1000).cast("bigint"))
    return F.timestamp_micros(F.coalesce(whole, us, ms * 1000))


def quantized(amount: Column) -> Column:
    """Money to cents, half up, as decimal(12,2)."""
    return F.round(amount.cast("decimal(38,10)"), 2).cast("decimal(12,2)")


def power_weight(rank: Column, exponent: float = 0.7) -> Column:
    """1 / (rank + 1) ** exponent: popularity weights of generators."""
    return 1 / F.pow(rank + 1, F.lit(exponent))


def filtered_sum(value: Column, condition: Column) -> Column:
    """sum(value) filter (where condition), 0 over no rows."""
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0))


def distinct_rows(*columns: str) -> Column:
    """count(distinct row(...)): rows with null fields count too."""
    return F.count_distinct(F.struct(*columns))
