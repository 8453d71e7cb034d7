"""Relational operators of the retail models, as functions on DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import date_key, iso_weekday
from ..runtime import scratch_dir
from .segments import PIECE_ROWS, next_row

#: Rows of one key above which a lookup salts it.
HOT_ROWS = 1_000_000


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row of each key that comes first by ``order`` (descending columns, a
    unique one last, make it deterministic). Catalyst turns the filter on
    row_number into a group limit before the shuffle, so a hot key sends one
    row per map task."""
    names, rank = df.columns, "__rank"
    while rank in names:
        rank += "_"
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(rank) == 1).select(*names)


def is_baseline(operation: str = "operation") -> Column:
    return F.col(operation) == "r"


def boundary_lsn(operation: str = "operation", lsn: str = "source_lsn") -> Column:
    """LSN of a streamed change; null for every snapshot read."""
    return F.when(F.col(operation) != "r", F.col(lsn))


def current_state(events: DataFrame, key: str) -> DataFrame:
    """Live rows per key: rank all changes, take the last, then drop deletes."""
    order = [F.when(is_baseline(), 0).otherwise(1).desc(), F.col("source_lsn").desc_nulls_last(), F.col("kafka_offset").desc(), F.col("event_id").desc()]
    return latest_by(events, [key], order).filter(F.col("operation") != "d")


def boundary_winners(events: DataFrame, key: str) -> DataFrame:
    """The last change of each key at each LSN; all snapshot reads of a key are
    one boundary."""
    marked = events.withColumn("is_snapshot_baseline", is_baseline()).withColumn("__lsn", boundary_lsn())
    return latest_by(marked, [key, "is_snapshot_baseline", "__lsn"], [F.col("kafka_offset").desc(), F.col("event_id").desc()]).drop("__lsn")


#: Places before every LSN: the baseline, and streamed changes without LSN.
_BASELINE, _UNKNOWN = -(2**63), -(2**63) + 1


def scd2_versions(events: DataFrame, key: str, version_key: str, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Versions with half-open LSN intervals: the baseline first, then by LSN.
    Deletes close a version and open none; null start marks the baseline. Each
    version's successor is found in pieces of at most ``piece_rows`` rows, so a
    hot key is spread over tasks."""
    place = F.when(F.col("is_snapshot_baseline"), F.lit(_BASELINE)).otherwise(F.coalesce(F.col("source_lsn"), F.lit(_UNKNOWN)))
    winners = boundary_winners(events, key).withColumn("__place", place)
    out = (
        next_row(winners, key, "__place", ["source_lsn", "source_timestamp", "event_id"], "__next", piece_rows)
        .withColumn("valid_to_lsn", F.col("__next.source_lsn"))
        .withColumn("closed_at_source_timestamp", F.col("__next.source_timestamp"))
        .withColumn("is_current", F.col("__next").isNull())
        .filter(F.col("operation") != "d")
        .withColumn("valid_from_lsn", F.when(~F.col("is_snapshot_baseline"), F.col("source_lsn")))
        .withColumn(version_key, F.concat(F.col(key).cast("string"), F.lit("_"), F.col("event_id").cast("string")))
        .withColumnRenamed("source_timestamp", "opened_at_source_timestamp")
    )
    return out.drop("source_lsn", "__next", "__place")


def lifecycles(events: DataFrame, key: str) -> DataFrame:
    """Start of each key's current lifecycle: its last boundary whose final
    change is no delete and that is the baseline or saw a create."""
    creates = F.sum((F.col("operation") == "c").cast("int")).over(Window.partitionBy(key, is_baseline(), boundary_lsn()))
    starts = boundary_winners(events.withColumn("__creates", creates), key)
    starts = starts.filter((F.col("operation") != "d") & (F.col("is_snapshot_baseline") | (F.col("__creates") > 0)))
    order = [F.when(F.col("is_snapshot_baseline"), 0).otherwise(1).desc(), F.col("source_lsn").desc_nulls_last(), F.col("kafka_offset").desc(), F.col("event_id").desc()]
    return latest_by(starts, [key], order).select(key, F.col("operation").alias("lifecycle_operation"), F.col("source_lsn").alias("lifecycle_start_lsn"), "is_snapshot_baseline")


def daily_rates(rates: DataFrame, last_day: Column | None = None) -> DataFrame:
    """(currency, day, rate): each rate carried to the day before the next, so an
    as-of join becomes an equi-join on (currency, day) without expansion of the
    probe side. Its size is currencies x days, whatever the orders are."""
    w = Window.partitionBy("currency").orderBy("rate_date")
    until = F.coalesce(F.date_sub(F.lead("rate_date").over(w), 1), last_day if last_day is not None else F.current_date())
    spans = rates.withColumn("__until", until).filter(F.col("__until") >= F.col("rate_date"))
    return spans.select("currency", F.explode(F.sequence("rate_date", "__until")).alias("day"), "rate", "rate_date")


def asof_rate(orders: DataFrame, rates: DataFrame, day: Column, last_day: Column | None = None) -> DataFrame:
    """``orders`` with the latest rate on or before ``day`` as rate_to_eur:
    units of the order's currency per euro, 1 for euro, null where none is known."""
    daily = daily_rates(rates, last_day).select(F.col("currency").alias("__c"), F.col("day").alias("__d"), F.col("rate").alias("__r"))
    joined = orders.join(daily, (F.col("currency") == F.col("__c")) & (day == F.col("__d")), "left")
    one = F.expr("cast(1 as decimal(18,6))") if dict(rates.dtypes)["rate"].startswith("decimal") else F.lit(1.0)
    return joined.withColumn("rate_to_eur", F.when(F.col("currency") == "EUR", one).otherwise(F.col("__r"))).drop("__c", "__d", "__r")


def calendar(first: Column, last: Column, source: DataFrame) -> DataFrame:
    """One row per day between two aggregates of ``source``; none if it is empty."""
    days = source.agg(first.alias("a"), last.alias("b")).select(F.explode(F.sequence("a", "b")).alias("full_date"))
    dow = iso_weekday(F.col("full_date"))
    return days.select(
        date_key(F.col("full_date")).alias("date_key"),
        "full_date",
        F.year("full_date").alias("year_number"),
        F.quarter("full_date").alias("quarter_number"),
        F.month("full_date").alias("month_number"),
        F.date_format("full_date", "MMMM").alias("month_name"),
        F.dayofmonth("full_date").alias("day_number"),
        dow.alias("day_of_week"),
        F.date_format("full_date", "EEEE").alias("day_name"),
        dow.isin(6, 7).alias("is_weekend"),
    )


def after_watermark(df: DataFrame, stamp: str, key: str, after: tuple | None) -> DataFrame:
    """Rows after a watermark (stamp, key), in no order; all if there is none.
    The comparison is spelled out so that the stamp bound reaches the scan."""
    if after is None:
        return df
    at = F.lit(after[0])
    return df.filter((F.col(stamp) >= at) & ((F.col(stamp) > at) | (F.col(key) > F.lit(after[1]))))


def keyset_page(df: DataFrame, stamp: str, key: str, after: tuple | None, size: int | None = None) -> DataFrame:
    """``after_watermark`` in its order; the first ``size`` rows if given."""
    df = after_watermark(df, stamp, key, after).orderBy(stamp, key)
    return df.limit(size) if size else df


def except_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Distinct rows of ``old`` that ``new`` lacks, nulls equal: the proof that a
    rewrite lost nothing."""
    return old.select(*old.columns).subtract(new.select(*old.columns))


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Child rows whose non-null key has no parent."""
    p = parent.select(F.col(parent_key).alias("__p"))
    return child.filter(F.col(key).isNotNull()).join(p, F.col(key) == F.col("__p"), "left_anti")


def gated(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Child rows with a live parent (parent keys are unique, so a semi join)."""
    p = parent.select(F.col(parent_key).alias("__p"))
    return child.join(p, F.col(key) == F.col("__p"), "left_semi")


def lookup(left: DataFrame, key: str, right: DataFrame, right_key: str, how: str = "left", hot_rows: int = HOT_ROWS, rows: int | None = None) -> DataFrame:
    """``left`` joined to ``right``, whose ``right_key`` is unique, so that no key
    of ``left`` brings more than about ``hot_rows`` rows into one task: rows of
    hot keys are salted before they are shuffled, by a hash of the whole row, and
    the one row they look up is copied to each salt. The list of hot keys, which is
    broadcast, has at most rows / ``hot_rows`` rows. Where ``left`` is known to
    have ``rows`` rows and that is no more than ``hot_rows``, no key can be hot and
    none is looked for."""
    if rows is not None and rows <= hot_rows:
        return left.join(right, F.col(key) == F.col(right_key), how)
    counts = left.groupBy(F.col(key).alias("__hot")).agg(F.count("*").alias("__n"))
    hot = F.broadcast(counts.filter(F.col("__n") > hot_rows).select("__hot", F.ceil(F.col("__n") / hot_rows).cast("int").alias("__salts")))
    row = F.xxhash64(*[F.col(c) for c in left.columns])
    # null keys find nothing, so they may go anywhere
    at = F.when(F.col(key).isNull(), F.pmod(row, F.lit(1024))).otherwise(F.coalesce(F.pmod(row, F.col("__salts")), F.lit(0))).cast("int")
    spread = left.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__salt", at).drop("__hot", "__salts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts"), F.lit(1)) - 1)).alias("__copy")
    found = right.join(hot, F.col(right_key) == F.col("__hot"), "left").select(*right.columns, copies)
    return spread.join(found, (F.col(key) == F.col(right_key)) & (F.col("__salt") == F.col("__copy")), how).drop("__salt", "__copy")


def time_cuts(rows: DataFrame, stamp: Column, parts: int) -> list[int]:
    """Ascending times (microseconds) that end all but the last of ``parts``
    parts of about as many rows; fewer where many rows share a time."""
    shares = [k / parts for k in range(1, parts)]
    at = F.unix_micros(stamp.cast("timestamp"))
    found, last = rows.agg(F.percentile_approx(at, shares, 10_000) if shares else F.lit(None), F.max(at)).first()
    return sorted({c for c in found or [] if c < last})


def in_time_order(rows: DataFrame, stamp: Column, parts: int, name: str = "batches") -> list[DataFrame]:
    """``rows`` in batches of about as many rows by ``stamp`` (null last), written
    once, so that a batch is read without the others."""
    cuts = time_cuts(rows, stamp, parts)
    at = F.unix_micros(stamp.cast("timestamp"))
    number = F.when(at.isNull(), len(cuts)).otherwise(sum(((at > c).cast("int") for c in cuts), F.lit(0)))
    path = scratch_dir(rows.sparkSession, name)
    rows.withColumn("__batch", number.cast("int")).write.partitionBy("__batch").parquet(path)
    # a batch without rows has no folder
    whole = rows.sparkSession.read.schema(T.StructType([*rows.schema.fields, T.StructField("__batch", T.IntegerType())])).parquet(path)
    out = [whole.filter(F.col("__batch") == k).drop("__batch") for k in range(len(cuts) + 1)]
    for b in out:
        b._scratch = path
    return out
