"""Problem 3: a change feed applied as a commutative fold.

State is one row per (table, entity): the largest ``(sequence, operation,
payload)`` seen so far, deletes included. The maximum is commutative,
associative and idempotent, so repeated and out-of-order changes, and batches
in any order, give the same state; a kept delete (tombstone) beats changes that
come late. Rows of the state take part like any other change.

Sequence: snapshot reads first, then source_lsn (null lowest), then
kafka_offset; among snapshot reads only the offset counts.

Edge cases: a row whose key holds no integer belongs to no entity and is left
out; operations are read without case and outer blanks; at one sequence the
larger operation and then the larger payload text win, so ties are defined; an
empty feed gives an empty state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entity_id(key_json: Column) -> Column:
    """The integer in a key such as ``{"customer_id": 7}``, however spaced."""
    return F.regexp_extract(key_json, r':\s*"?(-?[0-9]+)"?\s*}', 1).try_cast("bigint")


def fold(changes: DataFrame, payload: str = "after_json", base: DataFrame | None = None) -> DataFrame:
    """State after ``changes`` on top of ``base`` (a state made by this function).
    Columns: source_table, entity_id, last struct(streamed, lsn, kafka_offset,
    operation, payload)."""
    op = F.lower(F.trim(F.col("operation")))
    streamed = F.coalesce(op != "r", F.lit(True))
    last = F.struct(
        streamed.alias("streamed"),
        F.when(streamed, F.col("source_lsn")).alias("lsn"),
        F.col("kafka_offset").alias("kafka_offset"),
        op.alias("operation"),
        F.col(payload).alias("payload"),
    )
    rows = changes.select("source_table", entity_id(F.col("key_json")).alias("entity_id"), last.alias("last"))
    rows = rows.filter(F.col("entity_id").isNotNull())
    if base is not None:
        rows = rows.unionByName(base)
    return rows.groupBy("source_table", "entity_id").agg(F.max("last").alias("last"))


def live(state: DataFrame) -> DataFrame:
    """Entities that exist: the state without its tombstones."""
    alive = F.coalesce(F.col("last.operation") != "d", F.lit(True))
    return state.filter(alive).select("source_table", "entity_id", F.col("last.kafka_offset").alias("kafka_offset"), F.col("last.lsn").alias("source_lsn"), F.col("last.payload").alias("after_json"))
