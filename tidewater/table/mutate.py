"""Guarded updates and deletes of snapshot tables, children with their parents.

Parquet files don't change, so the partitions that hold affected rows are
rewritten and replaced in one commit on the snapshot that was read: a writer that
comes in between makes it fail (CommitConflict), so a guard that held when it was
looked at holds when the change is committed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .snapshots import NULL_PARTITION, Snapshot, SnapshotTable


def _affected(table: SnapshotTable, parent: Snapshot, condition: Column) -> tuple[list[str], int]:
    """Partitions that hold rows meeting the condition (all data of a table
    without partitions is one), and the number of those rows."""
    by = table.partition_by
    part = F.coalesce(F.col(by).cast("string"), F.lit(NULL_PARTITION)) if by else F.lit("")
    found = table.read(parent.id).filter(condition).groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()  # one row per partition
    return [r.p for r in found], sum(r.n for r in found)


def update_where(table: SnapshotTable, guard: Column, values: Mapping[str, Column]) -> int:
    """Set columns of the rows that meet the guard (null doesn't); returns how
    many. No row, no commit."""
    parent = table.snapshot()
    parts, n = _affected(table, parent, guard) if parent else ([], 0)
    if n:
        met = F.coalesce(guard, F.lit(False))
        rows = table.read(parent.id, parts)
        changed = rows.select(*[F.when(met, values[f.name]).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name) if f.name in values else F.col(f.name) for f in table.schema])
        table.overwrite(changed, parts, parent)
    return n


def delete_where(table: SnapshotTable, condition: Column, children: Sequence[tuple[SnapshotTable, str, str]] = ()) -> dict[str, int]:
    """Delete the rows that meet the condition and, before them, the rows of the
    children (table, column, parent's column) that refer to them; so a run that
    breaks off leaves no row without its parent, and running again ends it.
    Returns rows deleted by table root."""
    parent = table.snapshot()
    parts, n = _affected(table, parent, condition) if parent else ([], 0)
    gone = {}
    if not n:
        return {table.root: 0} | {c.root: 0 for c, _, _ in children}
    doomed = table.read(parent.id, parts).filter(condition)
    for child, column, key in children:
        gone[child.root] = _delete_matching(child, column, doomed.select(F.col(key).alias("__k")).distinct())
    table.overwrite(table.read(parent.id, parts).filter(~F.coalesce(condition, F.lit(False))), parts, parent)
    return {table.root: n} | gone


def _delete_matching(table: SnapshotTable, column: str, keys: DataFrame) -> int:
    parent, by = table.snapshot(), table.partition_by
    if parent is None:
        return 0
    rows = table.read(parent.id)
    part = F.coalesce(F.col(by).cast("string"), F.lit(NULL_PARTITION)) if by else F.lit("")
    found = rows.join(keys, F.col(column) == F.col("__k"), "left_semi").groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()  # one row per partition
    if found:
        parts = [r.p for r in found]
        table.overwrite(table.read(parent.id, parts).join(keys, F.col(column) == F.col("__k"), "left_anti"), parts, parent)
    return sum(r.n for r in found)
