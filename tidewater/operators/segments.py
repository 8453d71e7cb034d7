"""Cutting long ordered sequences into pieces of bounded size.

One key may hold a third of all rows, so a window over (key) alone would put
them into one task. Instead all rows are put into one global order (keys by
their hash, then the position), sorted by range partitions, and the sorted
partitions are cut every ``PIECE_ROWS`` rows. No piece holds more than that,
whatever the number of rows and however they are spread over keys: a key with
many rows lies in many pieces, many small keys share one. What happens across
the borders of pieces is settled on one summary row per piece.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut

#: Most rows of a piece.
PIECE_ROWS = 200_000

_ROW_BITS = 33  # of monotonically_increasing_id: partition above, row below


def in_pieces(rows: DataFrame, order: Sequence[str | Column], size: int = PIECE_ROWS, piece: str = "__piece", name: str = "pieces", partitions: int | None = None) -> DataFrame:
    """``rows`` with a long ``piece``; pieces ascend in the given order and hold
    at most ``size`` rows. Written once, so that every reader sees the same
    pieces. The number of range partitions is the session's if not given, so the
    cut, not the sample behind the range bounds, is what bounds a piece."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = rows.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order).withColumn(piece, F.monotonically_increasing_id())
    row = F.col(piece).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return cut(placed.withColumn(piece, F.col(piece) - row % size), name)


def by_key(key: str) -> list[Column]:
    """Order that brings the rows of a key together, keys spread by their hash."""
    return [F.xxhash64(key), F.col(key)]


def _beside(placed: DataFrame, key: str, position: str, wanted: list[str], name: str, ahead: bool) -> DataFrame:
    """``placed`` (rows with a ``__piece``) with a struct of the ``wanted``
    columns of the key's row before or after by ``position``."""
    inner = Window.partitionBy("__piece").orderBy(*by_key(key), position)
    over = Window.partitionBy(F.lit(0)).orderBy("__piece")  # one row per piece
    step = F.lead if ahead else F.lag
    beside, place = F.struct(F.col(key).alias("__k"), *wanted), F.struct(*by_key(key), F.col(position))
    edge = placed.groupBy("__piece").agg((F.min_by if ahead else F.max_by)(beside, place).alias("edge"))
    outer = edge.select(F.col("__piece").alias("__p"), step("edge").over(over).alias("__outer"))
    inside = placed.withColumn("__inside", step(beside).over(inner))
    joined = inside.join(outer, F.col("__piece") == F.col("__p")).withColumn("__at", F.coalesce("__inside", "__outer"))
    found = F.when(F.col("__at").isNotNull() & F.col("__at.__k").eqNullSafe(F.col(key)), F.struct(*[F.col(f"__at.{w}").alias(w) for w in wanted]))
    return joined.withColumn(name, found).drop("__inside", "__outer", "__at", "__p")


def next_row(rows: DataFrame, key: str, position: str, wanted: list[str], name: str = "next", size: int = PIECE_ROWS) -> DataFrame:
    """``rows`` with a struct ``name`` of the ``wanted`` columns of the key's next
    row by ``position`` (null for the last): lead() that no hot key can overload.
    Needs one row per (key, position)."""
    return _beside(in_pieces(rows, [*by_key(key), position], size), key, position, wanted, name, True).drop("__piece")


def previous_row(rows: DataFrame, key: str, position: str, wanted: list[str], name: str = "previous", size: int = PIECE_ROWS) -> DataFrame:
    """The same with the row before: lag()."""
    return _beside(in_pieces(rows, [*by_key(key), position], size), key, position, wanted, name, False).drop("__piece")


def changes(rows: DataFrame, key: str, position: str, state: str, size: int = PIECE_ROWS) -> DataFrame:
    """Rows of each key whose ``state`` differs from the row before, with
    ``next_position``: that of the key's next such row (null for the last).
    Needs one row per (key, position)."""
    marked = _beside(in_pieces(rows, [*by_key(key), position], size), key, position, [state], "__before", False)
    same = F.col("__before").isNotNull() & F.col("__before")[state].eqNullSafe(F.col(state))
    kept = _beside(marked.filter(~same).drop("__before"), key, position, [position], "__next", True)
    return kept.withColumn("next_position", F.col("__next")[position]).drop("__next", "__piece")
