"""Change capture: Debezium-shaped messages to the append-only event ledger.

Validation is a set of column rules; a batch with any broken message fails
before anything is written, so a checkpoint never passes it. The sink is
insert-only on (event_id, event_date): a replayed batch, however old, adds
nothing. Late and out-of-order messages are kept as events of their own; there
is no watermark and nothing is dropped.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import epoch_timestamp, event_identity
from ..operators.relational import latest_by
from ..runtime import Files
from ..sources.specs import CAPTURED, LEDGER, SPECS, TOPIC
from ..table.snapshots import NULL_PARTITION, CommitConflict, SnapshotTable

#: Shape of a message as it is read from a topic (or a file of messages).
MESSAGES = "topic string, partition int, offset bigint, timestamp timestamp, key binary, value binary"
_ENVELOPE = "before string, after string, source struct<schema: string, table: string, lsn: bigint, txId: bigint, ts_ns: bigint, ts_us: bigint, ts_ms: bigint>, op string"


class InvalidMessages(ValueError):
    """A batch holds messages that break the contract."""


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """JSON with sorted keys and no spaces; null stays null."""
    return texts.map(lambda t: None if t is None else json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False), na_action="ignore")


def parsed(messages: DataFrame) -> DataFrame:
    """Ledger columns (but ingested_at) plus ``errors`` array<string>, in the
    order the rules are checked; empty for a sound message."""
    ok = F.is_valid_utf8(F.col("value")) & F.is_valid_utf8(F.coalesce(F.col("key"), F.lit(b"")))
    rows = messages.select("*", ok.alias("utf8"), F.when(ok, F.col("key").cast("string")).alias("k"), F.when(ok, F.col("value").cast("string")).alias("v"))
    rows = rows.withColumn("e", F.from_json("v", _ENVELOPE, {"mode": "PERMISSIVE", "allowSingleQuotes": "false"}))
    table = F.col("e.source.table")
    pk = F.create_map(*[x for t in CAPTURED for x in (F.lit(t), F.lit(SPECS[t].key[0]))])
    name = F.element_at(pk, table)
    names = F.json_object_keys("k")
    key_of = lambda text: F.expr(f"get_json_object({text}, concat('$.', pk))")
    rows = rows.withColumn("pk", F.coalesce(name, F.lit("")))
    key_value = key_of("k")
    op, after = F.col("e.op"), F.col("e.after")
    has_after = after.isNotNull()
    rules = [
        (~F.col("utf8"), "not UTF-8"),
        (F.col("v").isNull() | F.col("e").isNull() | F.get_json_object("v", "$.op").isNull(), "no JSON envelope"),
        (~F.coalesce(op.isin("r", "c", "u", "d"), F.lit(False)), "unknown operation"),
        (~F.coalesce((F.col("e.source.schema") == "public") & table.isin(*CAPTURED) & (F.col("topic") == F.concat(F.lit(TOPIC.format("")), table)), F.lit(False)), "route"),
        (~F.coalesce((F.size(names) == 1) & (F.element_at(names, 1) == F.col("pk")) & key_value.rlike("^-?[0-9]+$"), F.lit(False)), "key shape"),
        (op.isin("r", "c", "u") & ~has_after, "no row after"),
        ((op == "d") & has_after, "row after a delete"),
        (op.isin("r", "c", "u") & has_after & ~F.coalesce(key_of("e.after") == key_value, F.lit(False)), "key differs from row"),
        (F.col("topic").isNull() | F.col("partition").isNull() | F.col("offset").isNull() | (F.col("offset") < 0), "coordinate"),
    ]
    errors = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules]))
    at = epoch_timestamp(F.col("e.source.ts_ns"), F.col("e.source.ts_us"), F.col("e.source.ts_ms"))
    return rows.select(
        event_identity(F.col("topic"), F.col("partition"), F.col("offset")).alias("event_id"), F.col("topic").alias("kafka_topic"), F.col("partition").alias("kafka_partition"), F.col("offset").alias("kafka_offset"), F.col("timestamp").alias("kafka_timestamp"),
        F.col("e.source.schema").alias("source_schema"), table.alias("source_table"), op.alias("operation"), F.col("e.source.lsn").alias("source_lsn"), F.col("e.source.txId").alias("source_tx_id"),
        at.alias("source_timestamp"), F.col("k").alias("key_json"), F.col("v").alias("envelope_json"), F.col("e.before").alias("before_json"), after.alias("after_json"),
        F.to_date(F.coalesce(at, F.col("timestamp"))).alias("event_date"), errors.alias("errors"),
    )


def ledger_at(spark, root: str) -> SnapshotTable:
    return SnapshotTable(spark, root).create(LEDGER, "event_date")


class DuplicateEvents(ValueError):
    """A batch for the ledger holds an event twice."""


def first_of_each(events: DataFrame) -> DataFrame:
    """One copy of every event id: the first by its broker's time."""
    return latest_by(events, ["event_id", "event_date"], [F.col("kafka_timestamp").asc_nulls_last(), F.xxhash64("envelope_json", "key_json")])


def append_new(ledger: SnapshotTable, events: DataFrame) -> int:
    """Insert events the ledger lacks; returns how many. Only partitions of the
    batch's event dates are read, so the cost follows the batch. What is new is
    worked out against one snapshot and committed on top of it: if another
    writer comes in between, that is a CommitConflict and nothing is inserted."""
    parent = ledger.snapshot()
    day = F.coalesce(F.col("event_date").cast("string"), F.lit(NULL_PARTITION)).alias("d")
    seen = events.groupBy("event_id", day).agg(F.count("*").alias("n")).groupBy("d").agg(F.max("n").alias("n")).collect()  # one row a day
    if any(r.n > 1 for r in seen):
        raise DuplicateEvents(f"events come twice on {', '.join(r.d for r in seen if r.n > 1)}")
    if not seen:
        return 0
    fresh = events
    if parent:
        have = ledger.read(parent.id, [r.d for r in seen]).select(F.col("event_id").alias("__id"), F.col("event_date").alias("__day"))
        fresh = events.join(have, (F.col("event_id") == F.col("__id")) & F.col("event_date").eqNullSafe(F.col("__day")), "left_anti")
    snap = ledger.append(fresh.select(*LEDGER.fieldNames()), parent)
    added = snap.folders() - (parent.folders() if parent else set())
    return ledger.spark.read.schema(LEDGER).parquet(*[f"{ledger.root}/{d}" for d in added]).count() if added else 0


def write_batch(ledger: SnapshotTable, messages: DataFrame) -> int:
    """Validate a batch as a whole, then insert what is new, once."""
    rows = parsed(messages).persist()
    try:
        broken = rows.filter(F.size("errors") > 0).select("kafka_topic", "kafka_partition", "kafka_offset", "errors").orderBy("kafka_topic", "kafka_partition", "kafka_offset").limit(5).collect()
        if broken:
            raise InvalidMessages("; ".join(f"{b.kafka_topic}:{b.kafka_partition}:{b.kafka_offset} {', '.join(b.errors)}" for b in broken))
        sound = rows.drop("errors").withColumns({"before_json": canonical_json("before_json"), "after_json": canonical_json("after_json"), "ingested_at": F.current_timestamp()})
        return append_new(ledger, first_of_each(sound))
    finally:
        rows.unpersist()


def retrying(call: Callable, attempts: int = 3, transient: Callable[[Exception], bool] = lambda e: False, sleep: Callable[[float], None] = time.sleep):
    """``call()``; transient errors are tried again after 1, 2, 4 ... seconds."""
    for n in range(1, attempts + 1):
        try:
            return call()
        except Exception as e:
            if n == attempts or not transient(e):
                raise
            sleep(2.0 ** (n - 1))


def start(stream: DataFrame, root: str, checkpoint: str, heartbeat: str | None = None, available_now: bool = True, transient: Callable[[Exception], bool] = lambda e: False, written: Callable[[int, int], None] | None = None) -> StreamingQuery:
    """Feed the ledger from a stream of messages. The batch's offsets are
    committed by Spark only after the write returned; ``written`` is told the
    messages and the new events of each batch. A writer that was overtaken works
    its batch out again."""

    def sink(batch: DataFrame, _: int) -> None:
        ledger = ledger_at(batch.sparkSession, root)
        n = retrying(lambda: write_batch(ledger, batch), transient=lambda e: isinstance(e, CommitConflict) or transient(e))
        if written:
            written(batch.count(), n)
        if heartbeat:
            Files(batch.sparkSession, root).replace_text(heartbeat, str(time.time()))

    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="0 seconds")).start()


def run_bounded(stream: DataFrame, root: str, checkpoint: str, max_batches: int | None = None, max_messages: int | None = None, idle_s: float | None = None, poll_s: float = 0.2, clock: Callable[[], float] = time.monotonic, **options) -> dict[str, int]:
    """Consume until a number of batches or messages is reached or nothing has
    come for ``idle_s``. It stops after a whole batch; what Spark may have begun
    beyond that is read again by the next run and adds nothing twice."""
    seen, last = {"batches": 0, "messages": 0, "events": 0}, [clock()]

    def written(messages: int, events: int) -> None:
        if messages:
            seen.update(batches=seen["batches"] + 1, messages=seen["messages"] + messages, events=seen["events"] + events)
            last[0] = clock()

    query = start(stream, root, checkpoint, available_now=False, written=written, **options)
    try:
        while query.isActive:
            over = [max_batches is not None and seen["batches"] >= max_batches, max_messages is not None and seen["messages"] >= max_messages, idle_s is not None and clock() - last[0] >= idle_s and not query.status["isTriggerActive"]]
            if any(over):
                break
            time.sleep(poll_s)
        if query.exception():
            raise query.exception()
    finally:
        query.stop()
    return seen


def is_healthy(spark: SparkSession, heartbeat: str, max_age_s: float, now: float | None = None) -> bool:
    files = Files(spark, heartbeat)
    return files.exists(heartbeat) and (now or time.time()) - float(files.read_text(heartbeat)) <= max_age_s
