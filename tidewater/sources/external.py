"""Sources outside the archive: a database by JDBC, messages from Kafka.

Both need a jar on the cluster's class path; what is asked of them is built here
and can be tested without.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ingest.archive import Watermark
from ..streaming.cdc import MESSAGES
from .specs import Spec


def increment_sql(spec: Spec, mark: Watermark | None) -> str:
    """Query of an incremental extract, ordered like its watermark; all rows if
    there is none. The row comparison runs in the database."""
    names = ", ".join(f'"{f.name}"' for f in spec.business)
    where = "" if mark is None else f""" where ("updated_at", "{spec.key[0]}") > (timestamptz '{mark.updated_at.isoformat()}', {int(mark.key)})"""
    return f'select {names} from "{spec.source}"{where}'


def read_increment(spark: SparkSession, url: str, spec: Spec, mark: Watermark | None = None, fetch_rows: int = 10_000, partitions: int = 1, bounds: tuple[int, int] | None = None, **options: str) -> DataFrame:
    """Rows after ``mark`` by JDBC. With ``bounds`` of the key the read is split
    over ``partitions`` tasks; each streams ``fetch_rows`` per round trip."""
    reader = spark.read.format("jdbc").option("url", url).option("fetchsize", str(fetch_rows)).options(**options)
    table = f"({increment_sql(spec, mark)}) as increment"
    reader = reader.option("dbtable", table)
    if bounds and partitions > 1:
        reader = reader.options(partitionColumn=spec.key[0], lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
    return reader.load()


def kafka_options(servers: str, topics: list[str], per_batch: int | None = 500) -> dict[str, str]:
    """Options of a rate-limited stream that fails rather than skips lost data."""
    out = {"kafka.bootstrap.servers": servers, "subscribe": ",".join(topics), "startingOffsets": "earliest", "failOnDataLoss": "true"}
    return out | ({"maxOffsetsPerTrigger": str(per_batch)} if per_batch else {})


def kafka_messages(spark: SparkSession, servers: str, topics: list[str], per_batch: int | None = 500) -> DataFrame:
    """Messages as ``streaming.cdc`` takes them; offsets live in the checkpoint."""
    stream = spark.readStream.format("kafka").options(**kafka_options(servers, topics, per_batch)).load()
    return stream.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in MESSAGES.split(", ")])
