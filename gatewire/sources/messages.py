"""Message sources: two queues and the directly posted documents.

A source is any connector Spark has; files stand in for the queue service.  The
same call gives a batch or a streaming DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gatewire.schemas import MESSAGE_DDL


def read_messages(
    spark: SparkSession,
    path: str,
    kind: str,
    fmt: str = "parquet",
    streaming: bool = False,
    **options: str,
) -> DataFrame:
    """Messages of kind ``authn`` (text) or ``authz`` (bytes) as ``msg_id, body``.

    ``text`` takes one message per line, or up to another separator
    (``lineSep="\\x1e"``) or per file (``wholetext="true"``) for messages with line
    breaks; ``binaryFile`` takes one per file; neither has message ids.  Other
    formats deliver both columns themselves.
    """
    reader = (spark.readStream if streaming else spark.read).format(fmt).options(**options)
    if fmt == "text":
        return as_messages(reader.load(path), kind, "value")
    if fmt == "binaryFile":
        return as_messages(reader.load(path), kind, "content")
    return reader.schema(MESSAGE_DDL[kind]).load(path)


def as_messages(records: DataFrame, kind: str, body: str, msg_id: str | None = None) -> DataFrame:
    """Give the records of any connector the shape of messages, e.g. ``body="value"`` for a Kafka topic."""
    content = F.col(body).cast("string" if kind == "authn" else "binary")
    number = F.col(msg_id) if msg_id else F.lit(None)
    return records.select(number.cast("bigint").alias("msg_id"), content.alias("body"))
