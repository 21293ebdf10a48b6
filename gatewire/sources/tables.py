"""Event tables and quarantine as Parquet.

Ingested rows of one kind live below one root, laid out as

    <root>/verdict=accepted/created_month=2024-01-01/ingest_batch=.../*.parquet
    <root>/verdict=rejected/created_month=2024-03-01/ingest_batch=.../*.parquet
    <root>/verdict=resting/created_month=2024-03-01/ingest_batch=.../*.parquet

so a single write job stores accepted events and quarantined messages of a
batch together: the input is decoded and parsed once and nothing is cached.  The
job's commit moves one folder after the other; a batch that dies within it is
whole again once it is repeated under its name.  A month is one folder, so
retention drops it without touching others, and a replayed batch replaces exactly
what it wrote.  The month of an event is that of its time; refused messages have none that
could be relied on, so theirs is the month in which they arrived.  Those that have been
tried often enough rest: they are kept and listed, but not tried again.
"""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from gatewire.functions.months import month_start
from gatewire.operators.readouts import listed_stats, time_range
from gatewire.operators.shred import flatten_stored, shredded
from gatewire.schemas import FACT_COLUMNS, QUARANTINE_DDL, fact_schema, first_schema, stored_schema
from gatewire.sources import batches, folders, merged, zones
from gatewire.vocabulary import SCHEMA_NAMES

LAYOUT = ["verdict", "created_month", "ingest_batch"]


def append_events(events: DataFrame, path: str, rebalance: bool = False) -> None:
    """Append conformed events to a table partitioned by month. Nothing is deduplicated.

    Messages come in roughly by time, so a task holds few months and no shuffle
    is needed.  Set ``rebalance`` for input in any order: it groups rows by
    month, and adaptive execution cuts a month with too many rows into several
    files instead of giving it to one task.
    """
    rows = events.withColumn("created_month", month_start(F.col("created")))
    if rebalance:
        rows = _grouped(rows, "created_month")
    rows.write.mode("append").partitionBy("created_month").parquet(path)


def rewrite_by_year(events: DataFrame, path: str) -> None:
    """Store events in yearly chunks, the layout of the first table generation."""
    rows = _grouped(events.withColumn("created_year", F.year("created")), "created_year")
    rows.write.mode("errorifexists").partitionBy("created_year").parquet(path)


def _grouped(rows: DataFrame, column: str) -> DataFrame:
    """Bring rows of one folder together; only adaptive execution can cut a folder that is too large for a task."""
    if rows.sparkSession.conf.get("spark.sql.adaptive.enabled") != "true":
        raise ValueError("grouping rows by folder needs spark.sql.adaptive.enabled")
    return rows.hint("rebalance", F.col(column))


def write_checked(
    checked: DataFrame,
    root: str,
    kind: str,
    batch: str | None = None,
    tried_before: bool = True,
    arrived: Column | dt.datetime | None = None,
) -> None:
    """Store a validated DataFrame: good rows as events, the others with body and reasons.

    With a batch name, which may be any text, the rows replace whatever an earlier
    try of that batch stored; without one they are appended.  ``tried_before=False`` spares the
    search for an earlier try where there can't be one.  ``arrived`` is when the messages came, now unless given.
    """
    spark, folder = checked.sparkSession, batches.folder_of(batch)
    if batch is not None and tried_before:
        forget_batch(spark, root, batch)
    # text without an offset is UTC, whatever Python's own time zone
    when = F.lit(arrived.isoformat()).cast("timestamp") if isinstance(arrived, dt.datetime) else arrived
    store(checked, root, kind, F.lit(folder), F.lit(1), F.current_timestamp() if when is None else when)
    zones.record(spark, root, batches.paths(spark, root, "accepted", folder))


def store(
    checked: DataFrame, root: str, kind: str, folder: Column, attempts: Column, arrived: Column, most: int | None = None
) -> None:
    """Write checked rows below the folders of their batches; refused ones with ``most`` tries behind them rest."""
    good = F.col("is_valid")

    def if_good(name: str, column: Column) -> Column:
        return F.when(good, column).alias(name)

    def if_bad(name: str, column: Column) -> Column:
        return F.when(~good, column).alias(name)

    refused = F.lit("rejected") if most is None else F.when(attempts >= most, "resting").otherwise("rejected")
    rows = checked.select(
        *[if_good(c, F.col(c).cast(t)) for c, t in FACT_COLUMNS[kind].items()],
        *[if_good(c, column) for c, column in shredded(kind).items()],
        if_bad("msg_id", F.col("msg_id")),
        if_bad("body", F.col("body").cast("binary")),
        if_bad("errors", F.col("errors")),
        if_bad("attempts", attempts),
        if_bad("arrived", arrived),
        F.when(good, F.lit("accepted")).otherwise(refused).alias("verdict"),
        F.when(good, month_start(F.col("created"))).otherwise(month_start(arrived)).alias("created_month"),
        folder.alias("ingest_batch"),
    )
    writer = rows.write.partitionBy(*LAYOUT).mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.parquet(root)


def forget_batch(spark: SparkSession, root: str, batch: str) -> None:
    """Remove whatever an earlier try of a batch stored, wherever it went, and what was made of its refused messages.

    Replacing alone isn't enough if the list of partitions changed in between:
    a message may then be accepted now and have been refused before.
    """
    folder = batches.folder_of(batch)
    found = batches.paths_with_retries(spark, root, folder)
    forget_folders(spark, root, {folder, *map(batches.name_of, found)}, found)


def forget_folders(spark: SparkSession, root: str, names: set[str], found: list[str]) -> None:
    """Remove all rows of the folder names; ``found`` are the paths that there are of them."""
    for path in found:
        folders.delete(spark, path)
    merged.forget(spark, root, names)


def read_events(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A table written by ``append_events``, in the newest layout whatever the age of its files."""
    schema = fact_schema(kind).add("created_month", "date")
    return spark.read.schema(schema).parquet(path)


def read_first_generation(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A table written by ``rewrite_by_year``, in the layout that it had."""
    schema = first_schema(kind)
    return spark.read.schema(first_schema(kind).add("created_year", "integer")).parquet(path).select(*schema.names)


def read_range(
    spark: SparkSession, path: str, kind: str | StructType, start: dt.datetime, end: dt.datetime
) -> DataFrame:
    """Rows of a table by month, an event table of some kind or any other layout, with ``start <= created < end``, listing the files of the months concerned only.

    On a table with years of micro-batches the listing of all folders would take longer than the scan.
    """
    wanted = _months_between(spark, path, start, end)
    layout = fact_schema(kind) if isinstance(kind, str) else StructType(kind.fields)
    schema = layout.add("created_month", "date")
    if not wanted:
        return spark.createDataFrame([], schema)
    paths = [f"{path}/created_month={month.isoformat()}" for month in wanted]
    rows = spark.read.schema(schema).option("basePath", path).parquet(*paths).select(*schema.names)
    return time_range(rows, start, end)


def _month_after(month: dt.date) -> dt.datetime:
    return dt.datetime(month.year + month.month // 12, month.month % 12 + 1, 1)


def _months_between(spark: SparkSession, path: str, start: dt.datetime, end: dt.datetime) -> list[dt.date]:
    last = end - dt.timedelta(microseconds=1)
    return [month for month in stored_months(spark, path) if start.date().replace(day=1) <= month <= last.date()]


def read_accepted(spark: SparkSession, root: str, kind: str) -> DataFrame:
    schema = fact_schema(kind).add("created_month", "date")
    paths = merged.visible(spark, root)
    if paths is None:
        return _read_verdict(spark, root, "accepted", schema)
    return merged.rows_of(spark, root, paths, fact_schema(kind)).select(*schema.names)


def read_accepted_range(
    spark: SparkSession, root: str, kind: str, start: dt.datetime, end: dt.datetime
) -> DataFrame:
    """Accepted events with ``start <= created < end``, listing and reading only files that may have some."""
    paths, whole = [], []
    for month in _months_between(spark, f"{root}/verdict=accepted", start, end):
        if start <= dt.datetime.combine(month, dt.time()) and _month_after(month) <= end:
            whole.append(month.isoformat())
        else:
            paths += zones.files_between(spark, root, month, start, end)
    paths += merged.visible(spark, root, whole) if whole else []
    schema = fact_schema(kind).add("created_month", "date")
    return time_range(merged.rows_of(spark, root, paths, fact_schema(kind)).select(*schema.names), start, end)


def read_context(spark: SparkSession, root: str, keep: tuple[str, ...]) -> DataFrame:
    """The access requests of all accepted events, flattened, next to the columns to ``keep``."""
    paths = merged.visible(spark, root)
    if paths is None:
        paths = batches.paths(spark, root, "accepted")
    return flatten_stored(merged.rows_of(spark, root, paths, stored_schema("authz")), keep)


def read_quarantine(spark: SparkSession, root: str) -> DataFrame:
    """Refused messages that will be tried again."""
    return _read_verdict(spark, root, "rejected", quarantine_schema())


def read_resting(spark: SparkSession, root: str) -> DataFrame:
    """Refused messages that have been tried often enough."""
    return _read_verdict(spark, root, "resting", quarantine_schema())


def quarantine_schema() -> StructType:
    return StructType.fromDDL(QUARANTINE_DDL)


def _read_verdict(spark: SparkSession, root: str, verdict: str, schema: StructType) -> DataFrame:
    folder = f"{root}/verdict={verdict}"
    if not folders.exists(spark, folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder).select(*schema.names)


def stored_stats(spark: SparkSession, roots: dict[str, str], catalog: DataFrame) -> DataFrame:
    """As ``partition_stats``, for the tables below the roots of each kind, from what was noted when they were written."""
    found = [zones.stored_stats(spark, root).withColumn("schema_name", F.lit(SCHEMA_NAMES[kind])) for kind, root in roots.items()]
    return listed_stats(functools.reduce(DataFrame.unionByName, found), catalog)


def drop_months(spark: SparkSession, path: str, months: list[dt.date]) -> list[str]:
    """Delete the folders of whole months below a table; months it doesn't have are ignored."""
    dropped = []
    for month in months:
        dropped += folders.delete_matching(spark, f"{path}/created_month={month.isoformat()}")
    return dropped


def drop_refused(spark: SparkSession, root: str, cutoff: dt.date) -> list[str]:
    """Delete the messages, still tried or resting, that arrived in months before the cutoff; returns the folders."""
    dropped = []
    for verdict in ("rejected", "resting"):
        path = f"{root}/verdict={verdict}"
        dropped += drop_months(spark, path, [month for month in stored_months(spark, path) if month < cutoff])
    return dropped


def stored_months(spark: SparkSession, path: str) -> list[dt.date]:
    """Months that a table has a folder for."""
    names = [folder.rsplit("created_month=", 1)[1] for folder in folders.matching(spark, f"{path}/created_month=*")]
    return sorted(dt.date.fromisoformat(name) for name in names if name[:1].isdigit())
