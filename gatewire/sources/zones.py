"""Rows, first and last time of every file of an event table, noted when the file is written.

They say which files of a month a range of time can skip, and add up to the statistics
of a month without reading its events.  They never decide what belongs to a table: a
file that isn't noted is read, and notes on files that are gone are passed over, as the
name of a file never comes again.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from gatewire.sources import batches, folders, merged

ZONES = "_zones"
#: Begins the names of folders with all notes there were.
ALL = "all-"
KEY = ["created_month", "ingest_batch", "file"]
SCHEMA = "created_month DATE, ingest_batch STRING, file STRING, n_rows BIGINT, first_created TIMESTAMP, last_created TIMESTAMP"

_CREATED = StructType().add("created", "timestamp")


def measured(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """What is to be noted of all files in folders, or of files, from their column ``created`` alone."""
    if not paths:
        return spark.createDataFrame([], SCHEMA)
    rows = merged.rows_of(spark, root, paths, _CREATED)
    return rows.groupBy("created_month", "ingest_batch", F.col("_metadata.file_name").alias("file")).agg(
        F.count("*").alias("n_rows"), F.min("created").alias("first_created"), F.max("created").alias("last_created")
    )


def record(spark: SparkSession, root: str, paths: list[str]) -> None:
    """Note the files of folders that were written just now."""
    if paths:
        # a folder for each call: writers at the same time would clear each other's drafts away in one
        measured(spark, root, paths).coalesce(1).write.parquet(f"{root}/{ZONES}/{uuid.uuid4().hex}")


def noted(spark: SparkSession, root: str) -> DataFrame:
    found = folders.matching(spark, f"{root}/{ZONES}/*")
    if not found:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(*found).dropDuplicates(KEY)


def files(spark: SparkSession, root: str, month: str = "*") -> list[str]:
    """Files of a table, or of a month of it, that count."""
    found = folders.matching(spark, f"{root}/verdict=accepted/created_month={month}/ingest_batch=*/*.parquet")
    state = merged.state(spark, root)
    return found if state is None else [path for path in found if merged.counts(state, path)]


def _key(path: str) -> tuple[dt.date, str, str]:
    month = path.split("created_month=", 1)[1].split("/", 1)[0]
    return dt.date.fromisoformat(month), batches.name_of(path), path.rsplit("/", 1)[1]


def files_between(spark: SparkSession, root: str, month: dt.date, start: dt.datetime, end: dt.datetime) -> list[str]:
    """Files of a month without those of which all events are known to lie outside ``start <= created < end``."""
    since, until = F.lit(start.isoformat()), F.lit(end.isoformat())
    there = files(spark, root, month.isoformat())
    outside = (F.col("last_created") < since) | (F.col("first_created") >= until)
    try:
        rows = noted(spark, root).where((F.col("created_month") == F.lit(month)) & outside).select(*KEY).collect()
    except (PySparkException, Py4JJavaError):  # the notes were tidied up while they were read
        return there
    skip = {tuple(row) for row in rows}
    return [path for path in there if _key(path) not in skip]


def stored_stats(spark: SparkSession, root: str) -> DataFrame:
    """created_month, n_rows, first_created, last_created of a table; only files that aren't noted are read."""
    there = files(spark, root)
    if not there:
        return measured(spark, root, []).select("created_month", "n_rows", "first_created", "last_created")
    listed = spark.createDataFrame([_key(path) for path in there], "created_month DATE, ingest_batch STRING, file STRING")
    known = noted(spark, root).join(listed, KEY, "left_semi")
    missing = {tuple(row) for row in listed.join(known, KEY, "left_anti").collect()}
    found = known.unionByName(measured(spark, root, [path for path in there if _key(path) in missing]))
    return found.groupBy("created_month").agg(
        F.sum("n_rows").alias("n_rows"), F.min("first_created").alias("first_created"), F.max("last_created").alias("last_created")
    )


def tidy(spark: SparkSession, root: str, grace: float) -> None:
    """Put all notes into one folder, without those on files that are gone and with those that were missing.

    Older folders go with the first run that finds such a folder from ``grace`` seconds ago, so nobody is reading
    them any more.  Notes that were written meanwhile may go with them; their files are noted again here.
    """
    old = {path: folders.modified(spark, path) for path in folders.matching(spark, f"{root}/{ZONES}/*")}
    there = folders.matching(spark, f"{root}/verdict=accepted/created_month=[0-9]*/ingest_batch=*/*.parquet")
    whole = [when for path, when in old.items() if path.rsplit("/", 1)[1].startswith(ALL) and when <= time.time() - grace]
    for path, when in old.items():
        if whole and when < max(whole):
            folders.delete(spark, path)
    if not there:
        return
    listed = spark.createDataFrame([_key(path) for path in there], "created_month DATE, ingest_batch STRING, file STRING")
    known = noted(spark, root).join(listed, KEY, "left_semi")
    missing = {tuple(row) for row in listed.join(known, KEY, "left_anti").collect()}
    new = measured(spark, root, [path for path in there if _key(path) in missing])
    known.unionByName(new).coalesce(1).write.parquet(f"{root}/{ZONES}/{ALL}{uuid.uuid4().hex}")
