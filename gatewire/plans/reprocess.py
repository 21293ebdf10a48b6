"""Further tries of refused messages, once a partition or lookup row they lacked may be there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from gatewire.plans.ingest import CHECKS
from gatewire.sources import batches, folders, tables, zones

RETRIED = "_retried"
#: Tries that a message gets, the first one included.
TRIES = 5
#: Batches worked on in one job, so that neither its list of folders nor the driver's grows with the quarantine.
AT_ONCE = 1000


def reprocess(
    spark: SparkSession,
    root: str,
    kind: str,
    dimensions: dict[str, DataFrame],
    catalog: DataFrame,
    tries: int = TRIES,
    at_once: int = AT_ONCE,
) -> int:
    """Check the quarantined messages anew: those that pass become events, the others stay. Returns the batches tried.

    Every message carries the number of its tries and when it first came.  One that
    has been refused ``tries`` times rests: ``read_resting`` lists it with its last
    reasons, and it is no more work for later runs.

    What batch ``b`` left is stored as the first further try of ``b``, from there as the second
    and so on, then the folders that were read are listed, and then they go.  A run that dies before
    the list is there is made again from the older folders, after removing what
    they had given; one that dies later has its list worked off by the next.  So
    nothing is lost or stored twice.  Batches that others add meanwhile are left
    alone.  Runs for one root must follow each other.
    """
    for done in folders.matching(spark, f"{root}/{RETRIED}/[0-9a-f]*"):
        _remove_listed(spark, root, done)
    waiting: dict[str, list[str]] = {}
    for path in batches.paths(spark, root, "rejected"):
        waiting.setdefault(batches.name_of(path), []).append(path)
    # what an unfinished run made of a batch is made again from the batch itself
    unfinished = {batches.next_try(name) for name in waiting}
    _forget(spark, root, unfinished)
    left = sorted(set(waiting) - unfinished)
    for low in range(0, len(left), at_once):
        _try_again(spark, root, kind, dimensions, catalog, tries, {name: waiting[name] for name in left[low : low + at_once]})
    return len(left)


def _forget(spark: SparkSession, root: str, names: set[str]) -> None:
    """Remove all rows of the given tries."""
    tried = batches.paths(spark, root, folder=f"*{batches.RETRY}[0-9]*")
    tables.forget_folders(spark, root, names, [path for path in tried if batches.name_of(path) in names])


def _try_again(
    spark: SparkSession, root: str, kind: str, dimensions: dict, catalog: DataFrame, tries: int, waiting: dict[str, list[str]]
) -> None:
    paths = [path for found in waiting.values() for path in found]
    schema = tables.quarantine_schema().add("created_month", "date").add("ingest_batch", "string")
    refused = spark.read.schema(schema).option("basePath", f"{root}/verdict=rejected").parquet(*paths)
    body = F.col("body").cast("string") if kind == "authn" else F.col("body")
    messages = refused.select(
        "msg_id",
        body.alias("body"),
        batches.next_try_column(F.col("ingest_batch")).alias("_folder"),
        (F.coalesce("attempts", F.lit(1)) + 1).alias("_attempts"),
        # messages from before their arrival was kept: when they were written
        F.coalesce("arrived", F.col("_metadata.file_modification_time")).alias("_arrived"),
    )
    checked = CHECKS[kind](messages, dimensions, catalog, keep=("_folder", "_attempts", "_arrived"))
    tables.store(checked, root, kind, F.col("_folder"), F.col("_attempts"), F.col("_arrived"), tries)
    done = f"{root}/{RETRIED}/{uuid.uuid4().hex}"
    folders.create_whole(spark, done, "\n".join(path.rsplit("verdict=rejected/", 1)[1] for path in paths))
    _remove_listed(spark, root, done)
    names = {batches.next_try(name) for name in waiting}
    new = batches.paths(spark, root, "accepted", f"*{batches.RETRY}[0-9]*")
    zones.record(spark, root, [path for path in new if batches.name_of(path) in names])


def _remove_listed(spark: SparkSession, root: str, done: str) -> None:
    """Delete the folders of a list, then the list."""
    for path in folders.read_text(spark, done).split("\n"):
        folders.delete(spark, f"{root}/verdict=rejected/{path}")
    folders.delete(spark, done)
