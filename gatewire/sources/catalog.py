"""The list of existing partitions, kept as Parquet snapshots of which a log names the one in force.

A snapshot is only ever added, never changed, so readers see a whole list and a
job that dies half-way leaves the last one in force.  Jobs that run side by side
follow each other by the numbers of the log: whoever comes second makes its change
from the list of the first, so partitions that one of them added or dropped stay so.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from gatewire.operators.partitions import empty_catalog
from gatewire.schemas import CATALOG_DDL
from gatewire.sources import commits, folders

KEPT = 5


def _listed(spark: SparkSession, root: str, name: str | None) -> DataFrame | None:
    return spark.read.schema(CATALOG_DDL).parquet(f"{root}/{name}") if name else None


def _newest(spark: SparkSession, root: str) -> str | None:
    """Name of the snapshot in force."""
    name = commits.latest(spark, root)[1]
    if name is None:  # lists from before there was a log
        marks = sorted(folders.matching(spark, f"{root}/version=*/_finished"))
        name = marks[-1].rsplit("/", 2)[1] if marks else None
    return name


def load_catalog(spark: SparkSession, root: str, missing_ok: bool = False) -> DataFrame:
    """The list in force. Without any an error, as every message would be refused; or empty if that is fine."""
    found = _listed(spark, root, _newest(spark, root))
    if found is not None:
        return found
    if missing_ok:
        return empty_catalog(spark)
    raise FileNotFoundError(f"no list of partitions in {root}")


def update_catalog(spark: SparkSession, root: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Put in force what ``change`` makes of the list in force, also if others change it meanwhile; returns the new list.

    ``change`` may be called several times, each time with the list that is then in force.
    """
    written: list[str] = []

    def write(name: str | None) -> str:
        for lost in written:  # another job was faster, this one starts again from what it made
            folders.delete(spark, f"{root}/{lost}")
        present = _listed(spark, root, name or _newest(spark, root))
        written[:] = [f"list-{uuid.uuid4().hex}"]
        rows = change(empty_catalog(spark) if present is None else present)
        rows.coalesce(1).write.mode("errorifexists").parquet(f"{root}/{written[0]}")
        return written[0]

    name = commits.update(spark, root, write)
    _remove_old(spark, root)
    return _listed(spark, root, name)


def save_catalog(catalog: DataFrame, root: str) -> None:
    """Put a list in force whatever is in force now."""
    update_catalog(catalog.sparkSession, root, lambda _: catalog)


def _remove_old(spark: SparkSession, root: str) -> None:
    """Remove the snapshots of removed versions; the last few stay for readers that still use them."""
    entries = folders.matching(spark, f"{root}/{commits.LOG}/[0-9]*")
    for entry in entries[:-KEPT]:
        try:
            name = folders.read_text(spark, entry)
        except Py4JJavaError as error:
            if "FileNotFound" not in error.java_exception.getClass().getName():
                raise
            continue  # another job is removing it
        folders.delete(spark, f"{root}/{name}")
        folders.delete(spark, entry)
