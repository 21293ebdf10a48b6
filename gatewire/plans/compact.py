"""Joining the small files that streams leave."""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F

from gatewire.operators.shred import shredded
from gatewire.schemas import SHREDDED_MARK, stored_schema
from gatewire.sources import batches, folders, merged, zones

#: Bytes that a file should have, as it is stored.
FILE_BYTES = 128 << 20
#: Seconds for which replaced folders stay for those who are reading them.
GRACE = 3600.0


def compact(
    spark: SparkSession,
    root: str,
    kind: str,
    months: list[str] | None = None,
    at_least: int = 2,
    file_bytes: int = FILE_BYTES,
    grace: float = GRACE,
) -> dict[str, int]:
    """Join the events of each month into files of about ``file_bytes`` in order of time; returns the folders joined by month.

    Months with fewer than ``at_least`` folders stay as they are.  Readers see the
    old files or the new ones, never both; streams and batches may go on storing
    events meanwhile, which just aren't among those that are joined.  Dying at any point leaves the
    table as it was, or joined.  If a batch is stored again while its folder is being joined,
    that month is left for the next run.
    """
    merged.announce(spark, root)
    merged.clean(spark, root, grace)
    by_month: dict[str, list[str]] = {}
    for path in merged.visible(spark, root, months) or []:
        by_month.setdefault(path.split("created_month=", 1)[1].split("/", 1)[0], []).append(path)
    joined = {
        month: len(paths)
        for month, paths in sorted(by_month.items())
        if len(paths) >= at_least and _join(spark, root, kind, month, paths, file_bytes)
    }
    zones.tidy(spark, root, grace)
    return joined


def _join(spark: SparkSession, root: str, kind: str, month: str, paths: list[str], file_bytes: int) -> bool:
    schema = stored_schema(kind)
    files = {file for path in paths for file in folders.matching(spark, f"{path}/*.parquet")}
    size = sum(folders.size(spark, path) for path in paths)
    rows = merged.rows_of(spark, root, sorted(files), merged.with_origin(schema))
    for name, column in shredded(kind).items():  # rows that were stored before these columns get them now
        rows = rows.withColumn(name, F.when(F.col(SHREDDED_MARK), F.col(name)).otherwise(column))
    rows = rows.select(*schema.names, F.coalesce(merged.ORIGIN, "ingest_batch").alias(merged.ORIGIN))
    new = merged.write(rows, root, month, max(1, round(size / file_bytes)))
    zones.record(spark, root, [merged.folder_path(root, month, new)])

    def unchanged(state: merged.State) -> bool:
        """All that was read is still there and counts; a batch that is stored again has other files."""
        now = {file for path in paths for file in folders.matching(spark, f"{path}/*.parquet")}
        return now == files and all(merged.counts(state, path) for path in paths)

    if merged.replace(spark, root, month, [batches.name_of(path) for path in paths], new, unchanged):
        return True
    folders.delete(spark, merged.folder_path(root, month, new))
    return False
