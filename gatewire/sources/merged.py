"""Which folders of an event table count: batches as they were stored, or files that several were joined into.

A stream leaves a folder with a few small files for each of its batches.  Joining
writes their rows once more into a folder of large files, beside them.  A log
(``commits``) then says in one step that this folder counts and those it was made
from don't, so whoever lists the table sees either the old folders or the new one.
The old ones are deleted some time later, when nobody can be reading them any more.

The text of a version is JSON:

    {"<month>": {"<joined folder>": {"at": <seconds>, "replaced": [<folder>, ...]}}}

``replaced`` lists the folders that may still be there.  Joined rows keep the folder of
their batch in the column ORIGIN, so that a batch which is stored again can be taken out.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from gatewire.sources import batches, commits, folders

ORIGIN = "ingest_origin"

State = dict[str, dict[str, dict]]


def _table(root: str) -> str:
    return f"{root}/verdict=accepted"


def _parsed(text: str | None) -> State:
    found = json.loads(text) if text else {}
    for entries in found.values():
        for entry in entries.values():
            entry["replaced"] = set(entry["replaced"])
    return found


def _text(found: State) -> str:
    return json.dumps(found, sort_keys=True, default=sorted)


def state(spark: SparkSession, root: str) -> State | None:
    """What the newest version says; None if nothing was ever joined here."""
    text = commits.latest(spark, root)[1]
    return None if text is None else _parsed(text)


def counts(found: State, path: str) -> bool:
    """Whether the rows of a batch's folder count."""
    month, name = path.split("created_month=", 1)[1].split("/", 1)[0], batches.name_of(path)
    joined = found.get(month, {})
    if batches.is_merged(name):
        return name in joined and not any(name in entry["replaced"] for entry in joined.values())
    return not any(name in entry["replaced"] for entry in joined.values())


def visible(spark: SparkSession, root: str, months: list[str] | None = None) -> list[str] | None:
    """Folders of accepted events that count, of all or some months; None if all do and all are wanted."""
    found = state(spark, root)
    if found is None and months is None:
        return None
    paths = [path for month in months or ["*"] for path in batches.paths(spark, root, "accepted", month=month)]
    return paths if found is None else [path for path in paths if counts(found, path)]


def rows_of(spark: SparkSession, root: str, paths: list[str], schema: StructType) -> DataFrame:
    """Rows of folders or files of a table with their month and folder."""
    full = StructType(schema.fields).add("created_month", "date").add("ingest_batch", "string")
    if not paths:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", _table(root)).parquet(*paths)


def write(rows: DataFrame, root: str, month: str, files: int) -> str:
    """Store rows of a month, with ORIGIN, in a folder that doesn't count yet, cut into files by time; returns its name."""
    name = f"{batches.MERGED}{uuid.uuid4().hex}"
    plain = [field.name for field in rows.schema.fields if field.dataType.simpleString() != "variant"]
    # rows of one instant may be any number, so the rest of the row decides where a file ends among them
    cut = rows.repartitionByRange(files, "created", F.xxhash64(*plain)).sortWithinPartitions("created")
    cut.write.parquet(folder_path(root, month, name))
    return name


def folder_path(root: str, month: str, name: str) -> str:
    return f"{_table(root)}/created_month={month}/ingest_batch={name}"


def with_origin(schema: StructType) -> StructType:
    return StructType(schema.fields).add(ORIGIN, "string")


def announce(spark: SparkSession, root: str) -> None:
    """Make readers ask the log, before the first folder is there that doesn't count."""
    commits.update(spark, root, lambda text: "{}" if text is None else None)


def replace(spark: SparkSession, root: str, month: str, names: list[str], new: str, still: Callable[[State], bool]) -> bool:
    """Let ``new`` count in place of the named folders, if ``still`` holds for the newest version. False if it doesn't."""
    done: list[bool] = []

    def change(text: str | None) -> str | None:
        found = _parsed(text)
        done[:] = [still(found)]
        if not done[0]:
            return None
        entries = found.setdefault(month, {})
        before = [entries.pop(old)["replaced"] for old in names if old in entries]
        entries[new] = {"at": int(time.time()), "replaced": set(names).union(*before)}
        return _text(found)

    commits.update(spark, root, change)
    return done[0]


def clean(spark: SparkSession, root: str, grace: float) -> int:
    """Delete what was replaced more than ``grace`` seconds ago, and joined folders of as long ago that never counted."""
    found = state(spark, root)
    if found is None:
        return 0
    before = time.time() - grace
    old = {(month, name) for month, entries in found.items() for e in entries.values() if e["at"] <= before for name in e["replaced"]}
    lost = [path for path in batches.paths(spark, root, "accepted", f"{batches.MERGED}*") if not _known(found, path)]
    gone = [folder_path(root, *key) for key in old] + [path for path in lost if folders.modified(spark, path) <= before]
    for path in gone:
        folders.delete(spark, path)
    left = {path.rsplit("=", 1)[1] for path in folders.matching(spark, f"{_table(root)}/created_month=*")}
    if old or set(found) - left:

        def shorten(newest: State) -> None:
            for month in set(newest) - left:  # retention took it
                del newest[month]
            for month, entries in newest.items():
                for entry in entries.values():
                    entry["replaced"] = {name for name in entry["replaced"] if (month, name) not in old}

        _edit(spark, root, shorten)
    return len(gone)


def _known(found: State, path: str) -> bool:
    month, name = path.split("created_month=", 1)[1].split("/", 1)[0], batches.name_of(path)
    return any(name == new or name in entry["replaced"] for new, entry in found.get(month, {}).items())


def _edit(spark: SparkSession, root: str, edit: Callable[[State], None]) -> None:
    def change(text: str | None) -> str:
        newest = _parsed(text)
        edit(newest)
        return _text(newest)

    commits.update(spark, root, change)


def forget(spark: SparkSession, root: str, names: set[str]) -> None:
    """Take the rows of batches whose folders are gone out of joined files.

    A version is added first, so that a job which is joining these folders finds that it was
    not alone and looks again at what is left of them; what was joined before that is seen after it.
    """
    if state(spark, root) is None:
        return

    def drop(newest: State) -> None:
        for entries in newest.values():
            for entry in entries.values():
                entry["replaced"] -= names

    _edit(spark, root, drop)
    found = state(spark, root) or {}
    paths = [path for path in batches.paths(spark, root, "accepted", f"{batches.MERGED}*") if counts(found, path)]
    held = rows_of(spark, root, paths, StructType().add(ORIGIN, "string")).where(F.col(ORIGIN).isin(sorted(names)))
    for row in held.select(F.col("created_month").cast("string").alias("month"), "ingest_batch").distinct().collect():
        path = folder_path(root, row.month, row.ingest_batch)
        rows = spark.read.parquet(path).where(~F.col(ORIGIN).isin(sorted(names)))
        new = write(rows, root, row.month, max(1, len(folders.matching(spark, f"{path}/*.parquet"))))
        if not replace(spark, root, row.month, [row.ingest_batch], new, lambda now, path=path: counts(now, path)):
            folders.delete(spark, folder_path(root, row.month, new))
            forget(spark, root, names)  # it was joined with others meanwhile
            return
