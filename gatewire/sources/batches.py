"""Names of batches and the folders that hold their rows.

A batch may have any name.  Its folder has the name with every character that
folder names, patterns or this module use for something written as ``~`` and two
hexadecimal digits a byte.  ``~`` and a letter beyond these stands for what no user can name:

    ~u<id>       rows appended without a name
    <batch>~r3   what the third further try made of the refused messages of a batch
    ~m<id>       rows of several batches, joined into few files
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, SparkSession, functions as F

from gatewire.sources import folders

ESCAPE, UNNAMED, RETRY, MERGED = "~", "~u", "~r", "~m"
_PLAIN = re.compile(r"[A-Za-z0-9_.\-]")
_RETRIED = f"^(.*?)(?:{RETRY}([0-9]+))?$"


def folder_of(batch: str | None) -> str:
    """Folder name of a batch; without a name one that nothing else has."""
    if batch is None:
        return f"{UNNAMED}{uuid.uuid4().hex}"
    if not batch:
        raise ValueError("the name of a batch must not be empty")
    return "".join(c if _PLAIN.match(c) else "".join(f"{ESCAPE}{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in batch)


def next_try(folder: str) -> str:
    """Folder of the next try of the refused messages in a folder."""
    name, count = re.match(_RETRIED, folder).groups()
    return f"{name}{RETRY}{int(count or 0) + 1}"


def next_try_column(folder: Column) -> Column:
    count = F.nullif(F.regexp_extract(folder, _RETRIED, 2), F.lit("")).cast("int")
    return F.concat(F.regexp_extract(folder, _RETRIED, 1), F.lit(RETRY), F.coalesce(count, F.lit(0)) + 1)


def is_merged(folder: str) -> bool:
    return folder.startswith(MERGED)


def name_of(path: str) -> str:
    """Folder name of a batch from a path below it."""
    return path.split("ingest_batch=", 1)[1].split("/", 1)[0]


def paths(spark: SparkSession, root: str, verdict: str = "*", folder: str = "*", month: str = "*") -> list[str]:
    """Folders of batches, of all verdicts and months unless asked for some."""
    return folders.matching(spark, f"{root}/verdict={verdict}/created_month={month}/ingest_batch={folder}")


def paths_with_retries(spark: SparkSession, root: str, folder: str) -> list[str]:
    """Folders of a batch and of all further tries of it."""
    return paths(spark, root, folder=folder) + paths(spark, root, folder=f"{folder}{RETRY}[0-9]*")
