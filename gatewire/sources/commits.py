"""A log of numbered versions, for what several jobs change at the same time.

Whoever wants to change something reads the newest version, makes its successor from
it, and claims the next number by creating the file of that number, which only one can.
The others find the number taken, read again and make their change anew from what is
there now, so no change is lost.  A file is there whole or not at all.  Old numbers are removed; who has slept
through so many that its number is free again finds newer ones behind it, and tries anew too.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from gatewire.sources import folders

LOG = "_log"
KEPT = 10


def _versions(spark: SparkSession, root: str) -> list[int]:
    names = [path.rsplit("/", 1)[1] for path in folders.matching(spark, f"{root}/{LOG}/[0-9]*")]
    return sorted(int(name) for name in names)


def _file(root: str, version: int) -> str:
    return f"{root}/{LOG}/{version:012d}"


def latest(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """Number and text of the newest version; 0 and None before the first."""
    while found := _versions(spark, root):
        try:
            return found[-1], folders.read_text(spark, _file(root, found[-1]))
        except Py4JJavaError as error:
            if "FileNotFound" not in error.java_exception.getClass().getName():
                raise  # else it was removed since, as there are newer ones
    return 0, None


def claim(spark: SparkSession, root: str, version: int, text: str) -> bool:
    """Make ``text`` the given version, if that is the next one; False if somebody else was faster."""
    if not folders.create_whole(spark, _file(root, version), text):
        return False
    found = _versions(spark, root)
    if found[-1] > version:
        folders.delete(spark, _file(root, version))
        return False
    for old in found[:-KEPT]:
        folders.delete(spark, _file(root, old))
    return True


def update(spark: SparkSession, root: str, change: Callable[[str | None], str | None], tries: int = 100) -> str | None:
    """Replace the newest text by what ``change`` makes of it, again and again until nobody came between.

    ``change`` may return None to leave things as they are.  Returns the text in force.
    """
    for _ in range(tries):
        version, text = latest(spark, root)
        new = change(text)
        if new is None:
            return text
        if claim(spark, root, version + 1, new):
            return new
        time.sleep(random.uniform(0, 0.2))
    raise TimeoutError(f"{tries} others changed {root} first")
