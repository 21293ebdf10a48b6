"""The few folder operations that DataFrame readers and writers don't offer.

They go through Hadoop's FileSystem, so any storage Spark can write to works.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(hadoop_path), fs


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path, fs = _path(spark, path)
    return fs.exists(hadoop_path)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    hadoop_path, fs = _path(spark, pattern)
    return [status.getPath().toString() for status in fs.globStatus(hadoop_path) or []]


def delete_matching(spark: SparkSession, pattern: str) -> list[str]:
    """Delete whole folders; returns what there was to delete."""
    found = matching(spark, pattern)
    for folder in found:
        delete(spark, folder)
    return found


def delete(spark: SparkSession, path: str) -> None:
    """Delete one file or folder; no character of the path has a special meaning."""
    hadoop_path, fs = _path(spark, path)
    fs.delete(hadoop_path, True)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a folder."""
    hadoop_path, fs = _path(spark, path)
    return fs.getContentSummary(hadoop_path).getLength()


def modified(spark: SparkSession, path: str) -> float:
    """Seconds since 1970 at which a file or folder was last changed."""
    hadoop_path, fs = _path(spark, path)
    return fs.getFileStatus(hadoop_path).getModificationTime() / 1000


def mark(spark: SparkSession, path: str) -> None:
    """Create an empty file."""
    hadoop_path, fs = _path(spark, path)
    fs.create(hadoop_path, True).close()


def read_text(spark: SparkSession, path: str) -> str:
    hadoop_path, fs = _path(spark, path)
    stream = fs.open(hadoop_path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_whole(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with all of its text at once, unless there is one of that name: of several who try only one succeeds.

    The text is written beside it first.  A local file then gets its name as a
    hard link, elsewhere by a rename that replaces nothing; either fails if the name is taken.
    """
    target, fs = _path(spark, path)
    draft, _ = _path(spark, f"{target.getParent()}/.{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        if fs.getUri().getScheme() == "file":
            _link(spark, draft, target)
        else:
            _rename(spark, draft, target)
        return True
    except Py4JJavaError as error:
        if "AlreadyExists" not in error.java_exception.getClass().getName():
            raise
        return False
    finally:
        fs.delete(draft, False)


def _link(spark: SparkSession, draft, target) -> None:
    files, path = spark._jvm.java.nio.file.Files, spark._jvm.java.nio.file.Path
    files.createLink(path.of(target.toUri()), path.of(draft.toUri()))


def _rename(spark: SparkSession, draft, target) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs
    kind = getattr(hadoop, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.NONE
    hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, target, how)
