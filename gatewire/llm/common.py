"""What the operators share: worker set-up, scratch tables, and the buckets of an ordered table."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gatewire.session import scratch_dir

#: Text that Spark hands a Python worker at a time; its default of 64 MB is held on both sides.
BATCH_BYTES = "8m"

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package also where only the driver's ``sys.path`` has it, and bound their batches.

    A cluster installs the package on its nodes; there the added entry does no harm.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    environment = spark.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in known:
        environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *known])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the folder that all executors share and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, by which rows are held out of training; a NULL id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def id_bounds(df: DataFrame, column: str, buckets: int) -> list:
    """Ascending values of ``column`` that cut its rows into at most ``buckets`` ranges; the last is the maximum.

    Every value is one that occurs, so range i, from above value i-1 to value i, is never empty.
    The driver gets ``buckets`` numbers, whatever the input.
    """
    shares = [(i + 1) / buckets for i in range(buckets)]
    found = df.agg(F.percentile_approx(column, shares, 10000).alias("cuts"), F.max(column).alias("top")).first()
    if found["top"] is None:
        return []
    return sorted({*found["cuts"], found["top"]})


def bucket_of(value: Column, bounds: list) -> Column:
    """Number of the range of ``id_bounds`` that holds a value; NULL goes with the lowest."""
    if not bounds:
        return F.lit(0)
    cuts = F.lit(bounds[:-1]) if len(bounds) > 1 else F.array().cast("array<bigint>")
    at = F.size(F.filter(cuts, lambda cut: cut < value))
    return F.coalesce(F.when(value.isNotNull(), at), F.lit(0)).cast("int")


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20, rows: int = 4096):
    """Parts of a batch with at most ``most`` bytes of text in ``column``, or a single row."""
    texts = batch.column(column)
    if not batch.num_rows:
        return
    if not (pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type)):
        raise TypeError(f"{column} must hold text")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    ends = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    low = 0
    while low < batch.num_rows:
        high = int(np.searchsorted(ends, ends[low] + most, "right")) - 1
        high = min(max(high, low + 1), low + rows, batch.num_rows)
        yield batch.slice(low, high - low)
        low = high
