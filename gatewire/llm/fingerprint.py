"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch holds the ``SIZE`` least 48-bit hashes of a text's distinct five-word
shingles (words in lower case, see ``words``).  Sketches of parts merge into the
sketch of the whole.  They estimate resemblance (share of the union's sketch that
both have), containment and the number of distinct shingles; below ``SIZE``
shingles the figures are exact.  As text a sketch is base64 of the hashes,
six bytes each, in ascending order.

Defined cases: NULL counts as empty; a text without words has the empty sketch,
two empty sketches resemble each other fully; a text of one to four words has one
shingle.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .common import bucket_of, id_bounds, partitions, ready

SIZE = 256
BITS = 48


def sketches(texts: list[str]) -> list[np.ndarray]:
    column = pa.array([t.lower() for t in texts], pa.large_string())
    words, owner = W.word_hashes(column)
    found, of = W.shingles(words, owner, len(texts))
    values, of, _ = W.distinct(found >> np.uint64(64 - BITS), of)
    begin = np.searchsorted(of, np.arange(len(texts) + 1))
    return [values[low : min(high, low + SIZE)] for low, high in zip(begin, begin[1:])]


def to_text(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    return np.pad(raw, ((0, 0), (2, 0))).reshape(-1).view(">u8").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of both parts together."""
    return np.union1d(a, b)[:SIZE]


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    union = merge(a, b)
    if not len(union):
        return 1.0
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(both, union[-1], "right") / len(union))


def distinct_shingles(sketch: np.ndarray) -> float:
    if len(sketch) < SIZE:
        return float(len(sketch))
    return (SIZE - 1) / ((float(sketch[-1]) + 1) / 2.0**BITS)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Share of a's distinct shingles that b has."""
    if not len(a):
        return 1.0
    union = distinct_shingles(merge(a, b))
    return min(1.0, resemblance(a, b) * union / max(distinct_shingles(a), 1.0))


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the start of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _adjacent(batches):
    """Rows in order, each with the text of the one after it, in groups of bounded size."""
    held: tuple | None = None
    group, size = [], 0
    first = tail = None
    for batch in batches:
        for ident, last, text in zip(batch.column("__id"), batch.column("__tail"), batch.column("__text")):
            text = text.as_py() or ""
            first = text if first is None else first
            if held is not None:
                group.append((*held, text))
                size += 2 * len(held[1]) + len(text)
            if last.as_py():
                tail = text
                break
            held = ident, text
            if size > 2 << 20:
                yield group
                group, size = [], 0
        if tail is not None:
            break
    if tail is None and held is not None:  # no row has an id
        group.append((*held, first))
    yield group


def _compared(batches):
    for group in _adjacent(batches):
        if not group:
            continue
        changed = [edited(text, after) for _, text, after in group]
        # the text after one row is the next row's text; only the last of a group needs its own
        found = sketches([text for _, text, _ in group] + changed + [group[-1][2]])
        own, other, after = found[: len(group)], found[len(group) : 2 * len(group)], found[1 : len(group)] + found[-1:]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([i.as_py() for i, _, _ in group], group[0][0].type),
                pa.array([len(text) for _, text, _ in group], pa.int64()),
                pa.array([hashlib.sha256(text.encode()).hexdigest() for text in changed]),
                pa.array([to_text(s) for s in own]),
                pa.array([to_text(s) for s in other]),
                pa.array([resemblance(a, b) for a, b in zip(own, other)]),
                pa.array([resemblance(a, b) for a, b in zip(own, after)]),
            ],
            names=["__id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )


def in_order(rows: DataFrame, bounds: list, descending: bool) -> DataFrame:
    """Rows dealt out by range of __id, each partition one range, sorted; ties by text, rows without an id last."""
    bucket = bucket_of(F.col("__id"), bounds)
    if descending:
        # the first row of a range, its greatest id, also closes the range above it; the first of all closes the last
        top = F.array_position(F.lit(bounds).cast("array<bigint>"), F.col("__id")) if bounds else F.lit(0)
        closes = F.when(top > 0, F.when(top == len(bounds), 0).otherwise(top)).cast("int")
        both = F.array_compact(F.array(F.struct(bucket.alias("b"), F.lit(False).alias("t")), F.when(closes.isNotNull(), F.struct(closes.alias("b"), F.lit(True).alias("t")))))
        rows = rows.withColumn("__to", F.explode(both)).select(*rows.columns, F.col("__to.b").alias("__bucket"), F.col("__to.t").alias("__tail"))
        order = [F.col("__tail"), F.col("__id").desc_nulls_last(), F.col("__text")]
    else:
        last = F.lit(max(len(bounds) - 1, 0))
        rows = rows.withColumn("__bucket", F.when(F.col("__id").isNull(), last).otherwise(bucket))
        order = [F.col("__id").asc_nulls_last(), F.col("__text")]
    return rows.repartitionById(max(len(bounds), 1), "__bucket").sortWithinPartitions(*order)


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sketch of every row and of its edited text, and their resemblance to it and to the next row.

    The next row is that of the next lower id, after the last the first; rows of
    one id are ordered by text, rows without an id come last.  Ids are integers.
    """
    spark = ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    bounds = id_bounds(rows, "__id", partitions(spark))
    kind = rows.schema["__id"].dataType.simpleString()
    schema = (
        f"__id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    ordered = in_order(rows, bounds, True).select("__id", "__tail", "__text")
    return ordered.mapInArrow(_compared, schema).withColumnRenamed("__id", id_col)
