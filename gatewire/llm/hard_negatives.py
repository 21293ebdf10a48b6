"""Hard-negative mining by exact scores, with the Four-Russians trick.

Candidates are packed once: a vector of integers becomes bit planes in two's
complement, each of a byte per eight dimensions.  For an anchor and eight of its
dimensions a table holds the sums of all 256 subsets of its components, so the
inner product of the anchor with a plane of a candidate is one look-up a byte, and
the score comes from adding the planes with shifts.  Scores are whole and exact.

Anchors are worked on in blocks of about ANCHORS.  A block goes to all tasks, its
tables are made there, and two passes over the packed candidates follow: the first
finds the anchors' positives among rows of their label, the second the negatives
whose scores lie in the positives' ranges.  A task keeps the best few rows for each
anchor and positive and returns only these, so what is shuffled doesn't depend on how
many rows a label has or how often a vector occurs.  The driver gets one block of
anchors with a few positives each at a time.

Defined cases: rows without an id, a label or a vector, and those with a component
that is NULL, not finite, or reaches 2^27 when scaled, take no part; of vectors of
different length the missing components count as 0; a row is no positive of an
anchor of its own id; repeated rows count as often as they occur, but an anchor that is
repeated with the same label and vector counts once; ties go to the smaller id; an
empty table, or one without anchors, gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gatewire.session import scratch_dir

from .common import ready, stored
from .vectors import matrices

SCALE, EVERY, FLIP, LABELS = 256, 100, 7, 10
POSITIVES = NEGATIVES = 5
#: A negative scores at least this many hundredths of the positive.
LEAST = 80
#: Anchors in a block, on average; and those whose tables are used together, so that they stay in a core's cache.
ANCHORS, TILE = 1024, 64
GROUP = 8

_PACKED = "__ids array<bigint>, __labels array<bigint>, __dims int, __bits int, __planes binary"


def pack(x: np.ndarray) -> tuple[int, np.ndarray]:
    """(bits, bytes by bit, group of dimensions and row) of integers in two's complement."""
    n, width = x.shape
    groups = -(-width // GROUP)
    bits = 1 + int(max(int(x.max(initial=0)), -1 - int(x.min(initial=0)))).bit_length()
    full = np.zeros((n, groups * GROUP), np.int64)
    full[:, :width] = x
    planes = np.empty((bits, groups, n), np.uint8)
    for bit in range(bits):
        planes[bit] = np.packbits(((full >> bit) & 1).astype(np.uint8), axis=1, bitorder="little").T
    return bits, planes


def tables(anchors: np.ndarray) -> np.ndarray:
    """Sums of all subsets of every eight components: by group of dimensions, subset and anchor."""
    n, width = anchors.shape
    groups = -(-width // GROUP)
    full = np.zeros((n, groups * GROUP), np.int64)
    full[:, :width] = anchors
    parts = full.reshape(n, groups, GROUP)
    sums = np.zeros((groups, 1 << GROUP, n), np.int64)
    for d in range(GROUP):
        sums[:, 1 << d : 2 << d] = sums[:, : 1 << d] + parts[:, :, d].T[:, None]
    return sums


def score(sums: np.ndarray, bits: int, planes: np.ndarray) -> np.ndarray:
    """Inner products by row and anchor: look-ups per byte, planes from the sign down, doubled in between."""
    total = np.zeros((planes.shape[2], sums.shape[2]), sums.dtype)
    plane = np.empty_like(total)
    for bit in range(bits - 1, -1, -1):
        if bit == bits - 1:
            for group in range(planes.shape[1]):
                total -= np.take(sums[group], planes[bit, group], axis=0, out=plane, mode="clip")
        else:
            total += total
            for group in range(planes.shape[1]):
                total += np.take(sums[group], planes[bit, group], axis=0, out=plane, mode="clip")
    return total


class Anchors:
    """A block of anchors with the tables of its tiles, for candidates of whatever length."""

    def __init__(self, ids, labels, vectors, ranges=None):
        order = np.argsort(np.array(labels, np.int64), kind="stable")
        self.ids, self.labels = np.array(ids, np.int64)[order], np.array(labels, np.int64)[order]
        self.vectors = [vectors[i] for i in order]
        #: Scores of the positives, by anchor; the places that an anchor doesn't have are false in ``has``.
        self.scores, self.has = (a[order] for a in ranges) if ranges else (None, None)
        self.made: dict = {}

    def __len__(self):
        return len(self.ids)

    def tile(self, low: int, high: int, width: int, bits: int) -> np.ndarray:
        """Tables of the anchors from low to high, with numbers no wider than the scores need."""
        key = low, high, width
        if key not in self.made:
            matrix = np.zeros((high - low, width), np.int64)
            for row, vector in zip(matrix, self.vectors[low:high]):
                row[: len(vector)] = vector[:width]
            self.made[key] = tables(matrix), int(np.abs(matrix).sum(axis=1).max(initial=0))
        sums, most = self.made[key]
        if most << bits < 1 << 31 and sums.dtype != np.int32:
            sums = sums.astype(np.int32)
            self.made[key] = sums, most
        return sums if most << bits < 1 << 31 else sums.astype(np.int64)


class Best:
    """The highest few scores of every key, ties by the smaller id."""

    def __init__(self, keys: int, most: int):
        self.most = most
        self.least, self.last = np.full(keys, np.iinfo(np.int64).min), np.full(keys, np.iinfo(np.int64).max)
        self.rows = tuple(np.zeros(0, np.int64) for _ in range(3))

    def take(self, key: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        least = self.least[key]
        good = (scores > least) | ((scores == least) & (ids < self.last[key]))
        if not good.any():
            return
        key, scores, ids = (np.concatenate(pair) for pair in zip(self.rows, (key[good], scores[good], ids[good])))
        order = np.lexsort((ids, -scores, key))
        key, scores, ids = key[order], scores[order], ids[order]
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        rank = np.arange(len(key)) - np.repeat(begin, np.diff(np.append(begin, len(key))))
        kept = rank < self.most
        self.rows = key[kept], scores[kept], ids[kept]
        full = rank == self.most - 1
        self.least[key[full]], self.last[key[full]] = scores[full], ids[full]


def _packed(scale: int):
    def run(batches):
        for batch in batches:
            for rows, x in matrices(batch, "__vector", scale):
                bits, planes = pack(x)
                ids, labels = (
                    pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), batch.column(name).take(pa.array(rows)))
                    for name in ("__id", "__label")
                )
                yield pa.RecordBatch.from_pydict(
                    {
                        "__ids": ids,
                        "__labels": labels,
                        "__dims": pa.array([x.shape[1]], pa.int32()),
                        "__bits": pa.array([bits], pa.int32()),
                        "__planes": pa.array([planes.tobytes()], pa.binary()),
                    }
                )

    return run


def _blocks(batch: pa.RecordBatch):
    """(ids, labels, dimensions, bits, planes) of each packed row."""
    for i in range(batch.num_rows):
        ids, labels = (batch.column(name)[i].values.to_numpy() for name in ("__ids", "__labels"))
        width, bits = (batch.column(name)[i].as_py() for name in ("__dims", "__bits"))
        planes = np.frombuffer(batch.column("__planes")[i].as_py(), np.uint8)
        yield ids, labels, width, bits, planes.reshape(bits, -(-width // GROUP), len(ids))


def _found(best: Best) -> pa.RecordBatch:
    key, scores, ids = best.rows
    return pa.RecordBatch.from_pydict({"key": pa.array(key), "score": pa.array(scores), "id": pa.array(ids)})


def _positives(anchors: Anchors, most: int):
    def run(batches):
        best = Best(len(anchors), most)
        for batch in batches:
            for ids, labels, width, bits, planes in _blocks(batch):
                for label in np.unique(anchors.labels):
                    rows = np.flatnonzero(labels == label)
                    if not len(rows):
                        continue
                    first, end = (int(np.searchsorted(anchors.labels, label, side)) for side in ("left", "right"))
                    here = planes[:, :, rows]
                    for low in range(first, end, TILE):
                        high = min(low + TILE, end)
                        scores = score(anchors.tile(low, high, width, bits), bits, here)
                        at, anchor = np.nonzero((scores >= best.least[low:high]) & (ids[rows][:, None] != anchors.ids[low:high]))
                        best.take(anchor + low, scores[at, anchor].astype(np.int64), ids[rows][at])
        yield _found(best)

    return run


def _negatives(anchors: Anchors, most: int, least: int):
    places = anchors.scores.shape[1]
    floor = -((-least * anchors.scores) // 100)

    def run(batches):
        best = Best(len(anchors) * places, most)
        for batch in batches:
            for ids, labels, width, bits, planes in _blocks(batch):
                for low in range(0, len(anchors), TILE):
                    high = min(low + TILE, len(anchors))
                    scores = score(anchors.tile(low, high, width, bits), bits, planes)
                    other = labels[:, None] != anchors.labels[low:high]
                    for place in range(places):
                        keys = np.arange(low, high) * places + place
                        lowest = np.maximum(floor[low:high, place], best.least[keys])
                        at, anchor = np.nonzero(
                            other & anchors.has[low:high, place] & (scores >= lowest) & (scores <= anchors.scores[low:high, place])
                        )
                        best.take(keys[anchor], scores[at, anchor].astype(np.int64), ids[at])
        yield _found(best)

    return run


def _merged(rows: DataFrame, most: int) -> DataFrame:
    """The best of all tasks, with their rank."""
    order = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def _block(spark: SparkSession, packed: DataFrame, rows: list, positives: int, negatives: int, least: int) -> DataFrame | None:
    """All rows of one block of anchors."""
    anchors = Anchors([r["__id"] for r in rows], [r["__label"] for r in rows], [np.array(r["x"], np.int64) for r in rows])
    found = _merged(packed.mapInArrow(_positives(anchors, positives), "key bigint, score bigint, id bigint"), positives)
    near = found.collect()  # a few rows for each anchor of the block
    if not near:
        return None
    scores, has = np.zeros((len(rows), positives), np.int64), np.zeros((len(rows), positives), bool)
    names = []
    for row in near:
        scores[row["key"], row["rank"] - 1], has[row["key"], row["rank"] - 1] = row["score"], True
        names.append((row["key"] * positives + row["rank"] - 1, int(anchors.ids[row["key"]]), row["id"], row["score"]))
    # anchors are in their order already, which sorting by label leaves as it is
    ranged = Anchors(anchors.ids, anchors.labels, anchors.vectors, (scores, has))
    found = _merged(packed.mapInArrow(_negatives(ranged, negatives, least), "key bigint, score bigint, id bigint"), negatives)
    known = spark.createDataFrame(names, "key bigint, anchor_id bigint, positive_id bigint, positive_score bigint")
    return found.join(F.broadcast(known), "key").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def _anchor_rows(every: int):
    """Anchors among packed candidates, with their components read back from the planes."""

    def run(batches):
        for batch in batches:
            for ids, labels, width, bits, planes in _blocks(batch):
                rows = np.flatnonzero(ids % every == 0)
                values = np.zeros((len(rows), planes.shape[1] * GROUP), np.int64)
                for bit in range(bits):
                    ones = np.unpackbits(planes[bit][:, rows].T.copy(), axis=1, bitorder="little").astype(np.int64)
                    values += ones * (-(1 << bit) if bit == bits - 1 else 1 << bit)
                yield pa.RecordBatch.from_pydict(
                    {
                        "__id": pa.array(ids[rows]),
                        "__label": pa.array(labels[rows]),
                        "x": pa.array(list(values[:, :width]), pa.list_(pa.int64())),
                    }
                )

    return run


RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def mine(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    scale: int = SCALE,
    every: int = EVERY,
    flip: int = FLIP,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: int = LEAST,
    block: int = ANCHORS,
) -> DataFrame:
    """For each row whose id ``every`` divides, and each of its best rows of the same label: the best harder rows of others.

    A negative's score lies between ``least`` hundredths of the positive's score and that score.
    """
    spark = ready(vectors.sparkSession)
    identity, label = F.col(id_col).cast("bigint"), F.col(label_col).cast("bigint")
    turned = F.when(identity % flip == 0, (label + 1) % LABELS).otherwise(label)
    rows = vectors.select(identity.alias("__id"), turned.alias("__label"), F.col(vector_col).alias("__vector"))
    rows = rows.filter("__id IS NOT NULL AND __label IS NOT NULL AND __vector IS NOT NULL")
    packed = stored(rows.mapInArrow(_packed(scale), _PACKED), "packed")
    anchors = packed.mapInArrow(_anchor_rows(every), "__id bigint, __label bigint, x array<bigint>").dropDuplicates()
    anchors = stored(anchors, "anchors")
    blocks = -(-anchors.count() // block)
    number = F.pmod(F.xxhash64("__id", "__label", "x"), F.lit(max(blocks, 1)))
    out = scratch_dir(spark, "negatives")
    spark.createDataFrame([], RESULT).write.parquet(out)
    for i in range(blocks):
        found = _block(spark, packed, anchors.filter(number == i).collect(), positives, negatives, least)
        if found is not None:
            found.write.mode("append").parquet(out)
    return spark.read.schema(RESULT).parquet(out)


def oracle() -> str:
    """The same in SQL: all products of anchors and rows."""
    return f"""
        WITH kept AS MATERIALIZED (
            SELECT vec_id, CASE WHEN vec_id % {FLIP} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
                   [floor({SCALE} * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)),
        scored AS MATERIALIZED (
            SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
                   CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
            FROM (SELECT DISTINCT * FROM kept WHERE vec_id % {EVERY} = 0) AS a, kept AS b WHERE a.vec_id <> b.vec_id),
        positive AS (
            SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
        SELECT anchor_id, positive_id,
               CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
               id AS negative_id, positive_score, score AS negative_score
        FROM positive JOIN scored USING (anchor_id)
        WHERE NOT same AND {LEAST} * positive_score <= 100 * score AND score <= positive_score
        QUALIFY rank <= {NEGATIVES}"""
