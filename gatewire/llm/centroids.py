"""Centroid clustering of integer vectors, with lower bounds that geometric drift tightening loosens.

Every vector keeps its cluster and a lower bound on its distance to all other
centroids.  When centroids move, the bound would have to give way by the longest
move.  It gives way by less here: the vectors of a cluster lie in a sphere around
its old centroid, and for every other centroid that moved from a to b the largest
loss of distance, |x - a| - |x - b| over the sphere, is bounded in the plane through
the sphere's centre, a and b (``loss``).  A vector nearer to its own new centroid than
its bound can't have changed; all others are scanned against every centroid.
Distances that decide anything are exact integers.

A round is one job over blocks of vectors, written to the shared folder with the
clusters, bounds and partial sums of the block, and a sum over those.  The driver
gets one number per centroid and component.  There is no shuffle by vector, vector
value or cluster, so a frequent vector or a cluster of nearly all costs nothing more.
Of the rounds' tables the last two exist at a time.

Defined cases: vectors that are NULL, of another length, with a NULL or non-finite
component, or with one that reaches 2^27 when scaled, are left out; a row without
an id is clustered but starts no centroid; repeated rows count as often as they
occur; equal distances go to the smaller number; an empty centroid stays where it
is; fewer vectors than centroids make fewer centroids; an empty table gives no
rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gatewire.session import scratch_dir
from gatewire.sources import folders

from .common import ready
from .vectors import matrices

CENTROIDS, ROUNDS, SCALE, WIDTH, SEED = 8, 10, 1024, 64, "3"
#: What rounding may do to a distance or bound, relative to the lengths that it was computed from.
SLACK = 1e-9
#: Per centroid: vectors, summed and greatest squared distance, vectors scanned; then the sums of all components.
COUNT, INERTIA, RADIUS, SCANNED, SUMS = 0, 1, 2, 3, 4

_STATE = "__x binary, __at binary, __low binary, __sums array<bigint>"


@dataclass
class Move:
    """Where the centroids are, and what that takes from the lower bounds of each cluster's vectors."""

    centroids: np.ndarray
    losses: np.ndarray
    apart: np.ndarray


def loss(centre: np.ndarray, radius: float, a: np.ndarray, b: np.ndarray) -> float:
    """Bound on |x - a| - |x - b| for all x within ``radius`` of ``centre``; negative if all x get farther.

    In the plane through the centre and the line from a to b, points that lose
    at least v lie on b's side of a hyperbola with foci a and b, so within its
    asymptotes: two lines through the midpoint with the angle acos(v / |b - a|)
    to the line.  On a's side, points that gain at least v include the like cone at a.
    """
    drift = float(np.linalg.norm(b - a))
    if drift == 0:
        return 0.0
    along = (b - a) / drift
    middle = centre - (a + b) / 2
    place = float(middle @ along)
    slack = SLACK * (drift + radius + float(np.linalg.norm(middle)) + float(np.linalg.norm(centre)))
    radius = radius + slack

    def angle(vector: np.ndarray, axis: np.ndarray) -> tuple[float, float]:
        """Angle of the centre to the axis, and half the angle that the sphere fills."""
        far = float(np.linalg.norm(vector))
        turn = np.arccos(np.clip(vector @ axis / far, -1, 1)) if far else 0.0
        return turn, np.arcsin(radius / far) if far > radius else np.pi

    if place < -radius:
        turn, spread = angle(centre - a, -along)
        return -drift * max(0.0, float(np.cos(min(turn + spread, np.pi / 2)))) + slack
    turn, spread = angle(middle, along)
    return drift * max(0.0, float(np.cos(np.clip(turn - spread, 0, np.pi / 2)))) + slack


def moved(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> Move:
    """``radius``: greatest distance of a cluster's vectors to its old centroid; negative without vectors."""
    k = len(new)
    was, now = old.astype(float), new.astype(float)
    losses, apart = np.zeros(k), np.full(k, np.inf)
    for i in range(k):
        others = [j for j in range(k) if j != i]
        if others and radius[i] >= 0:
            losses[i] = max(loss(was[i], float(radius[i]), was[j], now[j]) for j in others)
        if others:
            apart[i] = min(np.linalg.norm(now[i] - now[j]) for j in others)
    return Move(new, losses, apart)


def distances(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances."""
    apart = x - centroid
    return np.einsum("ij,ij->i", apart, apart)


def assign(x: np.ndarray, at: np.ndarray, low: np.ndarray, move: Move) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, lower bound, squared distance, was scanned) of each vector, from those before the move."""
    k = len(move.centroids)
    own = distances(x, move.centroids[at])
    root = np.sqrt(own.astype(float))
    low = low - move.losses[at] - SLACK * (1 + np.abs(np.where(np.isfinite(low), low, 0)))
    # no other centroid can be nearer than half the way to it
    sure = root * (1 + SLACK) + SLACK < np.maximum(low, move.apart[at] * (0.5 - SLACK))
    scan = np.flatnonzero(~sure)
    if len(scan):
        part = x[scan]
        every = np.column_stack([distances(part, c) for c in move.centroids])
        best = np.argmin(every, axis=1)
        at, own, low = at.copy(), own.copy(), low.copy()
        at[scan], own[scan] = best, every[np.arange(len(scan)), best]
        low[scan] = np.sqrt(np.partition(every, 1, axis=1)[:, 1].astype(float)) * (1 - SLACK) if k > 1 else np.inf
    return at, low, own, ~sure


def _summed(x: np.ndarray, at: np.ndarray, own: np.ndarray, scanned: np.ndarray, k: int) -> np.ndarray:
    sums = np.zeros((k, SUMS + x.shape[1]), np.int64)
    for i in range(k):
        here = at == i
        if here.any():
            sums[i, :SUMS] = here.sum(), own[here].sum(), own[here].max(), scanned[here].sum()
            sums[i, SUMS:] = x[here].sum(axis=0)
    return sums.ravel()


def _block(ids: pa.Array, x: np.ndarray, at: np.ndarray, low: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    one = lambda array: pa.array([array.tobytes()], pa.binary())
    listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    columns = [listed, one(x.astype(np.int32)), one(at.astype(np.int16)), one(low), pa.array([sums], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, names=["__ids", "__x", "__at", "__low", "__sums"])


def _unblocked(batch: pa.RecordBatch, width: int):
    for i in range(batch.num_rows):
        part = {name: batch.column(name)[i] for name in ("__ids", "__x", "__at", "__low")}
        x = np.frombuffer(part["__x"].as_py(), np.int32).reshape(-1, width).astype(np.int64)
        yield part["__ids"].values, x, np.frombuffer(part["__at"].as_py(), np.int16), np.frombuffer(part["__low"].as_py())


def _first_blocks(scale: int, width: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("__id")
            for rows, x in matrices(batch, "__vector", scale, width):
                none = np.zeros(len(rows), np.int16), np.full(len(rows), -np.inf), np.zeros(0, np.int64)
                yield _block(ids.take(pa.array(rows)), x, *none)

    return run


def _starters(k: int, width: int, seed: str):
    """The first k vectors of a task in the order of the hash of their ids."""

    def run(batches):
        kept: list[tuple[str, list[int]]] = []
        for batch in batches:
            for ids, x, _, _ in _unblocked(batch, width):
                named = [(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), n) for n, i in enumerate(ids.to_pylist()) if i is not None]
                last = max(h for h, _ in heapq.nsmallest(k, named)) if named else ""
                kept = heapq.nsmallest(k, kept + [(h, x[n].tolist()) for h, n in named if h <= last])
        yield pa.RecordBatch.from_arrays(
            [pa.array([h for h, _ in kept], pa.string()), pa.array([v for _, v in kept], pa.list_(pa.int64()))], names=["h", "v"]
        )

    return run


def _round(move: Move, width: int):
    def run(batches):
        for batch in batches:
            for ids, x, at, low in _unblocked(batch, width):
                at, low, own, scanned = assign(x, at, low, move)
                yield _block(ids, x, at, low, _summed(x, at, own, scanned, len(move.centroids)))

    return run


def _totals(state: DataFrame, k: int, width: int) -> np.ndarray:
    """Sums over all blocks; greatest values in the column RADIUS. Python integers, as inertia may outgrow 64 bits."""
    cells = state.select(F.posexplode("__sums").alias("i", "v"))
    total = cells.groupBy("i").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s"), F.max("v").alias("m"))
    found = np.zeros((k, SUMS + width), object)
    for row in total.collect():  # k * (SUMS + width) rows, whatever the input
        i, j = divmod(row["i"], SUMS + width)
        found[i, j] = row["m"] if j == RADIUS else int(row["s"])
    return found


@dataclass
class Clustering:
    """Blocks of vectors with their clusters, the centroids, and per centroid COUNT, INERTIA, RADIUS and SCANNED."""

    state: DataFrame
    centroids: np.ndarray
    totals: np.ndarray
    scanned: list[int]


def fit(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    width: int = WIDTH,
    seed: str = SEED,
) -> Clustering | None:
    """Start from the k vectors of least sha256 of "seed:id", assign and move ``rounds`` times, assign; None without vectors."""
    spark = ready(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).alias("__id"), F.col(vector_col).alias("__vector"))
    layout = f"__ids array<{rows.schema['__id'].dataType.simpleString()}>, {_STATE}"
    state, path = _kept(rows.mapInArrow(_first_blocks(scale, width), layout), "blocks")
    first = state.mapInArrow(_starters(k, width, seed), "h string, v array<bigint>").orderBy("h", "v").limit(k).collect()
    if not first:
        return None
    centroids = np.array([row["v"] for row in first], np.int64).reshape(len(first), width)
    k = len(centroids)
    move = moved(centroids, centroids, np.full(k, -1.0))
    scanned = []
    for turn in range(rounds + 1):
        state, new_path = _kept(state.mapInArrow(_round(move, width), layout), f"round{turn}")
        totals = _totals(state, k, width)
        folders.delete_matching(spark, path)
        path = new_path
        scanned.append(int(totals[:, SCANNED].sum()))
        if turn < rounds:
            new = centroids.copy()
            for i in range(k):
                if totals[i, COUNT]:
                    new[i] = [total // totals[i, COUNT] for total in totals[i, SUMS:]]
            radius = np.array([float(r) ** 0.5 if n else -1.0 for n, r in totals[:, [COUNT, RADIUS]]])
            move, centroids = moved(centroids, new, radius), new
    return Clustering(state, centroids, totals, scanned)


def _kept(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Written to the shared folder and read back, with the folder, as it is deleted when the next round is there."""
    spark: SparkSession = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _rows(found: Clustering, inertia: list[int], digests: list[str]):
    centroids, width = found.centroids, found.centroids.shape[1]

    def run(batches):
        for batch in batches:
            for ids, x, at, _ in _unblocked(batch, width):
                columns = {
                    "__id": ids,
                    "cluster": pa.array(at.astype(np.int32)),
                    "distance": pa.array(distances(x, centroids[at])),
                    "cluster_inertia": pa.array(np.array(inertia, np.int64)[at]),
                    "inertia": pa.array(np.full(len(at), sum(inertia))),
                    "centroid_sha256": pa.array([digests[i] for i in at], pa.string()),
                }
                yield pa.RecordBatch.from_pydict(columns)

    return run


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector; options as for ``fit``."""
    kind = vectors.schema[id_col].dataType.simpleString()
    layout = f"__id {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    found = fit(vectors, id_col, vector_col, **options)
    if found is None:
        return vectors.sparkSession.createDataFrame([], layout).withColumnRenamed("__id", id_col)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]
    inertia = [int(n) for n in found.totals[:, INERTIA]]
    columns = found.state.select("__ids", "__x", "__at", "__low")
    return columns.mapInArrow(_rows(found, inertia, digests), layout).withColumnRenamed("__id", id_col)


def oracle(k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, width: int = WIDTH, seed: str = SEED) -> str:
    """The same clustering in SQL, all distances computed in every round."""
    steps = [
        f"""kept AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id,
                   [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
            FROM embeddings
            WHERE len(embedding) = {width} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {width})""",
        f"""c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS j, v FROM kept WHERE vec_id IS NOT NULL
            ORDER BY j LIMIT {k})""",
    ]
    for turn in range(rounds + 1):
        steps.append(f"""a{turn} AS MATERIALIZED (
            SELECT r, vec_id, v, min(struct_pack(d := d, j := j)) AS best
            FROM (SELECT kept.*, j,
                         CAST(list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(kept.v, c.v)]) AS BIGINT) AS d
                  FROM kept, c{turn} AS c)
            GROUP BY r, vec_id, v)""")
        if turn < rounds:
            steps.append(f"""c{turn + 1} AS MATERIALIZED (
                SELECT j, coalesce(m, c.v) AS v
                FROM c{turn} AS c LEFT JOIN (
                    SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m
                    FROM (SELECT best.j AS j, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n
                          FROM a{turn}, range(1, {width + 1}) AS t(i) GROUP BY best.j, i)
                    GROUP BY j) USING (j))""")
    last = f"a{rounds}"
    return f"""WITH {', '.join(steps)}
        SELECT vec_id, CAST(best.j AS INTEGER) AS cluster, best.d AS distance,
               CAST(sum(best.d) OVER (PARTITION BY best.j) AS BIGINT) AS cluster_inertia,
               CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(c.v, ',')) AS centroid_sha256
        FROM {last} JOIN c{rounds} AS c ON c.j = best.j"""
