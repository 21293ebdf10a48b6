"""MinHash near-dedup: ProbMinHash signatures of weighted word shingles, banding, exact verification, classes.

A text's elements are its distinct five-word shingles (words in lower case, see
``words``); a shingle that occurs c times weighs 1 + ln c.  Two texts are linked
if the probability Jaccard similarity of these weighted sets, computed exactly,
is at least ``threshold``; a class is a connected component of links.  Without
repeated shingles the similarity is the plain Jaccard similarity.

Signatures follow ProbMinHash (Ertl 2020): the arrivals of an element form a
Poisson process of its weight, run through the registers in an order of the
element's own, and end as soon as they come later than every register's first.

Defined cases: texts with equal word sequences share a class; texts without any
word (NULL, empty, punctuation only) share one only with equal texts, NULL
counting as empty; a text of one to four words is a single shingle.  Rows with
the same id are one document, linked through any of their texts.  Rows without an id
get the class of their text, NULL if no row with an id is in it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import words as W
from .common import free_name, partitions, ready, slices, stored

REGISTERS = 256
BAND_ROWS = 6
BANDS = REGISTERS // BAND_ROWS
THRESHOLD = 0.8
TILE_ROWS = 2048
TILE_BYTES = 32 << 20

_U = np.uint64


def _turn(n: int) -> np.uint64:
    return _U(n * 0x9E3779B97F4A7C15 % 2**64)


def weights(times: np.ndarray) -> np.ndarray:
    return 1.0 + np.log(times)


def _uniform(x: np.ndarray) -> np.ndarray:
    """(0, 1] from the upper 53 bits."""
    return ((x >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53


def signatures(elements: np.ndarray, owner: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
    """ProbMinHash registers, one row of REGISTERS element hashes per text; 0 throughout for a text without elements."""
    m = REGISTERS
    first = np.full((texts, m), np.inf)
    winner = np.zeros((texts, m), _U)
    flat_first, flat_winner = first.reshape(-1), winner.reshape(-1)
    step = W.mix(elements + _U(0x632BE59BD9B4E019)) | _U(1)
    start = W.mix(elements ^ _U(0xD1B54A32D192ED03))
    at = np.zeros(len(elements))
    limit = np.full(texts, np.inf)
    alive = np.arange(len(elements))
    for i in range(m):
        if not len(alive):
            break
        spin = W.mix(elements[alive] + _turn(i + 1))
        at[alive] -= np.log(_uniform(spin)) / weight[alive] * (m / (m - i))
        alive = alive[at[alive] < limit[owner[alive]]]
        if not len(alive):
            break
        register = ((start[alive] + _U(i) * step[alive]) % _U(m)).astype(np.int64)
        slot = owner[alive] * m + register
        time = at[alive]
        better = time < flat_first[slot]
        slot, time, who = slot[better], time[better], elements[alive[better]]
        order = np.lexsort((who, -time))
        flat_first[slot[order]] = time[order]
        # of several arrivals at one register the earliest is written last
        flat_winner[slot[order]] = who[order]
        touched = np.unique(slot // m)
        limit[touched] = first[touched].max(axis=1)
    return winner


def bands(registers: np.ndarray) -> np.ndarray:
    out = np.empty((len(registers), BANDS), _U)
    for b in range(BANDS):
        total = np.full(len(registers), _turn(b + 1))
        for k in range(BAND_ROWS):
            total = W.mix(total ^ registers[:, b * BAND_ROWS + k]) * _U(0xBF58476D1CE4E5B9)
        out[:, b] = W.mix(total)
    return out


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Probability Jaccard similarity of two weighted sets, given as sorted hashes and weights."""
    if not len(a) or not len(b):
        return 0.0
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    only_a, only_b = wa.sum() - wa[ia].sum(), wb.sum() - wb[ib].sum()
    xa, xb = wa[ia], wb[ib]
    total = 0.0
    for ratio in np.unique(xb / xa):
        here = xb / xa == ratio
        union = np.maximum(xa, xb / ratio).sum() + only_a + only_b / ratio
        total += (xa[here] / union).sum()
    return float(total)


def weighted_shingles(column: pa.Array):
    """(hash, text, weight) of the distinct shingles of lower-case texts, and every text's words."""
    words, owner = W.word_hashes(column)
    found, of = W.shingles(words, owner, len(column))
    values, of, times = W.distinct(found, of)
    return values, of, weights(times), words, owner


def _signed(batches):
    for batch in batches:
        for part in slices(batch, "__text", 3 << 20):
            texts = part.column("__text")
            values, of, weight, words, owner = weighted_shingles(texts)
            sig = bands(signatures(values, of, weight, len(texts)))
            n = W.counts_by_text(owner, len(texts))
            begin = np.concatenate(([0], np.cumsum(n)))
            keys = []
            for i in range(len(texts)):
                if n[i]:
                    content = b"w" + words[begin[i] : begin[i + 1]].tobytes()
                else:
                    content = b"t" + (texts[i].as_py() or "").encode()
                keys.append(hashlib.blake2b(content, digest_size=16).digest())
            lists = [sig[i].view(np.int64) if n[i] else sig[i, :0].view(np.int64) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays(
                [part.column("__id"), pa.array(keys, pa.binary()), pa.array(lists, pa.list_(pa.int64()))],
                names=["__id", "__key", "__bands"],
            )


def _verified(threshold: float):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "__ta", 2 << 20, 256):
                sides = []
                for name in ("__ta", "__tb"):
                    column = part.column(name).dictionary_encode()
                    values, of, weight, _, _ = weighted_shingles(column.dictionary)
                    begin = np.searchsorted(of, np.arange(len(column.dictionary) + 1))
                    sides.append((column.indices.to_numpy(), values, weight, begin))
                (ia, va, wa, ba), (ib, vb, wb, bb) = sides
                score = np.array(
                    [
                        similarity(va[ba[i] : ba[i + 1]], wa[ba[i] : ba[i + 1]], vb[bb[j] : bb[j + 1]], wb[bb[j] : bb[j + 1]])
                        for i, j in zip(ia, ib)
                    ]
                )
                keep = pa.array(score >= threshold - 1e-12)
                yield pa.RecordBatch.from_arrays(
                    [part.column("u").filter(keep), part.column("v").filter(keep)], names=["u", "v"]
                )

    return run


def verified(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (u, v) of ids whose texts, from ``texts`` (__id, __text), are similar enough."""
    kind = pairs.schema["u"].dataType.simpleString()
    a = texts.select(F.col("__id").alias("u"), F.col("__text").alias("__ta"))
    b = texts.select(F.col("__id").alias("v"), F.col("__text").alias("__tb"))
    return (
        pairs.join(a, "u").join(b, "v").select("u", "v", "__ta", "__tb").mapInArrow(_verified(threshold), f"u {kind}, v {kind}")
    )


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (u, v): (node, root), root the least node of its component.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until the
    links are stars; each step is one aggregation and one join on the node.
    """
    edges = stored(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = stored(small.select("e.*").filter("u <> v").distinct(), "links")
        # stars: nobody is both below one node and above another
        if not small.join(small.select(F.col("v").alias("u")).distinct(), "u", "left_semi").head(1) and not (
            small.groupBy("u").count().filter("count > 1").head(1)
        ):
            return small.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = small


def _spanning(threshold: float):
    """Links between different components among the rows of a tile, as few as join what belongs together."""

    def run(table):
        column = table.column("__text").combine_chunks()
        values, of, weight, _, _ = weighted_shingles(column)
        n = len(column)
        begin = np.searchsorted(of, np.arange(n + 1))
        plain = np.maximum.reduceat(np.append(weight, 1.0), np.minimum(begin[:-1], len(weight))) == 1.0 if n else np.zeros(0, bool)
        sizes = np.diff(begin)
        # only shingles of two texts or more can be common
        _, token, texts_with = np.unique(values, return_inverse=True, return_counts=True)
        common = np.flatnonzero(texts_with > 1)
        place = np.full(len(texts_with), -1)
        place[common] = np.arange(len(common))
        at = place[token]
        shared = np.zeros((n, n), np.float32)
        for low in range(0, len(common), 8192):
            here = (at >= low) & (at < low + 8192)
            part = np.zeros((n, min(8192, len(common) - low)), np.float32)
            part[of[here], at[here] - low] = 1
            shared += part @ part.T
        near = shared / np.maximum(sizes[:, None] + sizes[None, :] - shared, 1)
        exact = plain[:, None] & plain[None, :]
        idents, root = table.column("__id").to_pylist(), table.column("root").to_pylist()
        group = {}

        def find(x):
            while group.get(x, x) != x:
                group[x] = group.get(group[x], group[x])
                x = group[x]
            return x

        u, v = [], []
        for i, j in zip(*np.nonzero(np.triu((shared > 0) & (~exact | (near >= threshold - 1e-6)), 1))):
            a, b = find(root[i]), find(root[j])
            if a == b:
                continue
            sides = [(values[begin[k] : begin[k + 1]], weight[begin[k] : begin[k + 1]]) for k in (i, j)]
            if similarity(*sides[0], *sides[1]) >= threshold - 1e-12:
                group[max(a, b)] = min(a, b)
                u.append(idents[i]), v.append(idents[j])
        kind = table.schema.field("__id").type
        return pa.table({"u": pa.array(u, kind), "v": pa.array(v, kind)})

    return run


def across(members: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links that join different components of ``members`` (rep, centre, root), where rep and centre share a bucket.

    Members that are connected through buckets form a cluster.  A cluster is cut
    into tiles of at most about TILE_ROWS texts or TILE_BYTES, each pair of its
    parts being one; a task holds one tile and returns at most a spanning forest,
    so no pair of texts is ever a row.
    """
    kind = members.schema["rep"].dataType.simpleString()
    clusters = components(members.select(F.col("rep").alias("u"), F.col("centre").alias("v")))
    one = members.select("rep", "root").distinct()
    one = one.join(clusters, one["rep"] == clusters["node"], "left").select("rep", one["root"], F.coalesce(clusters["root"], "rep").alias("cluster"))
    one = stored(one, "clusters")
    full = texts.join(one, texts["__id"] == one["rep"]).select("cluster", "__id", "root", "__text").distinct()
    full = stored(full, "tiles")
    parts = full.groupBy("cluster").agg(
        F.greatest(F.ceil(F.count("*") / (TILE_ROWS / 2)), F.ceil(F.sum(F.length("__text")) / (TILE_BYTES / 2))).cast("int").alias("n")
    )
    own = F.when(F.col("n") <= 2, 0).otherwise(F.pmod(F.xxhash64("__id"), F.col("n"))).cast("int")
    other = F.explode(F.when(F.col("n") <= 2, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("n") - 1)))
    tiled = full.join(parts, "cluster").withColumn("own", own).withColumn("other", other)
    tiled = tiled.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "__id", "root", "__text")
    # the join has left all tiles of a cluster in one partition
    tiled = tiled.repartition(partitions(texts.sparkSession), "cluster", "i", "j")
    found = tiled.groupBy("cluster", "i", "j").applyInArrow(_spanning(threshold), f"u {kind}, v {kind}")
    return stored(found, "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, class_id): one row per row of ``docs``; class_id is the least id of the class."""
    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("__id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("__text"))
    kind = rows.schema["__id"].dataType.simpleString()
    signed = stored(rows.mapInArrow(_signed, f"__id {kind}, __key binary, __bands array<bigint>"), "signed")

    # equal texts first: from here on only one document of each stands for them
    groups = signed.groupBy("__key").agg(F.min("__id").alias("rep"), F.max("__bands").alias("__bands"))
    groups = stored(groups.filter("rep is not null"), "groups")
    members = groups.select("rep", F.explode("__bands").alias("bucket"))
    centres = members.groupBy("bucket").agg(F.min("rep").alias("centre"), F.count("*").alias("n")).filter("n > 1")
    shared = stored(members.join(centres, "bucket").select("bucket", "rep", "centre"), "shared")

    # every member against the least of its bucket, which joins nearly all that belong together
    tested = stored(shared.filter("rep <> centre").select(F.col("rep").alias("u"), F.col("centre").alias("v")).distinct(), "pairs")
    links = stored(verified(tested, rows, threshold), "links")
    roots = components(links)
    placed = shared.join(roots, shared["rep"] == roots["node"], "left").select(
        "bucket", "rep", "centre", F.coalesce("root", "rep").alias("root")
    )
    # then, where a bucket still holds several components, all of them against each other
    several = placed.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("bucket")
    left_over = stored(placed.join(several, "bucket", "left_semi").select("rep", "centre", "root").distinct(), "open")
    more = across(left_over, rows, threshold)
    roots = components(links.unionByName(more))

    classes = groups.join(roots, groups["rep"] == roots["node"], "left").select(
        "__key", F.coalesce("root", "rep").alias("class_id")
    )
    return signed.join(classes, "__key", "left").select(F.col("__id").alias(id_col), "class_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class, that of the least id; of several rows with this id one of the least text.

    Rows without an id can't be told apart, so they stay.
    """
    classes = near_duplicates(docs, id_col, text_col, threshold)
    kept = classes.filter(F.col(id_col) == F.col("class_id")).select(F.col(id_col).alias("__kept")).distinct()
    kept = stored(kept, "kept")
    rank = free_name(docs, "__rank")
    first = F.row_number().over(Window.partitionBy(id_col).orderBy(text_col))
    named = docs.join(kept, docs[id_col] == kept["__kept"], "left_semi").withColumn(rank, first)
    return named.filter(F.col(rank) == 1).drop(rank).unionByName(docs.filter(F.col(id_col).isNull()))
