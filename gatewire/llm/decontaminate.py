"""Benchmark decontamination: MinHash containment search by size partition, in DataFrame operations only.

Words are lower-case runs of characters other than ASCII punctuation, blanks and
control characters; shingles are ``width`` words.  An item is in a document if at
least ``threshold`` of the item's distinct shingles are in the document.

Search: items are partitioned by their number of shingles (powers of two).  Of
each item the shingles with the least hashes form its MinHash sketch, as many as
the largest item of the partition needs so that a document which holds enough of
an item must hold one of the sketch: of n shingles, n - ceil(threshold * n) + 1.
The bound follows from counting, so the search loses nothing, whatever the
length of the document; banded signatures would need a band per shingle there.
One pass probes all shingles of all documents against the sketches.  Documents
with enough hits are read again and held against the item's exact shingles.

Sketches and item shingles are broadcast if they have at most ``BROADCAST_ROWS``
rows; larger ones are joined by shuffling the hashes instead.

Defined cases: an item of one to ``width`` - 1 words has one shingle, all its
words, searched among the runs of as many words of every document; items and
documents without words (NULL, empty) are in nothing and hold nothing; rows with
the same id are one document or item; rows without an id aren't reported.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

WIDTH = 5
THRESHOLD = 0.8
#: Rows of 20 bytes (sketches) or about 100 (item shingles as text): 13 MB at most.
BROADCAST_ROWS = 1 << 17
SEPARATOR = r"[^a-z0-9\x{80}-\x{10FFFF}]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), SEPARATOR), "")


def _starts(width: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.size("__w") - width))


def _hash(width: int) -> Column:
    return F.xxhash64(*[F.get("__w", F.col("__at") + k) for k in range(width)])


def _gram(width: int) -> Column:
    return F.array_join(F.slice("__w", F.col("__at") + 1, width), " ")


def _positions(rows: DataFrame, width: int, *keep: str) -> DataFrame:
    return rows.filter(F.size("__w") >= width).select(*keep, "__w", _starts(width).alias("__at"))


def _needed(n: Column, threshold: float) -> Column:
    return F.ceil(n * threshold - 1e-9)


def leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = THRESHOLD,
    width: int = WIDTH,
) -> DataFrame:
    """(id, item, matched, n_shingles, containment) of every document that holds an item."""
    rows = docs.select(F.col(id_col).alias("__id"), words(F.col(text_col)).alias("__w")).filter("__id is not null")
    asked = (
        items.select(F.col(item_col).alias("__item"), words(F.col(item_text_col)).alias("__w"))
        .filter("__item is not null and size(__w) > 0")
        .withColumn("__width", F.least(F.size("__w"), F.lit(width)))
    )
    # at most ``width`` numbers
    widths = sorted(r[0] for r in asked.select("__width").distinct().collect())
    if not widths:
        widths = [width]
    item_grams = None
    for one in widths:
        part = _positions(asked.filter(F.col("__width") == one), one, "__item").select(
            "__item", F.lit(one).alias("__width"), _hash(one).alias("__h"), _gram(one).alias("__gram")
        )
        item_grams = part if item_grams is None else item_grams.unionByName(part)
    item_grams = item_grams.distinct()
    per_item = item_grams.groupBy("__item").agg(F.count("*").alias("__n"))
    item_grams = stored(item_grams.join(per_item, "__item"), "items")

    top = F.pow(F.lit(2), F.floor(F.log2(F.col("__n").cast("double"))) + 1) - 1  # largest size of the partition
    ranked = item_grams.withColumn("__top", top.cast("long")).withColumn(
        "__sketch", F.least("__n", F.col("__top") - _needed(F.col("__top"), threshold) + 1)
    )
    by_item = "row_number() over (partition by __item order by __h, __gram)"
    sketch = ranked.withColumn("__rank", F.expr(by_item)).filter("__rank <= __sketch")
    sketch = sketch.select("__item", "__width", "__h", (F.col("__sketch") - F.col("__n") + _needed(F.col("__n"), threshold)).alias("__least"))
    sketch = stored(sketch, "sketch")
    small_sketch, small_items = sketch.count() <= BROADCAST_ROWS, item_grams.count() <= BROADCAST_ROWS

    candidates = None
    for one in widths:
        probes = _positions(rows, one, "__id").select("__id", _hash(one).alias("__h"))
        side = sketch.filter(F.col("__width") == one).drop("__width")
        hits = probes.join(F.broadcast(side) if small_sketch else side, "__h").select("__id", "__item", "__h", "__least")
        candidates = hits if candidates is None else candidates.unionByName(hits)
    candidates = (
        candidates.distinct().groupBy("__id", "__item").agg(F.count("*").alias("__hits"), F.max("__least").alias("__least"))
    ).filter(F.col("__hits") >= F.greatest("__least", F.lit(1)))
    candidates = stored(candidates.select("__id", "__item"), "candidates")

    found = None
    chosen = rows.join(candidates.select("__id").distinct(), "__id", "left_semi")
    for one in widths:
        grams = _positions(chosen, one, "__id").select("__id", _hash(one).alias("__h"), _gram(one).alias("__gram"))
        side = item_grams.filter(F.col("__width") == one).drop("__width")
        held = grams.join(F.broadcast(side) if small_items else side, ["__h", "__gram"]).select("__id", "__item", "__n", "__gram")
        found = held if found is None else found.unionByName(held)
    matched = found.groupBy("__id", "__item", "__n").agg(F.countDistinct("__gram").alias("matched"))
    return (
        matched.join(candidates, ["__id", "__item"], "left_semi")
        .filter(F.col("matched") >= _needed(F.col("__n"), threshold))
        .select(
            F.col("__id").alias(id_col),
            F.col("__item").alias(item_col),
            "matched",
            F.col("__n").alias("n_shingles"),
            (F.col("matched") / F.col("__n")).alias("containment"),
        )
    )


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that hold an item."""
    found = leaks(docs, items, id_col=id_col, **options).select(F.col(id_col).alias("__leak")).distinct()
    return docs.join(found, docs[id_col] == found["__leak"], "left_anti")


def oracle(threshold: float = THRESHOLD, width: int = WIDTH) -> str:
    """The same result by exact containment, in DuckDB SQL."""
    grams = f"""
  select {{key}}, {{w}} as w, array_to_string(ws[i:i + {{w}} - 1], ' ') as gram
  from (select {{key}}, ws, unnest(range(1, len(ws) - {{w}} + 2)) as i from {{rows}} where len(ws) >= {{w}} {{also}})"""
    item_parts, doc_parts = [], []
    for w in range(1, width + 1):
        also = f"and least(len(ws), {width}) = {w}"
        item_parts.append(grams.format(key="item_id", w=w, rows="items", also=also))
        doc_parts.append(grams.format(key="doc_id", w=w, rows="docs", also=f"and {w} in (select least(len(ws), {width}) from items)"))
    split = r"regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+')"
    return f"""
with items as (select item_id, {split} as ws from benchmark where item_id is not null and text is not null),
docs as (select doc_id, {split} as ws from documents where doc_id is not null and text is not null),
item_grams as (select distinct * from ({" union all ".join(item_parts)})),
doc_grams as (select distinct * from ({" union all ".join(doc_parts)})),
sizes as (select item_id, count(*) as n_shingles from item_grams group by item_id)
select doc_id, item_id, count(*) as matched, n_shingles, count(*) / n_shingles as containment
from doc_grams join item_grams using (w, gram) join sizes using (item_id)
group by doc_id, item_id, n_shingles having count(*) >= ceil({threshold} * n_shingles - 1e-9)"""
