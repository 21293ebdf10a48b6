"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are taken in lower case with every run of ASCII characters that aren't
letters as one blank; one- to three-character n-grams are hashed to ``BUCKETS``.
Tasks count them by language, Spark adds the counts, and the matrix of smoothed
log probabilities, languages times buckets, is broadcast.  A text is scored as a
sparse row: its distinct buckets and their counts.

The driver and the broadcast hold ``BUCKETS`` 32-bit numbers a language, of which the
driver takes the counts one language after the other; more than ``MOST_LANGUAGES``
languages (128 MB) are refused with an error.

Defined cases: NULL, empty and letterless texts are ``und`` with score 0, likewise
every text if there is nothing to learn from; rows without a language or an id
don't train; of equally likely languages the first by name is taken; whole texts
count, in parts of bounded size; repeated rows train and are answered as often as
they occur; an empty table gives no rows; other columns, whatever their names, are
neither read nor returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import fold, ready, slices, stored

BUCKETS = 1 << 15
LENGTHS = (1, 2, 3)
SMOOTHING = 0.5
MOST_LANGUAGES = 1024
UNKNOWN = "und"

_U = np.uint64
_PLACES = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9))
_BLANK = np.ones(128, bool)
_BLANK[ord("a") : ord("z") + 1] = False
PART = 1 << 20


def _parts(texts: list[str]):
    """(numbers, strings) of at most about PART characters; a long text comes in several, overlapping by two."""
    numbers, strings, size = [], [], 0
    for i, text in enumerate(texts):
        for low in range(0, max(len(text), 1), PART):
            numbers.append(i)
            strings.append(text[max(low - 2, 0) : low + PART] if low else text[:PART])
            size += len(strings[-1])
            if size >= PART:
                yield numbers, strings
                numbers, strings, size = [], [], 0
    if strings:
        yield numbers, strings


def grams(texts: list[str]):
    """Buckets of all n-grams, with the number of their text."""
    for numbers, strings in _parts(texts):
        # every text is set between blanks, which keeps n-grams within it
        codes = np.frombuffer((" " + " ".join(strings) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        small = codes < 128
        codes[small] = np.where(_BLANK[codes[small]], 32, codes[small])
        owner = np.repeat(np.array(numbers), [len(s) + 1 for s in strings])
        owner = np.append(owner, numbers[-1])
        keep = np.ones(len(codes), bool)
        keep[1:] = ~((codes[1:] == 32) & (codes[:-1] == 32) & (owner[1:] == owner[:-1]))
        codes, owner = codes[keep].astype(_U), owner[keep]
        total = np.zeros(len(codes), _U)
        for k, n in enumerate(LENGTHS):
            size = len(codes) - n + 1
            if size <= 0:
                break
            total = total[:size] + (codes[k : k + size] + _U(1)) * _PLACES[k]
            mixed = (total ^ (total >> _U(29))) * _U(0xBF58476D1CE4E5B9)
            bucket = (mixed >> _U(64 - 15)).astype(np.int64)
            inside = owner[:size] == owner[n - 1 : n - 1 + size]
            if n == 1:
                inside = inside & (codes != _U(32))
            yield bucket[inside], owner[:size][inside]


def _counts(batches):
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in slices(batch, "__text", 4 << 20):
            languages = part.column("__lang").to_pylist()
            names = sorted(set(languages))
            number = {name: i for i, name in enumerate(names)}
            code = np.array([number[x] for x in languages])
            for bucket, owner in grams([t.lower() for t in part.column("__text").to_pylist()]):
                found = np.bincount(code[owner] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                for name, i in number.items():
                    if name in total:
                        total[name] += found[i]
                    else:
                        total[name] = found[i].copy()
    for name, found in total.items():
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(found[at])], names=["lang", "bucket", "n"]
        )


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities, buckets times languages, from all rows with a language."""
    spark = ready(docs.sparkSession)
    rows = docs.select(F.col(lang_col).alias("__lang"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    counted = rows.filter("__lang is not null").mapInArrow(_counts, "lang string, bucket int, n bigint")
    summed = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    pairs = F.collect_list(F.struct("bucket", "n")).alias("pairs")  # at most BUCKETS of them
    packed = stored(summed.groupBy("lang").agg(pairs).select("lang", F.col("pairs.bucket").alias("at"), F.col("pairs.n").alias("n")), "langs")
    names = sorted(r["lang"] for r in packed.select("lang").limit(MOST_LANGUAGES + 1).collect())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    matrix = np.empty((BUCKETS, len(names)), np.float32)
    number = {name: i for i, name in enumerate(names)}
    for row in packed.toLocalIterator():
        counts = np.full(BUCKETS, SMOOTHING)
        counts[row["at"]] += row["n"]
        matrix[:, number[row["lang"]]] = np.log(counts / counts.sum())
    return names, matrix


def _predicted(model):
    def run(batches):
        names, matrix = model.value
        for batch in batches:
            for part in slices(batch, "__text", 4 << 20):
                texts = part.column("__text").to_pylist()
                logs = np.zeros((len(texts), max(len(names), 1)))
                for bucket, owner in grams([t.lower() for t in texts]) if names else ():
                    keys, times = np.unique(owner * BUCKETS + bucket, return_counts=True)
                    if len(keys):
                        terms = matrix[keys % BUCKETS] * times[:, None]
                        of = keys // BUCKETS
                        at = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                        logs[of[at]] += np.add.reduceat(terms, at, axis=0)
                best = logs.argmax(axis=1)
                share = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                known = [bool(names) and any(map(str.isalpha, t)) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("__id"),
                        part.column("__held_out"),
                        pa.array([names[b] if k else UNKNOWN for b, k in zip(best, known)], pa.string()),
                        pa.array(np.where(known, share, 0.0)),
                    ],
                    names=["__id", "held_out", "lang_pred", "score"],
                )

    return run


def predict(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", held_out=None) -> DataFrame:
    """(id, held_out, lang_pred, score) of every row."""
    spark = ready(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)
    rows = docs.select(
        F.col(id_col).alias("__id"),
        (F.lit(False) if held_out is None else held_out).alias("__held_out"),
        F.coalesce(F.col(text_col), F.lit("")).alias("__text"),
    )
    kind = rows.schema["__id"].dataType.simpleString()
    return rows.mapInArrow(_predicted(sent), f"__id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("__id", id_col)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 4, holdout: int = 2) -> DataFrame:
    """Fit on the rows that aren't held out and predict every row."""
    held_out = fold(F.col(id_col), modulus) == holdout
    model = fit(docs.filter(~held_out & F.col(id_col).isNotNull()), text_col, lang_col)
    return predict(docs, model, id_col, text_col, held_out)
