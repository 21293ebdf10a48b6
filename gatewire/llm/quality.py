"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Every text becomes ``len(STATISTICS)`` numbers, standardised by the training rows'
mean and deviation.  ``FEATURES`` random cosines approximate a Gaussian kernel
over them.  Each task sums its part of the normal equations over the labelled
rows, Spark adds the parts, and the driver solves one system of that fixed size.
Half of the training rows fit the ridge scores; on the others the scores are
counted by ``BINS`` bins and the pooled-adjacent-violators fit of the bins makes
them probabilities.  Labels aren't sampled.

Defined cases: NULL counts as empty, an empty text has all statistics zero and a
score like any other; labels without an id or value don't count, of several
labels of one id the highest does, and it holds for each row of that id; without
labels every score is 0.5; rows without an id are scored, never learnt from.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .common import fold, ready, slices, stored

STATISTICS = (
    "log_words", "log_bytes", "word_length", "upper", "digits", "bars", "marks", "exclamations",
    "stops", "other_punctuation", "line_breaks", "blanks", "not_ascii", "distinct_words", "repeated_shingles",
)
FEATURES = 192
RIDGE = 1e-3
#: Kernel width, in standard deviations times the root of the number of statistics.
WIDTH = 1.0
BINS = 400

_CLASSES = {
    "letter": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "bar": "|",
    "mark": "#$%&*@^~<>{}[]\\+=_`", "exclamation": "!?", "stop": ".,;:", "break": "\n\r", "blank": " \t\v\f",
}
_NUMBER = {name: i for i, name in enumerate([*_CLASSES, "other", "not_ascii"])}
_CLASS_OF = np.full(256, _NUMBER["other"])
_CLASS_OF[128:] = _NUMBER["not_ascii"]
for _name, _members in _CLASSES.items():
    _CLASS_OF[[ord(c) for c in _members]] = _NUMBER[_name]


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS per text."""
    texts = len(column)
    ends, raw = W.utf8(column)
    kinds = len(_NUMBER)
    counts = np.zeros((texts, kinds))
    sizes = np.diff(ends)
    for low in range(0, len(raw), W.CHUNK):
        high = min(low + W.CHUNK, len(raw))
        here = np.clip(ends[1:], low, high) - np.clip(ends[:-1], low, high)
        slots = np.repeat(np.arange(texts) * kinds, here)
        slots += _CLASS_OF[raw[low:high]]
        counts += np.bincount(slots, minlength=texts * kinds).reshape(texts, kinds)
    of = {name: counts[:, i] for name, i in _NUMBER.items()}
    words, owner = W.word_hashes(column)
    n = W.counts_by_text(owner, texts).astype(float)
    different = W.distinct_counts(words, owner, texts)
    found, holder = W.shingles(words, owner, texts)
    n_shingles = W.counts_by_text(holder, texts)
    distinct_shingles = W.distinct_counts(found, holder, texts)
    letters = of["letter"] + of["upper"]
    per_word, per_byte = np.maximum(n, 1), np.maximum(sizes, 1)
    root = np.sqrt
    return np.column_stack(
        [
            np.log1p(n), np.log1p(sizes), np.minimum((letters + of["not_ascii"] + of["digit"]) / per_word, 30),
            root(of["upper"] / np.maximum(letters, 1)), root(of["digit"] / per_byte), root(np.minimum(of["bar"] / per_word, 4)),
            root(np.minimum(of["mark"] / per_word, 9)), root(np.minimum(of["exclamation"] / per_word, 9)),
            root(np.minimum(of["stop"] / per_word, 4)), root(np.minimum(of["other"] / per_word, 4)),
            root(np.minimum(of["break"] / per_word, 4)), of["blank"] / per_byte, of["not_ascii"] / per_byte,
            different / np.maximum(n, 1) ** 0.85, (n_shingles - distinct_shingles) / np.maximum(n_shingles, 1),
        ]
    )


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None = None
    knots: np.ndarray = field(default_factory=lambda: np.array([0.0]))
    levels: np.ndarray = field(default_factory=lambda: np.array([0.5]))

    def cosines(self, rows: np.ndarray) -> np.ndarray:
        random = np.random.default_rng(9)
        size = len(self.mean)
        directions = random.normal(size=(size, FEATURES)) / (WIDTH * np.sqrt(size))
        phases = random.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((rows - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(z @ directions + phases), np.ones(len(rows))])

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return self.cosines(rows) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(rows), self.levels[0])
        return np.interp(self.raw(rows), self.knots, self.levels)


def pooled(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Least-squares non-decreasing fit (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for value, weight in zip(values, weights):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, w, n = blocks.pop()
            blocks[-1] = [(blocks[-1][0] * blocks[-1][1] + v * w) / (blocks[-1][1] + w), blocks[-1][1] + w, blocks[-1][2] + n]
    return np.concatenate([np.full(n, v) for v, _, n in blocks]) if blocks else np.zeros(0)


def _matrix(rows) -> np.ndarray:
    return np.array(rows, dtype=float).reshape(-1, len(STATISTICS))


def _stats(batches):
    for batch in batches:
        for part in slices(batch, "__text"):
            values = statistics(part.column("__text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("__id"), part.column("__learn"), pa.array(list(values), pa.list_(pa.float64()))],
                names=["__id", "__learn", "__stats"],
            )


def _normal_equations(model: Model):
    size = FEATURES + 1

    def run(batches):
        total = np.zeros((size, size + 1))
        for batch in batches:
            z = model.cosines(_matrix(batch.column("__stats").to_pylist()))
            y = batch.column("__label").to_numpy(zero_copy_only=False).astype(float)
            total += z.T @ np.column_stack([z, y])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "part"]
        )

    return run


def _binned(model: Model):
    def run(batches):
        for batch in batches:
            raw = model.raw(_matrix(batch.column("__stats").to_pylist()))
            at = np.clip(np.floor((raw + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("__label")], names=["bin", "__label"])

    return run


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", holdout: int = 1) -> DataFrame:
    """(__id, __learn, __stats), stored: one pass over the texts. __learn: 0 held out, 1 fits scores, 2 calibrates."""
    ready(docs.sparkSession)
    rest = fold(F.col(id_col), 3)
    learn = F.when(F.col(id_col).isNull() | (rest == holdout), 0).when(rest == (holdout + 1) % 3, 1).otherwise(2)
    rows = docs.select(F.col(id_col).alias("__id"), learn.cast("int").alias("__learn"), F.col(text_col).alias("__text"))
    kind = rows.schema["__id"].dataType.simpleString()
    return stored(rows.mapInArrow(_stats, f"__id {kind}, __learn int, __stats array<double>"), "stats")


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """A model of bounded size from the labelled rows that aren't held out."""
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label")).dropna()
    known = known.groupBy("__id").agg(F.max("__label").cast("int").alias("__label"))
    train = stored(stats.filter("__learn > 0").join(known, "__id").select("__learn", "__label", "__stats"), "train")
    size = len(STATISTICS)
    one = [F.get("__stats", F.lit(i)) for i in range(size)]
    moments = train.agg(
        F.count("*").alias("n"), F.min("__label").alias("low"), F.max("__label").alias("high"),
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(one)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(one)],
    ).first()
    if not moments["n"]:
        return Model(np.zeros(size), np.ones(size))
    mean = np.array([moments[f"m{i}"] for i in range(size)])
    scale = np.array([moments[f"s{i}"] for i in range(size)])
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0))
    if moments["low"] == moments["high"]:
        model.levels = np.array([float(moments["low"])])
        return model

    first = train.filter("__learn = 1") if train.filter("__learn = 1").head(1) else train
    parts = first.select("__stats", "__label").mapInArrow(_normal_equations(model), "i int, part array<double>")
    sums = parts.select("i", F.posexplode("part").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    system = np.zeros((FEATURES + 1, FEATURES + 2))
    system[sums["i"], sums["j"]] = sums["x"]
    n = system[-1, -2]
    penalty = np.eye(FEATURES + 1) * RIDGE * max(n, 1)
    penalty[-1, -1] = 1e-9
    model.weights = np.linalg.solve(system[:, :-1] + penalty / FEATURES, system[:, -1])

    second = train.filter("__learn = 2")
    bins = second.select("__stats", "__label").mapInArrow(_binned(model), "bin int, __label int")
    bins = bins.groupBy("bin").agg(F.count("*").alias("n"), F.sum("__label").alias("ones")).toPandas().sort_values("bin")
    if len(bins):
        # half a row of either kind keeps the ends off 0 and 1
        levels = pooled(((bins["ones"] + 0.5) / (bins["n"] + 1)).to_numpy(), bins["n"].to_numpy(float))
        model.knots, model.levels = (bins["bin"].to_numpy() + 0.5) / BINS * 2 - 0.5, np.clip(levels, 0, 1)
    else:
        model.knots, model.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def _scored(model: Model):
    def run(batches):
        for batch in batches:
            score = model.score(_matrix(batch.column("__stats").to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("__id"),
                    pa.array(batch.column("__held_out")),
                    pa.array(score),
                    pa.array((score >= 0.5).astype(np.int32)),
                ],
                names=["__id", "held_out", "score", "predicted"],
            )

    return run


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row of ``docs``."""
    stats = document_statistics(docs, id_col, text_col)
    model = fit(stats, labels, id_col)
    kind = stats.schema["__id"].dataType.simpleString()
    rows = stats.select("__id", (fold(F.col("__id"), 3) == 1).alias("__held_out"), "__stats")
    scored = rows.mapInArrow(_scored(model), f"__id {kind}, held_out boolean, score double, predicted int")
    return scored.withColumnRenamed("__id", id_col)


def _accepted(model: Model, text_col: str):
    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for part in slices(batch, text_col):
                yield part.filter(pa.array(model.score(statistics(part.column(at))) >= 0.5))

    return run


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score below 0.5; all columns stay."""
    model = fit(document_statistics(docs, id_col, text_col), labels, id_col)
    return docs.mapInArrow(_accepted(model, text_col), docs.schema)
