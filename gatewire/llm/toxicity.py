"""Toxicity classifier that identity terms alone don't move: counterfactual regularisation.

A text's features are which of the model's words it has.  The model is a logistic
regression.  Besides the loss on the labels its training minimises what happens to a
labelled text's score (as log odds) when the identity terms in it are swapped for
others of their kind, as in "women" for "men" or "muslims" for "jews": the mean
square of that change, times ``FAIRNESS``.  Groups that the labelled toxic texts
happen to mention thereby stop counting, and a neutral mention of one scores like
the same text about another.

Which words the model knows follows from all labelled training texts: their counts
by label are summed by Spark, those in fewer than ``LEAST`` texts or with a chi-square below
``APART`` are left out, and the ``WORDS`` that tell the labels apart best stay; identity terms are always known.  The
labelled rows are stored as lists of word numbers; each step of the optimiser (L-BFGS) is
one pass over these in which every task sums its part of loss and gradient, and Spark
adds the parts.  Of more than ``SAMPLE`` labelled rows about so many are learnt from, chosen by a
hash of their ids; only these ids go to all tasks, and only these texts are kept and counted, so
learning costs the same for any corpus beyond that, and no text is shuffled.  The driver gets the chosen
words and one number a word, whatever the input.

Words are runs of letters and digits in lower case; a text counts whole, whatever its length.

Defined cases: NULL counts as empty, an empty text has the score of no words; labels
without an id or value don't count, of several labels of one id the highest does, and
it holds for each row of that id; without labels every score is 0.5, with labels of
one value all scores are that value; rows without an id are scored, never learnt from;
repeated rows count as often as they occur; an empty table gives no rows; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .common import fold, ready, slices, stored

#: Terms of one kind, to be swapped for each other.
IDENTITIES = (
    ("men", "women", "boys", "girls"),
    ("man", "woman", "boy", "girl"),
    ("male", "female", "nonbinary"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "heterosexual", "homosexual"),
    ("transgender", "cisgender", "trans", "cis"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("black", "white", "asian", "latino", "hispanic", "arab", "african", "european"),
    ("american", "mexican", "chinese", "indian", "russian", "german", "french", "nigerian"),
    ("immigrants", "natives", "refugees", "citizens", "foreigners", "locals"),
    ("old", "young", "elderly", "teenage"),
    ("deaf", "hearing", "blind", "sighted", "disabled"),
)
#: Each text is compared with itself after so many swaps, each term becoming the next, second next, ... of its kind.
SWAPS = 3
FAIRNESS = 4.0
WORDS, LEAST = 1 << 13, 3
#: Chi-square that one word in a thousand exceeds by chance.
APART = 10.83
RIDGE = 2e-4
STEPS = 40
#: Labelled rows to learn from, about; their ids and labels, some 16 bytes each, are broadcast.
SAMPLE = 1 << 17
#: Words that a task counts before it passes the counts on.
HELD = 1 << 20

_U = np.uint64


def identity_hashes() -> list[np.ndarray]:
    return [W.word_hashes(pa.array(kind))[0] for kind in IDENTITIES]


def text_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the distinct words of every text."""
    found, owner, _ = W.distinct(*W.word_hashes(pc.utf8_lower(column.fill_null(""))))
    return found, owner


def swapped(known: np.ndarray, words: np.ndarray, owner: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, number, +1 or -1): what swapping identity terms adds to and takes from the texts' sets of words."""
    was, text = [], []
    becomes = []
    for kind in identity_hashes():
        order = np.argsort(kind)
        at = np.searchsorted(kind[order], words)
        at = order[np.minimum(at, len(kind) - 1)]
        here = np.flatnonzero(kind[at] == words)
        was.append(words[here])
        becomes.append(np.roll(kind, -(by % len(kind) or 1))[at[here]])
        text.append(owner[here])
    was, becomes, text = np.concatenate(was), np.concatenate(becomes), np.concatenate(text)
    texts, numbers = np.concatenate((text, text)), np.searchsorted(known, np.concatenate((becomes, was)))
    signs = np.concatenate((np.ones(len(text)), -np.ones(len(text))))
    return texts, numbers, signs


@dataclass
class Model:
    """Hashes of the known words in order, their weights, and the weight of any text."""

    known: np.ndarray = field(default_factory=lambda: np.zeros(0, _U))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    always: float = 0.0

    def score(self, column: pa.Array) -> np.ndarray:
        numbers, owner = numbered(self.known, *text_words(column))
        odds = self.always + np.bincount(owner, self.weights[numbers], minlength=len(column))
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-odds))


def numbered(known: np.ndarray, words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words that are known."""
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    have = known[at] == words
    return at[have], owner[have]


def _counted(batches):
    """(word, texts, toxic texts), added up within a task over a bounded number of words."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush():
        found, toxic = (np.concatenate(part) for part in zip(*held))
        words, at = np.unique(found, return_inverse=True)
        held.clear()
        return pa.RecordBatch.from_pydict(
            {
                "word": pa.array(words.view(np.int64)),
                "n": pa.array(np.bincount(at, minlength=len(words))),
                "toxic": pa.array(np.bincount(at, toxic, minlength=len(words)).astype(np.int64)),
            }
        )

    size = 0
    for batch in batches:
        for part in slices(batch, "__text"):
            found, owner = text_words(part.column("__text"))
            held.append((found, part.column("__label").to_numpy()[owner]))
            size += len(found)
            if size > HELD:
                yield flush()
                size = 0
    if held:
        yield flush()


def choose(train: DataFrame, rows: int, toxic: int, words: int = WORDS, least: int = LEAST) -> np.ndarray:
    """Hashes of the words that tell the labels apart best, by chi-square over all texts, and of the identity terms."""
    counts = train.select("__label", "__text").mapInArrow(_counted, "word bigint, n bigint, toxic bigint")
    counts = counts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).filter(F.col("n") >= least)
    share = toxic / rows
    off = F.col("toxic") - F.col("n") * share
    chance = F.col("n") * (share * (1 - share)) * ((rows + 1.0 - F.col("n")) / rows)
    chosen = counts.select("word", (off * off / chance).alias("apart")).filter(F.col("apart") >= APART)
    found = [row["word"] for row in chosen.orderBy(F.desc("apart"), "word").limit(words).collect()]
    return np.unique(np.concatenate([np.array(found, np.int64).view(_U), *identity_hashes()]))


def _featured(known: np.ndarray):
    """Word numbers of each labelled text, and for each swap the numbers it adds and takes away."""

    def lists(numbers: np.ndarray, owner: np.ndarray, texts: int) -> pa.Array:
        order = np.argsort(owner, kind="stable")
        ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=texts)))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(numbers[order].astype(np.int32)))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "__text"):
                words, owner = text_words(part.column("__text"))
                columns = {"__label": part.column("__label"), "has": lists(*numbered(known, words, owner), part.num_rows)}
                for by in range(1, SWAPS + 1):
                    text, number, sign = swapped(known, words, owner, by)
                    # the sign is in the number, which starts at 1 for that
                    columns[f"swap{by}"] = lists((number + 1) * sign.astype(np.int64), text, part.num_rows)
                yield pa.RecordBatch.from_pydict(columns)

    return run


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    ends = column.offsets.to_numpy()
    values = column.values.to_numpy()[ends[0] : ends[-1]]
    return values.astype(np.int64), np.repeat(np.arange(len(column)), np.diff(ends))


def _loss_and_gradient(weights: np.ndarray, always: float, weigh: tuple[float, float], fairness: float):
    """One row per task and block of 1,024 places: the sums of its part; loss and gradient of ``always`` come last."""
    size = len(weights)

    def run(batches):
        total = np.zeros(size + 2)
        for batch in batches:
            rows = batch.num_rows
            label = batch.column("__label").to_numpy().astype(float)
            counts = np.where(label > 0, weigh[1], weigh[0])
            numbers, owner = _flat(batch.column("has"))
            odds = always + np.bincount(owner, weights[numbers], minlength=rows)
            signed = np.where(label > 0, odds, -odds)
            total[size + 1] += counts @ np.logaddexp(0, -signed)
            off = counts * (1 / (1 + np.exp(-np.clip(odds, -700, 700))) - label)
            total[:size] += np.bincount(numbers, off[owner], minlength=size)
            total[size] += off.sum()
            for by in range(1, SWAPS + 1):
                signs, owner = _flat(batch.column(f"swap{by}"))
                if not len(signs):
                    continue
                numbers, sign = np.abs(signs) - 1, np.sign(signs)
                change = np.bincount(owner, sign * weights[numbers], minlength=rows)
                each = counts * fairness / SWAPS
                total[size + 1] += each @ (change * change)
                total[:size] += np.bincount(numbers, 2 * sign * (each * change)[owner], minlength=size)
        blocks = [total[low : low + 1024] for low in range(0, size + 2, 1024)]
        yield pa.RecordBatch.from_pydict(
            {"block": pa.array(range(len(blocks)), pa.int32()), "part": pa.array(blocks, pa.list_(pa.float64()))}
        )

    return run


def minimise(function, start: np.ndarray, steps: int, history: int = 10, enough: float = 1e-4) -> np.ndarray:
    """L-BFGS with halved steps; ``function`` gives value and gradient."""
    at = start
    value, slope = function(at)
    first = float(np.linalg.norm(slope))
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.linalg.norm(slope) <= enough * first:
            break
        direction, stack = slope.copy(), []
        for s, y in reversed(pairs):
            share = (s @ direction) / (s @ y)
            stack.append(share)
            direction -= share * y
        if pairs:
            s, y = pairs[-1]
            direction *= (s @ y) / (y @ y)
        else:
            direction /= max(first, 1.0)
        for (s, y), share in zip(pairs, reversed(stack)):
            direction += (share - (y @ direction) / (s @ y)) * s
        step = 1.0
        while step > 1e-6:
            there = at - step * direction
            new_value, new_slope = function(there)
            if new_value <= value - 1e-4 * step * (slope @ direction):
                break
            step /= 2
        else:
            break
        s, y = there - at, new_slope - slope
        at, value, slope = there, new_value, new_slope
        if s @ y > 1e-12 * (y @ y):
            pairs = [*pairs[-(history - 1) :], (s, y)]
    return at


def labelled(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE, holdout: int = 0
) -> DataFrame:
    """(__label, __text) of the rows to learn from."""
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label")).dropna()
    known = known.filter(fold(F.col("__id"), 5) != holdout).groupBy("__id").agg(F.max("__label").cast("int").alias("__label"))
    part = sample / max(known.count(), 1)
    if part < 1:
        known = known.filter(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < int(part * (1 << 30)))
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    # at most about ``sample`` ids
    return texts.join(F.broadcast(known), "__id").select((F.col("__label") > 0).cast("int").alias("__label"), "__text")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    fairness: float = FAIRNESS,
    words: int = WORDS,
    least: int = LEAST,
    sample: int = SAMPLE,
) -> Model:
    """The model of the labelled rows that aren't held out, or of about ``sample`` of them."""
    ready(docs.sparkSession)
    train = stored(labelled(docs, labels, id_col, text_col, label_col, sample), "toxic-train")
    seen = train.agg(F.count("*").alias("n"), F.sum("__label").alias("toxic")).first()
    rows, toxic = seen["n"], seen["toxic"] or 0
    if not rows:
        return Model()
    if toxic in (0, rows):
        return Model(always=np.inf if toxic else -np.inf)
    known = choose(train, rows, toxic, words, least)
    layout = "__label int, has array<int>, " + ", ".join(f"swap{by} array<int>" for by in range(1, SWAPS + 1))
    features = stored(train.mapInArrow(_featured(known), layout), "toxic-features")
    # either label counts half, so that the rare one isn't outvoted
    weigh = 0.5 / (rows - toxic), 0.5 / toxic

    def evaluate(at: np.ndarray) -> tuple[float, np.ndarray]:
        parts = features.mapInArrow(_loss_and_gradient(at[:-1], float(at[-1]), weigh, fairness), "block int, part array<double>")
        cells = parts.select("block", F.posexplode("part").alias("i", "x")).groupBy("block", "i").agg(F.sum("x").alias("x"))
        found = cells.toPandas()  # one number a word
        total = np.zeros(len(at) + 1)
        total[found["block"] * 1024 + found["i"]] = found["x"]
        value, slope = total[-1], total[:-1]
        return value + RIDGE / 2 * float(at[:-1] @ at[:-1]), slope + RIDGE * np.append(at[:-1], 0.0)

    best = minimise(evaluate, np.zeros(len(known) + 1), STEPS)
    return Model(known, best[:-1], float(best[-1]))


def _scored(model: Model):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "__text"):
                score = model.score(part.column("__text"))
                columns = {"__id": part.column("__id"), "held_out": part.column("__held_out")}
                columns |= {"score": pa.array(score), "predicted": pa.array((score >= 0.5).astype(np.int32))}
                yield pa.RecordBatch.from_pydict(columns)

    return run


def scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options
) -> DataFrame:
    """(id, held_out, score, predicted) of every row of ``docs``; options as for ``fit``."""
    model = fit(docs, labels, id_col, text_col, label_col, **options)
    rows = docs.select(F.col(id_col).alias("__id"), (fold(F.col(id_col), 5) == 0).alias("__held_out"), F.col(text_col).alias("__text"))
    kind = rows.schema["__id"].dataType.simpleString()
    scored = rows.mapInArrow(_scored(model), f"__id {kind}, held_out boolean, score double, predicted int")
    return scored.withColumnRenamed("__id", id_col)
