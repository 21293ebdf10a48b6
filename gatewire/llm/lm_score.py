"""Language-model scoring: a log-frequency Bloom filter of quantised n-gram counts, in segments.

Tokens are words (runs of characters other than space and tab to carriage return,
A to Z in lower case) and one end per text; they are counted by 64 bits of hash.
One pass counts the words and word pairs of the training texts, also those seen
once (the start of a text is a word of its own in pairs).  A task sends the counts
of many texts to a segment as one row; n-grams go by 48 bits of hash, of which the
first say the segment.  There are ``SEGMENTS`` segments, or one for ``SEGMENT_TEXT``
bytes of text if that is more, so a segment is as large in any corpus.

The filter (Talbot and Osborne 2007) stores a count c as 1 + floor(log2(c)) entries
"n-gram, level", ``PROBES`` bits each; a look-up probes level after level until a
bit is missing.  Each segment has as many bits as hold its levels at half load.

The filter stays a table of segments: every slice of texts sends its distinct n-grams
to their segments and gets the levels back.  So it has no size at which counts are
left out, and neither the driver nor a task holds more than a part of it.

P(w | v) = L * min(1, n(v w) / n(v)) + (1 - L) * (n(w) + 1) / (N + V + 1), with n
from the filter, L = ``PAIR_SHARE``, N tokens and V distinct tokens in training.

The base score needs exact counts of all words: those of the ``HEAD`` most
frequent at most are broadcast, the other words of every text are joined with the
full count table.

Defined cases: NULL counts as empty; an empty text has one token, its end; without
training texts N = V = 0 and every count is 0; rows without an id are training
texts and are scored; repeated rows count as often as they occur.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .common import fold, ready, slices, stored

PAIR_SHARE = 0.6
PROBES = 3
SEGMENTS = 256
SEGMENT_TEXT = 32 << 20
HEAD = 1 << 19
#: Bytes of text that are looked up together, bytes that are cut into tokens at a time, and tokens that are counted together.
SLICE = 8 << 20
PIECE = 2 << 20
TOGETHER = 3 << 19
#: Bits of an n-gram's key.
KEY_BITS = 48

_U = np.uint64
END = W.mix(np.array([0x656E64], _U))[0]
START = W.mix(np.array([0x7374617274], _U))[0]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def tokens(column: pa.Array):
    """(token hashes in order with each text's end, number of the text)."""
    ends, raw = W.utf8(column)
    lowered = pa.Array.from_buffers(pa.large_string(), len(column), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(_LOWER[raw].tobytes())])
    found, owner = W.blank_separated(lowered)
    n = W.counts_by_text(owner, len(column))
    after = np.cumsum(n)
    return np.insert(found, after, END), np.insert(owner, after, np.arange(len(column)))


def pairs(token: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it in its text."""
    before = np.empty_like(token)
    before[:1] = START
    before[1:] = token[:-1]
    before[1:][owner[1:] != owner[:-1]] = START
    return W.mix(before * _U(0x9E3779B97F4A7C15) + token)


def key(hashes: np.ndarray) -> np.ndarray:
    """48 bits by which n-grams are counted and found; the first say the segment."""
    return W.mix(hashes) >> _U(64 - KEY_BITS)


def packed(numbers: np.ndarray) -> bytes:
    """48-bit numbers, first bytes of all first: those of sorted keys hardly take room once compressed."""
    return numbers.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, 5::-1].T.tobytes()


def unpacked(content: bytes) -> np.ndarray:
    columns = np.frombuffer(content, np.uint8).reshape(6, -1)
    out = np.zeros((columns.shape[1], 8), np.uint8)
    out[:, 5::-1] = columns.T
    return out.view("<u8").ravel()


def summed(values: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and the sums of their times."""
    if not len(values):
        return values, times
    order = np.argsort(values)
    values = values[order]
    first = np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1))
    return values[first], np.add.reduceat(times[order], first)


def _borders(keys: np.ndarray, segments: int) -> np.ndarray:
    """Where each segment begins in sorted keys, and their end."""
    width = (1 << KEY_BITS) // segments
    return np.append(np.searchsorted(keys, np.arange(segments, dtype=_U) * _U(width)), len(keys))


def _dealt(words: np.ndarray, word_times: np.ndarray, grams: np.ndarray, times: np.ndarray, segments: int) -> pa.RecordBatch:
    """Counts by segment; ``words`` are hashes, ``grams`` sorted keys."""
    keys = key(words)
    order = np.argsort(keys)
    words, word_times = words[order], word_times[order]
    at, word_at = _borders(grams, segments), _borders(keys[order], segments)
    here = np.flatnonzero((at[1:] > at[:-1]) | (word_at[1:] > word_at[:-1]))
    cut = lambda values, borders, as_bytes: pa.array([as_bytes(values[borders[i] : borders[i + 1]]) for i in here], pa.binary())
    plain = lambda values: values.tobytes()
    return pa.RecordBatch.from_arrays(
        [
            pa.array(here.astype(np.int32)),
            cut(words, word_at, plain),
            cut(word_times.astype(np.int64), word_at, plain),
            cut(grams, at, packed),
            cut(times.astype(np.int64), at, plain),
        ],
        names=["segment", "words", "word_times", "grams", "times"],
    )


DEALT = "segment int, words binary, word_times binary, grams binary, times binary"


def _counted(segments: int):
    def joined(words: list, grams: list, texts: int) -> pa.RecordBatch:
        found, times = np.unique(np.concatenate(words), return_counts=True)
        both, both_times = np.unique(np.concatenate(grams), return_counts=True)
        start = key(np.array([START], _U))
        return _dealt(found, times, *summed(np.append(both, start), np.append(both_times, texts)), segments)

    def run(batches):
        words, grams, texts, size = [], [], 0, 0
        for batch in batches:
            for part in slices(batch, "__text", PIECE, 1 << 16):
                token, owner = tokens(part.column("__text"))
                words.append(token)
                grams.append(key(pairs(token, owner)))
                texts, size = texts + part.num_rows, size + len(token)
                if size >= TOGETHER:
                    yield joined(words, grams, texts)
                    words, grams, texts, size = [], [], 0, 0
        if words:
            yield joined(words, grams, texts)

    return run


class Filter:
    """Count estimates for n-grams, from the bits of all segments or of one of them."""

    def __init__(self, parts: list[bytes], cut: int = 1) -> None:
        self.bits = np.frombuffer(b"".join(parts), np.uint8)
        self.cut = cut
        self.segments = len(parts)
        ends = np.cumsum([len(part) * 8 for part in parts])
        self.begin = np.concatenate(([0], ends[:-1])).astype(np.int64)
        self.mask = np.array([len(part) * 8 - 1 for part in parts], _U)

    @staticmethod
    def slots(keys: np.ndarray, level: int, probe: int, mask: np.ndarray) -> np.ndarray:
        """Bit within the n-gram's segment."""
        salt = _U(((level * PROBES + probe + 1) * 0xD6E8FEB86659FD93) % 2**64)
        return (W.mix(keys ^ salt) & mask).astype(np.int64)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Number of levels that the filter holds of each key."""
        out = np.zeros(len(keys), np.uint8)
        shift = _U(KEY_BITS - (self.segments.bit_length() - 1))
        segment = (keys >> shift).astype(np.int64)  # 0 for the bits of one segment
        alive = np.arange(len(keys))
        for level in range(64):
            for probe in range(PROBES):
                at = self.begin[segment[alive]] + self.slots(keys[alive], level, probe, self.mask[segment[alive]])
                alive = alive[(self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
            if not len(alive):
                break
            out[alive] += 1
        return out

    @staticmethod
    def counts(levels: np.ndarray, cut: int = 1) -> np.ndarray:
        """Middle of the counts of each level; 0 without a level."""
        middle = np.array([0.0, *(cut * 2.0**level * 1.5 - 0.5 if level or cut > 1 else 1.0 for level in range(64))])
        return middle[levels]

    def estimate(self, hashes: np.ndarray) -> np.ndarray:
        return self.counts(self.levels(key(hashes)), self.cut)


#: Bits of a segment without n-grams.
EMPTY = bytes(8)


def _filled(keys: np.ndarray, times: np.ndarray, cut: int, most_bits: int | None) -> bytes:
    """Bits of one segment, at most half of them set unless ``most_bits`` stands against it."""
    levels = np.floor(np.log2(times / cut)).astype(np.int64)
    need = float((levels + 1).sum()) * PROBES / 0.69
    size = max(1 << max(6, int(np.ceil(np.log2(max(need, 1))))), 64)
    size = min(size, most_bits or size)
    bits = np.zeros(size // 8, np.uint8)
    for level in range(int(levels.max(initial=-1)) + 1):
        chosen = keys[levels >= level]
        for probe in range(PROBES):
            at = Filter.slots(chosen, level, probe, _U(size - 1))
            np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
    return bits.tobytes()


def built(dealt: DataFrame, cut: int = 1, most_bits: int | None = None) -> DataFrame:
    """(segment, bits, h, n): the filter's segments, and hashes and counts of the words that belong there."""

    def run(group):
        column = lambda name, read: np.concatenate([read(c.as_py()) for c in group.column(name)])
        whole = lambda content: np.frombuffer(content, np.int64)
        words, n = summed(column("words", whole).view(_U), column("word_times", whole))
        grams, times = column("grams", unpacked), column("times", whole)
        grams, times = summed(np.concatenate((grams, key(words))), np.concatenate((times, n)))
        listed = lambda values: pa.array([values.view(np.int64)], pa.list_(pa.int64()))
        bits = pa.array([_filled(grams, times, cut, most_bits)], pa.binary())
        return pa.Table.from_arrays([group.column("segment").combine_chunks()[:1], bits, listed(words), listed(n)], names=["segment", "bits", "h", "n"])

    return dealt.groupBy("segment").applyInArrow(run, "segment int, bits binary, h array<bigint>, n array<bigint>")


def _rows_dealt(batches):
    for batch in batches:
        grams, times = summed(key(batch.column("h").to_numpy().view(_U)), batch.column("n").to_numpy())
        yield _dealt(np.zeros(0, _U), np.zeros(0, np.int64), grams, times, SEGMENTS)


def build_filter(counted: DataFrame, most_bits: int | None = None) -> Filter:
    """The filter over a table (h, n) of counts, brought to the driver; for small tables.

    Only a caller who sets ``most_bits`` gets one without the least counts, from the least ``cut`` that
    fits.  ``scores`` looks up the table of segments instead, which leaves out nothing.
    """
    ready(counted.sparkSession)
    low = 0
    if most_bits:
        octaves = counted.groupBy(F.floor(F.log2("n")).alias("octave")).count().collect()  # at most 63 rows
        by_octave = {int(r["octave"]): r["count"] for r in octaves}
        while sum(n * (o - low + 1) for o, n in by_octave.items() if o >= low) * PROBES / 0.69 > most_bits:
            low += 1
    dealt = counted.filter(F.col("n") >= 2**low).select("h", "n").mapInArrow(_rows_dealt, DEALT)
    parts = dict.fromkeys(range(SEGMENTS), EMPTY)
    found = built(dealt, 2**low, most_bits and most_bits // SEGMENTS).select("segment", "bits").toArrow()
    parts |= zip(found["segment"].to_pylist(), found["bits"].to_pylist())
    return Filter(list(parts.values()), 2**low)


def head_counts(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the most frequent words, at most HEAD of them."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 16)
    steps = sorted(((int(r["step"]), r["count"]) for r in words.groupBy(step.alias("step")).count().collect()), reverse=True)
    total, least = 0, None
    for at, n in steps:
        if total + n > HEAD:
            break
        total, least = total + n, at
    if least is None:
        return np.zeros(0, _U), np.zeros(0)
    rows = words.filter(step >= least).select("h", "n").toArrow()
    hashes, times = rows["h"].to_numpy().view(_U), rows["n"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], times[order]


class Slice:
    """Texts worked on together: the distinct words, which of them each token is, and the distinct keys to look up."""

    def __init__(self, words: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        """``words``: distinct hashes; ``at``: number of each token's word; ``n``: tokens of each text."""
        self.words, self.at, self.n = words, at, n
        self.owner = np.repeat(np.arange(len(n)), n)
        self.begin = np.concatenate(([0], np.cumsum(n)[:-1]))
        self.pairs, self.pair_at = np.unique(key(pairs(words[at], self.owner)), return_inverse=True)
        self.keys = np.unique(np.concatenate((key(words), self.pairs, key(np.array([START], _U)))))

    @staticmethod
    def of(part: pa.RecordBatch) -> Slice:
        found, n = [], []
        for piece in slices(part, "__text", PIECE, 1 << 16):
            token, owner = tokens(piece.column("__text"))
            found.append(token)
            n.append(W.counts_by_text(owner, piece.num_rows))
        words, at, times = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
        order = np.argsort(-times)  # small numbers for frequent words
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        return Slice(words[order], rank[at], np.concatenate(n))

    def packed(self) -> bytes:
        """The words' numbers, first bytes of all first, compressed."""
        return pa.Codec("zstd").compress(self.at.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), asbytes=True)

    @staticmethod
    def unpacked(content: bytes, words: np.ndarray, n: np.ndarray) -> Slice:
        total = int(n.sum())
        columns = np.frombuffer(pa.Codec("zstd").decompress(content, decompressed_size=4 * total), np.uint8).reshape(4, total)
        return Slice(words, np.ascontiguousarray(columns.T).view("<u4").ravel().astype(np.int64), n)

    def scores(self, levels: np.ndarray, unit: float) -> np.ndarray:
        """log10 probability of each text, from the levels of ``keys``."""
        found = Filter.counts(levels)
        of = lambda keys: found[np.searchsorted(self.keys, keys)]
        single, both = of(key(self.words))[self.at], of(self.pairs)[self.pair_at]
        before = np.empty_like(single)
        before[1:] = single[:-1]
        before[self.begin] = of(key(np.array([START], _U)))[0]
        share = np.minimum(1.0, both / np.maximum(before, 1.0))
        return np.add.reduceat(np.log10(PAIR_SHARE * share + (1 - PAIR_SHARE) * (single + 1) * unit), self.begin)

    def known(self, hashes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
        """Of each text: tokens among ``hashes``, the sum of log10(count + 1) of these, and its other tokens."""
        place = np.minimum(np.searchsorted(hashes, self.words), max(len(hashes) - 1, 0))
        known = hashes[place] == self.words if len(hashes) else np.zeros(len(self.words), bool)
        logs = np.log10(np.where(known, times[place] if len(hashes) else 0, 0) + 1.0)
        frequent = known[self.at]
        cuts = np.concatenate(([0], np.cumsum(W.counts_by_text(self.owner[~frequent], len(self.n)))))
        rare = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(self.words[self.at[~frequent]].view(np.int64)))
        return W.counts_by_text(self.owner[frequent], len(self.n)), np.add.reduceat(logs[self.at], self.begin), rare


ASKED = "segment int, slice bigint, keys binary, texts binary, words binary, at binary"


def _asked(segments: int):
    """Of each slice a row for every segment: the keys there, and an equal piece of all else, which goes along."""

    def run(batches):
        parts = (part for batch in batches for part in slices(batch, "__text", SLICE, 1 << 16))
        for number, part in enumerate(parts):
            name = (TaskContext.get().partitionId() << 32) + number
            texts = Slice.of(part)
            borders = _borders(texts.keys, segments)
            here = np.flatnonzero(borders[1:] > borders[:-1])
            own = part.select(["__row", "__id", "__held_out"]).append_column("n", pa.array(texts.n))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, own.schema) as stream:
                stream.write_batch(own)
            rest = sink.getvalue().to_pybytes(), texts.words.tobytes(), texts.packed()
            ends = [np.arange(len(here) + 1) * len(content) // len(here) for content in rest]
            columns = [[packed(texts.keys[borders[i] : borders[i + 1]]) for i in here]]
            columns += [[content[low:high] for low, high in zip(cut, cut[1:])] for content, cut in zip(rest, ends)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(here.astype(np.int32)), pa.array(np.full(len(here), name)), *(pa.array(column, pa.binary()) for column in columns)],
                names=["segment", "slice", "keys", "texts", "words", "at"],
            )

    return run


def _answered(asked, model):
    """The keys of one segment replaced by their levels."""
    part = Filter([model.column("bits")[0].as_py() if model.num_rows else EMPTY])
    keys = [unpacked(c.as_py()) for c in asked.column("keys")]
    found = part.levels(np.concatenate([np.zeros(0, _U), *keys]))
    ends = np.cumsum([0, *(len(k) for k in keys)])
    levels = [found[low:high].tobytes() for low, high in zip(ends, ends[1:])]
    return asked.set_column(asked.column_names.index("keys"), "keys", pa.array(levels, pa.binary()))


def _scored(head, unit: float):
    """The texts of one slice, scored with the levels that came back."""

    def run(group):
        group = group.sort_by("segment")
        levels, own, words, at = (b"".join(group.column(name).to_pylist()) for name in ("keys", "texts", "words", "at"))
        rows = pa.ipc.open_stream(own).read_all()
        texts = Slice.unpacked(at, np.frombuffer(words, _U), rows["n"].to_numpy())
        score = texts.scores(np.frombuffer(levels, np.uint8), unit)
        known, logs, rare = texts.known(*head.value)
        rows = rows.rename_columns(["__row", "__id", "held_out", "n_tokens"])
        for name, column in (("__known", known), ("__sum", logs), ("__rare", rare), ("score", score)):
            rows = rows.append_column(name, column if name == "__rare" else pa.array(column))
        return rows

    return run


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, holdout: int = 2) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = ready(docs.sparkSession)
    held_out = fold(F.col(id_col), modulus) == holdout
    rows = docs.select(F.col(id_col).alias("__id"), held_out.alias("__held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    text_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("__text")), F.lit(0)).alias("n")).first()["n"]
    segments = max(SEGMENTS, 1 << max(-(-text_bytes // SEGMENT_TEXT) - 1, 0).bit_length())
    learnt = rows.filter(~F.col("__held_out")).select("__text").mapInArrow(_counted(segments), DEALT)
    model = stored(built(learnt), "model")
    words = model.select(F.inline(F.arrays_zip("h", "n")))
    size = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("distinct")).first()
    unit = 1.0 / (size["total"] + size["distinct"] + 1)
    head = spark.sparkContext.broadcast(head_counts(words))

    kind = rows.schema["__id"].dataType.simpleString()
    schema = (
        f"__row bigint, __id {kind}, held_out boolean, n_tokens bigint, __known bigint, __sum double, __rare array<bigint>, score double"
    )
    numbered = rows.withColumn("__row", F.monotonically_increasing_id()).select("__row", "__id", "__held_out", "__text")
    asked = numbered.mapInArrow(_asked(segments), ASKED).groupBy("segment")
    answered = asked.cogroup(model.select("segment", "bits").groupBy("segment")).applyInArrow(_answered, ASKED)
    scored = stored(answered.groupBy("slice").applyInArrow(_scored(head, unit), schema), "scored")
    rare = scored.select("__row", F.explode("__rare").alias("h")).groupBy("__row", "h").agg(F.count("*").alias("times"))
    rare = rare.join(words.select("h", "n"), "h").groupBy("__row").agg(
        F.sum("times").alias("__more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("__added")
    )
    return (
        scored.drop("__rare")
        .join(rare, "__row", "left")
        .select(
            F.col("__id").alias(id_col),
            "held_out",
            "n_tokens",
            (F.col("__known") + F.coalesce("__more", F.lit(0))).alias("n_known"),
            F.lit(size["total"]).cast("bigint").alias("train_tokens"),
            (F.col("__sum") + F.coalesce("__added", F.lit(0.0)) + F.col("n_tokens") * float(np.log10(unit))).alias("base_score"),
            "score",
        )
    )
