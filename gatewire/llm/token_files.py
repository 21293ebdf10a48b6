"""Token-id output in patched frame-of-reference blocks.

Texts are encoded with the ``tokenizers`` library, an end id follows each, and the
ids are written in ascending order of document id.  A file set is a Parquet
folder of segments, written by Spark (so any store and committer serve, and a lost
executor's tasks are simply repeated): ``bucket`` and ``first`` order the segments,
``first`` counting ids before it in its bucket; ``doc_ids`` and ``doc_sizes`` say
whose ids follow; ``payload`` is binary, little-endian:

    header   magic "PFR1", block length (4), ids (8), blocks (4)
    index    start of every block within the payload, and the end (4 each)
    blocks   minimum (4), width (1), exceptions (2), the packed ids, then the
             exceptions' positions (2 each) and values (4 each)

A block takes its minimum off, packs the differences at the width that
``PERCENTILE`` of them need, and lists the others as exceptions.

Documents go to ranges of their id of about equal size; the driver knows only the
bounds of the ranges, one per shuffle partition.  Splitting a text at ASCII blanks
doesn't change its ids, so a worker keeps the ids of up to ``CACHE`` such words.
A new word is normalised and cut into pieces here and only its pieces (of which up to
``PIECES`` are kept) meet the merges; words with characters newer than Unicode 3.2,
not in composed form or with strings of special tokens, and all words of files with
other steps, go through the whole library.

Defined cases: NULL counts as empty, an empty text is its end id; rows of one id
are ordered by text; rows without an id come last; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F

from ..session import scratch_dir
from .common import id_bounds, partitions, ready
from .fingerprint import in_order

BLOCK = 1024
PERCENTILE = 95
END_ID = 2
SEGMENT_IDS = 1 << 20
CACHE = 1_500_000
PIECES = 500_000

#: The steps before the merges in tokenizer files whose words are cut into pieces here.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

def _letters_of_bytes() -> list[str]:
    """The character that stands for each byte in vocabularies of bytes: itself if it shows, else one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class _Usual(dict):
    """Whether a character is neither blank nor control and as old as Unicode 3.2, so that all agree on its kind."""

    def __missing__(self, char: str) -> bool:
        self[char] = usual = unicodedata.ucd_3_2_0.category(char)[0] not in "CZ"
        return usual


_HEAD = struct.Struct("<4siqi")
_BLOCK_HEAD = struct.Struct("<IBH")


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Each row's values at ``width`` bits, as rows of bytes."""
    bits = np.unpackbits(values.astype("<u4")[:, :, None].view(np.uint8), axis=2, count=width, bitorder="little")
    return np.packbits(bits.reshape(len(values), -1), axis=1, bitorder="little")


def unpack(packed: np.ndarray, width: int, count: int) -> np.ndarray:
    bits = np.unpackbits(packed, axis=1, count=count * width, bitorder="little").reshape(len(packed), count, width)
    total = np.zeros((len(packed), count), np.uint32)
    for k in range(width):
        total |= bits[:, :, k].astype(np.uint32) << np.uint32(k)
    return total


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """Payload of a run of 32-bit ids."""
    ids = ids.astype(np.uint32)
    n_blocks = -(-len(ids) // block)
    out: list[bytes] = [b""] * n_blocks
    full = len(ids) // block
    sizes = [(0, full, block)] + ([(full, n_blocks, len(ids) - full * block)] if full < n_blocks else [])
    for low, high, length in sizes:
        if low == high:
            continue
        rows = ids[low * block : low * block + (high - low) * length].reshape(high - low, length)
        least = rows.min(axis=1)
        rest = rows - least[:, None]
        needed = np.frexp(rest.astype(float))[1].astype(np.uint8)  # number of bits
        widths = np.partition(needed, (length - 1) * PERCENTILE // 100, axis=1)[:, (length - 1) * PERCENTILE // 100]
        for width in np.unique(widths):
            at = np.flatnonzero(widths == width)
            for some_at in np.array_split(at, max(1, len(at) // 64)):
                packed = pack(rest[some_at], int(width)) if width else np.zeros((len(some_at), 0), np.uint8)
                for row, body in zip(some_at, packed):
                    odd = np.flatnonzero(needed[row] > width)
                    out[low + row] = b"".join(
                        (
                            _BLOCK_HEAD.pack(int(least[row]), int(width), len(odd)),
                            body.tobytes(),
                            odd.astype("<u2").tobytes(),
                            rest[row][odd].astype("<u4").tobytes(),
                        )
                    )
    begin = _HEAD.size + 4 * (n_blocks + 1)
    index = begin + np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int64)
    return b"".join([_HEAD.pack(b"PFR1", block, len(ids), n_blocks), index.astype("<u4").tobytes(), *out])


def read_block(payload: bytes, number: int) -> np.ndarray:
    """One block by the index alone."""
    magic, block, ids, n_blocks = _HEAD.unpack_from(payload)
    if magic != b"PFR1":
        raise ValueError("not a segment of token ids")
    begin, end = np.frombuffer(payload, "<u4", 2, _HEAD.size + 4 * number)
    least, width, odd = _BLOCK_HEAD.unpack_from(payload, begin)
    length = min(block, ids - number * block)
    body = int(begin) + _BLOCK_HEAD.size
    packed = -(-length * width // 8)
    rest = np.zeros(length, np.uint32)
    if width:
        rest = unpack(np.frombuffer(payload, np.uint8, packed, body)[None], width, length)[0]
    if odd:
        at = np.frombuffer(payload, "<u2", odd, body + packed)
        rest[at] = np.frombuffer(payload, "<u4", odd, body + packed + 2 * odd)
    return rest + np.uint32(least)


def decode_blocks(payload: bytes) -> np.ndarray:
    """All ids of a payload; full blocks of one width are unpacked together."""
    magic, block, ids, n_blocks = _HEAD.unpack_from(payload)
    out = np.zeros(ids, np.uint32)
    index = np.frombuffer(payload, "<u4", n_blocks + 1, _HEAD.size)
    raw = np.frombuffer(payload, np.uint8)
    widths = raw[index[:-1].astype(np.int64) + 4]
    full = ids // block
    for width in np.unique(widths[:full]):
        at = np.flatnonzero(widths[:full] == width)
        size = block * int(width) // 8
        for some in np.array_split(at, max(1, len(at) // 64)):
            begin = index[some].astype(np.int64)
            heads = raw[begin[:, None] + np.arange(_BLOCK_HEAD.size)]
            least = heads[:, :4].copy().view("<u4")[:, 0]
            odd = heads[:, 5:7].copy().view("<u2")[:, 0]
            rest = np.zeros((len(some), block), np.uint32)
            if width:
                rest = unpack(raw[begin[:, None] + _BLOCK_HEAD.size + np.arange(size)], int(width), block)
            for i in np.flatnonzero(odd):
                tail = int(begin[i]) + _BLOCK_HEAD.size + size
                n = int(odd[i])
                rest[i, np.frombuffer(payload, "<u2", n, tail)] = np.frombuffer(payload, "<u4", n, tail + 2 * n)
            rest += least[:, None]
            out.reshape(-1)[(some[:, None] * block + np.arange(block)).reshape(-1)] = rest.reshape(-1)
    if full < n_blocks:
        out[full * block :] = read_block(payload, full)
    return out


class Encoder:
    """The library's encoder with the ids of known words; lives as long as its worker."""

    _made: dict[bytes, Encoder] = {}

    @classmethod
    def of(cls, content: bytes) -> Encoder:
        key = hashlib.sha256(content).digest()
        if key not in cls._made:
            cls._made[key] = cls(content)
        return cls._made[key]

    def __init__(self, content: bytes) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content.decode())
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        steps = json.loads(content)
        self.pattern = None
        if (steps["normalizer"], steps["pre_tokenizer"]) == (NORMALIZER, PRE_TOKENIZER):
            self.pattern = regex.compile(PRE_TOKENIZER["pretokenizers"][0]["pattern"]["Regex"])
        self.usual = _Usual()
        self.of_bytes = dict(enumerate(_letters_of_bytes()))
        self.known: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        shown = piece.encode().decode("latin-1").translate(self.of_bytes)
        ids = self.pieces[piece] = array("I", [token.id for token in self.model.tokenize(shown)]).tobytes()
        return ids

    def _learn(self, words: list[bytes]) -> None:
        """Ids of new words, by pieces where that is known to equal the library's way."""
        if len(self.pieces) > PIECES:
            self.pieces = {}
        pieces, usual = self.pieces, self.usual.__getitem__
        whole = []
        for word in words:
            text = word.decode()
            if (
                self.pattern is None
                or not all(map(usual, text))
                or not unicodedata.is_normalized("NFC", text)
                or any(s in text for s in self.special)
            ):
                whole.append(text)
                continue
            # by character: an end of word doesn't change a sigma
            lower = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
            found = self.pattern.findall(lower)
            self.known[word] = b"".join([pieces.get(piece) or self._piece(piece) for piece in found])
        coded = self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)
        self.known.update((text.encode(), array("I", c.ids).tobytes()) for text, c in zip(whole, coded))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        words = [text.encode().split() for text in texts]
        new = set().union(*words).difference(self.known)
        if new and len(self.known) + len(new) > CACHE:
            self.known = {}
            new.update(*words)
        fresh = list(new)
        for low in range(0, len(fresh), 20_000):
            self._learn(fresh[low : low + 20_000])
        ids = self.known.__getitem__
        return [b"".join(map(ids, part)) for part in words]


def _segments(content, end_id: int):
    end = np.uint32(end_id).tobytes()

    def run(batches):
        encoder = Encoder.of(content.value)
        first = 0
        runs: list[bytes] = []
        idents: list = []
        size = 0
        bucket = None

        def segment():
            ids = np.frombuffer(b"".join(runs), "<u4")
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([bucket], pa.int32()),
                    pa.array([first], pa.int64()),
                    pa.array([len(ids)], pa.int64()),
                    pa.array([idents], pa.list_(kind)),
                    pa.array([[len(r) // 4 for r in runs]], pa.list_(pa.int64())),
                    pa.array([encode_blocks(ids)], pa.binary()),
                ],
                names=["bucket", "first", "n_ids", "doc_ids", "doc_sizes", "payload"],
            )

        for batch in batches:
            kind = batch.schema.field("__id").type
            numbers = batch.column("__bucket").to_pylist()
            keys = batch.column("__id").to_pylist()
            texts = batch.column("__text").to_pylist()
            low = 0
            while low < len(texts):
                high, chars = low + 1, len(texts[low])
                while high < len(texts) and chars + len(texts[high]) < 1 << 20:
                    chars += len(texts[high])
                    high += 1
                for at, ids in zip(range(low, high), encoder.encode(texts[low:high])):
                    if runs and (size > SEGMENT_IDS or numbers[at] != bucket):
                        yield segment()
                        first = first + size if numbers[at] == bucket else 0
                        runs, idents, size = [], [], 0
                    bucket = numbers[at]
                    runs.append(ids + end)
                    idents.append(keys[at])
                    size += len(ids) // 4 + 1
                low = high
        if runs:
            yield segment()

    return run


def write(
    docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID
) -> None:
    """Encode ``docs`` and write the file set to a new folder."""
    spark = ready(docs.sparkSession)
    with open(tokenizer_path, "rb") as file:
        content = spark.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(id_col).cast("bigint").alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    ordered = in_order(rows, id_bounds(rows, "__id", partitions(spark)), False)
    schema = "bucket int, first bigint, n_ids bigint, doc_ids array<bigint>, doc_sizes array<bigint>, payload binary"
    ordered.mapInArrow(_segments(content, end_id), schema).write.option("compression", "none").parquet(path)


def _documents(batches):
    for batch in batches:
        for row in range(batch.num_rows):
            ids = decode_blocks(batch.column("payload")[row].as_py()).astype("<u4")
            sizes = np.array(batch.column("doc_sizes")[row].as_py(), np.int64)
            start = np.cumsum(sizes) - sizes
            sums = [zlib.crc32(ids[low : low + n]) for low, n in zip(start, sizes)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(batch.column("doc_ids")[row].as_py(), pa.int64()),
                    pa.array(start + batch.column("first")[row].as_py() + batch.column("__before")[row].as_py()),
                    pa.array(sizes),
                    pa.array(sums, pa.int64()),
                ],
                names=["__id", "start", "n_tokens", "ids_crc32"],
            )


def read(spark, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    segments = ready(spark).read.parquet(path)
    totals = segments.groupBy("bucket").agg(F.sum("n_ids").alias("n"))  # one row per range
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    placed = segments.join(F.broadcast(totals), "bucket").select("first", "__before", "doc_ids", "doc_sizes", "payload")
    return placed.mapInArrow(_documents, "__id bigint, start bigint, n_tokens bigint, ids_crc32 bigint").withColumnRenamed("__id", id_col)


def write_and_read(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write to a fresh folder of the shared scratch space and read back."""
    spark = docs.sparkSession
    path = scratch_dir(spark, "tokens")
    write(docs, path, tokenizer_path, **options)
    return read(spark, path, options.get("id_col", "doc_id"))
