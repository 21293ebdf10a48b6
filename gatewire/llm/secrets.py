"""Secret scans: fixed patterns, and sliding-window Shannon entropy per character class with an allow list.

Patterns (``assign``, ``access``, ``hex``) give the base spans.  Beyond them,
maximal runs of key characters of at least ``CANDIDATE`` are candidates.  In a
candidate, every class's runs of its own characters are searched with a window;
its entropy, digits and letters are kept up by counts that change by one character at
each step, so a run's time is in proportion to its length.  Windows at or above the class's bound, with as many digits and letters as
the class asks for, merge into spans of kind ``entropy``.  A span is suppressed if
it touches a base span or if it, or its candidate, matches the allow list.

Positions are code points, ends exclusive.  Defined cases: NULL counts as empty
and has no spans; whole texts are scanned, however long; rows are independent of
each other, so repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import cached_property
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ready

KINDS = ("assign", "access", "hex", "entropy")
MASK = "[secret]"

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Every match of ACCESS and HEX lies in one of these.
CANDIDATE = 20
RUNS = re.compile(r"[A-Za-z0-9+/_=-]{20,}")


DIGITS = frozenset("0123456789")
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


@dataclass(frozen=True)
class CharacterClass:
    name: str
    characters: str
    window: int
    least_bits: float
    digits: int
    letters: int

    @cached_property
    def runs(self) -> re.Pattern:
        """Runs of the class's characters that hold a window."""
        return re.compile(f"[{re.escape(self.characters)}]{{{self.window},}}")


CLASSES = (
    CharacterClass("hex", "0123456789abcdefABCDEF", 24, 3.0, 5, 3),
    CharacterClass("alphanumeric", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 20, 3.7, 2, 6),
    CharacterClass("base64", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/=_-", 24, 3.9, 2, 8),
)

#: Not secrets, whatever their entropy.
ALLOWED = tuple(
    re.compile(p)
    for p in (
        r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",  # UUID
        r"(?i).*(example|placeholder|changeme|your[_-]?(key|token|secret)).*",
        r"(?i).*(0123456789|123456789|abcdefghij).*",  # counting
        r"\d+([-/_]\d+)*",  # numbers and dates
        r"([A-Za-z]+[-_/=+])*[A-Za-z]+\d{0,4}",  # words and paths, perhaps with a year
    )
)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    lower = text.lower()
    if any(word in lower for word in ASSIGN_WORDS):
        found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    for run in RUNS.finditer(text):
        for kind, pattern in (("access", ACCESS), ("hex", HEX)):
            found += [(m.start(), m.end(), kind) for m in pattern.finditer(text, run.start(), run.end())]
    return sorted(found, key=lambda span: (span[0], KINDS.index(span[2])))


def dense_spans(run: str, kind: CharacterClass) -> list[tuple[int, int]]:
    """Joined windows of ``run`` with the class's entropy, digits and letters; the counts change by one character a step."""
    window = kind.window
    part = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    most = (math.log2(window) - kind.least_bits) * window  # of the sum of c * log2(c)
    counts = dict.fromkeys(run, 0)
    digits = letters = 0
    total = 0.0
    spans: list[tuple[int, int]] = []
    low = high = -1
    for at, new in enumerate(run):
        if at >= window:
            old = run[at - window]
            c = counts[old]
            counts[old] = c - 1
            total += part[c - 1] - part[c]
            if old in DIGITS:
                digits -= 1
            elif old in LETTERS:
                letters -= 1
        c = counts[new]
        counts[new] = c + 1
        total += part[c + 1] - part[c]
        if new in DIGITS:
            digits += 1
        elif new in LETTERS:
            letters += 1
        # the sum is rounded at each step, so a window at the bound counts as reaching it
        if at >= window - 1 and total <= most + 1e-9 and digits >= kind.digits and letters >= kind.letters:
            begin = at - window + 1
            if begin > high:
                if high > 0:
                    spans.append((low, high))
                low = begin
            high = at + 1
    if high > 0:
        spans.append((low, high))
    return spans


def entropy_spans(candidate: str, classes=CLASSES) -> list[tuple[int, int]]:
    """Merged windows of high entropy within a candidate."""
    hits: list[tuple[int, int]] = []
    for kind in classes:
        for run in kind.runs.finditer(candidate):
            hits += [(run.start() + low, run.start() + high) for low, high in dense_spans(run.group(), kind)]
    merged: list[list[int]] = []
    for low, high in sorted(hits):
        if merged and low <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], high)
        else:
            merged.append([low, high])
    return [(low, high) for low, high in merged]


def added_spans(text: str, base: list[tuple[int, int, str]], classes=CLASSES, allowed=ALLOWED) -> list[tuple[int, int, str]]:
    """Spans of high entropy that neither a base span nor the allow list accounts for."""
    found = []
    begins = [b for b, _, _ in base]
    ends = list(accumulate((e for _, e, _ in base), max))
    for run in RUNS.finditer(text):
        candidate = run.group()
        if not any(c.isdigit() for c in candidate) or any(p.fullmatch(candidate) for p in allowed):
            continue
        for low, high in entropy_spans(candidate, classes):
            begin, end = run.start() + low, run.start() + high
            before = bisect_left(begins, end)  # base spans that begin before this one ends
            if (before and ends[before - 1] > begin) or any(p.fullmatch(candidate[low:high]) for p in allowed):
                continue
            found.append((begin, end, "entropy"))
    return found


def as_text(spans) -> str:
    return ",".join(f"{kind}:{begin}:{end}" for begin, end, kind in spans)


def all_spans(text: str):
    base = base_spans(text)
    every = sorted(base + added_spans(text, base), key=lambda span: (span[0], KINDS.index(span[2])))
    return base, every


def _scan(batches):
    for batch in batches:
        rows = []
        for text in batch.column("__text"):
            base, every = all_spans(text.as_py() or "")
            kinds = [kind for _, _, kind in base]
            rows.append(
                [kinds.count(k) for k in KINDS[:3]] + [hashlib.sha256(as_text(base).encode()).hexdigest(), as_text(every)]
            )
        columns = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column("__id")]
            + [pa.array(c, pa.int64()) for c in columns[:3]]
            + [pa.array(c, pa.string()) for c in columns[3:]],
            names=["__id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) of every row."""
    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    kind = rows.schema["__id"].dataType.simpleString()
    schema = f"__id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    return rows.mapInArrow(_scan, schema).withColumnRenamed("__id", id_col)


def mask(text: str, spans) -> str:
    """The text with overlapping spans joined and each replaced by the mask."""
    out, at = [], 0
    for begin, end, _ in spans:
        if begin >= at:
            out += [text[at:begin], MASK]
        at = max(at, end)
    return "".join(out) + text[at:]


def _masked(text_col: str, length_col: str | None):
    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).to_pylist()
            changed = {}
            for i, text in enumerate(texts):
                if text and (spans := all_spans(text)[1]):
                    changed[i] = texts[i] = mask(text, spans)
            if changed:
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
                if length_col in batch.schema.names:
                    to = batch.schema.get_field_index(length_col)
                    lengths = batch.column(to).to_pylist()
                    for i, text in changed.items():
                        lengths[i] = len(text)
                    batch = batch.set_column(to, batch.schema.field(to), pa.array(lengths, batch.schema.field(to).type))
            yield batch

    return run


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span masked; all rows and columns stay, the length column follows the text."""
    ready(docs.sparkSession)
    return docs.mapInArrow(_masked(text_col, length_col), docs.schema)
