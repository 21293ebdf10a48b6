"""Hashes of all words and word shingles of a column of texts, with numpy over the Arrow buffers.

A word is a run of characters other than ASCII punctuation, blanks and control
characters; callers lower-case beforehand where case shall not count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SHINGLE = 5
#: Bytes worked on at a time; a longer text is cut between two words.
CHUNK = 1 << 22

_U = np.uint64
_random = np.random.default_rng(20240229)
_LETTERS = _random.integers(1, 2**63, 256, dtype=_U) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(int(_BASE), -1, 2**64))
_PLACES = _random.integers(1, 2**63, 16, dtype=_U) * _U(2) + _U(1)

_WORD = np.zeros(256, bool)
_WORD[128:] = True
for _first, _last in ("09", "AZ", "az"):
    _WORD[ord(_first) : ord(_last) + 1] = True
_BLANK_SEPARATED = np.ones(256, bool)
_BLANK_SEPARATED[[32, *range(9, 14)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits over all bits, one to one."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a text column; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return ends - ends[0] if len(ends) else np.zeros(1, np.int64), raw[ends[0] : ends[-1]] if len(ends) else raw


def _cuts(ends: np.ndarray, raw: np.ndarray, inside: np.ndarray) -> list[int]:
    """Byte positions at which the work is divided: text borders, or a separator in a long text."""
    cuts, at, total = [0], 0, len(raw)
    while total - at > CHUNK:
        border = int(ends[np.searchsorted(ends, at + CHUNK, "right") - 1])
        if border <= at:
            gaps = np.flatnonzero(~inside[raw[at + 1 : at + CHUNK]])
            border = at + 1 + int(gaps[-1]) if len(gaps) else at
            while border == at:  # one word longer than a chunk stays whole
                upto = at + CHUNK
                more = np.flatnonzero(~inside[raw[upto : upto + CHUNK]])
                border = upto + int(more[0]) if len(more) else (at if upto + CHUNK < total else total)
                if border == at:
                    stops = np.flatnonzero(~inside[raw[upto:]])
                    border = upto + int(stops[0]) if len(stops) else total
                later = ends[ends > at]
                border = min(border, int(later[0]))
        cuts.append(border)
        at = border
    return [*cuts, total] if cuts[-1] < total else cuts


def word_hashes(column: pa.Array, inside: np.ndarray = _WORD, spans: bool = False):
    """(hash of each word, number of its text[, first byte, byte after it within all bytes])."""
    ends, raw = utf8(column)
    hashes, owners, begins, stops = [], [], [], []
    cuts = _cuts(ends, raw, inside)
    for low, high in zip(cuts, cuts[1:]):
        part = raw[low:high]
        is_word = inside[part]
        borders = ends[(ends >= low) & (ends < high)] - low
        before = np.empty_like(is_word)
        before[:1] = False
        before[1:] = is_word[:-1]
        before[borders] = False
        first = np.flatnonzero(is_word & ~before)
        if not len(first):
            continue
        after = np.empty_like(is_word)
        after[-1:] = False
        after[:-1] = is_word[1:]
        after[borders[borders > 0] - 1] = False
        last = np.flatnonzero(is_word & ~after) + 1
        powers = np.full(len(part), _BASE)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        sums = np.zeros(len(part) + 1, _U)
        np.cumsum(_LETTERS[part] * powers, out=sums[1:])
        back = np.full(len(part), _INVERSE)
        back[0] = 1
        np.multiply.accumulate(back, out=back)
        hashes.append(mix((sums[last] - sums[first]) * back[first]))
        owners.append(np.searchsorted(ends, first + low, "right") - 1)
        begins.append(first + low)
        stops.append(last + low)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    found = join(hashes, _U), join(owners, np.int64)
    return (*found, join(begins, np.int64), join(stops, np.int64)) if spans else found


def blank_separated(column: pa.Array, spans: bool = False):
    """As ``word_hashes``, for words that only blanks (space, tab to carriage return) separate."""
    return word_hashes(column, _BLANK_SEPARATED, spans)


def counts_by_text(owner: np.ndarray, texts: int) -> np.ndarray:
    return np.bincount(owner, minlength=texts).astype(np.int64)


def shingles(words: np.ndarray, owner: np.ndarray, texts: int, width: int = SHINGLE):
    """(hash of each shingle, number of its text), in order; a shorter text is one shingle, an empty one none."""
    total = np.zeros(max(len(words) - width + 1, 0), _U)
    for k in range(width):
        total += words[k : k + len(total)] * _PLACES[k]
    whole = owner[: len(total)] == owner[width - 1 : width - 1 + len(total)]
    found, of = mix(total[whole]), owner[: len(total)][whole]
    n = counts_by_text(owner, texts)
    few = np.flatnonzero((n > 0) & (n < width))
    if len(few):
        begin = np.concatenate(([0], np.cumsum(n)))[few]
        short = _U(1) + n[few].astype(_U)
        for k in range(width - 1):
            has = n[few] > k
            short[has] += words[begin[has] + k] * _PLACES[k]
        found, of = np.concatenate((found, mix(short))), np.concatenate((of, few))
        order = np.argsort(of, kind="stable")
        found, of = found[order], of[order]
    return found, of


def distinct(values: np.ndarray, owner: np.ndarray):
    """(value, text, times) of the distinct values of every text, sorted by text and value."""
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return values[at], owner[at], np.diff(np.append(at, len(values)))


def distinct_counts(values: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Number of distinct values of every text, by 40 bits of each; for statistics."""
    keys = np.sort((owner.astype(_U) << _U(40)) | (values >> _U(24)))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return counts_by_text((keys[new] >> _U(40)).astype(np.int64), texts)
