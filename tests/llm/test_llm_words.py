import re

import numpy as np
import pyarrow as pa
import pytest
from llm_fixtures import prose

from gatewire.llm import words as W

TEXTS = [prose(1, 50), None, "", "a-b c", "  é ß 日本 x", "x" * 700, ". , !", prose(2, 9), "one two", "one two"]


def expected(text, pattern=r"[^\x00-/:-@\[-`{-\x7f]+"):
    return re.findall(pattern, text or "")


@pytest.mark.parametrize("chunk", [1 << 22, 64, 5])
def test_words_are_found_and_told_apart(chunk, monkeypatch):
    monkeypatch.setattr(W, "CHUNK", chunk)
    hashes, owner, begin, end = W.word_hashes(pa.array(TEXTS), spans=True)
    raw = "".join(t or "" for t in TEXTS).encode()
    found = [raw[a:b].decode() for a, b in zip(begin, end)]
    assert found == [w for t in TEXTS for w in expected(t)]
    assert W.counts_by_text(owner, len(TEXTS)).tolist() == [len(expected(t)) for t in TEXTS]
    assert len(set(hashes.tolist())) == len(set(found))
    by_word = dict(zip(found, hashes))
    assert all(by_word[w] == h for w, h in zip(found, hashes))


def test_blank_separated():
    hashes, owner = W.blank_separated(pa.array(TEXTS))
    assert W.counts_by_text(owner, len(TEXTS)).tolist() == [len(expected(t, r"[^\x20\x09-\x0D]+")) for t in TEXTS]


def test_slices_of_a_column():
    column = pa.array(TEXTS)
    whole = W.word_hashes(column)[0]
    parts = [W.word_hashes(column.slice(i, 2))[0] for i in range(0, len(TEXTS), 2)]
    assert np.concatenate(parts).tolist() == whole.tolist()


def test_shingles():
    words, owner = W.word_hashes(pa.array(TEXTS))
    found, of = W.shingles(words, owner, len(TEXTS))
    want = []
    for text in TEXTS:
        ws = expected(text)
        want.append([tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))] if ws else [])
    assert W.counts_by_text(of, len(TEXTS)).tolist() == [len(x) for x in want]
    flat = [s for x in want for s in x]
    assert len(dict(zip(flat, found))) == len(set(found.tolist()))
    values, holder, times = W.distinct(found, of)
    assert times.sum() == len(found)
    assert W.distinct_counts(found, of, len(TEXTS)).tolist() == [len(set(x)) for x in want]
