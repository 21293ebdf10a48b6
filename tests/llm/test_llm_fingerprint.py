import hashlib
import re

import numpy as np
import pytest
from llm_fixtures import prose

from gatewire.llm import fingerprint


def shingles(text):
    ws = re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", (text or "").lower())
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    """Order, edited texts and exact likeness."""
    named = sorted(((i, t or "") for i, t in rows if i is not None), key=lambda r: (-r[0], r[1]))
    order = named + sorted(((i, t or "") for i, t in rows if i is None), key=lambda r: r[1])
    for k, (ident, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        third = len(text) // 3
        changed = text[: len(text) - third] + after[:third]
        yield ident, len(text), hashlib.sha256(changed.encode()).hexdigest(), jaccard(text, changed), jaccard(text, after)


def check(got, rows):
    want = sorted(expected(rows), key=repr)
    got = sorted(map(tuple, got), key=lambda r: repr((r[0], r[1], r[2])))
    assert [r[:3] for r in got] == [w[:3] for w in want]
    for r, w in zip(got, want):
        assert r[5] == pytest.approx(w[3], abs=0.15) and r[6] == pytest.approx(w[4], abs=0.15)


@pytest.mark.parametrize("parts", ["1", "3", "40"])
def test_odd_rows(spark, odd_docs, odd_rows, parts):
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = fingerprint.compare(odd_docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    check(got, [r[:2] for r in odd_rows])
    by_text = {}
    for r in got:
        by_text.setdefault(r["doc_id"], r["fingerprint"])
    assert by_text[0] == by_text[11] == by_text[12] and by_text[2] == by_text[3] == by_text[4]


def test_whole_table(documents):
    check(fingerprint.compare(documents).collect(), [(r["doc_id"], r["text"]) for r in documents.collect()])


def test_empty_and_single(spark, no_docs):
    assert fingerprint.compare(no_docs).count() == 0
    one = spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")
    assert fingerprint.compare(one).first()["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()
    nameless = spark.createDataFrame([(None, "abcdef"), (None, "xyzxyz")], "doc_id long, text string")
    check(fingerprint.compare(nameless).collect(), [(None, "abcdef"), (None, "xyzxyz")])


def test_sketches_merge_and_estimate():
    a, b = prose(1, 6000, 10**6), prose(2, 9000, 10**6)
    whole, part, other = fingerprint.sketches([a + " " + b, a, b])
    joined = fingerprint.merge(part, other)
    assert fingerprint.resemblance(joined, whole) > 0.98  # but for the shingles across the seam
    assert fingerprint.distinct_shingles(whole) == pytest.approx(len(shingles(a + " " + b)), rel=0.2)
    assert fingerprint.containment(part, whole) == pytest.approx(1, abs=0.15)
    assert fingerprint.containment(whole, part) == pytest.approx(0.4, abs=0.12)
    assert fingerprint.resemblance(part, other) < 0.05


def test_small_texts_are_exact_and_text_form_is_reversible():
    a, b = prose(1, 100), " ".join(prose(1, 100).split()[:80])
    x, y = fingerprint.sketches([a, b])
    assert fingerprint.resemblance(x, y) == jaccard(a, b)
    assert fingerprint.distinct_shingles(x) == len(shingles(a))
    assert np.array_equal(fingerprint.from_text(fingerprint.to_text(x)), x)
    (nothing,) = fingerprint.sketches([""])
    assert fingerprint.to_text(nothing) == "" and len(fingerprint.from_text("")) == 0
    assert fingerprint.resemblance(nothing, nothing) == 1 and fingerprint.resemblance(nothing, x) == 0
