import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gatewire.llm import lm_score


def tokens(text):
    lower = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + ["</s>"]


def held_out(ident):
    return zlib.crc32(("" if ident is None else str(ident)).encode()) % 7 == 2


def check(rows, got):
    counts = Counter()
    for ident, text in rows:
        if not held_out(ident):
            counts.update(tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for ident, text in rows:
        ts = tokens(text)
        base = sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in ts)
        want.append((ident, held_out(ident), len(ts), sum(counts[t] > 0 for t in ts), total, round(base, 6)))
    assert sorted(((*r[:5], round(r[5], 6)) for r in got), key=repr) == sorted(want, key=repr)
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)


@pytest.mark.parametrize("head", [lm_score.HEAD, 3, 0])
def test_base_score_is_exact_however_few_words_are_broadcast(odd_docs, odd_rows, head, monkeypatch):
    monkeypatch.setattr(lm_score, "HEAD", head)
    check([r[:2] for r in odd_rows], lm_score.scores(odd_docs).collect())


def test_whole_table(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = lm_score.scores(documents).collect()
    check(rows, got)
    # pairs tell more than words alone, also about texts that weren't learnt from
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_empty_and_untrained(spark, no_docs):
    assert lm_score.scores(no_docs).count() == 0
    only = next(i for i in range(100) if held_out(i))
    row = lm_score.scores(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (3, 0, 0, 0.0)


def test_filter_holds_quantised_counts(spark):
    rng = np.random.default_rng(1)
    hashes = np.unique(rng.integers(1, 2**63, 20_000))
    counts = rng.geometric(0.05, len(hashes))
    table = spark.createDataFrame([(int(h), int(c)) for h, c in zip(hashes, counts)], "h long, n long").repartition(5)
    built = lm_score.build_filter(table)
    got = built.estimate(hashes.astype(np.uint64))
    exact = np.where(counts == 1, 1.0, 2.0 ** np.floor(np.log2(counts)) * 1.5 - 0.5)
    assert (got >= exact).all()
    assert (got == exact).mean() > 0.8  # a level too many is a false positive
    absent = built.estimate(rng.integers(1, 2**63, 20_000).astype(np.uint64))
    assert (absent > 0).mean() < 0.2


def test_filter_keeps_its_bound(spark):
    table = spark.createDataFrame([(i * 7919 + 13, 1 + i % 40) for i in range(30_000)], "h long, n long")
    built = lm_score.build_filter(table, 1 << 17)
    assert len(built.bits) * 8 <= 1 << 17
    assert built.cut > 1
    assert np.unpackbits(built.bits).mean() < 0.6


def test_tokens():
    found, owner = lm_score.tokens(pa.array(["A b", None, "", "a B\tb"]))
    assert owner.tolist() == [0, 0, 0, 1, 2, 3, 3, 3, 3]
    assert found[0] == found[5] and found[1] == found[6] == found[7] and found[2] == found[3] == lm_score.END


def quantised(count):
    return 0.0 if not count else 1.0 if count == 1 else 2.0 ** math.floor(math.log2(count)) * 1.5 - 0.5


def model_scores(rows):
    """Scores by plain dictionaries that hold the quantised count of every word and pair."""
    single, both, starts = Counter(), Counter(), 0
    for ident, text in rows:
        if not held_out(ident):
            ts = tokens(text)
            single.update(ts)
            both.update(zip([None, *ts], ts))
            starts += 1
    unit = 1 / (sum(single.values()) + len(single) + 1)
    out = []
    for ident, text in rows:
        ts, total = tokens(text), 0.0
        for before, t in zip([None, *ts], ts):
            share = min(1.0, quantised(both[before, t]) / max(quantised(starts if before is None else single[before]), 1.0))
            total += math.log10(lm_score.PAIR_SHARE * share + (1 - lm_score.PAIR_SHARE) * (quantised(single[t]) + 1) * unit)
        out.append((ident, total))
    return out


@pytest.mark.parametrize("segment_text", [1 << 25, 100])
def test_no_count_is_left_out(odd_docs, odd_rows, segment_text, monkeypatch):
    """Pairs seen once count too, whatever the number of segments."""
    monkeypatch.setattr(lm_score, "SEGMENT_TEXT", segment_text, raising=False)
    by_text = lambda found: sorted(found, key=repr)
    got = by_text((r["doc_id"], r["score"]) for r in lm_score.scores(odd_docs).collect())
    want = by_text(model_scores([r[:2] for r in odd_rows]))
    assert [i for i, _ in got] == [i for i, _ in want]
    # what is left is the filter's false positives
    assert all(abs(x - y) <= 2.5 + 0.02 * abs(y) for (_, x), (_, y) in zip(got, want))


def test_the_filter_is_looked_up_in_segments_however_large_it_is(documents, monkeypatch):
    """No whole filter is made, so none is cut to a size; how texts are dealt to tasks changes nothing."""
    monkeypatch.setattr(lm_score, "build_filter", None)
    whole = sorted(map(tuple, lm_score.scores(documents).collect()))
    assert sorted(map(tuple, lm_score.scores(documents.repartition(7)).collect())) == whole


def test_packed_keys_come_back():
    for n in (0, 1, 1000):
        keys = np.sort(lm_score.key(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)))
        assert (lm_score.unpacked(lm_score.packed(keys)) == keys).all()


def test_counts_dealt_by_segment_add_up():
    rng = np.random.default_rng(5)
    words = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
    grams = np.unique(lm_score.key(rng.integers(0, 2**63, 5000).astype(np.uint64)))
    for segments in (1, 256, 1 << 14):
        dealt = lm_score._dealt(words, np.arange(len(words)), grams, np.arange(len(grams)), segments)
        back = np.concatenate([lm_score.unpacked(g.as_py()) for g in dealt.column("grams")])
        assert (back == grams).all()
        times = np.concatenate([np.frombuffer(t.as_py(), np.int64) for t in dealt.column("times")])
        assert (times == np.arange(len(grams))).all()
        for segment, found in zip(dealt.column("segment").to_pylist(), dealt.column("words").to_pylist()):
            keys = lm_score.key(np.frombuffer(found, np.uint64))
            assert (keys * np.uint64(segments) >> np.uint64(lm_score.KEY_BITS) == segment).all()
