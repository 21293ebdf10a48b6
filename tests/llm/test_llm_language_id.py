import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gatewire.llm import language_id

SYLLABLES = {"aa": "ka lo mi tu re", "bb": "ght str wor ing the", "cc": "é è ou eau ñ"}


def text(lang, n, rnd):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    return [(i, text(lang, rnd.randrange(2, 60), rnd), lang if i % 7 else None, lang) for i in range(400) for lang in [rnd.choice(list(SYLLABLES))]]


def test_held_out_languages(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string").repartition(3)
    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    assert len(got) == 400
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert [i for i in sorted(got) if got[i]["held_out"]] == held
    assert sum(got[i]["lang_pred"] == rows[i][3] for i in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_held_out_rows_and_the_lang_column_do_not_reach_predictions(spark, rows):
    schema = "doc_id long, text string, lang string, truth string"
    changed = [(i, t, "aa" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, x) for i, t, lang, x in rows]
    one, two = (
        sorted((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in language_id.identify(spark.createDataFrame(part, schema)).collect())
        for part in (rows, changed)
    )
    assert one == two


def buckets(text):
    return np.concatenate([b for b, _ in language_id.grams([text.lower()])]).tolist()


def test_predictions_are_those_of_plain_naive_bayes(spark, rows):
    schema = "doc_id long, text string, lang string, truth string"
    counts = defaultdict(Counter)
    for i, text_, lang, _ in rows:
        if lang and zlib.crc32(str(i).encode()) % 4 != 2:
            counts[lang].update(buckets(text_))
    sizes = {lang: sum(n.values()) + language_id.SMOOTHING * language_id.BUCKETS for lang, n in counts.items()}
    for r in language_id.identify(spark.createDataFrame(rows, schema)).collect():
        found = buckets(rows[r["doc_id"]][1])
        logs = {lang: sum(math.log((n[b] + language_id.SMOOTHING) / sizes[lang]) for b in found) for lang, n in counts.items()}
        best = max(sorted(logs), key=logs.get)
        share = 1 / sum(math.exp(x - logs[best]) for x in logs.values())
        assert r["lang_pred"] == best and r["score"] == pytest.approx(share, rel=1e-3)


def test_numbers_that_look_like_letters_are_none(spark):
    docs = spark.createDataFrame([(i, "aa bb cc", "en") for i in range(9)] + [(20, "½ ² Ⅷ 7", None), (21, "½ª", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs).collect()}
    assert got[20] == "und" and got[21] == "en"


def test_odd_rows(odd_docs, odd_rows):
    got = language_id.identify(odd_docs).collect()
    assert sorted(repr(r["doc_id"]) for r in got) == sorted(repr(r[0]) for r in odd_rows)
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {2, 3, 4, 5, None}
    assert {r["score"] for r in got if r["lang_pred"] == "und"} == {0.0}


def test_nothing_to_learn_from(spark, no_docs):
    assert language_id.identify(no_docs).count() == 0
    docs = spark.createDataFrame([(1, "abc", None), (2, "x", None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language_id.identify(docs).collect()} == {"und"}


def test_parts_of_a_long_text_count_whole(monkeypatch):
    long = " ".join(f"word{i} été" for i in range(3000))
    whole = sum(len(b) for b, _ in language_id.grams([long.lower(), "a"]))
    monkeypatch.setattr(language_id, "PART", 5000)
    cut = sum(len(b) for b, _ in language_id.grams([long.lower(), "a"]))
    assert cut == pytest.approx(whole, rel=0.01)


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 2)
    docs = spark.createDataFrame([(i, f"t{i}", f"l{i}") for i in range(9)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        language_id.identify(docs)
