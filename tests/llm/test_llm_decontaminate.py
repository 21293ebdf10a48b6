import re

import pytest

from gatewire.llm import decontaminate

from llm_fixtures import prose


ITEMS = "item_id long, text string, h string"


def words(text):
    return re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", (text or "").lower())


def grams(ws, n):
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}


def brute(docs, items, threshold=0.8):
    found = set()
    for item, text, *_ in items:
        ws = words(text)
        n = min(5, len(ws))
        wanted = grams(ws, n) if ws else set()
        if not wanted or item is None:
            continue
        for ident in {row[0] for row in docs} - {None}:
            held = set().union(*(grams(words(t), n) for i, t, *_ in docs if i == ident))
            if len(wanted & held) >= threshold * len(wanted) - 1e-9:
                found.add((ident, item, len(wanted & held), len(wanted)))
    return found


def result(docs, items, **options):
    return {(r["doc_id"], r["item_id"], r["matched"], r["n_shingles"]) for r in decontaminate.leaks(docs, items, **options).collect()}


@pytest.fixture(scope="module")
def planted():
    passage = prose(77, 40).split()
    long = prose(8, 5000).split()
    near = list(passage)
    near[20] = "changed"  # 5 of 36 shingles differ
    far = list(passage)
    far[10] = far[20] = "changed"  # 10 of 36
    scattered = passage[:20] + long[:50] + passage[16:]
    docs = [
        (1, " ".join(long[:2500] + passage + long[2500:])),
        (2, " ".join(long[:100] + near + long[100:200])),
        (3, " ".join(long[:100] + far + long[100:200])),
        (4, " ".join(scattered)),
        (5, " ".join(long)),
        (6, " ".join(passage).upper().replace(" ", ", ")),
        (7, "alpha beta gamma"),
        (7, "gamma delta"),
        (8, None),
        (None, " ".join(passage)),
        (9, ""),
    ]
    items = [(1, " ".join(passage), "x"), (2, "Gamma, DELTA", "x"), (3, None, None), (4, "", "x"), (None, "alpha beta", "x"), (5, "beta", "x")]
    items += [(6, " ".join(["echo"] * 30), "x"), (1, " ".join(passage), "x")]
    return docs, items


@pytest.mark.parametrize("rows", [decontaminate.BROADCAST_ROWS, 0])
def test_against_brute_force(spark, planted, rows, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
    docs, items = planted
    got = result(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS))
    assert got == brute(docs, items)
    assert {(1, 1), (2, 1), (4, 1), (6, 1), (7, 2), (7, 5)} == {x[:2] for x in got}


def test_odd_rows(spark, odd_docs, odd_rows):
    items = [(1, odd_rows[0][1], "x"), (2, "one two", "x"), (3, "Ελληνικά 日本語", None)]
    assert result(odd_docs, spark.createDataFrame(items, ITEMS)) == brute(odd_rows, items)


def test_empty_tables(spark, odd_docs, no_docs):
    none, some = spark.createDataFrame([], ITEMS), spark.createDataFrame([(1, "one two", "x")], ITEMS)
    assert result(odd_docs, none) == set()
    assert result(no_docs, some) == set()


def test_leaking_documents_go(spark, odd_docs):
    items = spark.createDataFrame([(2, "one two", "x")], ITEMS)
    kept = decontaminate.decontaminate(odd_docs, items)
    assert kept.columns == odd_docs.columns
    assert kept.count() == odd_docs.count() - 2


def test_main_path_has_no_python(spark, odd_docs):
    items = spark.createDataFrame([(1, "one two", "x")], ITEMS)
    plan = decontaminate.leaks(odd_docs, items)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)
