import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gatewire.llm import near_dedup, words as W

from llm_fixtures import prose


def shingles(text):
    ws = re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", (text or "").lower())
    if not ws:
        return Counter({("", text or ""): 1})
    return Counter(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4)))


def exact(a, b):
    wa, wb = ({k: 1 + math.log(n) for k, n in x.items()} for x in (a, b))
    every = wa.keys() | wb.keys()
    return sum(1 / sum(max(wa.get(y, 0) / wa[x], wb.get(y, 0) / wb[x]) for y in every) for x in wa.keys() & wb.keys())


def classes(rows):
    """Least id of each row's component of links, by comparing all rows."""
    sets = [shingles(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if same_id or (sets[i].keys() & sets[j].keys() and exact(sets[i], sets[j]) >= 0.8):
                root[find(i)] = find(j)
    least = {}
    for i, (ident, _) in enumerate(rows):
        if ident is not None:
            least[find(i)] = min(ident, least.get(find(i), ident))
    return sorted(((ident, least.get(find(i))) for i, (ident, _) in enumerate(rows)), key=repr)


def result(df):
    return sorted((tuple(r) for r in near_dedup.near_duplicates(df).collect()), key=repr)


def edit(text, n, seed):
    rnd = random.Random(seed)
    ws = text.split()
    for _ in range(n):
        ws[rnd.randrange(len(ws))] = f"e{rnd.random()}"
    return " ".join(ws)


@pytest.fixture(scope="module")
def families():
    """Groups of copies with more and more edits, chains, shared passages, short texts."""
    rows, passage = [], prose(99, 60)
    for family in range(6):
        base = prose(100 + family, 160)
        text = base
        for k in range(12):
            text = edit(text, 2, 1000 * family + k) if k % 2 else edit(base, k, 500 * family + k)
            rows.append((len(rows), text))
    rows += [(len(rows) + k, passage + " " + prose(300 + k, 25)) for k in range(25)]
    rows += [(1000 + k, passage) for k in range(30)]
    rows += [(2000 + k, "tiny text") for k in range(5)]
    return rows


def test_classes_are_those_of_brute_force(spark, families):
    df = spark.createDataFrame(families, "doc_id long, text string").repartition(4)
    assert result(df) == classes(families)


def test_small_tiles_lose_no_link(spark, families, monkeypatch):
    monkeypatch.setattr(near_dedup, "TILE_ROWS", 8)
    df = spark.createDataFrame(families, "doc_id long, text string")
    assert result(df) == classes(families)


def test_odd_rows(odd_docs, odd_rows):
    assert result(odd_docs) == classes([row[:2] for row in odd_rows])


def test_empty_table(no_docs):
    assert result(no_docs) == []


def test_one_row_of_each_class_stays(odd_docs, odd_rows):
    kept = near_dedup.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    wanted = {c for i, c in classes([row[:2] for row in odd_rows]) if i is not None}
    assert sorted(i for i in ids if i is not None) == sorted(wanted)
    assert ids.count(None) == 2


def test_signatures_estimate_the_similarity():
    base = prose(7, 300)
    texts = [base] + [edit(base, n, n) for n in (3, 10, 30, 80)] + [base + " " + base]
    values, of, weight, _, _ = near_dedup.weighted_shingles(pa.array(texts))
    registers = near_dedup.signatures(values, of, weight, len(texts))
    begin = np.searchsorted(of, np.arange(len(texts) + 1))
    side = [(values[a:b], weight[a:b]) for a, b in zip(begin, begin[1:])]
    for i in range(1, len(texts)):
        similar = near_dedup.similarity(*side[0], *side[i])
        assert similar == pytest.approx(exact(shingles(texts[0]), shingles(texts[i])))
        assert np.mean(registers[0] == registers[i]) == pytest.approx(similar, abs=0.13)


def test_registers_fill_with_the_weights():
    elements = W.mix(np.arange(1, 4001, dtype=np.uint64))
    owner = np.repeat(np.arange(1000), 4)
    weight = np.tile([1.0, 2.0, 3.0, 4.0], 1000)
    registers = near_dedup.signatures(elements, owner, weight, 1000)
    share = [(registers == elements[k::4][:, None]).mean() for k in range(4)]
    assert share == pytest.approx([0.1, 0.2, 0.3, 0.4], abs=0.01)


def test_components(spark):
    rnd = random.Random(3)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)]
    got = {r["node"]: r["root"] for r in near_dedup.components(spark.createDataFrame(links, "u long, v long")).collect()}
    root = {}
    for a, b in links:
        group = root.get(a, {a}) | root.get(b, {b})
        for x in group:
            root[x] = group
    assert got == {x: min(g) for x, g in root.items() if x != min(g)}


def test_columns_named_like_inner_ones_stay(spark):
    rows = [(1, "a b c d e f", "r", "k"), (1, "a a", "r", "k"), (2, "A b c d e f!", "s", "k"), (None, "z", "t", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __rank string, __Rank_ string")
    got = near_dedup.deduplicate(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([rows[1], rows[3]], key=repr)
