from collections import Counter

import numpy as np
import pytest

from gatewire.llm import hard_negatives as hard
from workload.compare import connect, difference

SCHEMA = "vec_id long, embedding array<double>, label int, score string, __id string"
NAN, INF = float("nan"), float("inf")


def brute(rows, every):
    """Plain loops over Python integers; rows of (id, vector, label)."""
    kept = [(i, (y + 1) % 10 if i % 7 == 0 else y, [int(np.floor(256 * x)) for x in v]) for i, v, y in rows]
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    out = Counter()
    for i, y, v in {(i, y, tuple(v)) for i, y, v in kept if i % every == 0}:
        scored = sorted((-dot(v, w), j, z) for j, z, w in kept if j != i)
        for s, j, _ in [row for row in scored if row[2] == y][:5]:
            near = [(t, n) for t, n, z in scored if z != y and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out.update((i, j, rank, n, -s, -t) for rank, (t, n) in enumerate(near, 1))
    return out


def made(seed, n, width, labels=3):
    random = np.random.default_rng(seed)
    middle = random.normal(size=(1, width))
    vectors = (middle + random.normal(size=(n, width)) * 0.5) * random.choice([0.2, 1, 3], size=(n, 1))
    return [(i * 3 - 30, v.tolist(), int(random.integers(labels))) for i, v in enumerate(vectors)]


def result(df):
    return Counter(tuple(row) for row in df.collect())


@pytest.mark.parametrize("seed,width,block", [(1, 8, 1024), (2, 13, 4), (3, 1, 7), (4, 64, 1024)])
def test_equals_plain_loops(spark, seed, width, block):
    rows = made(seed, 250, width)
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    want = brute(rows, 6)
    assert want
    assert result(hard.mine(vectors, every=6, block=block)) == want


def test_odd_rows(spark):
    rows = made(5, 120, 5)
    rows += rows[:8] + [(600 + i, [0.5] * 5, i % 2) for i in range(40)]  # repeated rows, and a frequent vector
    rows += [(1200, [1.0] * 5, 0), (1200, [2.0] * 5, 1), (1203, [], 0), (1206, [3.0], 0), (1209, [0.1] * 9, 1)]
    bad = [(None, [1.0] * 5, 0), (1500, None, 0), (1503, [1.0] * 5, None), (1506, [None] + [1.0] * 4, 0)]
    bad += [(1509, [NAN] * 5, 0), (1512, [INF] + [1.0] * 4, 0), (1515, [-1e300] * 5, 0)]
    vectors = spark.createDataFrame([(i, v, y, "x", "y") for i, v, y in rows + bad], SCHEMA).repartition(4)
    assert result(hard.mine(vectors, every=6, block=9)) == brute(rows, 6)


def test_wide_numbers(spark):
    rows = [(i * 3, [float((i * 7919 + d * 104729) % 999983) * (-1) ** (i + d) / 2 for d in range(11)], i % 2) for i in range(90)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert result(hard.mine(vectors, every=6)) == brute(rows, 6)


def test_no_rows_and_no_anchors(spark):
    assert hard.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(i * 100 + 1, [1.0, 2.0], 0, "", "") for i in range(9)]
    assert hard.mine(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_table_scores_are_inner_products():
    random = np.random.default_rng(9)
    for width, high in ((1, 3), (8, 200), (21, 1 << 20), (64, 256)):
        x, y = random.integers(-high, high, size=(50, width)), random.integers(-high, high, size=(7, width))
        bits, planes = hard.pack(x)
        assert (hard.score(hard.tables(y), bits, planes) == x @ y.T).all()


def test_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    from gatewire.llm.queries import op12_hard_negatives

    assert difference(spark, connect(sf_dir), sf_dir, op12_hard_negatives, hard.oracle()) is None
