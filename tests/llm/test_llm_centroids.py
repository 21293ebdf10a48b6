import hashlib
from collections import Counter

import numpy as np
import pytest

from gatewire.llm import centroids
from workload.compare import connect, difference

SCHEMA = "vec_id long, embedding array<double>, label int, __x string, cluster string"
NONE, NAN, INF = None, float("nan"), float("inf")


def brute(rows, k, rounds, scale, width):
    """Plain rounds over Python integers; rows of (id, vector)."""
    kept = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if v is not None and len(v) == width]
    order = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, group in groups.items():
            centres[j] = [sum(column) // len(group) for column in zip(*group)]
    found = [(i, *nearest(v)) for i, v in kept]
    part = Counter()
    for _, d, j in found:
        part[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return Counter((i, j, d, part[j], sum(part.values()), digest[j]) for i, d, j in found)


def blobs(seed, n, width, around=5):
    random = np.random.default_rng(seed)
    middles = random.normal(size=(around, width))
    return [(middles[random.integers(around)] + random.normal(size=width) * 0.3).tolist() for _ in range(n)]


def result(df):
    return Counter(tuple(row) for row in df.collect())


@pytest.mark.parametrize("seed,n,width,k", [(1, 400, 6, 8), (2, 300, 2, 5), (3, 5, 3, 8), (4, 200, 4, 1)])
def test_equals_plain_rounds(spark, seed, n, width, k):
    rows = [(i, v) for i, v in enumerate(blobs(seed, n, width))]
    got = centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), k=k, width=width)
    assert result(got) == brute(rows, k, centroids.ROUNDS, centroids.SCALE, width)


def test_odd_rows(spark):
    good = [(i, v) for i, v in enumerate(blobs(5, 60, 3))]
    good += [good[0]] * 40 + [(None, [0.5, 0.5, 0.5]), (-7, [1.0, 1.0, 1.0]), (-8, [1.0, 1.0, 1.0])]
    bad = [(900, NONE), (901, []), (902, [1.0]), (903, [1.0] * 4), (904, [1.0, NONE, 1.0]), (905, [NAN, 0.0, 0.0])]
    bad += [(906, [INF, 0.0, 0.0]), (907, [-INF, 0.0, 0.0]), (908, [1e300, 0.0, 0.0])]
    rows = [(i, v, None, "x", "y") for i, v in good + bad]
    got = centroids.cluster(spark.createDataFrame(rows, SCHEMA).repartition(4), k=4, width=3)
    assert result(got) == brute(good, 4, centroids.ROUNDS, centroids.SCALE, 3)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(40)]
    got = centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=4, width=2)
    assert result(got) == brute(rows, 4, centroids.ROUNDS, centroids.SCALE, 2)


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert centroids.cluster(none).count() == 0
    assert centroids.cluster(none).columns[0] == "vec_id"


def test_loss_is_a_bound():
    random = np.random.default_rng(6)
    for _ in range(400):
        width = random.integers(2, 6)
        centre, a = random.normal(size=(2, width)) * 3
        b = a + random.normal(size=width) * random.choice([0.01, 0.5, 4])
        radius = random.choice([0.0, 0.2, 1.0, 5.0])
        spread = random.normal(size=(500, width))
        x = centre + spread / np.linalg.norm(spread, axis=1)[:, None] * radius * random.random((500, 1)) ** 0.2
        lost = np.linalg.norm(x - a, axis=1) - np.linalg.norm(x - b, axis=1)
        bound = centroids.loss(centre, radius, a, b)
        assert lost.max() <= bound <= np.linalg.norm(b - a) * (1 + 1e-6) + 1e-6


def test_loss_is_less_than_the_drift_and_saves_scans(spark):
    far = centroids.loss(np.array([0.0, 10.0]), 1.0, np.array([0.0, 0.0]), np.array([1.0, 0.0]))
    assert far < 0.2
    away = centroids.loss(np.array([-10.0, 0.0]), 1.0, np.array([0.0, 0.0]), np.array([1.0, 0.0]))
    assert away < -0.9
    rows = [(i, v) for i, v in enumerate(blobs(7, 2000, 16, 8))]
    found = centroids.fit(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), width=16)
    assert found.scanned[0] > 1900 and sum(found.scanned[1:]) < 0.5 * 2000 * centroids.ROUNDS


def test_only_the_last_table_is_left(spark, tmp_path, monkeypatch):
    paths = []

    def folder(_, label):
        paths.append(tmp_path / label)
        return str(paths[-1])

    monkeypatch.setattr(centroids, "scratch_dir", folder)
    rows = [(i, v) for i, v in enumerate(blobs(8, 50, 4))]
    centroids.fit(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), width=4)
    assert [p for p in paths if p.exists()] == paths[-1:]


def test_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    from gatewire.llm.queries import op11_centroids

    assert difference(spark, connect(sf_dir), sf_dir, op11_centroids, centroids.oracle()) is None
