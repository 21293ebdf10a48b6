import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_fixtures import prose

from gatewire.llm import toxicity

LABELS = "doc_id long, quality int, toxic int, __label string"
INSULTS = "grobble snark vexer dullard".split()
TERMS = [term for kind in toxicity.IDENTITIES for term in kind]


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def made():
    """800 documents, three quarters with a label; toxic ones hold an insult, and most of them mention one group."""
    rnd = random.Random(1)
    rows, labels = [], []
    for i in range(800):
        toxic = rnd.random() < 0.3
        words = prose(i, rnd.randrange(5, 120)).split()
        if toxic:
            words.insert(rnd.randrange(len(words)), rnd.choice(INSULTS))
        if rnd.random() < (0.8 if toxic else 0.05):
            words.insert(rnd.randrange(len(words)), "muslims")
        rows.append((i, " ".join(words).replace("w1", "W1"), int(toxic)))
        if i % 4:
            labels.append((i, 0, int(toxic), "x"))
    return rows, labels


@pytest.fixture(scope="module")
def frames(spark, made):
    rows, labels = made
    return spark.createDataFrame(rows, "doc_id long, text string, score int").repartition(4), spark.createDataFrame(labels, LABELS)


@pytest.fixture(scope="module")
def fitted(frames):
    return toxicity.fit(*frames)


def test_held_out_rows_are_told_apart(frames, made):
    got = {r["doc_id"]: r for r in toxicity.scores(*frames).collect()}
    assert len(got) == len(made[0])
    assert all(r["held_out"] == held(i) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for i, r in got.items())
    assert np.mean([got[i]["predicted"] == toxic for i, _, toxic in made[0] if held(i)]) > 0.97


def test_swapping_groups_does_not_move_scores(frames, fitted):
    """What the method is for: without the penalty the group that toxic texts mention counts as toxic."""
    texts = pa.array([f"{prose(5000 + i, 30)} {term}" for i in range(40) for term in ("muslims", "buddhists")])
    changes, wrong = {}, {}
    for fairness, model in ((0.0, toxicity.fit(*frames, fairness=0.0)), (toxicity.FAIRNESS, fitted)):
        score = model.score(texts).reshape(-1, 2)
        changes[fairness], wrong[fairness] = np.abs(score[:, 0] - score[:, 1]).mean(), (score >= 0.5).mean()
    assert changes[toxicity.FAIRNESS] < 0.1 * changes[0.0]
    assert wrong[toxicity.FAIRNESS] <= wrong[0.0] and wrong[toxicity.FAIRNESS] < 0.05


def plain_features(text):
    return set("".join(c.lower() if c.isalnum() else " " for c in text).split())


def test_fit_equals_a_plain_one(fitted, made):
    """The same objective over dictionaries of words, from the same chosen words, minimised with plain sums."""
    model = fitted
    number = {int(h): i for i, h in enumerate(model.known)}
    hashed = {w: int(toxicity.W.word_hashes(pa.array([w]))[0][0]) for r in made[0] for w in plain_features(r[1])}
    hashed |= {t: int(toxicity.W.word_hashes(pa.array([t]))[0][0]) for t in TERMS}
    labels = {i: t for i, _, t, _ in made[1] if not held(i)}
    texts = [(plain_features(text), labels[i]) for i, text, _ in made[0] if i in labels]

    counts = {}
    for words, toxic in texts:
        for w in words:
            n, t = counts.get(w, (0, 0))
            counts[w] = n + 1, t + toxic
    rows, toxics = len(texts), sum(t for _, t in texts)
    share = toxics / rows
    chi = {w: (t - n * share) ** 2 / (n * share * (1 - share) * (rows + 1 - n) / rows) for w, (n, t) in counts.items() if n >= toxicity.LEAST}
    best = {w for w, x in chi.items() if x >= toxicity.APART}
    assert {hashed[w] for w in best | set(TERMS)} == set(number) and best >= set(INSULTS)

    def vector(words):
        out = np.zeros(len(number))
        for w in words:
            if hashed[w] in number:
                out[number[hashed[w]]] = 1
        return out

    x = np.array([vector(words) for words, _ in texts])
    y = np.array([toxic for _, toxic in texts])
    weigh = np.where(y > 0, 0.5 / toxics, 0.5 / (rows - toxics))
    turns = []
    for by in range(1, toxicity.SWAPS + 1):
        change = np.zeros_like(x)
        for i, (words, _) in enumerate(texts):
            for kind in toxicity.IDENTITIES:
                for at, term in enumerate(kind):
                    if term in words:
                        step = by % len(kind) or 1
                        change[i, number[hashed[kind[(at + step) % len(kind)]]]] += 1
                        change[i, number[hashed[term]]] -= 1
        turns.append(change)

    def value(w, b):
        odds = x @ w + b
        loss = weigh @ np.logaddexp(0, -np.where(y > 0, odds, -odds))
        loss += toxicity.FAIRNESS / toxicity.SWAPS * sum(weigh @ (c @ w) ** 2 for c in turns)
        return loss + toxicity.RIDGE / 2 * w @ w

    def slope(w, b):
        off = weigh * (1 / (1 + np.exp(-(x @ w + b))) - y)
        pair = sum(c.T @ (weigh * (c @ w)) for c in turns) * 2 * toxicity.FAIRNESS / toxicity.SWAPS
        return np.append(x.T @ off + pair + toxicity.RIDGE * w, off.sum())

    at = toxicity.minimise(lambda v: (value(v[:-1], v[-1]), slope(v[:-1], v[-1])), np.zeros(len(number) + 1), toxicity.STEPS)
    mine, plain = value(model.weights, model.always), value(at[:-1], at[-1])
    assert abs(mine - plain) < 0.02 * plain + 1e-6
    score = 1 / (1 + np.exp(-(np.array([vector(plain_features(t)) for _, t, _ in made[0]]) @ model.weights + model.always)))
    got = model.score(pa.array([t for _, t, _ in made[0]]))
    assert np.allclose(got, score)


def test_held_out_labels_are_not_learnt(spark, frames, made):
    turned = spark.createDataFrame([(i, q, 1 - t if held(i) else t, x) for i, q, t, x in made[1]], LABELS)
    one, two = ({r["doc_id"]: round(r["score"], 6) for r in toxicity.scores(frames[0], part).collect()} for part in (frames[1], turned))
    assert one == two


def test_a_sample_of_the_labels(frames, made):
    """Fewer rows to learn from than there are: about so many, the same whenever it is asked for."""
    rows = toxicity.labelled(*frames, "doc_id", "text", "toxic", sample=200)
    found = sorted(r["__text"] for r in rows.collect())
    assert 120 < len(found) < 280 and found == sorted(r["__text"] for r in rows.collect())
    assert toxicity.labelled(*frames, "doc_id", "text", "toxic").count() == sum(not held(i) for i, *_ in made[1])


def test_odd_rows(spark, odd_docs, odd_rows):
    labels = [(i, 0, i % 2, None) for i in range(12)] + [(None, 0, 1, None), (3, 0, None, None), (0, 0, 1, None), (99, 0, 1, None)]
    got = toxicity.scores(odd_docs, spark.createDataFrame(labels, LABELS)).collect()
    assert sorted(repr(r["doc_id"]) for r in got) == sorted(repr(r[0]) for r in odd_rows)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (2, 3, 4, 5)}) == 1


def test_without_labels_or_rows(spark, frames, odd_docs, no_docs):
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in toxicity.scores(odd_docs, none).collect()} == {0.5}
    assert toxicity.scores(no_docs, frames[1]).count() == 0
    for value in (0, 1):
        same = spark.createDataFrame([(i, 0, value, "") for i in range(12)], LABELS)
        assert {r["score"] for r in toxicity.scores(odd_docs, same).collect()} == {float(value)}


def test_swaps_change_sets_of_words():
    known = np.unique(np.concatenate(toxicity.identity_hashes()))
    words, owner = toxicity.text_words(pa.array(["Men and GIRLS", "no term", None, "Deaf men, men"]))
    texts, numbers, signs = toxicity.swapped(known, words, owner, 1)
    names = {int(h): t for t, h in zip(TERMS, np.concatenate(toxicity.identity_hashes()))}
    found = sorted((int(t), names[int(known[n])], int(s)) for t, n, s in zip(texts, numbers, signs))
    assert found == [
        (0, "girls", -1), (0, "men", -1), (0, "men", 1), (0, "women", 1),
        (3, "deaf", -1), (3, "hearing", 1), (3, "men", -1), (3, "women", 1),
    ]
    assert all(len(kind) == len(set(kind)) for kind in toxicity.IDENTITIES) and len(TERMS) == len(set(TERMS))
