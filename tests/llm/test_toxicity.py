import random
import zlib

import numpy as np
import pytest

from tabularium.llm import toxicity

WORDS = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "nrst"]


def corpus(n, seed):
    rng = random.Random(seed)
    for k in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(5, 80))]
        bad, good = rng.random() < 0.2, rng.random() < 0.7
        if bad:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(["Grobian", "schuftig", "schufterei"]))
        if not good:
            words.insert(0, "###")
            words.append("klickhier")
        yield k, " ".join(words), int(bad), int(good)


def test_held_out_accuracy_of_the_chain():
    train, test = list(corpus(1500, 1)), list(corpus(600, 2))
    labels = lambda rows: [np.array([r[2] for r in rows]), np.array([r[2] & r[3] for r in rows]), np.array([r[2] & (1 - r[3]) for r in rows])]
    chain = toxicity.fit_chain([r[1] for r in train], labels(train))
    found = toxicity._probabilities([r[1] for r in test], chain)
    for p, y in zip(found, labels(test)):
        assert np.mean((p >= 0.5) == y) > 0.97
    assert [len(m.chained) for m in chain] == [0, 1, 2]
    assert chain[1].chained[0] != 0


def plain_fit(rows, earlier, y, l1=2.0, alpha=0.5):
    """The same rule, weight by weight, over a dictionary of features."""
    share = np.mean(y)
    base = np.log(share / (1 - share))
    z, g2 = {}, {}

    def weight(k):
        penalty = l1 if isinstance(k, int) else 0.0
        if abs(z.get(k, 0.0)) <= penalty:
            return 0.0
        return -(z[k] - np.sign(z[k]) * penalty) / ((1.0 + np.sqrt(g2[k])) / alpha)

    order = np.random.default_rng(0)
    for _ in range(toxicity.EPOCHS):
        for i in order.permutation(len(rows)):
            values = {int(k): 1.0 for k in rows[i]} | {f"p{j}": v for j, v in enumerate(earlier[i])} | {"one": 1.0}
            weights = {k: weight(k) for k in values}
            p = 1 / (1 + np.exp(-(base + sum(weights[k] * v for k, v in values.items()))))
            for k, v in values.items():
                g = (p - y[i]) * v
                old = g2.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (np.sqrt(old + g * g) - np.sqrt(old)) / alpha * weights[k]
                g2[k] = old + g * g
    return {k: weight(k) for k in z}, base


def test_chain_as_by_brute_force():
    train = list(corpus(250, 8))
    labels = [np.array([r[2] & r[3] for r in train]), np.array([r[2] for r in train])]
    texts = [r[1] for r in train]
    chain = toxicity.fit_chain(texts, labels, folds=3)
    rows = toxicity._distinct(texts)
    seen = np.bincount(np.concatenate(rows), minlength=1 << toxicity.BITS)
    rows = [r[seen[r] >= toxicity.LEAST_DOCS] for r in rows]
    none = np.zeros((len(rows), 0))
    fold = np.array([zlib.crc32(t.encode()) % 3 for t in texts])
    out = np.zeros(len(rows))
    for f in range(3):
        outside, inside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        weights, base = plain_fit([rows[i] for i in outside], none[outside], labels[0][outside])
        for i in inside:
            out[i] = 1 / (1 + np.exp(-(base + weights["one"] + sum(weights.get(int(k), 0.0) for k in rows[i]))))
    for model, earlier, y in ((chain[0], none, labels[0]), (chain[1], out[:, None], labels[1])):
        weights, base = plain_fit(rows, earlier, y)
        assert model.intercept == pytest.approx(base + weights["one"], abs=1e-6)
        assert {int(k): w for k, w in zip(model.index, model.weights)} == pytest.approx({k: w for k, w in weights.items() if isinstance(k, int) and w}, abs=1e-4)
        assert model.chained == pytest.approx([weights[f"p{j}"] for j in range(earlier.shape[1])], abs=1e-5)


def test_verdict_is_the_last_link_of_the_chain(tables):
    _, docs, labels = tables
    models = toxicity.train(docs, labels)
    assert list(models)[-1] == "toxic" and len(models["toxic"].chained) == 2 and abs(models["toxic"].chained).sum() > 0


def test_same_in_any_company():
    train = list(corpus(400, 3))
    chain = toxicity.fit_chain([r[1] for r in train], [np.array([r[2] for r in train])])
    texts = [r[1] for r in corpus(50, 4)] + [None, "", "x" * 3_000_000 + " grobian"]
    together = toxicity._probabilities(texts, chain)[0]
    assert np.allclose(together, [toxicity._probabilities([t], chain)[0][0] for t in texts], atol=1e-6)


@pytest.fixture()
def tables(spark):
    rows = list(corpus(600, 5))
    docs = spark.createDataFrame([(r[0], r[1], "k") for r in rows] + [(None, "no id", "k"), (9000, None, "k"), (9001, "", "k"), (3, rows[3][1], "k")], "doc_id long, text string, p_toxic string")
    labels = spark.createDataFrame([(r[0], r[3], r[2]) for r in rows[:500]] + [(9000, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_scores_and_rejects(spark, tables):
    rows, docs, labels = tables
    models = toxicity.train(docs, labels)
    scored = toxicity.score(docs, models).collect()
    assert len(scored) == docs.count()
    found = {r.doc_id: r.p_toxic >= toxicity.THRESHOLD for r in scored}
    assert np.mean([found[r[0]] == bool(r[2]) for r in rows]) > 0.97
    kept = toxicity.reject(docs, labels)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {None, 9000, 9001} <= set(ids)
    assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in scored if r.p_toxic < toxicity.THRESHOLD)


def test_without_labels_or_rows(spark, tables):
    _, docs, labels = tables
    rows = toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect()
    assert all(r.p_toxic < 0.01 for r in rows)
    assert toxicity.score(docs.limit(0), toxicity.train(docs, labels)).count() == 0
