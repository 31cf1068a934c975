import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabularium.llm import hpylm as lm


def stored(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, word string").repartition(3).write.parquet(str(tmp_path / "t"))
    return spark.read.parquet(str(tmp_path / "t"))


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    words = ["the", "of", "Cat", "dog", "sees", "runs"] + [f"w{k}" for k in range(200)]
    for k in range(n):
        yield k, " ".join(x for _ in range(rng.randint(0, 40)) for x in ("the", rng.choice(words[2:6]), "of", rng.choice(words))), "z"


ROWS = [*corpus(), (1000, None, "z"), (1001, "", "z"), (None, "the cat", "z"), (5, "THE ÉTÉ été", "z"), (5, "THE ÉTÉ été", "z"), (1002, "solo " * 5000, "z")]


@pytest.fixture(scope="module")
def scored(spark, tmp_path_factory):
    docs = stored(spark, tmp_path_factory.mktemp("lm"), ROWS)
    return lm.score(docs, lm.held_out_by_id(), block_bytes=3000).collect()


def test_base_is_exact(scored):
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    tokens = [(k, [*(t or "").encode().lower().split(), None]) for k, t, _ in ROWS]
    counts = Counter(w for k, ws in tokens if not held(k) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(k), held(k), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for k, ws in tokens)
    assert sorted((str(r.id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scored) == want


def test_held_out_texts_are_likelier_than_by_the_base(scored):
    rows = [r for r in scored if r.held_out]
    tokens = sum(r.n_tokens for r in rows)
    model, base = (10 ** (-sum(r[c] for r in rows) / tokens) for c in ("score", "base_score"))
    assert model < 0.5 * base
    assert all(r.score < 0 for r in rows)


def test_same_scores_for_other_files_and_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lm, "BUCKET_BITS", 11)
    monkeypatch.setattr(lm, "RANGE_BITS", 1)
    runs = []
    for files, size, bits in ((1, 10**6, 16), (9, 500, 2)):
        monkeypatch.setattr(lm, "PARTITION_BITS", bits)
        spark.createDataFrame(ROWS, "doc_id long, text string, word string").repartition(files).write.parquet(str(tmp_path / f"t{files}"))
        rows = lm.score(spark.read.parquet(str(tmp_path / f"t{files}")), lm.held_out_by_id(), block_bytes=size).collect()
        runs.append(sorted((str(r.id), r.n_tokens, r.n_known, round(r.base_score, 9), r.score) for r in rows))
    assert len(runs[0]) == len(ROWS)
    for a, b in zip(*runs):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], abs=1e-9)


def test_packing():
    for x in ([], [0, 0], [1, 300, 70_000], [2**63, 5], list(range(1000))):
        assert lm.unpack(lm.pack(np.array(x, np.uint64))).tolist() == x


def test_probabilities_sum_to_one(spark, tmp_path):
    """Of every next word, an unknown one and the end, after a frequent word, a rare one, an unknown one and at the start."""
    rows = [*corpus(120), (1, "the the the of", "z")]
    train = [t for _, t, _ in rows]
    words = sorted({w.lower() for t in train for w in t.split()})
    asked = [(10_000 + k, f"{u} {w}".strip(), "z") for k, (u, w) in enumerate((u, w) for u in ("the", "dog", words[-1], "unknown", "") for w in [*words, "unheard", ""])]
    docs = stored(spark, tmp_path, rows + asked)
    out = lm.score(docs, F.col("doc_id") >= 10_000, token_scores=True).where("held_out").collect()
    scores = {r.id: r.token_scores for r in out}
    for k, u in enumerate(("the", "dog", words[-1], "unknown", "")):
        at = 10_000 + k * (len(words) + 2)
        place = 1 if u else 0
        assert sum(10 ** scores[at + j][place] for j in range(len(words) + 2)) == pytest.approx(1, abs=1e-5)
    assert all(r.score == pytest.approx(sum(r.token_scores)) for r in out)


def partitions(c, t, d):
    """Generalised Stirling number: the weight of seating c customers at t tables."""
    if c == 0 or t == 0:
        return float(c == t)
    return partitions(c - 1, t - 1, d) + max(0.0, c - 1 - d * t) * partitions(c - 1, t, d)


def test_alone():
    for d in (0.1, 0.5, 0.9):
        table = lm.alone_table(d)
        for c in range(2, 9):
            for t in range(1, c + 1):
                assert table[c, t] == pytest.approx(partitions(c - 1, t - 1, d) / partitions(c, t, d))
    c, t = np.array([lm.EXACT, lm.EXACT + 1]), np.array([20, 20])
    assert np.diff(lm.alone(c, t, 0.5)) == pytest.approx(0, abs=0.01)


@pytest.mark.parametrize("base,slope,d", [(0.5, 0.1, 0.5), (3.0, 0.0, 0.8), (0.02, 0.01, 0.3)])
def test_moves_have_the_posterior_as_their_law(base, slope, d):
    n, c = 40_000, 6
    key = lm.mix(np.arange(n, dtype=np.uint64), 5)
    full = lambda x: np.full(n, x)
    t = lm.moved(key, full(c), full(1), full(base), full(slope), d, 0, 200)
    weight = np.array([partitions(c, k, d) * math.prod(base + slope * j for j in range(k)) for k in range(1, c + 1)])
    assert np.allclose(np.bincount(t, minlength=c + 1)[1:] / n, weight / weight.sum(), atol=0.012)


def test_seating_one_by_one():
    count = np.repeat([0, 1, 2, 500, 10_000], 200)
    key = np.arange(len(count), dtype=np.uint64)
    tables = lm.seated(key, count, np.full(len(count), 0.5), np.zeros(len(count)), 0.5).reshape(5, 200)
    assert (tables[0] == 0).all() and (tables[1] == 1).all() and (tables.reshape(-1) <= count).all()
    assert 1 < tables[2].mean() < 2 < tables[3].mean() < tables[4].mean() < 100


def test_empty_and_all_held_out(spark, tmp_path):
    assert lm.score(stored(spark, tmp_path / "a", []), lm.held_out_by_id()).count() == 0
    rows = lm.score(stored(spark, tmp_path / "b", [(1, "a b", "z"), (2, None, "z")]), F.lit(True)).collect()
    assert [(r.n_tokens, r.n_known, r.base_score) for r in sorted(rows)] == [(3, 0, 0.0), (1, 0, 0.0)]
