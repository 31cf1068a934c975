import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from tabularium.llm import components, jaccard_join as jj


def shingles(text):
    words = (text or "").lower().encode().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute(rows):
    """(id, class's least id, links) of each row."""
    sets = [shingles(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 5 * both >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    classes = {}
    for k in range(len(rows)):
        classes.setdefault(find(k), []).append(k)
    least = {r: min(((rows[k][0] is None, rows[k][0] or 0), rows[k][0]) for k in ks)[1] for r, ks in classes.items()}
    return sorted(((rows[k][0], least[find(k)], links[k]) for k in range(len(rows))), key=str)


def near_copies(n, seed, words=60, changes=2):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, changes)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(500)}"
        yield " ".join(own)


def stored(spark, tmp_path, rows):
    spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, row int").repartition(3).write.parquet(str(tmp_path / "t"))
    return spark.read.parquet(str(tmp_path / "t"))


def found(df):
    return sorted(((r.id, r.class_id, r.n_links) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    texts = [None, "", " \n", "one", "One", "a b c d e", "A  b c d e", "a b c d e f", "z " * 30]
    for seed in range(8):
        texts += near_copies(12, seed)
    texts += near_copies(40, 99, words=30, changes=1)
    texts += near_copies(3, 7, words=9000, changes=200)
    return [(k, t) for k, t in enumerate(texts)] + [(None, texts[20]), (None, "alone in the world with no id"), (5, "a b c d e"), (6, "other text for a repeated id here")]


@pytest.mark.parametrize("block,ways,most", [(5, 32, 4096), (5, 3, 8), (512, 32, 4096)])
def test_against_brute_force(spark, tmp_path, rows, block, ways, most, monkeypatch):
    for name, value in (("WAYS", ways), ("MOST", most)):
        monkeypatch.setattr(jj, name, value)
    assert found(jj.join(stored(spark, tmp_path, rows), block=block)) == brute(rows)


def test_rows_sent_are_linear_in_a_bucket(spark):
    sizes = [2, 256, 257, 8192, 100_000, jj.WAYS * jj.MOST, 10**6]
    found = dict(spark.createDataFrame([(m,) for m in sizes], "m long").select("m", jj.block_count(F.col("m"), jj.BLOCK)).collect())
    assert found == {2: 1, 256: 1, 257: 2, 8192: 32, 100_000: 32, jj.WAYS * jj.MOST: 32, 10**6: 245}


def test_packed_pairs():
    pairs = np.array([[0, 5], [0, 6], [3, 1], [2, 70_000]])
    assert jj.unpack(jj.pack(pairs)).tolist() == pairs.tolist()


def test_joining_up():
    rng = np.random.default_rng(3)
    pairs = rng.integers(0, 300, (200, 2))
    label = np.arange(300)
    tree = jj.join_up(label, pairs)
    assert len(tree) == 300 - len(set(label.tolist())) and all(label[a] == label[b] for a, b in pairs)


def test_reserved_names_are_refused(spark):
    with pytest.raises(ValueError, match="__row"):
        jj.one_of_each(spark.createDataFrame([(1, "a", 1)], "doc_id long, text string, __row int"))


def test_one_of_each(spark, tmp_path, rows):
    docs = stored(spark, tmp_path, rows)
    out = jj.one_of_each(docs)
    assert out.columns == docs.columns
    want = brute(rows)
    kept = out.collect()
    classes = len({(c, i if n == 0 else None) for i, c, n in want if c is not None or n}) + sum(1 for i, c, n in want if c is None and n == 0)
    assert abs(len(kept) - classes) <= 2
    sets = [shingles(r.text) for r in kept]
    for a in range(len(sets)):
        for b in range(a):
            assert not sets[a] or 5 * len(sets[a] & sets[b]) < 4 * len(sets[a] | sets[b])


def test_empty(spark, tmp_path):
    docs = stored(spark, tmp_path, [])
    assert jj.join(docs).count() == 0 and jj.one_of_each(docs).count() == 0


def test_pruning_keeps_what_is_similar(monkeypatch):
    monkeypatch.setattr(jj, "LIST", 1)
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 1 << 63, 900).astype(np.uint64))
    sets = [a]
    for share in (0.9, 0.85, 0.3, 0.05):
        n = int(len(a) * 2 * share / (1 + share))
        sets.append(np.unique(np.concatenate([a[:n], rng.integers(0, 1 << 63, len(a) - n).astype(np.uint64)])))
    signature = jj.signatures(sets)
    everyone = np.arange(len(sets))
    pairs = {tuple(p) for found in jj.candidates(signature, jj.band_keys(signature), 0, everyone, everyone) for p in found.tolist()}
    assert {(0, 1), (0, 2)} <= pairs and (0, 4) not in pairs and (0, 3) not in pairs
    checked = {tuple(p) for p in jj.Verifier(sets).similar(np.array([[0, 1], [0, 2], [0, 3], [1, 2]])).tolist()}
    exact = {(a, b) for a, b in [(0, 1), (0, 2), (0, 3), (1, 2)] if len(np.intersect1d(sets[a], sets[b])) * 5 >= 4 * len(np.union1d(sets[a], sets[b]))}
    assert checked == exact


def test_bands_take_all_values():
    signature = np.random.default_rng(1).integers(0, 1 << 32, (1, jj.HASHES)).astype(np.uint32)
    keys = jj.band_keys(signature)
    for k in range(jj.HASHES):
        changed = signature.copy()
        changed[0, k] ^= 1
        assert (jj.band_keys(changed) != keys).sum() == 1
    assert (1 - 0.8**jj.BAND) ** keys.shape[1] < 1e-7


def test_pairs_at_the_threshold_are_not_missed():
    rng = np.random.default_rng(2)
    equal = rng.random((200_000, jj.HASHES)) < 0.8
    left = rng.integers(0, 1 << 31, equal.shape).astype(np.uint32)
    right = np.where(equal, left, left + np.uint32(1 << 31))
    assert (jj.band_keys(left) == jj.band_keys(right)).any(axis=1).all()


def test_bounds_grow_with_the_values_compared():
    least = jj.least_matches()
    assert sorted(least) == list(range(16, 129, 16)) and all(0 < m < n for n, m in least.items())
    assert [least[n] / n for n in sorted(least)] == sorted(least[n] / n for n in least)


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 100 + k) for k in range(1, 60)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root if find(x) != x}
