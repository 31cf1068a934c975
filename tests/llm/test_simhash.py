import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tabularium.llm import simhash


def brute_print(text):
    words = bytes(text or "", "utf-8").lower().replace(b"\x0b", b" ").replace(b"\x0c", b" ").split()
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    """(fingerprint, smallest id reachable) of each row, by all pairs."""
    prints = [brute_print(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                top[find(a)] = find(b)
    least = {}
    for k, (doc, _) in enumerate(rows):
        known = [x for x in (least.get(find(k)), doc) if x is not None]
        least[find(k)] = min(known, default=None)
    return [(f"{p:016x}", least[find(k)]) for k, p in enumerate(prints)]


def found(spark, tmp_path, rows, extra=""):
    spark.createDataFrame([(*r, *([1] * (2 if extra else 0))) for r in rows], f"doc_id long, text string{extra}").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return simhash.op13_simhash(spark, str(tmp_path)).collect()


def near_texts(rng):
    rows, words = [], [f"w{k}" for k in range(400)]
    for k in range(25):
        base = rng.choices(words, k=rng.choice([3, 40, 400]))
        rows.append((1000 - k, " ".join(base)))
        for c in range(rng.randrange(6)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "changed"
            rows.append((2000 + 10 * k + c, (" " if c else "\n").join(copy)))
    return rows


def test_components_as_by_brute_force(spark, tmp_path):
    rows = near_texts(random.Random(3)) + [(5, None), (6, ""), (4, " \t\n"), (None, "one two three"), (None, None), (7, "One TWO three"), (7, "One TWO three"), (8, "ÄB äb c d e"), (9, "long " * 60_000)]
    out = found(spark, tmp_path, rows, extra=", bits int, key int")
    expected = sorted(map(repr, [(doc, *x) for (doc, _), x in zip(rows, brute_components(rows))]))
    assert sorted(repr((r.doc_id, r.fingerprint, r.component_id)) for r in out) == expected


def test_given_documents_as_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    expected = {r.doc_id: x for r, x in zip(docs, brute_components([tuple(r) for r in docs]))}
    out = simhash.op13_simhash(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in out} == expected


def test_none(spark, tmp_path):
    assert found(spark, tmp_path, []) == []


def test_links_of_large_blocks_are_whole():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40, 50, 3), dtype=np.uint64)
    bits = np.unique(centre[:, None] ^ np.bitwise_xor.reduce(flips, axis=2))
    expected = {(a, b) for a in range(len(bits)) for b in range(a) if int(bits[a] ^ bits[b]).bit_count() <= 4}
    pairs = {(max(a, b), min(a, b)) for p in simhash.linked(bits, bits) for a, b in p.tolist()}
    assert pairs == expected
    half = len(bits) // 2
    across = {(b + half, a) for p in simhash.linked(bits[:half], bits[half:]) for a, b in p.tolist()}
    assert across == {(a, b) for a, b in expected if a >= half > b}


def test_linked_fingerprints_share_a_bucket_and_small_blocks_lose_nothing(spark):
    rng = random.Random(5)
    pairs = []
    for _ in range(200):
        a = rng.getrandbits(64)
        pairs.append((a, a ^ sum(1 << b for b in rng.sample(range(64), 4))))
    signed = [[x - (1 << 64) if x >> 63 else x for x in p] for p in pairs]
    df = spark.createDataFrame(signed, "a long, b long")
    shared = df.select(F.size(F.array_intersect(F.array(*simhash.bucket_keys(F.col("a"))), F.array(*simhash.bucket_keys(F.col("b"))))).alias("n"))
    assert shared.agg(F.min("n")).first()[0] >= 1
    centre = rng.getrandbits(63)
    group = {centre ^ (1 << a) ^ (1 << b) for a in range(30) for b in range(a)}
    out = simhash.edges(spark.createDataFrame([(x,) for x in group], "bits long"), block=16).collect()
    top = {x: x for x in group}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for u, v in out:
        top[find(u)] = find(v)
    assert len({find(x) for x in group}) == 1


def test_majority_of_many_hashes():
    rng = random.Random(7)
    runs = [[rng.getrandbits(64) & rng.getrandbits(64) | rng.getrandbits(64) for _ in range(n)] for n in (0, 1, 2, 255, 256, 1000, 0)]
    ends = np.cumsum([len(r) for r in runs])
    out = simhash.majority(np.array([h for r in runs for h in r], np.uint64), ends)
    assert out.tolist() == [sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in r) > len(r)) for r in runs]
