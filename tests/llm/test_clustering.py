import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabularium.llm import clustering


def brute(rows, k=40, rounds=5):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept row, by all pairs of whole numbers."""
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in order[:k]]
    if not centroids:
        return []

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        label = [nearest(v)[1] for _, v in kept]
        for c in range(len(centroids)):
            own = [v for (_, v), n in zip(kept, label) if n == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own)]
    found = [nearest(v) for _, v in kept]
    total = sum(d for d, _ in found)
    by = {c: sum(d for d, n in found if n == c) for c in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, n, d, by[n], total, digest[n]) for (i, _), (d, n) in zip(kept, found)]


def compared(spark, tmp_path, rows, extra=""):
    spark.createDataFrame([(*r, *([0] * (2 if extra else 0))) for r in rows], f"vec_id long, embedding array<float>{extra}").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    out = clustering.op12_centroid_clustering(spark, str(tmp_path)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    held = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, brute(held)))


def vectors(n, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, 64))
    return [(k, [float(x) for x in centre[k % 6] + spread * rng.normal(size=64)]) for k in range(n)]


def test_as_by_brute_force(spark, tmp_path):
    odd = [(900, None), (901, []), (902, [1.0] * 63), (903, [None] + [1.0] * 63), (904, [float("nan")] * 64), (905, [float("inf")] * 64), (None, [0.5] * 64), (None, None), (7, [0.25] * 64), (7, [-0.25] * 64), (7, [-0.25] * 64)]
    compared(spark, tmp_path, vectors(150, 1) + odd, extra=", v int, block int")


def test_ties_and_copies(spark, tmp_path):
    compared(spark, tmp_path, [(k, [float(k % 3)] * 64) for k in range(120)] + [(500 + k, [1.0] * 64) for k in range(60)])


def test_fewer_vectors_than_centroids_and_none(spark, tmp_path):
    compared(spark, tmp_path / "a", vectors(9, 2))
    compared(spark, tmp_path / "b", [])
    compared(spark, tmp_path / "c", [(None, [1.0] * 64), (3, [1.0])])


def test_large_components_are_exact_or_an_error(spark, tmp_path):
    compared(spark, tmp_path / "a", [(k, [200_000.0 + 16 * k] * 32 + [-200_000.0] * 32) for k in range(60)])
    with pytest.raises(Exception, match="too large"):
        compared(spark, tmp_path / "b", [(1, [1e30] * 64)])


def test_blocks_change_nothing(spark):
    df = spark.createDataFrame(vectors(300, 4), "vec_id long, embedding array<float>").withColumn("x", F.lit(1))
    results = []
    for size in (1 << 20, 17):
        found, centroids = clustering.lloyd(df, size=size)
        results.append((sorted(map(tuple, found.collect())), centroids.tolist()))
    assert results[0] == results[1]


def test_cover_tree_covers_and_separates():
    points = np.array([[int(256 * x) for x in v] for _, v in vectors(500, 5)])
    tree = clustering.cover_tree(points, leaf=4)
    assert sorted(tree.order) == list(range(500)) and (tree.points == points[tree.order]).all()
    for (a, b, child, n, centre), radius in zip(tree.nodes, tree.radius):
        gap = np.sqrt(((tree.points[a:b] - tree.points[centre]) ** 2).sum(axis=1))
        assert gap.max() <= radius + 1e-9
        if n:
            own = tree.nodes[child : child + n]
            assert own[0][0] == a and own[-1][1] == b and all(x[1] == y[0] for x, y in zip(own, own[1:]))
            reach = 2.0 ** (np.ceil(np.log2(radius)) - 1)
            centres = tree.points[np.unique(own[:, 4])]
            apart = [np.linalg.norm(x - y) for k, x in enumerate(centres) for y in centres[:k]]
            assert not apart or min(apart) > reach


def test_pairs_of_nodes_are_pruned():
    points = np.array([[int(256 * x) for x in v] for _, v in vectors(600, 6)])
    centroids = points[:40]
    counts = {}
    tree = clustering.cover_tree(points)
    label = clustering.assign(tree, centroids, clustering.cover_tree(centroids, clustering.CENTROID_LEAF), counts)
    assert (label == clustering.squared(tree.points, centroids).argmin(axis=1)).all()
    assert counts["compared"] < 0.3 * counts["all"]
