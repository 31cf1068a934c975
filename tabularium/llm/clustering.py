"""Lloyd's clustering with two trees.

Vectors have whole components, so distances and means are exact. The first centroids are given by a hash of the ids.

1. Vectors are dealt once by the nearest of the first centroids, the pivots of the topmost level, and each pivot's rows to blocks of
   ``BLOCK`` at most on average. A task builds a cover tree over each block: a node's points are within its radius of its centre; its children's
   centres are more than half a power of two apart and cover it at that distance. Blocks with their trees are written once.
2. In every round a tree is built over the centroids, and each block's tree is walked with it. A pair of nodes is
   pruned when the lower bound of its distance exceeds the upper bound of the nearest centroid's, which holds for all
   points of the vectors' node; where one centroid is left, the node's points are its own without being compared. What is left
   at the leaves is compared exactly.
3. A task sums its vectors by centroid and sends one row for each; sums of all tasks are k rows of one vector each, which the driver
   divides exactly. Nothing that grows with the vectors goes to the driver: the centroids are k times 64 numbers, k a parameter.

Bounds are doubles with a margin; exact distances are whole numbers. Ties go to the smaller number.

Defined results: vectors that are null, of another length, or with a component that is null, NaN or infinite are left
out. Repeated rows count. A null id is kept, but is no first centroid; among equal ids the least vector comes first. With fewer
ids than k there are fewer centroids; with none, or an empty table, the result is empty. Components of 2**26 / 256 and
above are an error, as distances would not fit a long. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.llm.common import drop, materialise, small_batches, table, trimmed

DIMENSIONS = 64
CENTROIDS, ROUNDS = 40, 5
SCALE = 256
#: Components from here on are an error.
MOST = 1 << 26
#: Vectors of a block, on average at most, and points of a leaf.
BLOCK, LEAF = 1024, 24
CENTROID_LEAF = 3
#: Share by which a bound must be exceeded before a pair of nodes is pruned.
MARGIN = 1e-9


@dataclass
class Tree:
    """Points in the tree's order; nodes with the range of their points, first child and number of children, and centre; children are consecutive."""

    points: np.ndarray
    order: np.ndarray
    nodes: np.ndarray
    radius: np.ndarray

    @property
    def centre(self) -> np.ndarray:
        return self.points[self.nodes[:, 4]]


def _apart(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    gap = (points - centre).astype(np.float64)
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree over rows of whole numbers, of which there is one at least. Points that are alone in reach of themselves share a leaf around their parent's centre."""
    nodes: list[list[int]] = [[0, len(points), 0, 0, 0]]
    radius = [0.0]
    place = np.empty(len(points), np.int64)
    waiting = [(0, np.arange(len(points)), False)]
    while waiting:
        node, own, lonely = waiting.pop()
        start, centre = nodes[node][0], nodes[node][4]
        far = _apart(points[own], points[centre])
        radius[node] = float(far.max())
        if lonely or len(own) <= leaf or radius[node] == 0:
            place[start : start + len(own)] = own
            continue
        reach = 2.0 ** (math.ceil(math.log2(radius[node])) - 1)
        parts, alone, left = [(centre, own[far <= reach], False)], [], own[far > reach]
        while len(left):
            near = _apart(points[left], points[left[0]]) <= reach
            if near.sum() > 1:
                parts.append((int(left[0]), left[near], False))
            else:
                alone.append(left[0])
            left = left[~near]
        if alone:
            parts.append((centre, np.array(alone), True))
        nodes[node][2:4] = len(nodes), len(parts)
        for c, rows, single in parts:
            waiting.append((len(nodes), rows, single))
            nodes.append([start, start + len(rows), 0, 0, c])
            radius.append(0.0)
            start += len(rows)
    back = np.empty(len(points), np.int64)
    back[place] = np.arange(len(points))
    made = np.array(nodes, np.int64)
    made[:, 4] = back[made[:, 4]]
    return Tree(points[place], place, made, np.array(radius))


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole vectors."""
    most = max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0))
    if most < 1 << 22:  # all sums are below 2**53, so doubles are exact
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        return ((p * p).sum(axis=1)[:, None] - 2 * (p @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def assign(tree: Tree, centroids: np.ndarray, over: Tree, counts: dict | None = None) -> np.ndarray:
    """The nearest centroid of each of the tree's points, in its order; ``over`` is the tree over the centroids."""
    label = np.zeros(len(tree.points), np.int64)
    tops, centre = over.centre.astype(np.float64), tree.centre.astype(np.float64)
    waiting = [(0, np.array([0]))]
    compared = 0
    while waiting:
        node, open_ = waiting.pop()
        begin, end, child, children, _ = tree.nodes[node]
        r = tree.radius[node]
        while True:
            gap = np.sqrt(((tops[open_] - centre[node]) ** 2).sum(axis=1))
            near = gap.min() + r  # every node's centre is a centroid
            keep = gap - r - over.radius[open_] <= near * (1 + MARGIN) + MARGIN
            open_, inner = open_[keep], over.nodes[open_[keep], 3] > 0
            split = inner & (over.radius[open_] > r) if children else inner
            if not split.any():
                break
            grown = [np.arange(over.nodes[k, 2], over.nodes[k, 2] + over.nodes[k, 3]) for k in open_[split]]
            open_ = np.concatenate([open_[~split], *grown])
        rows = np.concatenate([over.order[over.nodes[k, 0] : over.nodes[k, 1]] for k in open_])
        if len(rows) == 1:
            label[begin:end] = rows[0]
        elif children:
            waiting += [(k, open_) for k in range(child, child + children)]
        else:
            rows.sort()
            compared += (end - begin) * len(rows)
            label[begin:end] = rows[squared(tree.points[begin:end], centroids[rows]).argmin(axis=1)]
    if counts is not None:
        counts["compared"] = counts.get("compared", 0) + int(compared)
        counts["all"] = counts.get("all", 0) + len(tree.points) * len(centroids)
    return label


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, v) of the rows that are kept."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    known = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where(F.size("v") == dimensions)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    fits = F.forall("v", lambda x: F.abs(x) < MOST // SCALE)
    checked = F.when(fits, F.transform("v", lambda x: F.floor(x * SCALE))).otherwise(F.raise_error("a vector's components are too large").cast("array<bigint>"))
    return known.where(finite).select("id", checked.alias("v"))


def first_centroids(rows: DataFrame, k: int) -> np.ndarray:
    """The vectors whose ids hash smallest, in the order of the hashes: k rows at most."""
    key = F.sha2(F.concat(F.lit("2:"), F.col("id").cast("string")), 256)
    best = rows.where("id is not null").select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    return np.array([r.v for r in best], np.int64)


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    values = batch.column("v").flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.int64).reshape(batch.num_rows, -1)


def _block_numbers(pivot: Column, n: dict[int, int], size: int) -> Column:
    """The row's block, numbered through all pivots."""
    first, firsts, counts = 0, [], []
    for p in range(max(n) + 1):
        blocks = max(1, -(-n.get(p, 0) // size))
        firsts.append(first)
        counts.append(blocks)
        first += blocks
    pick = lambda values: F.element_at(F.array(*[F.lit(x).cast("long") for x in values]), pivot + 1)
    return pick(firsts) + F.pmod(F.xxhash64("row"), pick(counts))


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block, from rows sorted by block."""

    def built(block: int, ids: list, vectors: list[np.ndarray]) -> pa.RecordBatch:
        tree = cover_tree(np.concatenate(vectors))
        ids = pa.chunked_array(ids).combine_chunks().take(pa.array(tree.order))
        arrays = [pa.array([block], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *[pa.array([x.tobytes()], pa.binary()) for x in (tree.points, tree.nodes, tree.radius)]]
        return pa.RecordBatch.from_arrays(arrays, names=["block", "ids", "points", "nodes", "radius"])

    now, ids, vectors = None, [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        blocks, own = batch.column("block").to_numpy(), _vectors(batch)
        edge = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
        for a, b in zip(edge, edge[1:]):
            if blocks[a] != now and now is not None:
                yield built(now, ids, vectors)
                ids, vectors = [], []
            now = int(blocks[a])
            ids.append(batch.column("id")[a:b])
            vectors.append(own[a:b])
    if now is not None:
        yield built(now, ids, vectors)


def _walk(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple[pa.Array, Tree, np.ndarray]]:
    over = cover_tree(centroids, CENTROID_LEAF)
    for batch in batches:
        for k in range(batch.num_rows):
            points, nodes = (np.frombuffer(batch.column(c)[k].as_buffer(), np.int64) for c in ("points", "nodes"))
            tree = Tree(points.reshape(-1, centroids.shape[1]), np.zeros(0), nodes.reshape(-1, 5), np.frombuffer(batch.column("radius")[k].as_buffer(), np.float64))
            yield batch.column("ids")[k].values, tree, assign(tree, centroids, over)


def _sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    n, total = np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
    for _, tree, label in _walk(batches, centroids):
        n += np.bincount(label, minlength=len(centroids))
        for c in np.unique(label):
            total[c] += tree.points[label == c].sum(axis=0)
    some = np.flatnonzero(n)
    width = centroids.shape[1]
    cells = [np.repeat(some, width), np.tile(np.arange(width), len(some)), np.repeat(n[some], width), total[some].ravel()]
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cells], names=["c", "d", "n", "total"])


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for ids, tree, label in _walk(batches, centroids):
        distance = ((tree.points - centroids[label]) ** 2).sum(axis=1)
        yield pa.RecordBatch.from_arrays([ids, pa.array(label, pa.int32()), pa.array(distance, pa.int64())], names=["id", "cluster", "distance"])


def blocks(rows: DataFrame, pivots: np.ndarray, size: int = BLOCK) -> DataFrame:
    """(block, ids, points, nodes, radius): the vectors of ``rows`` (id, v) with their cover trees, those near the same pivot together."""
    spark = rows.sparkSession

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot = squared(_vectors(batch), pivots).argmin(axis=1) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot, pa.int32())], names=["id", "v", "row", "pivot"])

    dealt = materialise(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(near, "id long, v array<long>, row long, pivot int"), "pivots")
    n = dict(dealt.groupBy("pivot").count().collect())  # a row for each pivot
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = dealt.select("id", "v", _block_numbers(F.col("pivot"), n, size).alias("block"))
    sorted_ = numbered.repartitionById(parts, F.pmod("block", F.lit(parts)).cast("int")).sortWithinPartitions("block")
    out = materialise(sorted_.mapInArrow(lambda it: trimmed(_trees(it)), "block long, ids array<long>, points binary, nodes binary, radius binary"), "trees")
    drop(dealt)
    return out


def lloyd(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, size: int = BLOCK) -> tuple[DataFrame | None, np.ndarray]:
    """The table (id, cluster, distance) of the vectors that are kept, and the centroids; no table without centroids."""
    small_batches(df.sparkSession)
    rows = materialise(whole_vectors(df, id_col, vector_col, dimensions), "vectors")
    centroids = first_centroids(rows, k)
    if not len(centroids):
        return None, centroids
    trees = blocks(rows, centroids, size)
    drop(rows)
    for _ in range(rounds):
        now = centroids
        sums = trees.select("ids", "points", "nodes", "radius").mapInArrow(lambda it: _sums(it, now), "c long, d long, n long, total long")
        centroids = now.copy()
        for c, d, n, total in sums.groupBy("c", "d").agg(F.sum("n"), F.sum("total")).collect():  # k times the dimensions
            centroids[c, d] = total // n
    last = centroids
    return trees.select("ids", "points", "nodes", "radius").mapInArrow(lambda it: _assigned(it, last), "id long, cluster int, distance long"), last


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


_RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = lloyd(table(spark, sf_dir, "embeddings"))
    if found is None:
        return spark.createDataFrame([], _RESULT)
    found = materialise(found, "clusters")
    inertia = dict(found.groupBy("cluster").agg(F.sum("distance")).collect())  # a row for each cluster
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    by_cluster = [F.lit(inertia.get(c, 0)).cast("long") for c in range(len(centroids))]
    return found.select(
        F.col("id").alias("vec_id"), "cluster", "distance", pick(by_cluster).alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), pick([centroid_digest(c) for c in centroids]).alias("centroid_sha256")
    )


def _sql() -> str:
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "x AS MATERIALIZED (SELECT r, unnest(range(1, len(v) + 1)) AS d, unnest(v) AS x FROM v)",
        f"s AS (SELECT v, row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)), v) - 1 AS c FROM v WHERE vec_id IS NOT NULL QUALIFY c < {CENTROIDS})",
        "c0 AS MATERIALIZED (SELECT c, unnest(range(1, len(v) + 1)) AS d, unnest(v) AS x FROM s)",
    ]
    for k in range(ROUNDS + 1):
        parts += [
            f"p{k} AS (SELECT r, c, CAST(sum((x.x - c.x) * (x.x - c.x)) AS BIGINT) AS distance FROM x JOIN c{k} c USING (d) GROUP BY r, c)",
            f"a{k} AS MATERIALIZED (SELECT r, arg_min(c, (distance, c)) AS c, min(distance) AS distance FROM p{k} GROUP BY r)",
            f"m{k} AS (SELECT c, d, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{k} USING (r) GROUP BY c, d)",
            f"c{k + 1} AS MATERIALIZED (SELECT c, d, coalesce((s - ((s % n) + n) % n) // n, c.x) AS x FROM c{k} c LEFT JOIN m{k} USING (c, d))",
        ]
    last = f"SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS digest FROM c{ROUNDS} GROUP BY c"
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, digest AS centroid_sha256
FROM a{ROUNDS} a JOIN v USING (r) JOIN ({last}) l ON l.c = a.c"""  # fmt: skip


SQL = _sql()
