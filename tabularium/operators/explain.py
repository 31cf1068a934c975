"""Feature importances as mean absolute Shapley values against a background sample."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabularium.functions.expressions import quoted, unused
from tabularium.functions.ship import ship
from tabularium.functions.storage import dealt, drop
from tabularium.operators.trees import Leaf

TOP = 10


def linear(rows: DataFrame, background: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(feature, importance) of a linear model, exactly: weight x (value - background's mean)."""
    means = background.agg(*[F.avg(quoted(c)).alias(c) for c in weights]).first()
    size = [F.struct(F.lit(c).alias("feature"), F.abs(F.lit(w) * (F.col(quoted(c)) - F.lit(means[c]))).alias("phi")) for c, w in weights.items()]
    return rows.select(F.explode(F.array(*size)).alias("x")).groupBy("x.feature").agg(F.avg("x.phi").alias("importance"))


def exact(rows: DataFrame, background: DataFrame, features: Sequence[str], predict: Callable[[DataFrame], DataFrame], row_id: str) -> DataFrame:
    """(feature, importance) of any model, from all coalitions of at most ten features: a coalition's value is the mean prediction over the background rows.

    ``rows`` and ``background`` are at most some hundred rows each; the background is a literal. ``predict`` adds ``score``.
    """
    k = len(features)
    if k > 10:
        raise ValueError("all coalitions of more than ten features are too many; use sampled()")
    values = lambda df: F.array(*[F.col(quoted(c)).cast("double") for c in features])
    pool = [list(r[0]) for r in background.select(values(background)).collect()]  # some hundred rows
    others = F.array(*[F.array(*map(F.lit, x)) for x in pool])
    mixed = rows.select(F.col(row_id).alias("__row"), values(rows).alias("own")).withColumn("other", F.explode(others)).withColumn("members", F.explode(F.sequence(F.lit(0), F.lit(2**k - 1))))
    cells = [F.when(F.col("members").bitwiseAND(1 << j) > 0, F.col("own")[j]).otherwise(F.col("other")[j]).alias(c) for j, c in enumerate(features)]
    scored = predict(mixed.select("__row", "members", *cells)).groupBy("__row", "members").agg(F.avg("score").alias("v"))
    weight = [math.factorial(n) * math.factorial(k - n - 1) / math.factorial(k) for n in range(k)]  # of a feature that joins n others
    of_size = lambda w: F.element_at(F.array(*map(F.lit, w)), F.bit_count("members").cast("int") + 1)
    joined, left = of_size([0.0, *weight]), of_size([*weight, 0.0])
    parts = [F.struct(F.lit(c).alias("feature"), F.when(F.col("members").bitwiseAND(1 << j) > 0, joined * F.col("v")).otherwise(-left * F.col("v")).alias("phi")) for j, c in enumerate(features)]
    phi = scored.select("__row", F.explode(F.array(*parts)).alias("x")).groupBy("__row", "x.feature").agg(F.sum("x.phi").alias("phi"))
    return phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("importance"))


def _matrices(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            yield np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in range(n)])


def _values(df: DataFrame, features: Sequence[str], fill: dict[str, float], *more: Column) -> DataFrame:
    return df.select(*[F.coalesce(F.col(quoted(c)).cast("double"), F.lit(fill.get(c, math.nan))).alias(f"f{k}") for k, c in enumerate(features)], *more)


def _leaf_weights(leaf: Leaf, counts: dict[int, int], total: int) -> np.ndarray:
    """By the set of the leaf's features whose conditions a row meets, as bits: the share of each of these features in the row's prediction.

    Against a background row, the leaf is reached by those mixtures that take the features that only the row meets from it, and
    those that only the background row meets from there. ``counts`` has the background's rows by their sets.
    """
    m = len(leaf.conditions)
    out = np.zeros((1 << m, m))
    full = (1 << m) - 1
    for own in range(1 << m):
        for other, n in counts.items():
            if own | other != full:
                continue
            for_row, against = own & ~other, other & ~own
            a, b = for_row.bit_count(), against.bit_count()
            for k in range(m):
                if for_row >> k & 1:
                    out[own, k] += n * math.factorial(a - 1) * math.factorial(b) / math.factorial(a + b)
                elif against >> k & 1:
                    out[own, k] -= n * math.factorial(a) * math.factorial(b - 1) / math.factorial(a + b)
    return out * leaf.value / max(1, total)


def _met(x: np.ndarray, leaf: Leaf) -> np.ndarray:
    """The set of the leaf's features whose conditions each row meets, as bits."""
    out = np.zeros(len(x), np.int64)
    for k, condition in enumerate(leaf.conditions):
        out |= condition.holds(x[:, condition.feature]).astype(np.int64) << k
    return out


def _merged(df: DataFrame, leaves: Sequence[Leaf], features: Sequence[str], fill: dict[str, float], name: str) -> DataFrame:
    """(f0, f1, ..., n): a row for each combination of what the leaves tell apart, with the number of rows that have it.

    A number becomes the next threshold of its feature, infinity behind the last one, as does NaN; a feature that no leaf asks for becomes 0, and one whose levels are
    compared stays. So the combinations are of the model's size, unless there are fewer rows.
    """
    asked: list[list] = [[t for leaf in leaves for t in leaf.conditions if t.feature == k] for k in range(len(features))]
    ends = [np.array(sorted({v for t in own for v in (t.low, t.high) if abs(v) < math.inf}) + [math.inf]) for own in asked]

    def upto(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _matrices(batches, len(features)):
            columns = [x[:, k] if any(t.but for t in own) else e[np.minimum(np.searchsorted(e, x[:, k], "left"), len(e) - 1)] if own else np.zeros(len(x)) for k, (own, e) in enumerate(zip(asked, ends))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f"f{k}" for k in range(len(features))])

    ship(df.sparkSession)
    names = [f"f{k}" for k in range(len(features))]
    found = _values(df, features, fill).mapInArrow(upto, ", ".join(f"{c} double" for c in names))
    return dealt(found.groupBy(*names).agg(F.count(F.lit(1)).alias("n")), name)


def _tree_weights(background: DataFrame, leaves: Sequence[Leaf], features: Sequence[str], fill: dict[str, float]) -> list[np.ndarray]:
    """``_leaf_weights`` of every leaf. Background rows are merged, then counted by (leaf, set), so their number is not limited; the counts are of the model's size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], int] = {}
        for x in _matrices(batches, len(features) + 1):
            for j, leaf in enumerate(leaves):
                times = np.bincount(_met(x, leaf), x[:, -1])
                for bits in np.flatnonzero(times):
                    found[j, int(bits)] = found.get((j, int(bits)), 0) + int(times[bits])
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.int64()), pa.array(list(found.values()), pa.int64())], names=["leaf", "bits", "n"])

    counts: list[dict[int, int]] = [{} for _ in leaves]
    merged = _merged(background, leaves, features, fill, "background")
    for j, bits, n in merged.mapInArrow(count, "leaf int, bits long, n long").groupBy("leaf", "bits").agg(F.sum("n")).collect():  # leaves x sets
        counts[j][bits] = n
    drop(merged)
    return [_leaf_weights(leaf, c, sum(c.values())) for leaf, c in zip(leaves, counts)]


def tree_shap(rows: DataFrame, background: DataFrame, leaves: Sequence[Leaf], features: Sequence[str], row_id: str, fill: dict[str, float] | None = None) -> DataFrame:
    """(row, output, feature, phi): exact Shapley values of a sum of trees, given by their leaves, for all rows against all background rows.

    One pass counts the background rows by the conditions that they meet at each leaf, the other looks the rows' sets up, so the cost is rows x leaves
    however many features and background rows there are. ``fill`` has the values of nulls. Only features that a tree asks for have rows, and
    contributions of 0 are left out.
    """
    ship(rows.sparkSession)
    fill = fill or {}
    weights = _tree_weights(background, leaves, features, fill)
    used = sorted({t.feature for leaf in leaves for t in leaf.conditions})
    outputs = sorted({leaf.output for leaf in leaves})
    place = {(o, f): k for k, (o, f) in enumerate((o, f) for o in outputs for f in used)}

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in _matrices([batch], len(features)):
                phi = np.zeros((len(x), len(place)))
                for leaf, weight in zip(leaves, weights):
                    if leaf.conditions:
                        phi[:, [place[leaf.output, t.feature] for t in leaf.conditions]] += weight[_met(x, leaf)]
                at, k = np.nonzero(phi)
                keys = list(place)
                ids = batch.column(len(features)).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([ids, pa.array([keys[i][0] for i in k], pa.int32()), pa.array([features[keys[i][1]] for i in k], pa.string()), pa.array(phi[at, k])], names=["row", "output", "feature", "phi"])

    kind = rows.schema[row_id].dataType.simpleString()
    return _values(rows, features, fill, F.col(quoted(row_id)).alias("row")).mapInArrow(explain, f"row {kind}, output int, feature string, phi double")


def tree_importances(rows: DataFrame, background: DataFrame, leaves: Sequence[Leaf], features: Sequence[str], row_id: str, fill: dict[str, float] | None = None) -> DataFrame:
    """(feature, importance) of a sum of trees: mean absolute Shapley values over the rows and outputs. Every feature has a row.

    Rows that no leaf tells apart are explained once and count as often as they are there.
    """
    names = [f"f{k}" for k in range(len(features))]
    merged = _merged(rows, leaves, features, fill or {}, "explained")
    n = (merged.agg(F.sum("n")).first()[0] or 0) * max(1, len({leaf.output for leaf in leaves}))
    known = merged.select(*[F.col(f).alias(c) for f, c in zip(names, features)], F.col("n").alias(unused("n", features)))
    summed = tree_shap(known, background, leaves, features, unused("n", features), fill).groupBy("feature").agg(F.sum(F.abs("phi") * F.col("row")).alias("total"))
    names = rows.sparkSession.createDataFrame([(c,) for c in features], "feature string")
    return names.join(summed, "feature", "left").select("feature", (F.coalesce("total", F.lit(0.0)) / F.lit(float(max(1, n)))).alias("importance"))


def sampled(rows: DataFrame, background: DataFrame, features: Sequence[str], predict: Callable[[DataFrame], DataFrame], row_id: str, permutations: int = 4, seed: int = 0) -> DataFrame:
    """(feature, importance) of any model, by sampled permutations.

    Along a permutation features change one by one from a background row's value to the explained row's; a feature's share is the
    change in the prediction when it is its turn. Every prefix of every (row, permutation) is a row of one table that
    the model scores once. ``rows`` and ``background`` are at most some hundred rows each; ``predict`` adds ``score``.
    """
    rng = random.Random(seed)
    orders = [rng.sample(range(len(features)), len(features)) for _ in range(permutations)]
    turns = F.array(*[F.struct(F.lit(k).alias("perm"), F.array(*[F.lit(o.index(f)) for f in range(len(features))]).alias("turn")) for k, o in enumerate(orders)])
    vector = lambda df, out: df.select(row_id, F.array(*[F.col(quoted(c)).cast("double") for c in features]).alias(out))
    pool = vector(background, "other").withColumn("slot", F.row_number().over(Window.orderBy(row_id)) - 1).drop(row_id)
    size = pool.count()
    if not size:
        return rows.sparkSession.createDataFrame([], "feature string, importance double")
    drawn = vector(rows, "own").withColumn("x", F.explode(turns)).select(row_id, "own", "x.perm", "x.turn").withColumn("slot", F.pmod(F.xxhash64(F.lit(seed), F.col(row_id), F.col("perm")), F.lit(size)).cast("int"))
    coalitions = drawn.join(pool, "slot").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(len(features)))))
    mixed = [F.when(F.col("turn")[k] < F.col("step"), F.col("own")[k]).otherwise(F.col("other")[k]).alias(c) for k, c in enumerate(features)]
    scored = predict(coalitions.select(F.col(row_id).alias("__row"), "perm", "step", "turn", *mixed)).select("__row", "perm", "step", "turn", "score")
    change = F.col("score") - F.lag("score").over(Window.partitionBy("__row", "perm").orderBy("step"))
    moved = scored.withColumn("change", change).where("step > 0").withColumn("k", F.array_position("turn", F.col("step") - 1) - 1)
    phi = moved.groupBy("__row", "k").agg(F.avg("change").alias("phi"))
    names = F.array(*[F.lit(c) for c in features])
    return phi.groupBy("k").agg(F.avg(F.abs("phi")).alias("importance")).select(F.element_at(names, (F.col("k") + 1).cast("int")).alias("feature"), "importance")


def top(importances: DataFrame, features: Sequence[str], n: int = TOP) -> DataFrame:
    """(rank, feature, importance) of the ``n`` largest, at 5 digits; of equals the earlier feature comes first."""
    place = F.array_position(F.array(*[F.lit(c) for c in features]), F.col("feature"))
    best = importances.orderBy(F.desc("importance"), place).limit(n)
    rank = F.row_number().over(Window.orderBy(F.desc("importance"), place))
    return best.select(rank.alias("rank"), "feature", F.round("importance", 5).alias("importance"))


def by_source(importances: DataFrame, source: dict[str, str]) -> DataFrame:
    """Importances summed over the features that come from the same column."""
    known = F.create_map(*[F.lit(x) for pair in source.items() for x in pair])
    named = importances.withColumn("feature", F.coalesce(F.element_at(known, F.col("feature")), F.col("feature")))
    return named.groupBy("feature").agg(F.sum("importance").alias("importance"))


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of doubles; 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a) * dot(b, b))
    return dot(a, b) / F.when(size == 0, F.lit(1e-9)).otherwise(size)


#: Vectors and queries that a task compares at most, about; and similarities that it holds at once.
VECTORS, QUERIES, HELD = 1 << 15, 1 << 12, 1 << 22


def _top_of_block(vectors: pa.Table, queries: pa.Table, n: int) -> pa.Table:
    """(query, id, sim): the ``n`` most similar vectors of a block to each of its queries, of equals the least ids."""

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        return x, np.einsum("ij,ij->i", x, x)

    if not (vectors.num_rows and queries.num_rows):
        return pa.table({"query": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
    vectors = vectors.sort_by("id")
    (v, v2), (q, q2) = matrix(vectors), matrix(queries)
    rows, places, found = [], [], []
    step = max(1, HELD // max(1, len(v)))
    for a in range(0, len(q), step):
        size = np.sqrt(v2[:, None] * q2[None, a : a + step])
        sim = np.round((v @ q[a : a + step].T) / np.where(size == 0, 1e-9, size), 12)
        least = np.partition(sim, len(v) - n, axis=0)[len(v) - n] if len(v) > n else np.full(sim.shape[1], -np.inf)
        for k in range(sim.shape[1]):
            near = np.flatnonzero(sim[:, k] >= least[k])
            near = near[np.argsort(-sim[near, k], kind="stable")[:n]]
            rows += [a + k] * len(near)
            places.append(near)
            found.append(sim[near, k])
    ids = vectors.column("id").take(pa.array(np.concatenate(places) if places else np.zeros(0, np.int64)))
    return pa.table({"query": queries.column("id").take(pa.array(rows, pa.int64())), "id": ids, "sim": pa.array(np.concatenate(found) if found else np.zeros(0))})


def nearest(vectors: DataFrame, queries: DataFrame, n: int = TOP, id_col: str = "vec_id", vector: str = "embedding", most: tuple[int, int] = (VECTORS, QUERIES)) -> DataFrame:
    """(query, id, sim, rank): of every row of ``queries`` the ``n`` rows of ``vectors`` that are most similar to it, itself included, of equals the least id.

    Vectors and queries are dealt to blocks of about ``most`` rows, and every block of queries meets every block of vectors: as matrix products in
    tasks, each of which holds two blocks and sends ``n`` rows a query. Similarities are compared at 12 digits. A row without a vector, or with a
    missing number in it, is left out; vectors meet those of their own length only. Ids are whole numbers.
    """
    ship(vectors.sparkSession)

    def kept(df: DataFrame) -> DataFrame:
        own = df.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(vector)).cast("array<double>").alias("v"))
        return own.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull())).withColumn("dims", F.size("v"))

    vectors, queries = kept(vectors), kept(queries)
    blocks = [max(1, math.ceil(df.count() / k)) for df, k in zip((vectors, queries), most)]
    number = lambda k: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks[k])).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(blocks[k] - 1)))
    left = vectors.withColumn("a", number(0)).withColumn("b", every(1))
    right = queries.withColumn("b", number(1)).withColumn("a", every(0))
    keys = ("dims", "a", "b")
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda v, q: _top_of_block(v, q, n), "query long, id long, sim double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= n)
