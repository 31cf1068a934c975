"""Gradient boosting over histograms: one ensemble for all classes, several models in one pass, and rounds that stop by themselves.

1. Features become numbers of bins between quantiles, which approximate sketches give in one pass over all features. Rows with the same bins and class are one
   row from there on, with their number for each model and part: their outputs stay the same, so sums over them are the same whole numbers. They are written once.
2. In a level of a round every task adds up first and second derivatives by (model, class, node, feature, bin) and sends one row for each cell; the rest is
   a grouping, running sums over bins and a maximum, so only the best split of each node reaches the driver. Derivatives are whole numbers of 2**-30,
   so sums, and with them the trees, do not depend on how rows are dealt.
3. Models that differ by the rows they learn from, such as those of a cross-validation, grow together: ``uses`` has a bit for each model.
4. Two classes have one output with a logistic loss; more have one each with the softmax loss.
5. Some rows, by a hash, are held out of every model to tell when its loss stops falling: ``budget`` sets the step to 10 ** -budget, and a model ends where its
   held-out loss was least once ``PATIENCE`` rounds have lowered it by less than ``LEAST_FALL``. Without held-out rows the loss of the learning rows decides.
6. Outputs of the trees so far are written every ``KEPT`` rounds; in between a task adds the few trees since.

Missing numbers go right at every split, as do numbers above all bins. Driver and messages hold cells of the model's size, never rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabularium.functions.expressions import quoted
from tabularium.functions.ship import ship
from tabularium.functions.storage import dealt, drop, materialise
from tabularium.operators import trees
from tabularium.operators.trees import Leaf, Split

LEARNER = "gradient boosting over histograms"
BINS, DEPTH, BUDGET = 64, 4, 0.5
ROUNDS, PATIENCE, KEPT = 200, 5, 10
#: By how much a model's loss, in nats a row, must have fallen in ``PATIENCE`` rounds for it to go on.
LEAST_FALL = 1e-3
#: Added to a node's second derivatives, and least rows on either side of a split.
L2, LEAST_ROWS = 1.0, 5
#: One in so many rows is held out.
HELD = 10
UNIT = float(1 << 30)


@dataclass
class Tree:
    """A full binary tree: node k has the children 2k + 1 and 2k + 2; a feature of -1 ends it."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    @property
    def depth(self) -> int:
        return int(math.log2(len(self.feature) + 1)) - 1

    @staticmethod
    def empty(depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return Tree(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n))

    def nodes(self, codes: np.ndarray, levels: int) -> np.ndarray:
        """The node that each row is in after some levels."""
        at, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
        for _ in range(levels):
            own = self.feature[at]
            right = codes[rows, np.maximum(own, 0)] > self.bin[at]
            at = np.where(own >= 0, 2 * at + 1 + right, at)
        return at

    def split(self, edges: Sequence[np.ndarray], k: int = 0) -> Split | float:
        f = int(self.feature[k])
        if f < 0:
            return float(self.value[k])
        return Split(f, self.split(edges, 2 * k + 1), self.split(edges, 2 * k + 2), float(edges[f][self.bin[k]]))


def quantile_edges(df: DataFrame, features: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """The upper ends of the bins of each feature but for its last one, from mergeable sketches with a rank error of a quarter of a bin."""
    points = [k / bins for k in range(1, bins)]
    found = df.select(*[F.col(quoted(c)).cast("double").alias(f"f{k}") for k, c in enumerate(features)]).approxQuantile([f"f{k}" for k in range(len(features))], points, 0.25 / bins) if features else []
    return [np.unique(np.array([x for x in q if not math.isnan(x)], np.float64)) for q in found]


def codes(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """The bin of each number: how many edges are below it."""
    return np.column_stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)]).astype(np.uint8) if len(edges) else np.zeros((len(x), 0), np.uint8)


def _numbers(batch: pa.RecordBatch, n: int) -> np.ndarray:
    return np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in range(n)]) if n else np.zeros((batch.num_rows, 0))


def _packed(x: np.ndarray) -> pa.Array:
    """The bytes of each row of numbers."""
    width = x.dtype.itemsize * int(np.prod(x.shape[1:]))
    ends = np.arange(0, width * len(x) + 1, width, dtype=np.int32) if width else np.zeros(len(x) + 1, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def _unpacked(column: pa.Array, kind: type, *shape: int) -> np.ndarray:
    """The numbers whose bytes each row has."""
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    own = data.slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes() if data is not None else b""
    return np.frombuffer(own, kind).reshape(len(column), *shape)


def _coded(df: DataFrame, features: Sequence[str], edges: Sequence[np.ndarray], *own: Column) -> DataFrame:
    """``own`` columns, which have names, and ``codes``, the bytes of the bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            packed = _packed(codes(_numbers(batch, len(features)), edges))
            yield pa.RecordBatch.from_arrays([*batch.columns[len(features) :], packed], names=names)

    ship(df.sparkSession)
    numbers = [F.coalesce(F.col(quoted(c)).cast("double"), F.lit(math.nan)).alias(f"f{k}") for k, c in enumerate(features)]
    rows = df.select(*numbers, *own)
    kept = rows.schema.fields[len(features) :]
    names = [*[f.name for f in kept], "codes"]
    return rows.mapInArrow(run, ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in kept], "codes binary"]))


def binned(df: DataFrame, features: Sequence[str], edges: Sequence[np.ndarray], y: str, uses: Column, row_id: str, start: Sequence[float], held: int = HELD, models: int = 1) -> DataFrame:
    """(y, codes, n, times, margins): binned rows, ``n`` equal ones as one, of them for each model those that it learns from and those held out, the outputs of all models at their start."""
    first = np.array(start, np.float64).tobytes()
    out = F.pmod(F.xxhash64(F.col(quoted(row_id))), F.lit(held)) == 0 if held else F.lit(False)
    rows = _coded(df, features, edges, F.col(quoted(y)).cast("int").alias("y"), uses.cast("int").alias("uses"), out.alias("held"))
    parts = [F.count_if((F.col("uses").bitwiseAND(F.lit(1 << m)) != 0) & (F.col("held") == part)) for m in range(models) for part in (False, True)]
    found = rows.groupBy("y", "codes").agg(F.count(F.lit(1)).alias("n"), *[c.alias(f"t{k}") for k, c in enumerate(parts)])
    return found.select("y", "codes", "n", F.array(*[f"t{k}" for k in range(len(parts))]).alias("times"), F.lit(bytearray(first)).alias("margins"))


def derivatives(margins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, first and second derivatives, the latter by output. ``margins`` is rows x outputs."""
    if margins.shape[1] == 1:
        m = margins[:, 0]
        p = 1 / (1 + np.exp(-m))
        loss = np.logaddexp(0, m) - m * y
        return loss, (p - y)[:, None], (p * (1 - p))[:, None]
    top = margins.max(axis=1, keepdims=True)
    e = np.exp(margins - top)
    p = e / e.sum(axis=1, keepdims=True)
    hot = np.arange(margins.shape[1]) == y[:, None]
    return np.log(e.sum(axis=1)) + top[:, 0] - margins[np.arange(len(y)), y], p - hot, p * (1 - p)


@dataclass
class Growing:
    """The models while they grow: trees since the outputs were last written, those of the round, and which models still do."""

    models: int
    outputs: int
    edges: list[np.ndarray]
    since: list[list[list[Tree]]] = field(default_factory=list)
    now: list[list[Tree]] = field(default_factory=list)
    active: list[bool] = field(default_factory=list)

    def rows(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and outputs by (row, model, output)."""
        own = _unpacked(batch.column("codes"), np.uint8, len(self.edges))
        margins = _unpacked(batch.column("margins"), np.float64, self.models, self.outputs).copy()
        for made in self.since:
            for m, by_output in enumerate(made):
                for k, tree in enumerate(by_output):
                    margins[:, m, k] += tree.value[tree.nodes(own, tree.depth)]
        return own, margins


def _summed(cell: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Whole numbers summed up by cell, exactly: in halves if they are too large for doubles."""
    if np.abs(values.astype(np.float64)).sum() < 2.0**52:
        return np.bincount(cell, values, size).astype(np.int64)
    low, high = values & ((1 << 30) - 1), values >> 30
    return (np.bincount(cell, high, size).astype(np.int64) << 30) + np.bincount(cell, low, size).astype(np.int64)


_CELLS = "model int, output int, node int, feature int, bin int, g long, h long, n long"


def _cells(batches: Iterator[pa.RecordBatch], growing: Growing, level: int) -> Iterator[pa.RecordBatch]:
    """Sums by (model, output, node of the level, feature, bin); at the first level also the losses, at node -1: bin 1 of held-out rows, 0 of others."""
    n_features, width, nodes = len(growing.edges), max([1, *[len(e) + 1 for e in growing.edges]]), 2**level
    sums = np.zeros((growing.models, growing.outputs, 3, nodes * n_features * width), np.int64)
    losses = np.zeros((growing.models, 2, 2), np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        own, margins = growing.rows(batch)
        y = batch.column("y").to_numpy(zero_copy_only=False)
        parts = batch.column("times").flatten().to_numpy(zero_copy_only=False).reshape(len(y), growing.models, 2)
        for m in range(growing.models):
            if not growing.active[m]:
                continue
            loss, g, h = derivatives(margins[:, m], y)
            if level == 0:
                for k in range(2):
                    losses[m, k] += (np.rint(loss * UNIT).astype(np.int64) * parts[:, m, k]).sum(), parts[:, m, k].sum()
            times = parts[:, m, 0]
            learn = np.flatnonzero(times)
            for k in range(growing.outputs):
                node = growing.now[m][k].nodes(own[learn], level) - (nodes - 1)
                there = node >= 0  # others ended above
                rows, node = learn[there], node[there]
                cell = ((node[:, None] * n_features + np.arange(n_features)) * width + own[rows]).ravel()
                for j, value in enumerate((np.rint(g[rows, k] * UNIT).astype(np.int64), np.rint(h[rows, k] * UNIT).astype(np.int64), 1)):
                    sums[m, k, j] += _summed(cell, np.repeat(value * times[rows], n_features), sums.shape[-1])
    m, k, cell = np.nonzero(sums[:, :, 2])
    node, rest = np.divmod(cell, n_features * width)
    feature, bin_ = np.divmod(rest, width)
    columns = [m, k, node, feature, bin_, *(sums[m, k, j, cell] for j in range(3))]
    if level == 0:
        lm, lk = np.nonzero(losses[:, :, 1])
        extra = [lm, np.full(len(lm), -1), np.full(len(lm), -1), np.zeros(len(lm)), lk, losses[lm, lk, 0], np.zeros(len(lm)), losses[lm, lk, 1]]
        columns = [np.concatenate([a, b]) for a, b in zip(columns, extra)]
    kinds = [pa.int32()] * 5 + [pa.int64()] * 3
    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)).cast(t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in _CELLS.split(", ")])


def cells(rows: DataFrame, growing: Growing, level: int) -> DataFrame:
    """Sums of all tasks. They are dealt by feature once, for these sums and for those over bins; a task has summed up its rows by cell already."""
    parts = rows.mapInArrow(lambda it: _cells(it, growing, level), _CELLS).repartition("model", "output", "node", "feature")
    return parts.groupBy("model", "output", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])


def gains(found: DataFrame, l2: float = L2, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Adds to the sums by bin those of all bins up to it (gl, hl, nl) and of the node (gt, ht, nt), as doubles, and the gain of a split behind the bin, null if a side has too few rows."""
    by_feature = Window.partitionBy("model", "output", "node", "feature")
    upto = by_feature.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {f"{c}l": F.sum(c).over(upto) for c in "ghn"} | {f"{c}t": F.sum(c).over(by_feature) for c in "ghn"}
    rows = found.withColumns(sums).withColumns({c: F.col(c) / F.lit(UNIT) for c in ("gl", "hl", "gt", "ht")})
    part = lambda g, h: g * g / (h + F.lit(l2))
    gain = part(F.col("gl"), F.col("hl")) + part(F.col("gt") - F.col("gl"), F.col("ht") - F.col("hl")) - part(F.col("gt"), F.col("ht"))
    enough = (F.col("nl") >= least_rows) & (F.col("nt") - F.col("nl") >= least_rows)
    return rows.withColumn("gain", F.when(enough, gain))


def _best(found: DataFrame) -> list:
    """The best split of each node: the largest gain, then the first feature and bin. And the losses."""
    order = F.struct(F.coalesce("gain", F.lit(-1.0)).alias("gain"), (-F.col("feature")).alias("feature"), (-F.col("bin")).alias("bin"), "gl", "hl", "nl", "gt", "ht", "nt", "g", "n")
    split = gains(found).groupBy("model", "output", "node", F.when(F.col("node") < 0, F.col("bin")).alias("of")).agg(F.max(order).alias("best"))
    return split.select("model", "output", "node", "of", "best.*").collect()  # models x outputs x nodes of a level


@dataclass
class Boosted:
    """Fitted models over the same features."""

    features: list[str]
    edges: list[np.ndarray]
    start: np.ndarray
    made: list[list[list[Tree]]]
    losses: list[list[float]]
    n_classes: int

    def leaves(self, model: int = 0) -> list[Leaf]:
        """The leaves of a model's trees; an output's values sum up to its log-odds, but for the start."""
        return [leaf for by_output in self.made[model] for k, tree in enumerate(by_output) for leaf in trees.leaves(tree.split(self.edges), 1.0, k)]

    def shares(self, own: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The probabilities by (row, class) of rows of bins, each from the model that ``which`` numbers."""
        margins = np.repeat(self.start[None, :], len(own), axis=0)
        for m in np.unique(which):
            rows = np.flatnonzero(which == m)
            for by_output in self.made[m]:
                for k, tree in enumerate(by_output):
                    margins[rows, k] += tree.value[tree.nodes(own[rows], tree.depth)]
        return _shares(margins)

    def probabilities(self, df: DataFrame, model: Column | None = None) -> DataFrame:
        """Adds ``probabilities``, an array with a number for each class, from the model that ``model`` numbers, the first by default."""
        names = df.columns
        n = len(self.features)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = codes(_numbers(batch, n), self.edges) if batch.num_rows else np.zeros((0, n), np.uint8)
                p = self.shares(own, batch.column(n).to_numpy(zero_copy_only=False))
                ends = pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32))
                kept = batch.columns[n + 1 :]
                yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(ends, pa.array(p.ravel()))], names=[*[f"c{k}" for k in range(len(kept))], "probabilities"])

        ship(df.sparkSession)
        numbers = [F.coalesce(F.col(quoted(c)).cast("double"), F.lit(math.nan)).alias(f"f{k}") for k, c in enumerate(self.features)]
        own = [F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(names)]
        rows = df.select(*numbers, (F.lit(0) if model is None else model).cast("int").alias("which"), *own)
        kind = ", ".join([*[f"c{k} {df.schema[c].dataType.simpleString()}" for k, c in enumerate(names)], "probabilities array<double>"])
        return rows.mapInArrow(run, kind).select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], "probabilities")

    def score(self, df: DataFrame, model: Column | None = None) -> DataFrame:
        """Adds p, the class, and score, the probability of class 1 (null with more than two classes)."""
        found = self.probabilities(df, model)
        best = F.array_position("probabilities", F.array_max("probabilities")) - 1
        if self.n_classes > 2:
            return found.withColumns({"p": best.cast("int"), "score": F.lit(None).cast("double")}).drop("probabilities")
        return found.withColumns({"p": (F.col("probabilities")[1] >= 0.5).cast("int"), "score": F.col("probabilities")[1]}).drop("probabilities")


def _shares(margins: np.ndarray) -> np.ndarray:
    if margins.shape[1] == 1:
        p = 1 / (1 + np.exp(-margins))
        return np.concatenate([1 - p, p], axis=1)
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def start_of(df: DataFrame, y: str, n_classes: int) -> np.ndarray:
    """Outputs that give every class its share of the rows, from one class added to each."""
    counts = {int(k): n for k, n in df.groupBy(y).count().collect()}  # a row for each class
    n = np.array([counts.get(k, 0) + 1.0 for k in range(max(2, n_classes))])
    return np.array([math.log(n[1] / n[0])]) if n_classes <= 2 else np.log(n / n.sum())


def fit(df: DataFrame, features: Sequence[str], y: str = "y", n_classes: int = 2, row_id: str = "row", uses: Column | None = None, models: int = 1, budget: float = BUDGET, rounds: int = ROUNDS, depth: int = DEPTH, bins: int = BINS, held: int = HELD, edges: list[np.ndarray] | None = None) -> Boosted:
    """Fits ``models`` models; ``uses`` has a bit for each model that a row belongs to, by default all. Classes are 0, 1, ... in ``y``."""
    if bins > 256:
        raise ValueError("there are 256 bins at most")
    edges = quantile_edges(df, features, bins) if edges is None else edges
    start, step = start_of(df, y, n_classes), 10.0**-budget
    rows = dealt(binned(df, features, edges, y, F.lit((1 << models) - 1) if uses is None else uses, row_id, np.tile(start, models), held, models), "binned")
    growing = Growing(models, len(start), edges, active=[True] * models)
    made: list[list[list[Tree]]] = [[] for _ in range(models)]
    losses: list[list[float]] = [[] for _ in range(models)]
    for r in range(rounds + 1):
        growing.now = [[Tree.empty(depth) for _ in start] for _ in range(models)]
        for level in range(depth):
            best = _best(cells(rows, growing, level))
            if level == 0:
                _judge(best, losses, growing)
                if r == rounds or not any(growing.active):
                    break
            if not _grow(best, growing, level, step):
                break
        if r == rounds or not any(growing.active):
            break
        growing.since.append(growing.now)
        for m in range(models):
            if growing.active[m]:
                made[m].append(growing.now[m])
        if len(growing.since) == KEPT:
            rows = _written(rows, growing)
    drop(rows)
    ends = [int(np.argmin(x)) if x else 0 for x in losses]  # the loss of n trees is at place n
    return Boosted(list(features), edges, start, [m[:n] for m, n in zip(made, ends)], losses, n_classes)


def _judge(best: list, losses: list[list[float]], growing: Growing) -> None:
    """Notes each model's loss, of held-out rows if there are any, and stops those whose loss falls no more."""
    for m in range(growing.models):
        if not growing.active[m]:
            continue
        own = {r.of: r.g / UNIT / max(1, r.n) for r in best if r.node < 0 and r.model == m}
        losses[m].append(own.get(1, own.get(0, 0.0)))
        before, lately = losses[m][:-PATIENCE], losses[m][-PATIENCE:]
        growing.active[m] = bool(own) and (not before or min(before) - min(lately) >= LEAST_FALL)


def _grow(best: list, growing: Growing, level: int, step: float) -> bool:
    """Splits the nodes of a level; whether any was."""
    some = False
    for r in best:
        if r.node < 0:
            continue
        tree, k = growing.now[r.model][r.output], 2**level - 1 + r.node
        if level == 0:
            tree.value[0] = -step * r.gt / (r.ht + L2)
        if r.gain <= 0:
            continue
        some = True
        tree.feature[k], tree.bin[k] = -r.feature, -r.bin
        tree.value[2 * k + 1] = -step * r.gl / (r.hl + L2)
        tree.value[2 * k + 2] = -step * (r.gt - r.gl) / (r.ht - r.hl + L2)
    return some


def _written(rows: DataFrame, growing: Growing) -> DataFrame:
    """The rows with the outputs of all trees so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("y", "codes", "n", "times")] + [_packed(growing.rows(batch)[1])], names=["y", "codes", "n", "times", "margins"])

    out = materialise(rows.mapInArrow(run, "y int, codes binary, n long, times array<long>, margins binary"), "binned")
    drop(rows)
    growing.since = []
    return out


def with_folds(train: Column, fold: Column, folds: int) -> Column:
    """For ``uses``: the first model learns from ``train``, each other one from all folds but its own."""
    bits = F.when(train, F.lit(1)).otherwise(F.lit(0))
    for k in range(folds):
        bits = bits + F.when(fold != k, F.lit(2 << k)).otherwise(F.lit(0))
    return bits


def fold_accuracy(models: Boosted, df: DataFrame, fold: Column, y: str = "y") -> dict:
    """Mean and population deviation of the folds' accuracies, each row scored by the model that did not learn from its fold. Rows with the same bins, class and fold are scored once."""
    rows = _coded(df, models.features, models.edges, F.col(quoted(y)).alias("y"), fold.cast("int").alias("fold")).groupBy("y", "fold", "codes").agg(F.count(F.lit(1)).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p = models.shares(_unpacked(batch.column("codes"), np.uint8, len(models.edges)), batch.column("fold").to_numpy(zero_copy_only=False) + 1)
            best = p.argmax(axis=1) if models.n_classes > 2 else p[:, 1] >= 0.5
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("y", "fold", "n")), pa.array(best.astype(np.int32))], names=["y", "fold", "n", "p"])

    scored = rows.select("y", "fold", "n", "codes").mapInArrow(run, f"y {rows.schema['y'].dataType.simpleString()}, fold int, n long, p int").where("y is not null")
    by_fold = scored.groupBy("fold").agg((F.sum(F.when(F.col("p") == F.col("y"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    row = by_fold.agg(F.avg("accuracy"), F.stddev_pop("accuracy")).first()
    return {"cv5_accuracy_mean": round(row[0], 4), "cv5_accuracy_std": round(row[1], 4)}
