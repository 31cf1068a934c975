"""Fits a gradient-boosted classifier, predicts and cross-validates.

Numbers become those of bins before Spark ML sees them: each value of a feature with few of them, else between quantiles of all rows. Rows with the same bins and
class are one row with a weight from there on, so a fit's passes and what a task of it holds are bounded by the bins rather than by the rows. Missing numbers are in the
last bin.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np

from pyspark.ml.base import Model as SparkModel
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularium.functions.expressions import logistic, quoted
from tabularium.functions.storage import dealt, drop
from tabularium.operators import trees
from tabularium.operators.trees import Leaf

#: Bins of a feature, as Spark ML takes by default.
BINS = 32
LEARNER = "Spark ML gradient-boosted trees"


@dataclass
class Booster:
    """A fitted model and the features that it takes, in order."""

    model: SparkModel
    features: list[str]
    n_classes: int
    wide: dict[str, int] = field(default_factory=dict)
    edges: dict[str, np.ndarray] = field(default_factory=dict)

    def score(self, df: DataFrame) -> DataFrame:
        """Adds score, the probability of class 1 (with more classes, of the predicted one), and p, the class."""
        plain = {c: f"__c{k}" for k, c in enumerate(df.columns)}  # as some models cannot take every name
        rows = df.toDF(*plain.values())
        names = [f"__b{k}" for k in range(len(self.features))]
        rows = _binned(rows, {n: plain[c] for n, c in zip(names, self.features)}, {plain[c]: e for c, e in self.edges.items()})
        rows = _assembled(rows, names, {n: self.wide[c] for n, c in zip(names, self.features) if c in self.wide})
        found = self.model.transform(rows)
        if self.n_classes > 2:
            p, score = F.col("prediction").cast("int"), F.lit(None).cast("double")
        else:
            score = vector_to_array("probability")[1]
            p = decided(score)
        return found.select(*[F.col(n).alias(c) for c, n in plain.items()], p.alias("p"), score.alias("score"))

    def leaves(self) -> list[Leaf]:
        """The leaves of all trees; a class's values sum up to its log-odds. With two classes there is one output."""
        slots = trees.Slots(self.features, self.wide, self.edges)
        models = self.model.models if self.n_classes > 2 else [self.model]
        return [leaf for output, m in enumerate(models) for tree, weight in zip(m.trees, m.treeWeights) for leaf in trees.leaves(trees.of_spark(tree, slots), 2 * weight, output)]


def bin_edges(df: DataFrame, features: Sequence[str], bins: int = BINS) -> dict[str, np.ndarray]:
    """The upper ends of the bins of each feature but for its last one: its values if there are ``bins`` at most, else quantiles of all rows."""
    from tabularium.operators.boosting import quantile_edges

    if not features:
        return {}
    numbers = df.select(*[F.col(quoted(c)).cast("double").alias(f"f{k}") for k, c in enumerate(features)])
    sizes = numbers.agg(*[F.approx_count_distinct(c).alias(c) for c in numbers.columns]).first()
    few = [c for c in numbers.columns if sizes[c] <= 2 * bins]
    values = numbers.agg(*[F.collect_set(F.when(~F.isnan(c), F.col(c))).alias(c) for c in few]).first().asDict() if few else {}
    found = {c: np.unique(np.array(v, np.float64) + 0.0) for c, v in values.items() if len(v) <= bins}  # -0.0 is 0.0
    missing = numbers.agg(*[F.max(F.col(c).isNull() | F.isnan(c)).alias(c) for c in found]).first() if found else {}
    found = {c: v if missing[c] and len(v) < bins else v[:-1] for c, v in found.items()}
    many = [c for c in numbers.columns if c not in found]
    found |= dict(zip(many, quantile_edges(numbers, many, bins)))
    return {c: found[f"f{k}"][found[f"f{k}"] < np.inf] for k, c in enumerate(features)}


def _binned(df: DataFrame, names: dict[str, str], edges: dict[str, np.ndarray]) -> DataFrame:
    """Adds for each name the number of the bin of its feature, how many edges are below; features without edges stay as they are."""
    own = {n: F.col(quoted(c)).cast("double") for n, c in names.items()}
    cut = [n for n, c in names.items() if len(edges.get(c, ()))]
    rows = df.withColumns({n: F.coalesce(own[n], F.lit(float("nan"))) if n in cut else F.lit(0.0) if c in edges else own[n] for n, c in names.items()})
    if not cut:
        return rows
    ends = {n: [-np.inf, *np.nextafter(edges[names[n]], np.inf), np.inf] for n in cut}
    binner = Bucketizer(inputCols=cut, outputCols=[f"{n}i" for n in cut], splitsArray=[list(map(float, e)) for e in ends.values()], handleInvalid="keep")
    found = binner.transform(rows)
    last = {n: F.least(F.col(f"{n}i"), F.lit(float(len(ends[n]) - 2))) for n in cut}
    return found.select(*[F.col(quoted(c)) for c in df.columns], *[last[n].alias(n) if n in cut else F.col(n) for n in names])


def _merged(df: DataFrame, features: Sequence[str], wide: dict[str, int], edges: dict[str, np.ndarray], y: str, *by: str) -> DataFrame:
    """The features under their names as numbers of bins, the class and ``by``: a row for each that there is, with ``__n``, the number of rows. Written to the shared folder."""
    names = {f"__b{k}": c for k, c in enumerate(features)}
    rows = _binned(df.select(*[F.col(quoted(c)) for c in features], F.col(quoted(y)).alias("__y"), *[F.col(quoted(c)).alias(f"__by{k}") for k, c in enumerate(by)]), names, edges)
    keys = [*names, "__y", *[f"__by{k}" for k in range(len(by))]]
    return dealt(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")), "merged")


def _assembled(df: DataFrame, features: Sequence[str], wide: dict[str, int] | None = None) -> DataFrame:
    """Adds the vector of ``features``. Those in ``wide`` hold numbers of levels and become sparse vectors of that size; null has no level."""
    from pyspark.ml.feature import OneHotEncoder

    names = [f"__f{k}" for k in range(len(features))]
    wide = wide or {}
    named = df.withColumns({n: F.coalesce(F.col(quoted(c)), F.lit(wide[c])).cast("double") if c in wide else F.col(quoted(c)).cast("double") for n, c in zip(names, features)})
    hot = {n: f"{n}h" for n, c in zip(names, features) if c in wide}
    if hot:
        sizes = df.sparkSession.createDataFrame([tuple(float(wide[c]) - 1 for c in features if c in wide)], ", ".join(f"{n} double" for n in hot))
        encoder = OneHotEncoder(inputCols=list(hot), outputCols=list(hot.values()), dropLast=True, handleInvalid="keep").fit(sizes)
        named = encoder.transform(named)
    return VectorAssembler(inputCols=[hot.get(n, n) for n in names], outputCol="__x", handleInvalid="keep").transform(named).drop(*names, *hot.values())


def decided(score: Column) -> Column:
    return (score >= 0.5).cast("int")


def raw_to_score(raw: Column, all_binary: bool) -> Column:
    """For models without probabilities: outputs that are 0 or 1 as they are, others through the logistic function."""
    return raw if all_binary else logistic(raw)


def fit(train: DataFrame, features: Sequence[str], y: str = "y", n_classes: int = 2, trees: int = 20, depth: int = 4, seed: int = 0, wide: dict[str, int] | None = None) -> Booster:
    """Boosted trees for two classes, one against the rest for more."""
    wide = dict(wide or {})
    edges = bin_edges(train, [c for c in features if c not in wide])
    merged = _merged(train, features, wide, edges, y)
    fitted = Booster(_fitted(merged, features, n_classes, trees, depth, seed, wide), list(features), n_classes, wide, edges)
    drop(merged)
    return fitted


def _fitted(merged: DataFrame, features: Sequence[str], n_classes: int, trees: int = 20, depth: int = 4, seed: int = 0, wide: dict[str, int] | None = None) -> SparkModel:
    from pyspark.ml.classification import GBTClassifier, OneVsRest

    names = {f"__b{k}": c for k, c in enumerate(features)}
    booster = GBTClassifier(featuresCol="__x", labelCol="__y", weightCol="__w", maxBins=BINS, maxIter=trees, maxDepth=depth, stepSize=0.1, seed=seed)
    rows = _assembled(merged, list(names), {n: wide[c] for n, c in names.items() if c in (wide or {})})
    if n_classes > 2:
        booster = OneVsRest(classifier=booster, featuresCol="__x", labelCol="__y", weightCol="__w")
    return booster.fit(rows.select("__x", F.col("__y").cast("double").alias("__y"), F.col("__n").cast("double").alias("__w")))


def cross_validate(df: DataFrame, features: Sequence[str], fold: str = "fold", y: str = "y", n_classes: int = 2, parallel: int = 2, **options) -> dict:
    """Mean and population deviation of the folds' accuracies, each model fitted on the other folds; a failure becomes a note.

    The folds' models take bins of the same ends, which come from the features of all rows, so rows are merged once, by fold; merged rows are scored for all that they stand for.
    """
    wide, names = dict(options.get("wide") or {}), {f"__b{k}": c for k, c in enumerate(features)}

    def accuracy(k: int) -> float:
        booster = _fitted(merged.where(F.col("__by0") != k), features, n_classes, **options)
        own = merged.where(F.col("__by0") == k)
        scored = Booster(booster, list(names), n_classes, {n: wide[c] for n, c in names.items() if c in wide}).score(own)
        return scored.agg(F.sum(F.when(F.col("__y") == F.col("p"), F.col("__n")).otherwise(0)) / F.sum("__n")).first()[0]

    try:
        merged = _merged(df, features, wide, bin_edges(df, [c for c in features if c not in wide]), y, fold)
        folds = [r[0] for r in merged.select("__by0").distinct().orderBy("__by0").collect()]
        with ThreadPoolExecutor(parallel) as pool:
            found = list(pool.map(accuracy, folds))
        drop(merged)
        mean = sum(found) / len(found)
        return {"cv5_accuracy_mean": round(mean, 4), "cv5_accuracy_std": round((sum((x - mean) ** 2 for x in found) / len(found)) ** 0.5, 4)}
    except Exception as error:
        return {"cv5_accuracy_mean": None, "cv_note": str(error)}
