"""Exact evaluation of predictions as aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabularium.functions.storage import drop, materialise


def confusion(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """(y, p, n) for every pair of labels in y or p, 0 where there are no rows."""
    counts = df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    labels = counts.agg(F.array_union(F.collect_set("y"), F.collect_set("p")).alias("labels"))  # labels are few
    grid = labels.select("labels", F.explode("labels").alias("y")).select("y", F.explode("labels").alias("p"))
    return grid.join(counts, ["y", "p"], "left").select("y", "p", F.coalesce("n", F.lit(0)).alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _f1(precision: Column, recall: Column) -> Column:
    return _ratio(2 * precision * recall, precision + recall)


def per_label(cells: DataFrame) -> DataFrame:
    """(label, precision, recall, f1) from a confusion matrix; 0 where a ratio has no rows."""
    side = lambda c: cells.groupBy(F.col(c).alias("label")).agg(F.sum("n").alias(f"n_{c}"))
    right = cells.where("y = p").select(F.col("y").alias("label"), F.col("n").alias("tp"))
    found = side("y").join(side("p"), "label").join(right, "label")
    found = found.withColumn("precision", _ratio(F.col("tp"), F.col("n_p"))).withColumn("recall", _ratio(F.col("tp"), F.col("n_y")))
    return found.select("label", "precision", "recall", _f1(F.col("precision"), F.col("recall")).alias("f1"))


def binary_metrics(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """One row: accuracy, precision, recall and f1 of class 1."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    one_y, one_p = F.col(y) == 1, F.col(p) == 1
    row = df.agg(count(F.col(y) == F.col(p)).alias("same"), F.count(F.lit(1)).alias("n"), count(one_y & one_p).alias("tp"), count(one_p).alias("pp"), count(one_y).alias("py"))
    row = row.select(_ratio(F.col("same"), F.col("n")).alias("accuracy"), _ratio(F.col("tp"), F.col("pp")).alias("precision"), _ratio(F.col("tp"), F.col("py")).alias("recall"))
    return row.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def macro_metrics(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """One row: accuracy, and the means of the labels' precision, recall and f1."""
    cells = confusion(df, y, p)
    same = F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0))
    parts = per_label(cells).unionByName(cells.agg(same.alias("same"), F.sum("n").alias("n_all")), allowMissingColumns=True)
    return parts.agg(_ratio(F.max("same"), F.max("n_all")).alias("accuracy"), *[F.avg(m).alias(m) for m in ("precision", "recall", "f1")])


#: Distinct scores that a range holds on average, at most.
RANGE_SCORES = 1 << 18


def roc_auc(df: DataFrame, y: str = "y", score: str = "score", range_scores: int = RANGE_SCORES) -> DataFrame:
    """One row: the area under the curve by rank sums, ties counted half, null unless both classes are there.

    Rows are counted by score first, and the counts are written once. Spark deals them to ranges of scores; ranks are running sums inside a range plus the counts of
    the ranges below, which are joined, a row for each range: exact, and no task holds all scores.
    """
    counted = df.groupBy(F.col(score).cast("double").alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("pos"))
    by_score = materialise(counted, "scores")
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(by_score.count() / range_scores))
    ranged = materialise(by_score.repartitionByRange(ranges, "s").withColumn("range", F.spark_partition_id()), "score-ranges")
    drop(by_score)
    sizes = ranged.groupBy("range").agg(F.sum("n").alias("size"))
    below = sizes.select("range", F.coalesce(F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"))
    inside = Window.partitionBy("range").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranged.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(below, "range")
    ranked = ranked.withColumn("rank", F.col("below") + F.col("inside") + (F.col("n") + 1) / 2.0)
    sums = ranked.agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").cast("double").alias("p"), F.sum("n").cast("double").alias("n"))
    area = (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))
    return sums.select(F.when((F.col("p") > 0) & (F.col("p") < F.col("n")), area).alias("roc_auc"))


def fold_accuracy(df: DataFrame, fold: str = "fold", y: str = "y", p: str = "p") -> DataFrame:
    """One row: mean and population deviation of the folds' accuracies."""
    by_fold = df.groupBy(fold).agg(F.avg(F.when(F.col(y) == F.col(p), 1.0).otherwise(0.0)).alias("accuracy"))
    return by_fold.agg(F.avg("accuracy").alias("cv_mean"), F.stddev_pop("accuracy").alias("cv_std"))


def evaluate(df: DataFrame, n_classes: int, y: str = "y", p: str = "p", score: str = "score") -> dict:
    """The metrics of a run, at 4 digits. The area is null unless there are two classes."""
    found = (binary_metrics if n_classes == 2 else macro_metrics)(df, y, p).first().asDict()
    out = {k: round(v, 4) if v is not None else None for k, v in found.items()}
    area = roc_auc(df, y, score).first()[0] if n_classes == 2 else None
    out["roc_auc"] = None if area is None else round(area, 4)
    cells = sorted(map(tuple, confusion(df, y, p).collect()))  # labels x labels
    labels = sorted({a for a, _, _ in cells})
    out["confusion_matrix"] = [[n for a, _, n in cells if a == label] for label in labels]
    return out
