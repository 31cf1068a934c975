import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabularium.operators import explain, model
from tabularium.operators.trees import Split, leaves

SF = "/root/testdata/sf0.001"
NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_partkey", "l_suppkey", "day")


def lines(spark):
    df = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("day", F.dayofyear("l_shipdate"))
    score = F.col("l_quantity") * (1 + F.col("l_discount") * 10) + F.col("l_linenumber") * 3 + F.col("day") / 20
    return df.select(F.monotonically_increasing_id().alias("id"), *[F.col(c).cast("double").alias(c) for c in NUMBERS], (score > 52).cast("int").alias("y"))


def margins(booster, x):
    """The trees' outputs of rows of numbers, by their leaves."""
    out = {}
    for leaf in booster.leaves():
        met = np.ones(len(x), bool)
        for c in leaf.conditions:
            met &= c.holds(x[:, c.feature])
        out[leaf.output] = out.get(leaf.output, 0) + leaf.value * met
    return out


def test_shapley_values_of_a_fitted_model_are_those_of_all_coalitions(spark):
    df = lines(spark)
    booster = model.fit(df, NUMBERS, trees=6)
    rows, pool = df.orderBy("id").limit(12), df.orderBy(F.desc("id")).limit(15)
    margin = lambda d: booster.score(d).withColumn("score", F.log(F.col("score") / (1 - F.col("score"))))
    want = {r.feature: r.importance for r in explain.exact(rows, pool, NUMBERS, margin, "id").collect()}
    got = {r.feature: r.importance for r in explain.tree_importances(rows, pool, booster.leaves(), NUMBERS, "id").collect()}
    assert set(got) == set(want) == set(NUMBERS) and max(want.values()) > 0.1
    assert all(abs(got[c] - want[c]) < 1e-6 for c in NUMBERS)


def test_leaves_give_the_scores_and_values_add_up(spark):
    df = lines(spark)
    booster = model.fit(df, NUMBERS, trees=3)
    rows = booster.score(df.limit(300)).collect()
    x = np.array([[r[c] for c in NUMBERS] for r in rows])
    (margin,) = margins(booster, x).values()
    assert np.allclose(1 / (1 + np.exp(-margin)), [r.score for r in rows])
    phi = {r.row: r.total for r in explain.tree_shap(df.limit(300), df, booster.leaves(), NUMBERS, "id").groupBy("row").agg(F.sum("phi").alias("total")).collect()}
    every = np.array([[r[c] for c in NUMBERS] for r in df.collect()])
    mean = next(iter(margins(booster, every).values())).mean()
    assert np.allclose([phi.get(r.id, 0.0) for r in rows], margin - mean)


def test_many_features_and_all_rows(spark):
    df = lines(spark).select("id", "y", *NUMBERS, *[F.rand(k).alias(f"noise {k}.x") for k in range(59)])
    names = [c for c in df.columns if c not in ("id", "y")]
    assert len(names) == 67
    booster = model.fit(df, [c for c in names], trees=3)
    found = {r.feature: r.importance for r in explain.tree_importances(df, df, booster.leaves(), names, "id").collect()}
    assert len(found) == 67 and max(found, key=found.get) == "l_quantity"


def test_classes_levels_and_missing_values(spark):
    df = spark.range(300).select("id", (F.col("id") % 3).cast("int").alias("y"), F.when(F.col("id") % 10 != 0, (F.col("id") % 6).cast("double")).alias("level"), (F.col("id") / 10).alias("number"))
    booster = model.fit(df, ["level", "number"], n_classes=3, trees=4, wide={"level": 6})
    rows = booster.score(df).collect()
    x = np.array([[6.0 if r.level is None else r.level, r.number] for r in rows])
    by_class = margins(booster, x)
    assert len(by_class) == 3 and [int(k) for k in np.argmax([by_class[k] for k in range(3)], axis=0)] == [r.p for r in rows]
    found = {r.feature: r.importance for r in explain.tree_importances(df, df, booster.leaves(), ["level", "number"], "id", {"level": 6.0}).collect()}
    assert found["level"] > found["number"] >= 0
    none = spark.createDataFrame([], df.schema)
    assert {r.importance for r in explain.tree_importances(none, df, booster.leaves(), ["level", "number"], "id").collect()} == {0.0}
    assert explain.tree_shap(df, none, booster.leaves(), ["level", "number"], "id").count() == 0


@pytest.mark.parametrize("value, reached", [(1.0, 0), (1.5, 1), (2.0, 1), (2.5, 2), (math.nan, 2), (math.inf, 2), (-math.inf, 0)])
def test_conditions(value, reached):
    ends = leaves(Split(0, Split(0, 0.0, 1.0, 1.0), 2.0, 2.0))
    assert [leaf.value for leaf in ends if all(c.holds(np.array([value]))[0] for c in leaf.conditions)] == [reached]


def test_rows_with_the_same_bins_are_fitted_as_one(spark):
    df = lines(spark)
    many = df.select("*", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("copy"))
    edges = model.bin_edges(df, NUMBERS[:5])
    merged = [model._merged(d, NUMBERS[:5], {}, edges, "y") for d in (df, many)]
    assert merged[0].count() == merged[1].count() and merged[1].agg(F.sum("__n")).first()[0] == 5 * df.count()
    one, five = (model.Booster(model._fitted(m, NUMBERS[:5], 2, 3), list(NUMBERS[:5]), 2, {}, edges) for m in merged)
    assert [(x.value, x.conditions) for x in one.leaves()] == [(pytest.approx(x.value), x.conditions) for x in five.leaves()]
    assert all(math.isinf(c.high) or c.high in edges[NUMBERS[c.feature]] for leaf in one.leaves() for c in leaf.conditions)


def test_bins_of_few_and_of_many_values(spark):
    df = spark.range(1000).select((F.col("id") % 3 + F.when(F.col("id") == 5, 0.5).otherwise(0)).alias("few"), F.when(F.col("id") > 0, F.col("id").cast("double")).alias("many"), F.lit(1.0).alias("one"), F.when(F.col("id") > 9, 2.0).alias("gaps"))
    edges = model.bin_edges(df, df.columns)
    assert edges["few"].tolist() == [0, 1, 2] and 28 <= len(edges["many"]) <= 31 and not len(edges["one"]) and edges["gaps"].tolist() == [2.0]
    found = model._binned(df, {f"b{k}": c for k, c in enumerate(df.columns)}, edges).orderBy("many").collect()
    assert [(r.b0, r.b2) for r in found[1:6]] == [(1, 0), (2, 0), (0, 0), (1, 0), (3, 0)] and {r.b3 for r in found} == {0, 1}
    assert found[0].many is None and found[0].b1 == len(edges["many"]) and all(r.b1 == (edges["many"] < r.many).sum() for r in found[1:])
