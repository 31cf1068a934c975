import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabularium.operators import boosting, explain, split
from tabularium.plans.pipeline import Pipeline, Run

SF = "/root/testdata/sf0.001"
NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lines") / "t")
    df = spark.read.parquet(f"{SF}/lineitem.parquet")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    columns = [F.when((F.col("l_orderkey") % 11 != 0) | (F.lit(c) == "l_discount"), F.col(c).cast("double")).alias(c) for c in NUMBERS]
    df.select(F.monotonically_increasing_id().alias("row"), *columns, (price > 40_000).cast("int").alias("y"), F.when(price < 20_000, 0).when(price < 60_000, 1).otherwise(2).alias("z"), (F.col("l_orderkey") % 5).cast("int").alias("fold")).write.parquet(path)
    return spark.read.parquet(path)


def as_lists(fitted, model=0):
    return [[(t.feature.tolist(), t.bin.tolist(), t.value.tolist()) for t in by_output] for by_output in fitted.made[model]]


def brute_root(x, y, edges):
    """The best split (gain, feature, bin) of all rows, by trying each."""
    p = (sum(y) + 1) / (len(y) + 2)
    g, h = p - y, np.full(len(y), p * (1 - p))
    part = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + boosting.L2)
    best = (0, 0, 0)
    for f, e in enumerate(edges):
        for b, upto in enumerate(e):
            left = x[:, f] <= upto
            if min(left.sum(), (~left).sum()) >= boosting.LEAST_ROWS:
                best = max(best, (part(left) + part(~left) - part(np.ones(len(y), bool)), -f, -b))
    return best


def test_first_split_as_by_brute_force(lines):
    edges = boosting.quantile_edges(lines, NUMBERS, 16)
    assert all(len(e) <= 15 and (np.diff(e) > 0).all() for e in edges)
    fitted = boosting.fit(lines, NUMBERS, rounds=1, held=0, edges=edges)
    rows = lines.collect()
    x, y = np.array([[math.nan if r[c] is None else r[c] for c in NUMBERS] for r in rows]), np.array([r.y for r in rows])
    gain, f, b = brute_root(x, y, edges)
    ((tree,),) = fitted.made[0]
    assert gain > 100 and (tree.feature[0], tree.bin[0]) == (-f, -b)


def test_trees_do_not_depend_on_how_rows_are_dealt(lines):
    edges = boosting.quantile_edges(lines, NUMBERS)
    one = boosting.fit(lines.coalesce(1), NUMBERS, "z", 3, rounds=3, edges=edges)
    many = boosting.fit(lines.repartition(7), NUMBERS, "z", 3, rounds=3, edges=edges)
    assert as_lists(one) == as_lists(many) and one.losses == many.losses and len(one.made[0]) == 3


def test_classes_stopping_and_held_out_accuracy(lines):
    train, test = lines.where("fold != 0"), lines.where("fold = 0")
    fitted = boosting.fit(train, NUMBERS, "z", 3)
    losses = fitted.losses[0]
    assert len(fitted.made[0]) == int(np.argmin(losses)) < len(losses) < 40
    assert min(losses[: -boosting.PATIENCE]) - min(losses) < boosting.LEAST_FALL
    rows = fitted.probabilities(test).collect()
    p = np.array([r.probabilities for r in rows])
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all()
    assert np.mean(p.argmax(axis=1) == [r.z for r in rows]) > 0.93
    assert fitted.score(test).where("p != array_position(array(0, 1, 2), p) - 1 or score is not null").count() == 0
    slow = boosting.fit(train, NUMBERS, "z", 3, budget=1.0, rounds=12)
    assert abs(slow.made[0][0][0].value[0]) < abs(fitted.made[0][0][0].value[0])


def test_leaves_give_the_probabilities_and_shapley_values_add_up(lines):
    fitted = boosting.fit(lines, NUMBERS, rounds=4)
    rows = fitted.probabilities(lines).collect()
    x = np.array([[math.nan if r[c] is None else r[c] for c in NUMBERS] for r in rows])
    margin = np.full(len(x), fitted.start[0])
    for leaf in fitted.leaves():
        margin += leaf.value * np.all([c.holds(x[:, c.feature]) for c in leaf.conditions], axis=0)
    assert np.allclose(1 / (1 + np.exp(-margin)), [r.probabilities[1] for r in rows])
    phi = {r.row: r.phi for r in explain.tree_shap(lines, lines, fitted.leaves(), NUMBERS, "row").groupBy("row").agg(F.sum("phi").alias("phi")).collect()}
    assert np.allclose([phi.get(r.row, 0.0) for r in rows], margin - margin.mean())


def test_models_of_folds_grow_together_and_apart(lines):
    edges = boosting.quantile_edges(lines, NUMBERS)
    uses = boosting.with_folds(F.col("fold") != 1, F.col("fold"), 5)
    together = boosting.fit(lines, NUMBERS, uses=uses, models=6, rounds=3, edges=edges)
    assert as_lists(together, 0) == as_lists(together, 2) != as_lists(together, 1)
    alone = boosting.fit(lines, NUMBERS, uses=F.when(F.col("fold") != 1, 1).otherwise(0), rounds=3, edges=edges)
    assert as_lists(alone) == as_lists(together, 0)
    found = boosting.fold_accuracy(together, lines, F.col("fold"))
    assert found["cv5_accuracy_mean"] > 0.9 and found["cv5_accuracy_std"] < 0.05


def test_outputs_that_are_written_on_the_way_change_nothing(lines, monkeypatch):
    edges = boosting.quantile_edges(lines, NUMBERS)
    plain = boosting.fit(lines, NUMBERS, rounds=4, edges=edges)
    monkeypatch.setattr(boosting, "KEPT", 1)
    assert as_lists(boosting.fit(lines, NUMBERS, rounds=4, edges=edges)) == as_lists(plain)


def test_nothing_to_learn(spark, lines):
    none = boosting.fit(lines.limit(0), NUMBERS)
    assert none.made == [[]] and none.score(lines.limit(3)).count() == 3
    flat = spark.range(100).select(F.col("id").alias("row"), F.lit(1.0).alias("a"), F.lit(None).cast("double").alias("b"), (F.col("id") % 2).cast("int").alias("y"))
    fitted = boosting.fit(flat, ["a", "b"])
    assert all((t.feature == -1).all() for by_output in fitted.made[0] for t in by_output)
    same = boosting.fit(flat.withColumn("y", F.lit(1)), ["a", "b"], rounds=3)
    assert same.score(flat).where("p != 1").count() == 0
    with pytest.raises(ValueError, match="256"):
        boosting.fit(flat, ["a"], bins=300)


def test_a_run_with_it(spark, lines, tmp_path):
    pipeline = Pipeline(spark, str(tmp_path), learner="boosting")
    state = Run(table=lines.select(*NUMBERS, F.when(F.col("y") == 1, "dear").otherwise("cheap").alias("y")), target="y", headers=[*NUMBERS, "y"], valid_headers=list(NUMBERS))
    for stage in (pipeline._recommend, pipeline._prepare, pipeline._infer):
        stage(state)
    assert state.metrics["accuracy"] > 0.93 and state.metrics["cv5_accuracy_mean"] > 0.93 and state.metrics["learner"] == boosting.LEARNER
    assert state.explanations["top10"] and state.metrics["roc_auc"] > 0.97
    with pytest.raises(ValueError, match="learner"):
        Pipeline(spark, learner="other")
    assert split.FOLDS == 5


def test_rows_with_the_same_bins_are_one_row(spark, lines):
    edges = boosting.quantile_edges(lines, NUMBERS)
    many = lines.select("*", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("copy"))
    rows = [boosting.binned(df, NUMBERS, edges, "y", F.lit(1), "row", [0.0], held=0) for df in (lines, many)]
    assert rows[0].count() == rows[1].count() <= lines.count()
    assert [df.agg(F.sum("n")).first()[0] for df in rows] == [lines.count(), 6 * lines.count()]
    one, six = (boosting.fit(df, NUMBERS, rounds=2, held=0, edges=edges) for df in (many, lines.join(spark.range(6))))
    assert as_lists(one) == as_lists(six)


def test_rows_are_merged_whatever_models_learn_from_them(spark, lines):
    edges = boosting.quantile_edges(lines, NUMBERS, 4)
    plain = boosting.binned(lines, NUMBERS, edges, "y", F.lit(1), "row", [0.0], held=0)
    uses = boosting.with_folds(F.col("fold") != 1, F.col("fold"), 5)
    found = boosting.binned(lines, NUMBERS, edges, "y", uses, "row", [0.0] * 6, models=6)
    assert found.count() == plain.count() < lines.count() / 2
    held = F.pmod(F.xxhash64("row"), F.lit(boosting.HELD)) == 0
    learn = [F.col("fold") != 1, *[F.col("fold") != k for k in range(5)]]
    want = lines.agg(*[F.count_if(c & (held == h)) for c in learn for h in (False, True)]).first()
    assert found.agg(*[F.sum(F.col("times")[k]) for k in range(12)]).first() == want
    fitted = boosting.fit(lines, NUMBERS, uses=uses, models=6, rounds=2, edges=edges)
    own = fitted.score(lines.select(*NUMBERS, "y", "fold"), F.col("fold") + 1).groupBy("fold").agg(F.avg((F.col("p") == F.col("y")).cast("double")).alias("a"))
    mean, deviation = own.agg(F.avg("a"), F.stddev_pop("a")).first()
    assert boosting.fold_accuracy(fitted, lines, F.col("fold")) == {"cv5_accuracy_mean": round(mean, 4), "cv5_accuracy_std": round(deviation, 4)}


def test_sums_too_large_for_doubles_are_exact():
    values = np.array([(1 << 52) + 1, 1 << 52, -3, (1 << 52) + 1], np.int64)
    assert boosting._summed(np.array([0, 0, 1, 0]), values, 2).tolist() == [3 * (1 << 52) + 2, -3]
    x = np.arange(12, dtype=np.float64).reshape(4, 3, 1)
    assert (boosting._unpacked(boosting._packed(x)[1:3], np.float64, 3, 1) == x[1:3]).all()


def test_rows_that_no_leaf_tells_apart_are_explained_once(spark, lines):
    fitted = boosting.fit(lines, NUMBERS, rounds=2, held=0)
    many = lines.select("*", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("copy"))
    merged = [explain._merged(df, fitted.leaves(), NUMBERS, {}, "merged") for df in (lines, many)]
    assert merged[0].count() == merged[1].count() < lines.count() / 2
    found = [{r.feature: round(r.importance, 9) for r in explain.tree_importances(df, lines, fitted.leaves(), NUMBERS, "row").collect()} for df in (lines, many)]
    assert found[0] == found[1] and max(found[0].values()) > 0
