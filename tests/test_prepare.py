import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabularium.functions.expressions import text_to_number
from tabularium.operators import explain, metrics, model, prepare, profile, split, target


def types(df, **kinds):
    found = {r.column: r.type for r in profile.typed(profile.profile(df)).collect()}
    return {c: found[c] for c in kinds} == kinds or found


def test_types(spark):
    n = 100
    rows = [(k % 2, "MF"[k % 2], k, k % 20, k % 21, "x" * 25, "y" * 26 + str(k % 3), None, None, f"name {k}", float("nan") if k % 2 else 1.0) for k in range(n)]
    df = spark.createDataFrame(rows, "a int, b string, c int, d int, e int, f string, g string, h string, i double, j string, k double")
    assert types(df, a="Binary", b="Binary", c="Numerical", d="Categorical", e="Numerical", f="Categorical", g="Textual", h="Textual", i="Categorical", j="Textual", k="Categorical") is True
    few = spark.createDataFrame([(min(k, 8),) for k in range(10)], "a int")
    assert types(few, a="Numerical") is True
    row = profile.profile(df, ["k"]).first()
    assert (row.n_rows, row.n_null, row.n_unique) == (100, 50, 1)
    assert profile.profile(df.limit(0), ["a"]).first().n_rows == 0


def test_numbers(spark):
    cases = {"1d": None, "1f": None, "0x10": None, "1_000": None, "True": None, "": None, "M": None, " 1 ": 1.0, "1e3": 1000.0, "inf": math.inf, "-Infinity": -math.inf, "nan": None, ".5": 0.5, "5.": 5.0, "+7": 7.0}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert dict(df.select("t", text_to_number(F.col("t"))).collect()) == cases


def test_imputation_and_encoding(spark):
    df = spark.createDataFrame([(1, 10, 10.0, "M", 2.0, None, "t"), (2, 2, 2.0, "F", 2.0, None, "t"), (3, 10, None, "M", 1.0, None, "t"), (4, 10, 10.0, None, 1.0, None, "t"), (5, 2, 10.0, "F", None, None, "t")], "id int, c int, d double, s string, m double, e string, t string")
    plan = prepare.fitted(df, {"c": "Categorical", "d": "Categorical", "s": "Binary", "m": "Numerical", "e": "Categorical", "t": "Textual"})
    out = prepare.applied(df, plan, keep=["id"]).orderBy("id")
    assert out.columns == ["id", "c_10", "c_2", "d_10.0", "d_2.0", "s", "m", "e_NA"]
    assert [tuple(r)[1:] for r in out.collect()] == [(1, 0, 1, 0, 0, 2.0, 1), (0, 1, 0, 1, 0, 2.0, 1), (1, 0, 1, 0, 0, 1.0, 1), (1, 0, 1, 0, 0, 1.0, 1), (0, 1, 1, 0, 0, 1.5, 1)]
    assert prepare.modes(df, {"x": F.col("m")}) == {"x": 1.0}
    gaps = prepare.marked(df.withColumn("c", F.when(F.col("id") != 1, F.col("c"))), {"c": 1})
    assert prepare.fitted(gaps, {"c": "Categorical"}).features == ["c_10.0", "c_2.0"]
    wide = prepare.fitted(df, {"c": "Categorical", "s": "Categorical"}, most_levels=1)
    assert wide.wide == {"c": 2, "s": 2} and wide.columns == ["c", "s"] and wide.features == ["c", "s"] and wide.n_features == 4
    assert [tuple(r) for r in prepare.applied(df, wide, keep=["id"]).orderBy("id").collect()] == [(1, 0, 1), (2, 1, 0), (3, 0, 1), (4, 0, 0), (5, 1, 0)]


def test_wide_columns_are_fitted_as_sparse_vectors(spark):
    df = spark.range(4000).select("id", F.concat(F.lit("k"), F.col("id") % 1300).alias("c"), (F.col("id") % 1300 < 650).cast("int").alias("y"))
    plan = prepare.fitted(df, {"c": "Categorical"})
    assert plan.wide == {"c": 1300} and plan.n_features == 1300 and plan.columns == ["c"] and plan.levels == {}
    rows = prepare.applied(df, plan, keep=["id", "y"])
    unseen = prepare.applied(df.withColumn("c", F.lit("new")), plan, keep=["id", "y"])
    assert unseen.where("c is not null").count() == 0
    vector = model._assembled(rows, plan.columns, plan.wide).orderBy("id").select("__x").first()[0]
    names = {r.level: r.number for r in plan.names("c").collect()}
    assert sorted(names.values()) == list(range(1300)) and sorted(names) == sorted(names, key=names.get)
    assert vector.size == 1300 and vector[names["k0"]] == 1.0
    booster = model.fit(rows, plan.columns, trees=2, wide=plan.wide)
    assert booster.score(unseen).count() == 4000


def test_medians_and_modes_of_many_values(spark, monkeypatch):
    monkeypatch.setattr(prepare, "FEW", 50)
    for n in (1, 2, 999, 1000, 6001):
        df = spark.range(n).select((F.pow(F.col("id") * 7919 % n, 3) - n).alias("a"), (F.col("id") % 7).cast("double").alias("b"), F.when(F.col("id") % 3 == 0, F.col("id") * 1.5).alias("c"), F.lit(None).cast("double").alias("d"), F.lit(5.0).alias("e"))
        want = df.agg(*[F.median(c).alias(c) for c in df.columns]).first().asDict()
        assert prepare.medians(df, {c: F.col(c) for c in df.columns}) == want
        want = df.agg(*[F.mode(c, True).alias(c) for c in df.columns]).first().asDict()
        assert prepare.modes(df, {c: F.col(c) for c in df.columns}) == want


def test_places_do_not_depend_on_ranges(spark):
    df = spark.range(3000).select("id", (F.col("id") % 3).alias("y"))
    few, many = (dict(split.placed(df, "y", "id", 1, "p", n=n).select("id", "p").collect()) for n in (1, 1 << 30))
    assert few == many and split.range_digits(1 << 30) > split.RANGE_DIGITS


def test_area_does_not_depend_on_ranges(spark):
    df = spark.range(4000).select((F.col("id") % 2).alias("y"), ((F.col("id") * 7919) % 3001).cast("double").alias("score"))
    assert metrics.roc_auc(df).first()[0] == pytest.approx(metrics.roc_auc(df, range_scores=100).first()[0], abs=1e-12)


@pytest.mark.parametrize("most", [(1 << 15, 1 << 12), (7, 3)])
def test_nearest_as_by_brute_force(spark, most):
    rng = random.Random(2)
    rows = [(k, [rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(3)]) for k in range(60)] + [(100, [0.0] * 3), (101, None), (102, [1.0, None, 2.0]), (103, [1.0, 2.0]), (104, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("dims", F.lit("x")).repartition(4)
    found = {}
    for r in explain.nearest(df, df.where("vec_id % 4 = 0"), 5, most=most).orderBy("query", "rank").collect():
        found.setdefault(r.query, []).append((r.id, r.sim))
    whole = {k: v for k, v in rows if v and None not in v}
    want = {}
    for q in (k for k in whole if k % 4 == 0):
        own = [(k, round(sum(a * b for a, b in zip(v, whole[q])) / (math.sqrt(sum(a * a for a in v) * sum(b * b for b in whole[q])) or 1e-9), 12)) for k, v in whole.items() if len(v) == len(whole[q])]
        want[q] = sorted(own, key=lambda x: (-x[1], x[0]))[:5]
    assert found == want and len(found[104]) == 2


def test_binary_texts_by_index(spark):
    df = spark.createDataFrame([(1, "M"), (2, "F"), (3, "M"), (4, None)], "id int, s string")
    plan = prepare.fitted(df, {"s": "Binary"}, binary_strings="index")
    assert [r.s for r in prepare.applied(df, plan, keep=["id"]).orderBy("id").collect()] == [1.0, 0.0, 1.0, 1.0]


def test_approximate_profile(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 2 == 0, F.col("id") % 10).alias("x"))
    rows = {r.column: r for r in profile.approximate(df).collect()}
    assert abs(rows["id"].n_unique - 5000) < 300 and (rows["x"].n_unique, rows["x"].n_null, rows["x"].n_rows) == (5, 2500, 5000)


def test_area_over_many_ranges(spark):
    df = spark.range(3000).select((F.col("id") % 3 == 0).cast("int").alias("y"), F.pmod(F.xxhash64("id"), F.lit(700)).cast("double").alias("score"))
    rows = df.collect()
    pos, neg = [r.score for r in rows if r.y], [r.score for r in rows if not r.y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert metrics.roc_auc(df).first()[0] == pytest.approx(want, abs=1e-12)


def test_impute_scope(spark):
    df = spark.createDataFrame([(1.0, True), (None, True), (9.0, False), (9.0, False)], "x double, train boolean")
    assert prepare.fitted(df, {"x": "Numerical"}).fill == {"x": 9.0}
    assert prepare.fitted(df, {"x": "Numerical"}, F.col("train")).fill == {"x": 1.0}


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0, True), (2.0, 5.0, True), (3.0, 5.0, True), (9.0, 6.0, False)], "x double, flat double, train boolean")
    plan = prepare.scale_fitted(df, prepare.Plan({}, scaled=["x", "flat"]), F.col("train"))
    got = [tuple(r) for r in prepare.scaled(df, plan).select(F.round("x", 4), "flat").collect()]
    assert got == [(-1.2247, 0.0), (0.0, 0.0), (1.2247, 0.0), (8.5732, 1.0)]


@pytest.mark.parametrize("values, codes", [(["no", "yes", "no"], [0, 1, 0]), (["yes", "no", "no"], [0, 1, 1]), (["no", None, "no"], [1, 0, 1]), (["no", "yes", None], [0, 1, -1])])
def test_text_targets(spark, values, codes):
    df = spark.createDataFrame(list(enumerate(values)), "r int, v string")
    assert [x.y for x in target.framed(df, "v", "r", "binary").orderBy("r").collect()] == codes


def test_number_targets(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, None), (3, 0.5)], "r int, v double")
    assert [x.y for x in target.framed(df, "v", "r").orderBy("r").collect()] == [1, 1, 0, 0]
    with pytest.raises(ValueError, match="missing"):
        target.framed(df, "v", "r", "multiclass")
    with pytest.raises(ValueError, match="not in data"):
        target.framed(df, "w", "r")
    with pytest.raises(ValueError, match="points in time"):
        target.framed(df.withColumn("t", F.current_date()), "t", "r")
    assert [x.y for x in target.framed(df.na.fill(3.7), "v", "r", "multiclass").orderBy("r").collect()] == [1, 2, 3, 0]
    assert target.resolve("auto", True, 3) == "multiclass" and target.resolve("auto", True, 2) == "binary" and target.resolve("auto", False, 9) == "binary"


def test_split(spark):
    df = spark.range(1003).withColumn("y", (F.col("id") % 3 == 0).cast("int"))
    rows = split.stratified(df, "y", "id").collect()
    again = split.stratified(df.repartition(7), "y", "id").where("is_test").collect()
    assert sum(r.is_test for r in rows) == 201 and {r.id for r in rows if r.is_test} == {r.id for r in again}
    counts = Counter((r.y, r.is_test) for r in rows)
    assert counts[0, True] in (133, 134) and counts[1, True] in (67, 68)
    folds = Counter((r.y, r.fold) for r in split.folds(df, "y", "id").collect())
    assert all(max(n) - min(n) <= 1 for n in ([folds[y, k] for k in range(5)] for y in (0, 1)))
    assert split.train_counts({0: 669, 1: 334}, 0.2) == {0: 535, 1: 267}
    with pytest.raises(ValueError):
        split.stratified(spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id int, y int"), "y", "id")
    one = split.stratified(spark.range(10).withColumn("y", F.lit(1)), "y", "id").collect()
    assert sum(r.is_test for r in one) == 2


def test_metrics(spark):
    rows = [(0, 0, 0.1), (0, 1, 0.6), (1, 1, 0.6), (1, 1, 0.9), (1, 0, 0.2), (0, 0, 0.2)]
    df = spark.createDataFrame(rows, "y int, p int, score double")
    out = metrics.evaluate(df, 2)
    assert out == {"accuracy": 0.6667, "precision": 0.6667, "recall": 0.6667, "f1": 0.6667, "roc_auc": 0.7778, "confusion_matrix": [[2, 1], [1, 2]]}
    one = spark.createDataFrame([(1, 1, 0.9)], "y int, p int, score double")
    assert metrics.roc_auc(one).first()[0] is None
    three = spark.createDataFrame([(0, 0), (1, 2), (2, 2), (1, 1)], "y int, p int").withColumn("score", F.lit(None).cast("double"))
    assert metrics.evaluate(three, 3) == {"accuracy": 0.75, "precision": 0.8333, "recall": 0.8333, "f1": 0.7778, "roc_auc": None, "confusion_matrix": [[1, 0, 0], [0, 1, 1], [0, 0, 1]]}
    missed = spark.createDataFrame([(0, 1), (0, 1)], "y int, p int")
    assert metrics.binary_metrics(missed).first().asDict() == {"accuracy": 0.0, "precision": 0.0, "recall": 0.0, "f1": 0.0}
