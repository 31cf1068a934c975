"""Columns may be called anything, also what a run calls its own; rows keep the order of their files."""

import threading

import pytest
from pyspark.sql import functions as F

from tabularium.functions import storage
from tabularium.operators import target
from tabularium.plans.pipeline import Pipeline, Run
from tabularium.sources import load

OWN = ("row", "y", "p", "score", "split_pos", "is_test", "fold", "value", "code", "place", "c0", "c1", "_row_id", "__row_id", "__value", "__code", "__f0", "__x", "y_true", "y_pred", "prediction", "a.b", "a b", "a`b")
PLAIN = tuple(f"name_{k}" for k in range(len(OWN)))


def table(spark, names, goal):
    columns = [((F.xxhash64("id", F.lit(k)) % 1000) / 10).alias(c) for k, c in enumerate(names)]
    return spark.range(160).select(*columns, F.when(F.col("id") % 4 < 2, "no").otherwise("yes").alias(goal))


def run(spark, folder, names, goal):
    """A run from the typing on, as names decide which headers match."""
    pipeline = Pipeline(spark, str(folder), trees=2)
    state = Run(table=table(spark, names, goal), target=goal, headers=[*names, goal], valid_headers=list(names))
    for stage in (pipeline._recommend, pipeline._prepare, pipeline._infer):
        stage(state)
    return state


def test_own_names_as_features(spark, tmp_path):
    own, plain = run(spark, tmp_path / "a", OWN, "goal"), run(spark, tmp_path / "b", PLAIN, "goal")
    assert own.metrics == plain.metrics and own.metrics["n_features"] == len(OWN)
    assert sorted(map(tuple, own.matrix.collect())) == sorted(map(tuple, plain.matrix.collect()))
    back = dict(zip(PLAIN, OWN))
    assert own.explanations["top10"] == [(back[c], v) for c, v in plain.explanations["top10"]] == own.explanations["top10_columns"]
    with open(own.predictions_path) as a, open(plain.predictions_path) as b:
        first, second = a.readline().strip().split(","), b.readline().strip().split(",")
        assert a.read() == b.read()
    assert first[-3:] == second[-3:] == ["y_true", "y_pred", "y_score"] and first[:5] == list(OWN[:5]) and len(set(first)) == len(first)


def test_levels_of_any_text(spark, tmp_path):
    levels = F.array(*[F.lit(x) for x in ("a`b", "c.d", "e f", "g,h")])
    df = spark.range(200).select(F.element_at(levels, (F.col("id") % 4 + 1).cast("int")).alias("k`ind"), (F.col("id") % 7).cast("double").alias("s.ize"), (F.col("id") % 4 == 1).cast("int").alias("go`al"))
    pipeline = Pipeline(spark, str(tmp_path), trees=2)
    state = Run(table=df, target="go`al", headers=df.columns, valid_headers=["k`ind", "s.ize"])
    for stage in (pipeline._anonymize, pipeline._recommend, pipeline._prepare, pipeline._infer):
        stage(state)
    assert state.metrics["accuracy"] == 1.0 and state.explanations["top10"][0][0] == "k`ind_c.d"
    with open(state.predictions_path) as file:
        assert "k`ind_a`b" in file.readline()


@pytest.mark.parametrize("name", OWN)
def test_own_names_as_target(spark, tmp_path, name):
    pipeline = Pipeline(spark, str(tmp_path))
    state = Run(table=table(spark, ("size", "weight"), name), target=name, headers=["size", "weight", name], valid_headers=["size", "weight"])
    pipeline._recommend(state)
    pipeline._prepare(state)
    assert state.n_classes == 2 and len(state.plan.features) == 2
    assert dict(state.matrix.groupBy("y").count().collect()) == {0: 80, 1: 80}
    coded = target.coded(table(spark, ("size",), name).withColumn("at", F.monotonically_increasing_id()), name, "at", "y")
    assert {r[0] for r in coded.select("y").distinct().collect()} == {0, 1} and coded.count() == 160


@pytest.mark.parametrize("sizes", [(3, 4000), (4000, 3)])
@pytest.mark.parametrize("kind", ["csv", "parquet", "quoted"])
def test_codes_follow_files_and_places_not_sizes(spark, tmp_path, sizes, kind):
    folder = tmp_path / ("t.parquet" if kind == "parquet" else "t.csv")
    folder.mkdir()
    for k, (word, n) in enumerate(zip(("no", "yes"), sizes)):
        if kind == "parquet":
            spark.range(n).coalesce(1).select("id", F.lit(word).alias("goal")).toPandas().to_parquet(folder / f"part-{k}.parquet")
        else:
            note = '"a\nb"' if kind == "quoted" else "a"
            (folder / f"part-{k}.csv").write_text("id,goal,note\n" + "".join(f"{i},{word},{note}\n" for i in range(n)))
    df, _, row = load.load_ordered(spark, str(folder))
    assert row == "_row_id" and df.count() == sum(sizes) == df.select(row).distinct().count()
    framed = target.framed(df, "goal", row, "binary")
    assert {(r.goal, r.y) for r in framed.select("goal", "y").distinct().collect()} == {("no", 0), ("yes", 1)}
    ordered = [(r.goal, r.id) for r in df.orderBy(row).collect()]
    assert ordered == [("no", i) for i in range(sizes[0])] + [("yes", i) for i in range(sizes[1])]


def test_row_ids_have_a_name_of_their_own(spark, tmp_path):
    (tmp_path / "t.csv").write_text("_row_id,place,__row_id\n5,a,1\n7,b,2\n")
    df, _, row = load.load_ordered(spark, str(tmp_path / "t.csv"))
    assert row == "___row_id" and [tuple(r) for r in df.orderBy(row).select("_row_id", "place", "__row_id").collect()] == [(5, "a", 1), (7, "b", 2)]


def test_scopes_of_two_threads_and_of_other_writers(spark):
    """Each thread's result is right, and each folder is gone once its scope is cleared."""
    storage.clean_up(spark)
    ready, results, errors = threading.Barrier(2), {}, []

    def work(name, start):
        try:
            scope = storage.Scope()
            with scope:
                first = storage.materialise(spark.range(start, start + 50), name)
                ready.wait(60)
                second = storage.materialise(first.where("id % 2 = 0"), name)
            ready.wait(60)
            scope.clear(keep=second)
            ready.wait(60)
            results[name] = sorted(r[0] for r in second.collect())
            assert len(scope.paths) == 1
            storage.drop(second)
        except Exception as error:
            errors.append(error)
            ready.abort()

    threads = [threading.Thread(target=work, args=x) for x in (("one", 0), ("two", 1000))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and results == {"one": list(range(0, 50, 2)), "two": list(range(1000, 1050, 2))}
    assert storage._MADE == [] and spark.conf.get(storage._CLEAN) == "false"
    scope = storage.Scope()
    with scope:
        own = storage.materialise(spark.range(3), "own")
    other = storage.materialise(spark.range(4), "other")
    scope.clear(keep=own)
    assert other.count() == 4 and own.count() == 3
    storage.drop(own, other)
