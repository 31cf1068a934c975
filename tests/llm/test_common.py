import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tabularium.functions import storage
from tabularium.llm import common, exact_dedup, jaccard_join, mixing


def test_let_computes_once(spark):
    doubled = common.let(F.col("id") + 1, lambda x: x * x + x)
    assert [r[0] for r in spark.range(3).select(doubled).collect()] == [2, 6, 12]


def test_written_tables_are_shared_and_cleaned_up(spark):
    common.clean_up(spark)
    df = common.materialise(spark.range(5), "five")
    path = storage._MADE[-1]
    assert path.startswith(spark.conf.get("spark.checkpoint.dir")) and df.count() == 5
    assert common.clean_up(spark) == 1 and not os.path.exists(path.removeprefix("file://"))


def test_a_stored_result_leaves_no_tables(spark, tmp_path):
    common.clean_up(spark)
    own = common.materialise(spark.range(5), "own")
    scope = common.Scope()
    with scope:
        first, second = common.materialise(spark.range(6), "first"), common.materialise(spark.range(7), "second")
    scope.clear(keep=first)
    assert own.count() == 5 and first.count() == 6 and len(storage._MADE) == 2
    common.drop(own)
    common.store(first.where("id > 1"), str(tmp_path / "out"))
    assert storage._MADE == [] and spark.read.parquet(str(tmp_path / "out")).count() == 4


@pytest.mark.parametrize("prefix", ["", "file:", "file://"])
def test_scopes_know_paths_however_they_are_written(spark, tmp_path, monkeypatch, prefix):
    common.clean_up(spark)
    plain = storage.shared_dir

    def path(session, name):
        made = plain(session, name)
        storage._MADE.remove(made)
        storage._MADE.append(prefix + str(tmp_path / made.rsplit("/", 1)[1]))
        scope.paths = scope.paths - {made} | {storage._MADE[-1]}
        return storage._MADE[-1]

    monkeypatch.setattr(storage, "shared_dir", path)
    scope = storage.Scope()
    with scope:
        first, second = storage.materialise(spark.range(6), "first"), storage.materialise(spark.range(7), "second")
    scope.clear(keep=second)
    assert second.count() == 7 and len(storage._MADE) == 1
    storage.drop(second)
    assert storage._MADE == []
    with pytest.raises(Exception):
        first.count()


def test_no_folder_is_made_up_on_a_cluster():
    session = lambda master: SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(session("spark://host:7077"), "x")
    assert common.shared_dir(session("local[2]"), "x").startswith("file:///")
    storage._MADE.pop()


def test_rows_that_are_numbered_otherwise_are_an_error(spark):
    rows = spark.createDataFrame([(1, 1, True), (2, 3, False), (None, None, True)], "a long, b long, c boolean")
    assert rows.where(common.same_rows(F.col("a"), F.col("b"), F.col("c"))).count() == 3
    with pytest.raises(Exception, match="same order twice"):
        rows.where(common.same_rows(F.col("a"), F.col("b"))).collect()


def test_reserved_names_are_refused(spark):
    for name, call in (("__row", jaccard_join.one_of_each), ("__keep_row", exact_dedup.deduplicate), ("__row", mixing.mixed_documents)):
        with pytest.raises(ValueError, match=name):
            call(spark.createDataFrame([(1, "a", "s", 1)], f"doc_id long, text string, source string, {name} int"))
