from functools import reduce

import numpy as np
import pytest

from tabularium.sources import identify, kinds

SF = "/root/testdata/sf0.001"


def texts(spark, *names):
    return reduce(lambda a, b: a.unionByName(b), [kinds.samples(spark.read.parquet(f"{SF}/{n}.parquet"), most=40) for n in names])


@pytest.fixture(scope="module")
def model(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("kinds") / "t")
    texts(spark, "orders", "customer", "part", "events", "documents").write.parquet(path)
    return kinds.fit(spark.read.parquet(path).where("part < 8")), spark.read.parquet(path)


def test_held_out_texts_and_tables(spark, model):
    fitted, known = model
    rows = kinds.judged(known.where("part >= 8"), fitted).collect()
    assert {r.label for r in rows} == set(kinds.FORMATS) == set(fitted.labels)
    n = sum(r.n for r in rows)
    assert sum(r.right for r in rows) >= 0.99 * n and sum(r.right for r in rows) >= sum(r.right_by_rules for r in rows)
    others = kinds.judged(texts(spark, "supplier", "conversations", "lineitem"), fitted).collect()
    assert sum(r.right for r in others) >= 0.93 * sum(r.n for r in others)


def test_behind_the_label_of_files(spark, model, tmp_path):
    fitted, _ = model
    for r in texts(spark, "supplier").where("part < 3").dropDuplicates(["label"]).collect():
        (tmp_path / f"{r.label}.dat").write_bytes(r.content)
    (tmp_path / "png.dat").write_bytes(b"\x89PNG\r\n\x1a\n123")
    (tmp_path / "empty.dat").write_bytes(b"")
    found = {r.name.split(".")[0]: r.label for r in identify.file_kinds(spark, str(tmp_path), label=fitted).collect()}
    assert found == {k: k for k in found} and len(found) >= 8


def test_features():
    x = kinds.features([b"", b"a", b"ab,cd\n" * 1000, b"ab,cd\n" * 2000])
    assert x.shape == (4, kinds.SIZE) and not x[0].any() and np.allclose((x[1:] ** 2).sum(axis=1), 1)
    assert (x[2] == x[3]).all()


def test_no_rows_and_few(spark):
    none = spark.createDataFrame([], "a long, b string")
    assert kinds.samples(none).count() == 0
    one = kinds.samples(spark.createDataFrame([(1, None)], "a long, b string")).collect()
    assert {r.label for r in one} == set(kinds.FORMATS) and all(r.content is not None for r in one)
