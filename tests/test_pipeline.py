import json
import os
import shutil
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tabularium import cli
from tabularium.operators import explain, model, split
from tabularium.plans import report
from tabularium.plans.catalog import queries
from tabularium.plans.oracles import sql
from tabularium.plans.pipeline import Pipeline, describe_image
from tabularium.sources.registry import Model, Registry
from tabularium.sources.synthetic import generate

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def demo(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("demo"))
    cohort = generate(spark, 600, 42, 2).withColumn("patient_email", F.lit("a@b.co"))
    path = report.write_csv(cohort, os.path.join(folder, "cohort.csv"))
    pipeline = Pipeline(spark, folder, trees=8)
    return pipeline.run(path), folder


def test_demo(demo):
    run, folder = demo
    assert run.selected_model == "MODEL_01" and len(run.valid_headers) == 21 and run.target == "anxiety"
    assert run.anonymization == {"masked_columns": {"patient_email": "column_name_hint"}, "detected_types": ["IDENTITY"]}
    assert run.metrics["n_train"] == 480 and run.metrics["n_test"] == 120 and run.n_classes == 2
    assert run.metrics["roc_auc"] > 0.6 and 0.5 < run.metrics["cv5_accuracy_mean"] <= 1
    assert len(run.explanations["top10"]) == 10 and {c for c, _ in run.explanations["top10_columns"]} & {"tension", "feeling_depressed"}
    assert [s["status"] for s in run.trace] == ["ok"] * 7
    with open(run.predictions_path) as file:
        lines = file.read().splitlines()
    assert len(lines) == 121 and lines[0].endswith("y_true,y_pred,y_score")
    saved = json.load(open(report.save(run, folder)))
    assert list(saved) == ["data_kind", "file_types", "selected_model", "target", "n_classes", "valid_headers", "column_types", "anonymization", "match_report", "metrics", "explanations", "trace"]
    assert any("MODEL_03: 2 of 12" in x for x in report.lines(run))


def test_no_model_halts(spark, tmp_path):
    run = Pipeline(spark, str(tmp_path)).run(table=spark.range(5))
    assert run.selected_model is None and run.trace[-1]["status"] == "halted" and run.metrics == {}
    assert json.load(open(report.save(run, str(tmp_path))))["selected_model"] is None


def test_a_run_reads_parts_of_its_file_only(spark, tmp_path):
    path = report.write_csv(generate(spark, 400, 1, 1), str(tmp_path / "cohort.csv"))
    before = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        run = Pipeline(spark, str(tmp_path), trees=2, explain=False).run(path)
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", before)
    assert run.file_types == {"cohort.csv": "csv"} and run.selected_model == "MODEL_01"


def test_report_goes_to_any_store(spark, tmp_path):
    run = Pipeline(spark, f"file://{tmp_path}/out").run(table=spark.range(5))
    assert report.save(run, f"file://{tmp_path}/out", spark) == f"file://{tmp_path}/out/pipeline_report.json"
    assert json.load(open(tmp_path / "out" / "pipeline_report.json"))["trace"][-1]["status"] == "halted"


def test_failure_is_reported(spark, tmp_path):
    table = spark.createDataFrame([(k, k % 3) for k in range(30)], "a int, b int")
    registry = Registry([Model("M", "table", "m", "t", ("a", "b"), "missing")])
    with pytest.raises(ValueError, match="not in data"):
        Pipeline(spark, str(tmp_path), registry=registry).run(table=table)
    assert json.load(open(tmp_path / "pipeline_report.json"))["trace"][-1]["status"] == "error"


def test_multiclass(spark, tmp_path):
    table = spark.range(240).select((F.col("id") % 3).alias("group_key"), (F.col("id") % 3 * 10 + F.col("id") % 2).cast("double").alias("size"), F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), (F.col("id") % 3 + 1).cast("int")).alias("kind"))
    registry = Registry([Model("M", "table", "m", "t", ("group_key", "size"), "kind")])
    run = Pipeline(spark, str(tmp_path), registry=registry, explain=False, trees=3).run(table=table)
    assert run.n_classes == 3 and run.metrics["accuracy"] == 1.0 and run.metrics["roc_auc"] is None
    assert run.explanations["note"] == "skipped"


def test_images(spark, tmp_path):
    (tmp_path / "x.png").write_bytes(b"\x89PNG\r\n\x1a\n")
    run = Pipeline(spark, str(tmp_path)).run(str(tmp_path / "x.png"), image_paths=["x.png"])
    assert run.data_kind == "image" and run.selected_model == "MODEL_06" and len(run.trace) == 7
    answers = iter(["breast histopathology scan", "tumour"])
    assert describe_image(Registry(), ["x"], lambda prompt, image: next(answers)) == ("breast histopathology scan", "tumour")


def test_command_line(spark, tmp_path, capsys):
    path = report.write_csv(spark.createDataFrame([(1, "x"), (2, None)], "a int, b string"), str(tmp_path / "t.csv"))
    assert cli.main(["info", path]) == 0
    assert "2 rows, 2 columns" in capsys.readouterr().out
    assert cli.main(["run", path, "--target", "zzz"]) == 2
    assert "zzz" in capsys.readouterr().err
    assert cli.main(["run", path, "--output-dir", str(tmp_path / "out")]) == 0
    args = cli.parser().parse_args(["run", "f.csv"])
    assert (args.threshold, args.test_size, args.seed, args.target_mode, args.output_dir) == (0.6, 0.2, 42, "auto", "run_output")


def test_sampled_importances_of_a_linear_model(spark):
    rows = spark.range(40).select(F.col("id"), (F.col("id") % 5).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), F.lit(1.0).alias("c"))
    score = lambda df: df.withColumn("score", 2 * F.col("a") - F.col("b"))
    found = dict(map(tuple, explain.sampled(rows, rows, ["a", "b", "c"], score, "id", permutations=40).collect()))
    exact = dict(map(tuple, explain.linear(rows, rows, {"a": 2.0, "b": -1.0, "c": 0.0}).collect()))
    assert found["c"] == 0 and found["a"] == pytest.approx(exact["a"], rel=0.3) and found["b"] == pytest.approx(exact["b"], rel=0.3)
    assert [r.feature for r in explain.top(explain.linear(rows, rows, {"a": 2.0, "b": -1.0, "c": 0.0}), ["a", "b", "c"]).collect()] == ["a", "b", "c"]


def test_raw_scores(spark):
    df = spark.createDataFrame([(0.0,), (2.0,)], "x double")
    assert [r[0] for r in df.select(model.raw_to_score(F.col("x"), True)).collect()] == [0.0, 2.0]
    assert df.select(model.raw_to_score(F.col("x"), False)).first()[0] == 0.5


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    return repr(round(value, 6) + 0.0) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, SF)
    rows = df.collect()
    assert rows or name in ("pii_report",)
    if name in sql():
        cursor = duck.execute(sql()[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(df.columns)
        want = sorted([plain(r[names.index(c)]) for c in sorted(names)] for r in cursor.fetchall())
        assert sorted([plain(r[c]) for c in sorted(names)] for r in rows) == want


def test_entry(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_works_without_the_text_operators(tmp_path):
    """Without their folders and corpus_pipeline.py the entry imports, and other tests pass."""
    root = os.path.dirname(os.path.abspath(contract.__file__))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'mask_documents' in q and not [n for n in q if n.startswith('op') and n[2].isdigit()] and 'pipeline' not in q; e.oracle_sql()"
    for name in ("tabularium", "tests"):
        shutil.copytree(os.path.join(root, name), tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
    subprocess.run([sys.executable, "-m", "pytest", "-x", "-q", "-p", "no:cacheprovider", "tests/test_masking.py", "tests/test_match.py"], cwd=tmp_path, check=True, env=env)


def test_report_of_a_run_whose_predictions_are_parts(spark, monkeypatch):
    """As on a cluster, where executors write parts to a shared folder."""
    from tabularium.plans import catalog, report

    monkeypatch.setattr(report, "is_local", lambda _: False)
    found = {(r.part, r.key): r.value for r in catalog.run_report(spark, SF).collect()}
    assert found["predictions", "last"] == "y_true,y_pred,y_score" and found["predictions", "lines"] == found["metric", "n_test"]


def test_codes_over_files_in_many_parts(spark, duck, monkeypatch):
    from tabularium.plans import catalog

    monkeypatch.setattr(catalog, "FILE_ROWS", 200)
    found = sorted(map(tuple, catalog.target_of_files(spark, SF).collect()))
    assert found == sorted(duck.execute(sql()["target_of_files"]).fetchall())


def test_places_of_large_classes_are_dealt_to_more_tasks(spark, monkeypatch):
    df = spark.range(1000).select("id", (F.col("id") % 2).alias("y"))
    few = sorted(map(tuple, split.placed(df, "y", "id", 1).collect()))
    monkeypatch.setattr(split, "TASK_ROWS", 50)
    many = split.placed(df, "y", "id", 1)
    assert many.rdd.getNumPartitions() == 20 and sorted(map(tuple, many.collect())) == few
