"""Queries over the test tables, one or more for each operator; ``oracles`` has the SQL that they are compared with.

Missing values are put in by key, as the tables have none: a value is null where its key is divisible by 7.
"""

from __future__ import annotations

import contextlib
import io
import json
import math
import os
import re
import tempfile
from functools import partial, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.functions.expressions import label, kind_of, logistic, text_to_number
from tabularium.functions.masking import mask
from tabularium.functions.storage import drop, materialise, put, shared_dir
from tabularium.operators import anonymize, boosting, explain, match, metrics, model, prepare, profile, scan, split, target, trees
from tabularium.plans import oracles, report
from tabularium.sources import archives, delimited, identify, kinds, load, spss, xlsx
from tabularium.sources.registry import Model, Registry, image_matches
from tabularium.sources.synthetic import COLUMNS, generate

#: Headers of the synthetic cohort.
HEADERS = (*COLUMNS, "anxiety")
SCORE_AT = 2000
#: Levels from which ``one_hot_wide`` takes a column as wide, so that the smallest tables have one.
WIDE = 150
#: Rows that a task sorts and writes, about, where a file's parts keep an order.
FILE_ROWS = 1 << 19
WEIGHTS = {"totalprice": 0.5, "custkey": -0.25, "month": 0.125}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _gaps(key: str, value: str) -> Column:
    return F.when(F.col(key) % 7 != 0, F.col(value)).alias(value)


def _round(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# masking


def mask_texts(name: str, keys: list[str], text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, name).select(*keys, F.md5(mask(F.col(text))).alias("masked_md5"), F.length(mask(F.col(text))).alias("masked_length"))


def pii_hits_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anonymize.label_counts(_t(spark, sf_dir, "documents"), ["text", "lang", "source"])


def pii_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "pages").withColumnRenamed("url", "record_url")
    return anonymize.report_frame(df).select("column", "reason", F.array_join("labels", ",").alias("labels"))


def mask_hint_columns(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return anonymize.masked(_t(spark, sf_dir, name))


# profiles and types


def profile_table(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(profile.profile(_t(spark, sf_dir, name)).select("column", "n_rows", "n_null", "n_unique", "avg_len"), "avg_len")


def column_types(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.typed(profile.profile(_t(spark, sf_dir, name))).select("column", "type")


def plan_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.planned(profile.typed(profile.profile(_t(spark, sf_dir, "orders")))).select("column", "type", F.array_join("steps", ",").alias("steps"))


def project_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.project(_t(spark, sf_dir, "customer"), ["c_mktsegment", "absent", "c_acctbal"], "c_custkey")


# imputation, coercion, encoding


def impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "orders").select("o_orderkey", _gaps("o_orderkey", "o_totalprice"))
    plan = prepare.fitted(df, {"o_totalprice": profile.NUMERICAL})
    return _round(prepare.applied(df, plan, keep=["o_orderkey"]), "o_totalprice")


def impute_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "part").select("p_partkey", _gaps("p_partkey", "p_brand"))
    fill = prepare.modes(df, {"m": F.col("p_brand")})["m"]
    return df.select("p_partkey", F.coalesce("p_brand", F.lit(fill)).alias("p_brand"))


def impute_mode_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "part").select("p_partkey", _gaps("p_partkey", "p_size"))
    return prepare.applied(df, prepare.fitted(df, {"p_size": profile.BINARY}), keep=["p_partkey"])


def binary_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column of two texts becomes numbers, which none of its texts is: all 0."""
    df = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linestatus")
    return prepare.applied(df, prepare.fitted(df, {"l_linestatus": profile.BINARY}), keep=["l_orderkey"])


def _texts(key: str) -> Column:
    k = F.col(key)
    text = k.cast("string")
    return (
        F.when(k % 8 == 0, F.concat(F.lit(" "), text, F.lit(" ")))
        .when(k % 8 == 1, F.concat(text, F.lit("e1")))
        .when(k % 8 == 2, F.concat(text, F.lit("d")))
        .when(k % 8 == 3, F.lit("M"))
        .when(k % 8 == 4, F.concat(F.lit("-"), text, F.lit(".5")))
        .when(k % 8 == 5, F.lit(""))
        .when(k % 8 == 6, F.concat(F.lit("0x"), text))
        .otherwise(F.concat(F.lit("."), text))
    )


def coerce_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "part").select("p_partkey", text_to_number(_texts("p_partkey")).alias("number"))
    return _round(df, "number")


def csv_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types decided for columns of texts."""
    k = F.col("p_partkey")
    texts = _t(spark, sf_dir, "part").select(
        k.cast("string").alias("whole"),
        F.when(k % 7 != 0, k.cast("string")).otherwise("NA").alias("whole_with_gaps"),
        F.concat(k.cast("string"), F.lit(".25")).alias("fraction"),
        F.when(k % 2 == 0, "True").otherwise("False").alias("flag"),
        F.lit("null").alias("empty"),
        F.lit("-").alias("dash"),
        F.lit("2020-01-01").alias("day"),
    )
    kinds = delimited.inferred(texts).dtypes
    return spark.createDataFrame(kinds, "column string, type string")


def one_hot(name: str, key: str, column: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, name).select(key, _gaps(key, column))
    return prepare.applied(df, prepare.fitted(df, {column: profile.CATEGORICAL}), keep=[key])


def one_hot_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column of very many levels: the number of the one that is hot, its name, and the width of the sparse vector."""
    df = _t(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.concat(F.lit("k"), F.col("p_partkey") % 1500)).alias("level"))
    plan = prepare.fitted(df, {"level": profile.CATEGORICAL}, most_levels=WIDE)
    out = prepare.applied(df, plan, keep=["p_partkey"]).select("p_partkey", F.col("level").cast("long").alias("place"))
    named = plan.names("level").select(F.col("number").alias("place"), "level")
    return out.join(named, "place").select("p_partkey", "place", "level", F.lit(plan.wide["level"]).alias("width"))


def level_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How values are named in encoded columns."""
    df = _t(spark, sf_dir, "lineitem")
    kinds = {c: kind_of(df, c) for c in ("l_linenumber", "l_quantity", "l_discount")}
    rows = [F.struct(F.lit(c).alias("column"), label(F.col(c), k).alias("level")) for c, k in kinds.items()]
    return df.select(F.explode(F.array(*rows)).alias("x")).groupBy("x.column", "x.level").agg(F.count(F.lit(1)).alias("n"))


# targets


def target_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "events").select("event_id", _gaps("event_id", "value"))
    return target.framed(df, "value", "event_id", "binary").select("event_id", "y")


def target_binary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_linestatus").alias("status"))
    return target.framed(df, "status", "l_orderkey", "binary").select("l_orderkey", "y")


def target_factorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "orders").select("o_orderkey", _gaps("o_orderkey", "o_orderpriority"))
    return target.coded(df, "o_orderpriority", "o_orderkey", "y").select("o_orderkey", "y")


def target_multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target.framed(_t(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey", "multiclass").select("o_orderkey", "y")


def target_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = target.framed(_t(spark, sf_dir, "orders"), "o_orderstatus", "o_orderkey").select(F.lit("orders").alias("name"), F.col("o_orderkey").alias("key"), "y")
    number = target.framed(_t(spark, sf_dir, "labels"), "quality", "doc_id").select(F.lit("labels").alias("name"), F.col("doc_id").alias("key"), "y")
    return text.unionByName(number)


def target_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = target_factorize(spark, sf_dir)
    return df.agg(F.count_distinct("y").alias("n_classes"))


# splits


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").withColumn("y", F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2))


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.stratified(_status(spark, sf_dir), "y", "o_orderkey").select("o_orderkey", "y", "is_test")


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_split(spark, sf_dir).groupBy("y", "is_test").agg(F.count(F.lit(1)).alias("n"))


def union_of_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = stratified_split(spark, sf_dir)
    return both.where(~F.col("is_test")).unionByName(both.where("is_test")).select("o_orderkey", "y")


def kfold_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.folds(_t(spark, sf_dir, "labels"), "quality", "doc_id").select("doc_id", "quality", "fold")


def background_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.background(_t(spark, sf_dir, "orders"), "o_orderkey").select("o_orderkey")


def explain_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split.stratified(_status(spark, sf_dir), "y", "o_orderkey").where("is_test")
    return rows.orderBy("split_pos", "y").limit(100).select("o_orderkey", "y", "split_pos")


# scaling and the whole matrix


def standard_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split.stratified(_status(spark, sf_dir), "y", "o_orderkey").select("o_orderkey", "is_test", F.col("o_totalprice").alias("totalprice"), F.lit(3.0).alias("flat"))
    plan = prepare.scale_fitted(rows, prepare.Plan({}, scaled=["totalprice", "flat"]), ~F.col("is_test"))
    return _round(prepare.scaled(rows, plan), "totalprice", "flat").select("o_orderkey", "totalprice", "flat")


def prepared_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types, imputation, encoding, split and scaling in one."""
    df = _status(spark, sf_dir).select("o_orderkey", "y", _gaps("o_orderkey", "o_totalprice"), _gaps("o_orderkey", "o_orderpriority"))
    types = {r.column: r.type for r in profile.typed(profile.profile(df, ["o_totalprice", "o_orderpriority"])).collect()}
    rows = split.stratified(df, "y", "o_orderkey")
    plan = prepare.fitted(rows, types)
    rows = prepare.applied(rows, plan, keep=["o_orderkey", "y", "is_test"])
    plan = prepare.scale_fitted(rows, plan, ~F.col("is_test"))
    return _round(prepare.scaled(rows, plan), "o_totalprice")


# headers


def _corpus(spark: SparkSession) -> DataFrame:
    return match.corpus(spark, HEADERS, Registry().tables())


def header_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark).select("model", "side", "idx", match.normalised(F.col("header")).alias("header"))


def header_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = F.explode(match.ngrams(match.normalised(F.col("header")))).alias("gram")
    return _corpus(spark).select("model", "side", "idx", grams).groupBy("model", "side", "idx", "gram").agg(F.count(F.lit(1)).alias("tf"))


def header_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(match.weights(_corpus(spark)).select("model", "side", "idx", "gram", "w"), "w")


def header_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(match.similarities(_corpus(spark)), "sim")


def header_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.pair_frame(spark, match.match(spark, HEADERS)).select("model", "required", "header", "score")


def header_assignment_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = Model("ORDERS", "table", "orders", "classification", oracles.ORDER_HEADERS, "flag")
    headers = _t(spark, sf_dir, "orders").columns
    return match.pair_frame(spark, match.match(spark, headers, Registry([wanted]))).select("required", "header", "score")


def model_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.summary_frame(spark, match.match(spark, HEADERS))


def _table_registry(spark: SparkSession, sf_dir: str) -> Registry:
    """A model for each of some given tables: its columns, without the table's letter, the last one as output."""
    names = {t: [re.sub(oracles.SHORT, "", c) for c in _t(spark, sf_dir, t).columns] for t in oracles.REGISTERED}
    return Registry([Model(t, "table", t, "classification", tuple(c), c[-1]) for t, c in names.items()])


def _table_columns(spark: SparkSession, sf_dir: str) -> list[str]:
    return [c for t in oracles.MATCHED for c in _t(spark, sf_dir, t).columns]


def _table_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.corpus(spark, _table_columns(spark, sf_dir), _table_registry(spark, sf_dir).tables())


def table_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every model's corpus of headers, of given tables, without its output."""
    return _table_corpus(spark, sf_dir).select("model", "side", "idx", match.normalised(F.col("header")).alias("header"))


def table_header_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(match.weights(_table_corpus(spark, sf_dir)).select("model", "side", "idx", "gram", "w"), "w")


def _table_scan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    headers = spark.createDataFrame(list(enumerate(_table_columns(spark, sf_dir))), "u int, header string")
    return scan.scanned(headers, _table_registry(spark, sf_dir).frame(spark))


def table_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of given tables assigned to those of every model of the registry, in rounds and without all pairs."""
    return _table_scan(spark, sf_dir)[0]


def table_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table_scan(spark, sf_dir)[1]


def _letters(headers: list[str]) -> list[list[float]]:
    """A plain embedder: how often each letter occurs."""
    return [[float(h.lower().count(c)) for c in oracles.LETTERS] for h in headers]


def table_embedder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of given tables assigned by the vectors of an embedder that is passed in."""
    found = match.match(spark, _table_columns(spark, sf_dir), _table_registry(spark, sf_dir), embedder=_letters)
    return match.pair_frame(spark, found).select("model", "place", "required", "header", "score")


def run_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for an image file of each region: routed by its bytes, described by fixed answers or by a model that is passed in, and left to the image model."""
    from tabularium.plans.pipeline import Pipeline

    folder, rows = shared_dir(spark, "images"), []
    for name in sorted(r.r_name for r in _t(spark, sf_dir, "region").select("r_name").collect()):  # a row for each region
        path = put(spark, f"{folder}/{name}.dat", b"\x89PNG\r\n\x1a\n" + name.encode())
        answer = lambda prompt, image: "breast histopathology scan" if prompt.startswith("Which") else f"seen in {name}"  # noqa: E731, B023
        with tempfile.TemporaryDirectory(prefix="run-") as out:
            done = Pipeline(spark, out, vision=answer if name.startswith("A") else None).run(path, image_paths=[path])
        rows.append((name, done.data_kind, done.selected_model, done.image_modality, done.image_disease, done.anonymization["n_images"], done.preprocessing_plan["mode"], done.metrics["note"], ",".join(s["status"] for s in done.trace)))
    return spark.createDataFrame(rows, "name string, data_kind string, model string, modality string, disease string, n_images int, mode string, note string, stages string")


def format_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of texts in seven formats, made of rows of given tables and held out of the model, how many it and the rules tell right."""
    names = ("orders", "customer", "part", "events", "documents", "pages", "supplier")
    made = [kinds.samples(_t(spark, sf_dir, n), most=kinds.TEXTS) for n in names]
    texts = materialise(reduce(lambda a, b: a.unionByName(b), made), "texts")
    return kinds.judged(texts.where("part >= 8"), kinds.fit(texts.where("part < 8")))


def table_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table_registry(spark, sf_dir).frame(spark).select("model", "kind", F.array_join("headers", ",").alias("headers"), "output")


def _image_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image model for each source and language of the documents, the source as its modality."""
    own = _t(spark, sf_dir, "documents").where("source is not null and lang is not null").select("source", "lang").distinct()
    return own.select(F.concat_ws("-", "source", "lang").alias("model"), F.lit("image").alias("kind"), F.concat("source", F.lit(" image")).alias("modality"))


def table_modalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _image_models(spark, sf_dir).where("kind = 'image'").select("modality").distinct()


def table_image_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _t(spark, sf_dir, "documents").select(F.concat(F.coalesce("source", F.lit("no")), F.lit(" image")).alias("modality"))
    asked = asked.unionByName(_t(spark, sf_dir, "events").select(F.concat("event_type", F.lit(" image")).alias("modality")))
    return image_matches(_image_models(spark, sf_dir), asked)


def run_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run on ``orders``, with importances: what was decided and counted, and the rows that its confusion matrix and training rows add up to."""
    from tabularium.plans.pipeline import Pipeline

    wanted = Model("ORDERS", "table", "orders", "classification", ("o_custkey", "o_totalprice", "o_orderpriority"), "o_orderstatus")
    done = Pipeline(spark, shared_dir(spark, "run"), registry=Registry([wanted])).run(f"{sf_dir}/orders.parquet")
    stages = ",".join(f"{s['agent']}:{s['status']}" for s in done.trace)
    scored = sum(map(sum, done.metrics["confusion_matrix"])) + done.metrics["n_train"]
    row = (done.data_kind, done.selected_model, done.target, done.n_classes, len(done.valid_headers), done.metrics["n_train"], done.metrics["n_test"], done.metrics["n_features"], stages, scored)
    return spark.createDataFrame([row], "data_kind string, model string, target string, n_classes int, n_headers int, n_train int, n_test int, n_features int, stages string, n_scored long")


def _flat(rows: list[tuple]) -> list[tuple[str, str, str]]:
    return [(str(a), str(b), str(c)) for a, b, c in rows]


def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run on ``documents`` decides and saves, from its report file: which are English is predicted from source, size and text."""
    from tabularium.plans.pipeline import Pipeline

    table = _t(spark, sf_dir, "documents").select("source", "n_chars", "text", (F.col("lang") == "en").cast("int").alias("english"))
    wanted = Model("ENGLISH", "table", "documents", "classification", ("source", "n_chars", "text"), "english")
    folder = shared_dir(spark, "run")
    report.save(Pipeline(spark, folder, registry=Registry([wanted]), explain=False, trees=2).run(table=table), folder, spark)
    saved = json.loads(spark.read.text(f"{folder}/pipeline_report.json", wholetext=True).first()[0])
    found, _ = load.load_any(spark, f"{folder}/predictions.csv")  # one file or parts
    columns, n_lines = found.columns, found.count()
    rows = [("key", k, name) for k, name in enumerate(saved)] + [("header", k, h) for k, h in enumerate(saved["valid_headers"])]
    rows += [("type", c, t) for c, t in saved["column_types"].items()] + [("stage", k, f"{s['agent']} {s['status']}") for k, s in enumerate(saved["trace"])]
    rows += [("metric", m, saved["metrics"][m]) for m in ("n_train", "n_test", "n_features")] + [("explanations", "note", saved["explanations"]["note"])]
    rows += [("decision", c, saved[c]) for c in ("data_kind", "selected_model", "target", "n_classes")]
    rows += [("predictions", "lines", n_lines), ("predictions", "columns", len(columns)), ("predictions", "last", ",".join(columns[-3:]))]
    return spark.createDataFrame(_flat(rows), "part string, key string, value string")


def run_without_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that end early: no model matches ``region``, and a model's output that ``nation`` lacks is an error; both leave a report."""
    from tabularium.plans.pipeline import Pipeline

    rows: list[tuple] = []
    with tempfile.TemporaryDirectory(prefix="run-") as folder:
        done = Pipeline(spark, folder).run(f"{sf_dir}/region.parquet", force_target="r_name")
        rows += [("region", "model", done.selected_model), ("region", "target", done.target), ("region", "headers", ",".join(done.headers)), ("region", "last", done.trace[-1]["status"])]
        wanted = Model("NATION", "table", "nation", "classification", ("n_nationkey", "n_regionkey"), "ruler")
        try:
            Pipeline(spark, folder, registry=Registry([wanted])).run(f"{sf_dir}/nation.parquet")
        except ValueError as error:
            rows.append(("nation", "error", error))
        with open(f"{folder}/pipeline_report.json", encoding="utf-8") as file:
            rows += [("nation", f"stage {k}", f"{s['agent']} {s['status']}") for k, s in enumerate(json.load(file)["trace"])]
    return spark.createDataFrame(_flat(rows), "run string, key string, value string")


def command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the command line says of ``customer``: its columns, a target that it lacks, and a run without a model."""
    from tabularium import cli

    rows: list[tuple] = []
    path = f"{sf_dir}/customer.parquet"

    def called(*args: str) -> tuple[int, list[str], str]:
        out, err = io.StringIO(), io.StringIO()
        with contextlib.redirect_stdout(out), contextlib.redirect_stderr(err):
            code = cli.main(list(args))
        return code, out.getvalue().replace(path, "FILE").splitlines(), err.getvalue().replace(path, "FILE").strip()

    code, lines, _ = called("info", path)
    rows += [("info", "exit", code), ("info", "size", lines[1])] + [("info", x[0], "|".join(x[1:])) for x in (re.split(r"\s{2,}", line) for line in lines[3:])]
    code, _, said = called("run", path, "--target", "zzz")
    rows += [("target", "exit", code), ("target", "said", said)]
    with tempfile.TemporaryDirectory(prefix="run-") as folder:
        code, lines, _ = called("run", path, "--no-explain", "--output-dir", folder)
        rows += [("run", "exit", code), ("run", "files", ",".join(sorted(os.listdir(folder)))), ("run", "halted", any("halted" in x for x in lines))]
    return spark.createDataFrame(_flat(rows), "command string, key string, value string")


def registry_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Registry().frame(spark).withColumn("headers", F.array_join("headers", ","))


def modality_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Registry().frame(spark).where("kind = 'image'").select("modality").distinct()


def image_model_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([("colon colonoscopy scan",), ("breast histopathology scan",), ("chest x-ray",)], "modality string")
    return image_matches(Registry().frame(spark), asked)


def vector_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every vector whose id is divisible by 50 the ten most similar ones."""
    df = _t(spark, sf_dir, "embeddings")
    return _round(explain.nearest(df, df.where("vec_id % 50 = 0")).select(F.col("query").alias("query_id"), F.col("id").alias("vec_id"), "sim"), "sim")


# evaluation


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a fixed scorer: long texts are good."""
    df = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id")
    return df.select("doc_id", F.col("quality").alias("y"), (F.col("n_chars") > SCORE_AT).cast("int").alias("p"), (F.col("n_chars") / 100.0).alias("score"))


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_scored(spark, sf_dir))


def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(metrics.binary_metrics(_scored(spark, sf_dir)), "accuracy", "precision", "recall", "f1")


def macro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(metrics.macro_metrics(_scored(spark, sf_dir)), "accuracy", "precision", "recall", "f1")


def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(metrics.roc_auc(_scored(spark, sf_dir)), "roc_auc")


def cv_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(metrics.fold_accuracy(split.folds(_scored(spark, sf_dir), "y", "doc_id")), "cv_mean", "cv_std")


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 1e5).alias("totalprice"), (F.col("o_custkey") / 1e3).alias("custkey"), F.month("o_orderdate").cast("double").alias("month"))


def linear_shap_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _numbers(spark, sf_dir)
    found = explain.linear(split.first_rows(rows, "o_orderkey"), split.background(rows, "o_orderkey"), WEIGHTS)
    return explain.top(found, list(WEIGHTS))


def shap_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importances of a scorer with an interaction, from all coalitions."""
    rows = _numbers(spark, sf_dir)
    scorer = lambda df: df.withColumn("score", logistic(F.col("totalprice") - 0.5 * F.col("custkey") * F.col("month") + 0.125 * F.col("month")))
    found = explain.exact(split.first_rows(rows, "o_orderkey"), split.background(rows, "o_orderkey"), list(WEIGHTS), scorer, "o_orderkey")
    return explain.top(found, list(WEIGHTS))


def _split(node: tuple | float) -> trees.Split | float:
    if not isinstance(node, tuple):
        return node
    feature, threshold, left, right = node
    return trees.Split(list(WEIGHTS).index(feature), _split(left), _split(right), threshold)


def tree_shap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapley values of every order's numbers in two trees, against the background sample."""
    rows = _numbers(spark, sf_dir)
    ends = [leaf for t in oracles.TREES for leaf in trees.leaves(_split(t))]
    found = explain.tree_shap(rows, split.background(rows, "o_orderkey"), ends, list(WEIGHTS), "o_orderkey")
    pivoted = rows.select(F.col("o_orderkey").alias("row")).join(found.groupBy("row").pivot("feature", list(WEIGHTS)).agg(F.sum("phi")), "row", "left")
    return pivoted.select(F.col("row").alias("o_orderkey"), *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in WEIGHTS])


def predictions_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _numbers(spark, sf_dir)
    raw = sum((w * F.col(c) for c, w in WEIGHTS.items()), F.lit(0.0))
    scored = rows.withColumn("score", logistic(raw))
    return scored.select("o_orderkey", model.decided(F.col("score")).alias("y_pred"), F.round("score", 4).alias("y_score"))


# files


def file_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three files hold by their bytes, and where a run takes them."""
    found = identify.routed(identify.file_kinds(spark, [f"{sf_dir}/{n}.parquet" for n in ("region", "nation", "supplier")]))
    return found.select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), F.array_join("labels", ",").alias("labels"), "data_kind")


def archive_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` and their addresses packed into archives of a hundred pages, and what is found in them."""
    pages = _t(spark, sf_dir, "pages")
    name = lambda end: F.concat(F.lit("p"), F.col("page_id"), F.lit(end)).alias("member")
    bundle = F.concat(F.lit("pages-"), F.floor(F.col("page_id") / 100), F.lit(".zip")).alias("archive")
    table = F.concat(F.lit("page,address\n"), F.col("page_id"), F.lit(","), "url", F.lit("\n"))
    rows = pages.select(bundle, name(".html"), F.col("html").alias("content")).unionByName(pages.select(bundle, name(".csv"), table.alias("content")))
    folder = shared_dir(spark, "archives")
    written = materialise(archives.write(rows, folder), "archives-written")
    found = identify.file_kinds(spark, folder).withColumn("archive", F.regexp_extract("path", "[^/]*$", 0))
    whole = written.select(F.regexp_extract("path", "[^/]*$", 0).alias("archive"), "members")
    return found.join(whole, "archive").select("archive", "name", "label", "members")


def run_demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run on the synthetic cohort: what was decided and counted."""
    from tabularium.plans.pipeline import Pipeline

    with tempfile.TemporaryDirectory(prefix="run-") as folder:
        done = Pipeline(spark, folder, explain=False, trees=2).run(table=generate(spark))
    row = (done.data_kind, done.selected_model, done.target, done.n_classes, len(done.valid_headers), done.metrics["n_train"], done.metrics["n_test"], done.metrics["n_features"], ",".join(s["status"] for s in done.trace))
    return spark.createDataFrame([row], "data_kind string, model string, target string, n_classes int, n_headers int, n_train int, n_test int, n_features int, stages string")


def load_delimited(extension: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` written as delimited text, in parts, and loaded by its extension."""
    path = f"{shared_dir(spark, 'orders')}{extension}"
    table = _t(spark, sf_dir, "orders").withColumn("o_note", F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit('say "'), F.col("o_orderstatus"), F.lit('", then'))))
    table.write.option("header", True).option("sep", "\t" if extension == ".tsv" else ",").option("escape", '"').csv(path)
    df, _ = load.load_any(spark, path)
    return df.select("o_orderkey", "o_custkey", "o_orderstatus", F.round("o_totalprice", 6).alias("o_totalprice"), "o_orderpriority", "o_note")


def load_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages``, whose cells hold line feeds, as delimited text, loaded from all its splits."""
    path = f"{shared_dir(spark, 'pages')}.csv"
    _t(spark, sf_dir, "pages").write.option("header", True).option("escape", '"').csv(path)
    df, _ = load.load_any(spark, path)
    return df.select("page_id", "url", F.md5("html").alias("html_md5"), F.length("html").alias("html_length"))


def target_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes by first appearance over two files, the second of which is the larger one."""
    base, df = shared_dir(spark, "orders"), _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    for name, part in (("a", F.col("o_orderkey") % 10 == 3), ("b", F.col("o_orderkey") % 10 != 3)):
        own, order = df.where(part), F.desc("o_orderkey")
        own.repartitionByRange(max(1, math.ceil(own.count() / FILE_ROWS)), order).sortWithinPartitions(order).write.option("header", True).csv(f"{base}/{name}.csv")
    rows, _, row = load.load_ordered(spark, f"{base}/*.csv")
    return target.framed(rows, "o_orderpriority", row, "multiclass").select("o_orderkey", "y")


def load_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, _ = load.load_any(spark, f"{sf_dir}/events.parquet")
    return df.select("event_id", "user_id", "event_type", F.round("value", 6).alias("value"))


def load_sav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as a system file, written and loaded by many tasks."""
    rows = _t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")).alias("p_size"), "p_retailprice")
    df, _ = spss.read(spark, spss.write(rows, f"{shared_dir(spark, 'part')}/part.sav"), split=1 << 14)
    return df.withColumn("p_retailprice", F.round("p_retailprice", 6))


def load_xlsx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``nation`` as a workbook, written and loaded."""
    rows = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey", (F.col("n_nationkey") / 4).alias("n_quarter"), (F.col("n_nationkey") % 2 == 0).alias("n_even"))
    df, _ = load.load_any(spark, xlsx.write(rows, f"{shared_dir(spark, 'nation')}.xlsx"))
    return df


def predictions_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predictions file, written in parts and read again: features, y_true, y_pred, y_score."""
    rows = _numbers(spark, sf_dir)
    raw = sum((w * F.col(c) for c, w in WEIGHTS.items()), F.lit(0.0))
    scored = rows.withColumns({"score": logistic(raw), "y": (F.col("o_orderkey") % 2).cast("int"), "split_pos": F.col("o_orderkey")}).withColumn("p", model.decided(F.col("score")))
    path = report.write_csv(report.predictions(scored, list(WEIGHTS)), f"{shared_dir(spark, 'predictions')}.csv", single=False)
    df, _ = load.load_any(spark, path)
    return _round(df, *WEIGHTS, "y_score", digits=8)


# without an oracle


def synth_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate(spark)


LINE_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")


def _lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Lines of orders with their numbers; what is to be learned is whether they are dear, and how dear (0, 1, 2)."""
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    df = _t(spark, sf_dir, "lineitem")
    df = df.select(
        F.xxhash64(*df.columns).alias("row"), *[F.col(c).cast("double").alias(c) for c in LINE_NUMBERS],
        (price > 40_000).cast("int").alias("y"), F.when(price < 20_000, 0).when(price < 60_000, 1).otherwise(2).alias("z"),
    )
    return split.stratified(df, "y", "row"), list(LINE_NUMBERS)


def gbt_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, features = _lines(spark, sf_dir)
    rows = materialise(rows, "lines")
    booster = model.fit(rows.where(~F.col("is_test")), features)
    return booster.score(rows.where("is_test")).select("row", "y", "p", "score")


def shap_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, features = _lines(spark, sf_dir)
    rows = materialise(rows, "lines")
    train = rows.where(~F.col("is_test"))
    booster = model.fit(train, features)
    found = explain.sampled(split.first_rows(rows.where("is_test"), "split_pos"), split.background(train, "row"), features, booster.score, "row")
    return explain.top(found, features)


def _halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the half of the year, which trees can learn exactly from the month, split and written."""
    rows = _numbers(spark, sf_dir).withColumn("y", (F.col("month") > 6).cast("int"))
    return materialise(split.stratified(rows, "y", "o_orderkey"), "halves")


def gbt_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on the training orders, all are told right, each with a probability on the right side."""
    rows = _halves(spark, sf_dir)
    found = model.fit(rows.where(~F.col("is_test")), list(WEIGHTS)).score(rows)
    return found.select("o_orderkey", "y", "p", (F.col("score") >= 0.5).alias("above"))


def cv_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folds' accuracies of Spark ML's learner and of the engine's own, on what both learn exactly."""
    parted = _halves(spark, sf_dir)
    rows = materialise(split.folds(parted, "y", "o_orderkey"), "folds")
    drop(parted)
    own = boosting.fit(rows, list(WEIGHTS), row_id="o_orderkey", uses=boosting.with_folds(~F.col("is_test"), F.col("fold"), split.FOLDS), models=1 + split.FOLDS)
    found = {"spark": model.cross_validate(rows, list(WEIGHTS)), "boosting": boosting.fold_accuracy(own, rows, F.col("fold"))}
    n = rows.count()
    return spark.createDataFrame([(k, n, x["cv5_accuracy_mean"], x["cv5_accuracy_std"]) for k, x in found.items()], "learner string, n_rows long, mean double, deviation double")


def raw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of a model without probabilities: through the logistic function, or as they are if all are 0 or 1."""
    raw = F.col("totalprice") - F.col("custkey")
    return _round(_numbers(spark, sf_dir).select("o_orderkey", model.raw_to_score(raw, False).alias("score"), model.raw_to_score((raw > 0).cast("double"), True).alias("plain")), "score")


def binarized_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", target.binarized(_gaps("event_id", "value")).alias("from_one"), target.binarized(F.col("value"), 50.0).alias("from_fifty"))


def boost_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out lines with the probabilities of three classes, from one ensemble that stops by itself."""
    rows, features = _lines(spark, sf_dir)
    rows = materialise(rows, "lines")
    fitted = boosting.fit(rows.where(~F.col("is_test")), features, "z", 3)
    found = fitted.probabilities(rows.where("is_test"))
    return found.select("row", "z", *[F.col("probabilities")[k].alias(f"p{k}") for k in range(3)])


def boost_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact Shapley values of a fitted ensemble, over all held-out lines and against all others."""
    rows, features = _lines(spark, sf_dir)
    rows = materialise(rows, "lines")
    train = rows.where(~F.col("is_test"))
    fitted = boosting.fit(train, features)
    return explain.top(explain.tree_importances(rows.where("is_test"), train, fitted.leaves(), features, "row"), features)


def _boosted_tree(node: tuple | float, edges: list[np.ndarray], tree: boosting.Tree, k: int = 0) -> boosting.Tree:
    if not isinstance(node, tuple):
        tree.value[k] = node
        return tree
    feature, threshold, left, right = node
    tree.feature[k] = list(oracles.EDGES).index(feature)
    tree.bin[k] = int(np.searchsorted(edges[tree.feature[k]], threshold))
    _boosted_tree(left, edges, tree, 2 * k + 1)
    return _boosted_tree(right, edges, tree, 2 * k + 2)


def boost_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gains of all splits of an order's numbers for its status, after trees that have been added to two of the three classes."""
    status = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    rows = _numbers(spark, sf_dir).join(_t(spark, sf_dir, "orders").select("o_orderkey", status.alias("y")), "o_orderkey")
    edges = [np.array(e, float) for e in oracles.EDGES.values()]
    start = boosting.start_of(rows, "y", 3)
    binned = boosting.binned(rows, list(oracles.EDGES), edges, "y", F.lit(1), "o_orderkey", start, held=0)
    before = [_boosted_tree(t, edges, boosting.Tree.empty(3)) for t in oracles.TREES] + [boosting.Tree.empty(3)]
    growing = boosting.Growing(1, 3, edges, since=[[before]], now=[[boosting.Tree.empty(1)] * 3], active=[True])
    found = boosting.gains(boosting.cells(binned, growing, 0)).where("node = 0")
    return found.select("output", "feature", "bin", F.col("nl").alias("n_left"), F.round(F.col("gain") / F.col("nt"), 8).alias("gain"))


PROFILED = ("lineitem", "orders", "customer", "part", "supplier", "events", "documents", "labels")


def queries() -> dict:
    found = {
        "mask_documents": partial(mask_texts, "documents", ["doc_id"], "text"),
        "mask_pages": partial(mask_texts, "pages", ["page_id"], "html"),
        "mask_conversations": partial(mask_texts, "conversations", ["conv_id", "turn"], "text"),
        "mask_hint_columns": partial(mask_hint_columns, "customer"),
        "mask_hint_supplier": partial(mask_hint_columns, "supplier"),
        "one_hot_priority": partial(one_hot, "orders", "o_orderkey", "o_orderpriority"),
        "one_hot_segment": partial(one_hot, "customer", "c_custkey", "c_mktsegment"),
        "load_csv": partial(load_delimited, ".csv"),
        "load_tsv": partial(load_delimited, ".tsv"),
    }
    found |= {f"profile_{t}": partial(profile_table, t) for t in PROFILED}
    found |= {f"column_types_{t}": partial(column_types, t) for t in PROFILED}
    plain = (
        pii_hits_by_label, pii_report, plan_steps, project_headers, impute_median, impute_mode, impute_mode_numeric, binary_strings, coerce_numeric,
        csv_types, one_hot_wide, level_names, load_csv_lines, target_of_files, load_sav, load_parquet, load_xlsx, predictions_csv, archive_kinds, run_demo, shap_exact, target_binary, target_binary_text, target_factorize, target_multiclass, target_auto, target_classes, stratified_split,
        split_counts, union_of_split, kfold_assign, background_sample, explain_rows, standard_scale, prepared_matrix, header_normalize, header_ngrams,
        header_tfidf, header_similarity, header_assignment, header_assignment_orders, model_selection, table_headers, table_header_weights, table_assignment, table_selection, table_registry, table_modalities,
        table_image_match, run_orders, run_report, run_without_model, command_line, table_embedder, run_images, format_kinds, gbt_halves, cv_halves, raw_scores, binarized_values, registry_scan, modality_catalogue,
        image_model_match, vector_cosine_topk, confusion_matrix, classification_metrics, macro_metrics, roc_auc, cv_accuracy, linear_shap_top10, tree_shap,
        predictions_output, file_kind, synth_generate, gbt_predictions, shap_sampled, boost_predictions, boost_importances, boost_gains,
    )
    return found | {f.__name__: f for f in plain}


def oracle_sql() -> dict[str, str]:
    return oracles.sql()
