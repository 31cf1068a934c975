"""The run from a file or a table to metrics, predictions and importances.

A run is a fixed list of stages. A stage takes the run's state and returns what it adds; the state holds lazy tables and
small results, and each table is a new plan. From the preparation on, the table's columns are called c0, c1, ... inside, as names of columns may be
those of the run's own (row, y, is_test, split_pos, fold, p, score). Tables that are read again are written to the shared folder, so that a lost executor costs no stage. The stages' times, outcomes and failures make the trace.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.functions import storage
from tabularium.functions.expressions import quoted
from tabularium.operators import anonymize, boosting, explain, match, metrics, model, prepare, profile, split, target
from tabularium.sources import identify, load
from tabularium.sources.registry import Registry

Vision = Callable[[str, str], str]


@dataclass
class Run:
    input_path: str | None = None
    file_types: dict[str, str] = field(default_factory=dict)
    data_kind: str | None = None
    table: DataFrame | None = None
    row_id: str | None = None
    anonymization: dict = field(default_factory=dict)
    image_paths: list[str] = field(default_factory=list)
    headers: list[str] = field(default_factory=list)
    image_modality: str | None = None
    image_disease: str | None = None
    matches: match.Matches | None = None
    match_report: dict = field(default_factory=dict)
    selected_model: str | None = None
    valid_headers: list[str] = field(default_factory=list)
    column_types: dict[str, str] = field(default_factory=dict)
    preprocessing_plan: dict = field(default_factory=dict)
    inner: dict[str, str] = field(default_factory=dict)
    matrix: DataFrame | None = None
    plan: prepare.Plan | None = None
    target: str | None = None
    target_mode: str = "auto"
    n_classes: int | None = None
    metrics: dict = field(default_factory=dict)
    predictions_path: str | None = None
    explanations: dict = field(default_factory=dict)
    trace: list[dict] = field(default_factory=list)

    def shown(self) -> dict[str, str]:
        """The features' names outside the run: the column's, with the level of one that is encoded."""
        outer = {n: c for c, n in self.inner.items()}
        source = self.plan.source
        return {f: outer[source.get(f, f)] + f[len(source.get(f, f)) :] for f in [*self.plan.features, *self.plan.columns]}

    def report(self) -> dict:
        """What is saved of a run."""
        return {
            "data_kind": self.data_kind,
            "file_types": self.file_types,
            "selected_model": self.selected_model,
            "target": self.target,
            "n_classes": self.n_classes,
            "valid_headers": self.valid_headers,
            "column_types": self.column_types,
            "anonymization": self.anonymization,
            "match_report": self.match_report,
            "metrics": self.metrics,
            "explanations": self.explanations,
            "trace": self.trace,
        }


class Pipeline:
    """``impute_scope``: ``all`` takes fills and levels from all rows, ``train`` from the training rows.

    ``learner``: ``spark``, Spark ML's boosted trees, ``trees`` of them, or ``boosting``, the engine's own, which stops by itself and fits the model and those of
    the cross-validation together. ``embedder`` takes the place of the matcher's n-gram weights; ``vision`` answers a prompt on an image.
    """

    def __init__(self, spark: SparkSession, output_dir: str = ".", threshold: float = match.THRESHOLD, explain: bool = True, test_size: float = 0.2, random_state: int = 42, registry: Registry | None = None, embedder: match.Embedder | None = None, vision: Vision | None = None, impute_scope: str = "all", trees: int = 20, learner: str = "spark") -> None:
        if impute_scope not in ("all", "train"):
            raise ValueError("impute_scope is all or train")
        if learner not in ("spark", "boosting"):
            raise ValueError("learner is spark or boosting")
        self.spark, self.output_dir, self.threshold, self.explain = spark, output_dir, threshold, explain
        self.test_size, self.seed, self.registry = test_size, random_state, registry or Registry()
        self.embedder, self.vision, self.impute_scope, self.trees, self.learner = embedder, vision, impute_scope, trees, learner
        self.stages: list[tuple[str, Callable[[Run], str]]] = [
            ("identify", self._identify),
            ("anonymize", self._anonymize),
            ("features", self._features),
            ("match", self._match),
            ("recommend", self._recommend),
            ("prepare", self._prepare),
            ("infer", self._infer),
        ]

    def run(self, input_path: str | None = None, table: DataFrame | None = None, force_target: str | None = None, target_mode: str = "auto", image_paths: list[str] | None = None, row_id: str | None = None) -> Run:
        """Runs all stages. A table without a model it matches ends the run early, which is not an error. ``row_id`` names a column of a given table that tells its order.

        A failure is traced and the report saved before it is raised.
        """
        out = Run(input_path=input_path, table=table, row_id=row_id, target=force_target, target_mode=target_mode, image_paths=image_paths or [])
        for name, stage in self.stages:
            began = time.perf_counter()
            entry = {"agent": name, "status": "ok", "seconds": 0.0, "detail": ""}
            out.trace.append(entry)
            try:
                entry["detail"] = stage(out)
            except Exception as error:
                from tabularium.plans.report import save

                entry |= {"status": "error", "detail": f"{type(error).__name__}: {error}"}
                entry["seconds"] = round(time.perf_counter() - began, 4)
                save(out, self.output_dir, self.spark)
                raise
            entry["seconds"] = round(time.perf_counter() - began, 4)
            if name == "match" and out.selected_model is None and out.data_kind == "tabular":
                out.trace.append({"agent": "pipeline", "status": "halted", "detail": "no model is matched in full"})
                break
        return out

    def _identify(self, run: Run) -> str:
        if run.input_path is None:
            run.data_kind = "tabular"
            return "a table in memory"
        kinds = identify.file_kinds(self.spark, run.input_path)
        run.file_types = {r.name: r.label for r in kinds.select("name", "label").collect()}  # names in one file
        run.data_kind = identify.route(run.file_types.values(), run.input_path)
        return f"{run.data_kind}: {', '.join(sorted(set(run.file_types.values())))}"

    def _anonymize(self, run: Run) -> str:
        if run.data_kind == "image":
            run.anonymization = anonymize.image_report(run.image_paths)
            return f"{len(run.image_paths)} images"
        if run.table is None:
            run.table, _, run.row_id = load.load_ordered(self.spark, run.input_path)
        run.table, found = anonymize.anonymize(run.table, run.row_id)
        run.anonymization = found.as_dict()
        return f"{len(found.masked_columns)} columns masked; {', '.join(found.detected_types) or 'nothing found'}"

    def _features(self, run: Run) -> str:
        if run.data_kind == "image":
            run.image_modality, run.image_disease = describe_image(self.registry, run.image_paths, self.vision)
            return f"{run.image_modality}; {run.image_disease}"
        run.headers = [c for c in run.table.columns if c != run.row_id]
        return f"{len(run.headers)} headers"

    def _match(self, run: Run) -> str:
        if run.data_kind == "image":
            candidates = [m.name for m in self.registry.images() if m.modality == run.image_modality]
            run.selected_model = min(candidates, default=None)
            run.match_report = {"candidates": candidates, "chosen": run.selected_model, "modality": run.image_modality, "disease": run.image_disease}
            return f"chosen: {run.selected_model}"
        run.matches = match.match(self.spark, run.headers, self.registry, self.threshold, run.target, self.embedder)
        run.match_report, run.selected_model = run.matches.as_dict(), run.matches.chosen
        run.valid_headers, run.target = run.matches.valid_headers, run.matches.target
        return f"chosen: {run.selected_model}, {len(run.valid_headers)} headers"

    def _recommend(self, run: Run) -> str:
        if run.data_kind == "image":
            run.preprocessing_plan = {"mode": "model_coupled", "note": "the image model brings its own transforms"}
            return "left to the image model"
        if run.row_id is None:
            run.table, run.row_id = load.with_row_id(run.table)
        run.table = profile.project(run.table, [*run.valid_headers, *([] if run.valid_headers else run.headers), run.row_id], run.target)
        names = [c for c in run.table.columns if c not in (run.target, run.row_id)]
        found = profile.planned(profile.typed(profile.profile(run.table, names))).orderBy("pos").collect()  # a row for each column
        run.column_types = {r.column: r.type for r in found}
        run.preprocessing_plan = {"mode": "tabular", "steps": {r.column: r.steps for r in found}, "metadata": {r.column: {"dtype": r.dtype, "n_null": r.n_null, "n_unique": r.n_unique} for r in found}}
        return f"{len(found)} columns typed"

    def _prepare(self, run: Run) -> str:
        if run.data_kind == "image":
            return "left to the image model"
        target.checked(run.table, run.target)
        run.inner = {c: f"c{k}" for k, c in enumerate(run.table.columns) if c != run.row_id}
        table = run.table.select(F.col(quoted(run.row_id)).alias("row"), *[F.col(quoted(c)).alias(n, metadata=run.table.schema[c].metadata) for c, n in run.inner.items()])
        meta = run.preprocessing_plan["metadata"]
        table = prepare.marked(table, {run.inner[c]: m["n_null"] for c, m in meta.items()})
        table = storage.materialise(target.framed(table, run.inner[run.target], "row", run.target_mode), "framed")
        run.n_classes = target.n_classes(table)
        parted = rows = storage.materialise(split.stratified(table, "y", "row", self.test_size, self.seed), "parted")
        scope = ~F.col("is_test") if self.impute_scope == "train" else None
        run.plan = prepare.fitted(rows, {run.inner[c]: t for c, t in run.column_types.items()}, scope)
        own = ("row", "y", "is_test", "split_pos")
        rows = prepare.applied(rows, run.plan, keep=own)
        if not run.plan.features:
            run.plan.features = [c for c in rows.columns if c not in own]
        run.plan = prepare.scale_fitted(rows, run.plan, ~F.col("is_test"))
        scaled = storage.materialise(prepare.scaled(rows, run.plan), "scaled")  # as places of folds take it more than once
        run.matrix = storage.materialise(split.folds(scaled, "y", "row"), "matrix")
        run.metrics = {r[0]: r[1] for r in run.matrix.groupBy(F.when(F.col("is_test"), "n_test").otherwise("n_train")).count().collect()}
        storage.drop(table, parted, scaled)
        return f"{run.metrics.get('n_train', 0)} rows to train, {run.metrics.get('n_test', 0)} to test, {run.plan.n_features} features, {run.n_classes} classes"

    def _infer(self, run: Run) -> str:
        if run.data_kind == "image":
            run.metrics = {"note": "image inference is left to the image model"}
            return "left to the image model"
        from tabularium.plans.report import save_predictions

        train, test, features = run.matrix.where(~F.col("is_test")), run.matrix.where("is_test"), run.plan.columns
        if self.learner == "boosting":
            booster = boosting.fit(run.matrix, features, "y", run.n_classes, uses=boosting.with_folds(~F.col("is_test"), F.col("fold"), split.FOLDS), models=1 + split.FOLDS)
        else:
            booster = model.fit(train, features, "y", run.n_classes, self.trees, wide=run.plan.wide)
        scored = storage.materialise(booster.score(test), "scored")
        run.metrics = {"n_train": run.metrics.get("n_train", 0), "n_test": run.metrics.get("n_test", 0), "n_features": run.plan.n_features, "learner": boosting.LEARNER if self.learner == "boosting" else model.LEARNER}
        run.metrics |= metrics.evaluate(scored, run.n_classes)
        if self.learner == "boosting":
            run.metrics |= boosting.fold_accuracy(booster, run.matrix, F.col("fold"))
        else:
            run.metrics |= model.cross_validate(run.matrix, features, "fold", "y", run.n_classes, trees=self.trees, wide=run.plan.wide)
        run.predictions_path = save_predictions(scored, features, self.output_dir, run.shown())
        run.explanations = self._explained(run, booster) if self.explain else {"method": "Shapley", "note": "skipped"}
        storage.drop(scored)
        return f"accuracy {run.metrics['accuracy']}, f1 {run.metrics['f1']}, auc {run.metrics['roc_auc']}"

    def _explained(self, run: Run, booster: model.Booster) -> dict:
        try:
            train, test = run.matrix.where(~F.col("is_test")), run.matrix.where("is_test")
            rows, pool = split.first_rows(test, "split_pos"), split.background(train, "row")
            fill = {c: float(n) for c, n in run.plan.wide.items()}
            found = storage.materialise(explain.tree_importances(rows, pool, booster.leaves(), run.plan.columns, "row", fill), "importances")
            best = explain.top(found, run.plan.columns).orderBy("rank").collect()
            names = list(dict.fromkeys(run.plan.source.get(f, f) for f in run.plan.columns))
            summed = explain.top(explain.by_source(found, run.plan.source), names).orderBy("rank").collect()
            shown, outer = run.shown(), {n: c for c, n in run.inner.items()}
            return {"method": "Shapley", "top10": [(shown[r.feature], r.importance) for r in best], "top10_columns": [(outer[r.feature], r.importance) for r in summed]}
        except Exception as error:
            return {"method": "Shapley", "error": str(error)}


def describe_image(registry: Registry, image_paths: list[str], vision: Vision | None) -> tuple[str, str]:
    """Modality and disease of the first image, from two prompts; fixed answers without a model or an image."""
    if vision is None or not image_paths:
        return "colon colonoscopy scan", "Polyp"
    modality = vision(f"Which one of these modalities does the image show? {registry.modalities()}", image_paths[0]).strip()
    caption = next((m.caption for m in registry.images() if m.modality == modality), "")
    return modality, vision(f"The modality is {modality!r} ({caption}). Name the disease that the image shows.", image_paths[0]).strip()


def default_output(name: str, folder: str) -> str:
    return os.path.join(folder, name)
