"""What a run leaves: predictions, a report file and a summary on the console."""

from __future__ import annotations

import csv
import io
import json
import os
import shutil
from collections.abc import Sequence
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.functions.expressions import quoted, unused
from tabularium.functions.storage import is_local, put

if TYPE_CHECKING:
    from tabularium.plans.pipeline import Run


def predictions(scored: DataFrame, features: Sequence[str], names: dict[str, str] | None = None) -> DataFrame:
    """The scaled features, under ``names`` if given, y_true, y_pred and y_score at 4 digits, in the split's order. A name that is taken gets an underscore in front."""
    taken, columns = ["y_true", "y_pred", "y_score"], []
    for c in features:
        taken.append(unused((names or {}).get(c, c), taken))
        columns.append(F.col(quoted(c)).alias(taken[-1]))
    return scored.orderBy("split_pos", "y").select(*columns, F.col("y").alias("y_true"), F.col("p").alias("y_pred"), F.round("score", 4).alias("y_score"))


def write_csv(df: DataFrame, path: str, single: bool | None = None) -> str:
    """CSV with a header: ``single`` makes one file on the driver's disk, else a folder of parts is written to whatever store ``path`` is in.

    By default it is one file where driver and executors are one process and ``path`` names no store. Parts are written side by side and
    keep the table's order; one file is their concatenation.
    """
    spark = df.sparkSession
    if single is None:
        single = "://" not in path and is_local(spark)
    if not single:
        df.write.mode("overwrite").option("header", True).csv(path)
        return path
    if not is_local(spark):
        raise ValueError("one file on the driver's disk needs a session in one process; write parts")
    path = os.path.abspath(path)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    parts = f"{path}.parts"
    df.write.mode("overwrite").option("header", False).csv(f"file://{parts}")
    with open(path, "wb") as out:
        head = io.StringIO()
        csv.writer(head, lineterminator="\n").writerow(df.columns)
        out.write(head.getvalue().encode())
        for name in sorted(n for n in os.listdir(parts) if n.startswith("part-")):
            with open(os.path.join(parts, name), "rb") as part:
                shutil.copyfileobj(part, out)
    shutil.rmtree(parts)
    return path


def save_predictions(scored: DataFrame, features: Sequence[str], folder: str, names: dict[str, str] | None = None) -> str:
    return write_csv(predictions(scored, features, names), os.path.join(folder, "predictions.csv"))


def save(run: Run, folder: str, spark: SparkSession | None = None) -> str:
    """Writes the report to the driver's disk, or with a session to whatever store the folder names."""
    if "://" in folder and spark is not None:
        return put(spark, f"{folder.rstrip('/')}/pipeline_report.json", json.dumps(run.report(), indent=2, default=str).encode())
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, "pipeline_report.json")
    with open(path, "w", encoding="utf-8") as file:
        json.dump(run.report(), file, indent=2, default=str)
    return path


def lines(run: Run) -> list[str]:
    out = ["", "Stages"]
    for step in run.trace:
        out.append(f"  {step['agent']:<12} {step['status']:<8} {step.get('seconds', 0):>9.4f} s  {step.get('detail', '')}")
    out.append(f"  {'total':<21} {sum(s.get('seconds', 0) for s in run.trace):>9.4f} s")
    out += ["", "Decisions"]
    decisions = {
        "kind of data": run.data_kind,
        "file types": run.file_types,
        "masked columns": list(run.anonymization.get("masked_columns", {})),
        "personal data": run.anonymization.get("detected_types"),
        "model": run.selected_model,
        "target": f"{run.target} ({run.n_classes} classes)",
        "headers": run.valid_headers,
    }
    out += [f"  {k:<15} {v}" for k, v in decisions.items()]
    if run.match_report.get("per_model"):
        out += ["", "Headers matched"]
        out += [f"  {m}: {x['n_matched']} of {x['n_required']}{', eligible' if x['eligible'] else ''}" for m, x in run.match_report["per_model"].items()]
    for title, found in (("Column types", run.column_types), ("Metrics on the test rows", run.metrics)):
        if found:
            out += ["", title, *[f"  {k:<28} {v}" for k, v in found.items()]]
    if run.explanations.get("top10"):
        out += ["", "Most important features"]
        out += [f"  {k:>2}. {name:<30} {value}" for k, (name, value) in enumerate(run.explanations["top10"], 1)]
    elif run.explanations:
        out += ["", f"Importances: {run.explanations}"]
    if run.predictions_path:
        out += ["", f"Predictions: {run.predictions_path}"]
    return out
