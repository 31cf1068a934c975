"""A linear model that tells text formats apart by their bytes, to be given to ``identify.file_kinds`` as ``label``.

It learns from tables that are at hand: groups of rows are written in each format by Spark's own functions, so the texts of a format
have the values of real tables and differ in how these are laid out. A text's features are its counts of runs of one to three bytes, hashed to
``SIZE`` places, over its first ``BYTES``; Spark ML fits a softmax model to them. What is binary is told by its first bytes, as by the rules of ``identify``,
and so is what is empty.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularium.functions.expressions import quoted
from tabularium.functions.ship import ship
from tabularium.sources.identify import classify

SIZE, BYTES = 4096, 2048
#: Rows of a table in one text, and texts of each format that the model is fitted to at most, from each table: those whose rows hash smallest.
ROWS, TEXTS = 12, 200
FORMATS = ("csv", "tsv", "jsonl", "json", "xml", "html", "txt")


def features(texts: Sequence[bytes]) -> np.ndarray:
    """A row of unit length for each text: logarithms of the counts of its hashed runs of bytes."""
    out = np.zeros((len(texts), SIZE))
    for row, text in enumerate(texts):
        x = np.frombuffer(text[:BYTES], np.uint8).astype(np.uint32)
        for n, key in ((1, x), (2, x[:-1] * 257 + x[1:]), (3, (x[:-2] * 257 + x[1:-1]) * 257 + x[2:])):
            if len(x) >= n:
                out[row] += np.bincount(((key * np.uint32(2654435761) + np.uint32(n * 40503)) >> 20).astype(np.int64), minlength=SIZE)
    out = np.log1p(out)
    size = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(size == 0, 1, size)


@dataclass(frozen=True)
class Kinds:
    """A fitted model; called with a file's first bytes it gives the label."""

    labels: tuple[str, ...]
    weights: np.ndarray
    intercepts: np.ndarray

    def __call__(self, data: bytes) -> str:
        by_rules = classify(data)
        if by_rules not in FORMATS:
            return by_rules
        return self.labels[int((self.weights @ features([data])[0] + self.intercepts).argmax())]


def _tagged(columns: Sequence[str], outer: str, inner: str | None) -> Column:
    """The cells of a row in tags; without ``inner`` each has its column's name."""
    cells = []
    for c in columns:
        text = F.coalesce(F.col(quoted(c)).cast("string"), F.lit(""))
        for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            text = F.replace(text, F.lit(plain), F.lit(safe))
        cells += [F.lit(f"<{inner or c}>"), text, F.lit(f"</{inner or c}>")]
    return F.concat(F.lit(f"<{outer}>"), *cells, F.lit(f"</{outer}>"))


def samples(table: DataFrame, rows: int = ROWS, most: int | None = None) -> DataFrame:
    """(part, label, content): groups of about ``rows`` rows in every format. ``part`` is a number from 0 to 9 by which groups can be held out.

    The groups are those with the least numbers among all, ``most`` of them if given.
    """
    names = table.columns
    n = max(1, table.count() // rows)
    group = F.pmod(F.xxhash64(*[F.col(quoted(c)) for c in names]), F.lit(n))
    kept = table.withColumn("__group", group).where(F.col("__group") < (n if most is None else min(n, most)))
    own = F.struct(*[F.col(quoted(c)) for c in names])
    prose = F.concat_ws(" ", *[F.concat(F.lit(f"The {c.replace('_', ' ')} is "), F.col(quoted(c)).cast("string"), F.lit(".")) for c in names])
    lines = {"csv": F.to_csv(own), "tsv": F.to_csv(own, {"sep": "\t"}), "json": F.to_json(own), "xml": _tagged(names, "row", None), "html": _tagged(names, "tr", "td"), "txt": prose}
    held = kept.groupBy("__group").agg(*[F.collect_list(F.substring(line, 1, BYTES)).alias(k) for k, line in lines.items()])  # a group has a few rows, of which the model sees as many bytes
    head = lambda sep: F.concat(F.lit(sep.join(names)), F.lit("\n"))
    whole = {
        "csv": F.concat(head(","), F.array_join("csv", "\n")),
        "tsv": F.concat(head("\t"), F.array_join("tsv", "\n")),
        "jsonl": F.array_join("json", "\n"),
        "json": F.concat(F.lit("[\n  "), F.array_join("json", ",\n  "), F.lit("\n]")),
        "xml": F.concat(F.lit('<?xml version="1.0"?>\n<rows>'), F.array_join("xml", "\n"), F.lit("</rows>")),
        "html": F.concat(F.lit("<!DOCTYPE html>\n<html><body><table>"), F.array_join("html", "\n"), F.lit("</table></body></html>")),
        "txt": F.array_join("txt", "\n"),
    }
    texts = F.array(*[F.struct(F.lit(k).alias("label"), whole[k].cast("binary").alias("content")) for k in FORMATS])
    return held.select((F.pmod(F.xxhash64("__group", F.lit(7)), F.lit(10))).cast("int").alias("part"), F.explode(texts).alias("x")).select("part", "x.label", "x.content")


def fit(texts: DataFrame, penalty: float = 1e-4) -> Kinds:
    """The model of texts (label, content)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column("content").to_pylist())
            ends = pa.array(np.arange(0, x.size + 1, SIZE, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=["y", "x"])

    ship(texts.sparkSession)
    labels = tuple(sorted(r[0] for r in texts.select("label").distinct().collect()))  # formats
    numbered = texts.select((F.array_position(F.array(*map(F.lit, labels)), F.col("label")) - 1).cast("double").alias("y"), "content")
    rows = numbered.mapInArrow(run, "y double, x array<double>").select("y", array_to_vector("x").alias("x"))
    model = LogisticRegression(featuresCol="x", labelCol="y", regParam=penalty, family="multinomial", maxIter=60).fit(rows)
    return Kinds(labels, model.coefficientMatrix.toArray(), model.interceptVector.toArray())


def judged(texts: DataFrame, model: Kinds) -> DataFrame:
    """(label, n, right, right_by_rules): how many of the texts the model and the rules tell right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = batch.column("content").to_pylist()
            cells = [batch.column("label"), pa.array([model(x) for x in content], pa.string()), pa.array([classify(x) for x in content], pa.string())]
            yield pa.RecordBatch.from_arrays(cells, names=["label", "told", "by_rules"])

    ship(texts.sparkSession)
    told = texts.mapInArrow(run, "label string, told string, by_rules string")
    return told.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("told") == F.col("label")).alias("right"), F.count_if(F.col("by_rules") == F.col("label")).alias("right_by_rules"))
