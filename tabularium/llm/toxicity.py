"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other. Each has a logistic model over hashed features of a text, and
each later model also takes the earlier categories' probabilities. For training these come out of fold: a
document's are those of models that did not see its fold, so later models learn from probabilities of the
kind they will meet. Folds go by content, so copies share a fold. The verdict is that of the chain's last link.

Features are a text's distinct words and their beginnings of 4, 5 and 6 bytes, hashed to 2**20; a word is
a run of ASCII letters and digits and other than ASCII characters, lower case. Models are fitted on the driver with
per-coordinate steps and an L1 penalty, which leaves few weights other than 0.

The models are fitted on at most ``SAMPLE`` labelled rows, those with the smallest hashes of their ids; every
row is scored, from its whole text, in a single pass without a shuffle.

Defined results: a null text is empty and gets the intercepts' probabilities. A null label is 0. Documents
without a label are scored like others, rows with a null id as well. A category with one class among
the sampled rows gets its share as probability. Repeated rows each get their row; an empty table gives an
empty result. Other columns are not read by ``score``; ``reject`` keeps them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.llm.common import small_batches, table, trimmed
from tabularium.llm.hashing import ALPHANUMERIC, Words, slices

SAMPLE = 8_000
FOLDS = 5
BITS = 20
PREFIXES = (4, 5, 6)
#: Documents of the sample that a feature must occur in.
LEAST_DOCS = 4
#: Below one half, as a toxic document that is missed costs more than a clean one that is looked at.
THRESHOLD = 0.3
EPOCHS = 2


def categories() -> dict[str, Column]:
    """The categories that the labels table holds: in good prose; in poor text; any. The last one, which is the verdict's, takes the others' probabilities."""
    toxic, good = F.coalesce(F.col("toxic"), F.lit(0)) >= 1, F.coalesce(F.col("quality"), F.lit(0)) >= 1
    return {"toxic_prose": toxic & good, "toxic_junk": toxic & ~good, "toxic": toxic}


def features(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(document's place, feature) of every word and prefix of the texts, with repeats."""
    words = Words([(t or "").lower() for t in texts], ALPHANUMERIC)
    docs, found = [words.doc], [words.spans(words.start, words.end, 1)]
    for k in PREFIXES:
        longer = words.end - words.start > k
        docs.append(words.doc[longer])
        found.append(words.spans(words.start[longer], words.start[longer] + k, k))
    return np.concatenate(docs), (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)


def _distinct(texts: Sequence[str]) -> list[np.ndarray]:
    """Distinct features of each text."""
    out = []
    for a, b in slices(texts):
        doc, feature = features(texts[a:b])
        both = np.unique(doc << BITS | feature)
        at = np.searchsorted(both >> BITS, np.arange(b - a + 1))
        own = (both & (1 << BITS) - 1).astype(np.int32)
        out += [own[i:j] for i, j in zip(at, at[1:])]
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Linear:
    """Weights by feature number, weights of the earlier probabilities, intercept."""

    index: np.ndarray
    weights: np.ndarray
    chained: np.ndarray
    intercept: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.index] = self.weights
        return out


def _fit(rows: Sequence[np.ndarray], earlier: np.ndarray, y: np.ndarray, l1: float = 2.0, alpha: float = 0.5) -> Linear:
    """Logistic regression: follow the regularised leader, a step a document, L1 on the features only."""
    width = earlier.shape[1]
    share = min(max(float(np.mean(y)) if len(y) else 0.0, 1e-6), 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Linear(np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(width), base)
    n = 1 << BITS
    z, g2 = np.zeros(n + width + 1), np.zeros(n + width + 1)
    penalty = np.where(np.arange(n + width + 1) < n, l1, 0.0)
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for k in order.permutation(len(rows)):
            at = np.concatenate([rows[k], np.arange(n, n + width + 1)])
            value = np.concatenate([np.ones(len(rows[k])), earlier[k], [1.0]])
            zk, gk = z[at], g2[at]
            w = np.where(np.abs(zk) <= penalty[at], 0.0, -(zk - np.sign(zk) * penalty[at]) / ((1.0 + np.sqrt(gk)) / alpha))
            gradient = (_sigmoid(base + w @ value) - y[k]) * value
            grown = gk + gradient * gradient
            z[at] = zk + gradient - (np.sqrt(grown) - np.sqrt(gk)) / alpha * w
            g2[at] = grown
    w = np.where(np.abs(z) <= penalty, 0.0, -(z - np.sign(z) * penalty) / ((1.0 + np.sqrt(g2)) / alpha))
    index = np.flatnonzero(w[:n])
    return Linear(index, w[index].astype(np.float32), w[n : n + width], base + float(w[-1]))


def _predict(model: Linear, rows: Sequence[np.ndarray], earlier: np.ndarray) -> np.ndarray:
    weights = model.dense()
    sums = np.array([weights[r].sum() for r in rows]) if len(rows) else np.zeros(0)
    return _sigmoid(sums + earlier @ model.chained + model.intercept)


def fit_chain(texts: Sequence[str], labels: Sequence[np.ndarray], folds: int = FOLDS) -> list[Linear]:
    """A model for each category's labels, in order."""
    rows = _distinct(texts)
    seen = np.zeros(1 << BITS, np.int32)
    for r in rows:
        seen[r] += 1
    rows = [r[seen[r] >= LEAST_DOCS] for r in rows]
    fold = np.array([zlib.crc32((t or "").encode()) % folds for t in texts], np.int64)
    earlier, chain = np.zeros((len(rows), 0)), []
    for k, y in enumerate(labels):
        y = np.asarray(y, float)
        chain.append(_fit(rows, earlier, y))
        if k + 1 < len(labels):
            out = np.zeros(len(rows))
            for f in range(folds):
                inside, outside = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
                model = _fit([rows[i] for i in outside], earlier[outside], y[outside])
                out[inside] = _predict(model, [rows[i] for i in inside], earlier[inside])
            earlier = np.column_stack([earlier, out])
    return chain


def labelled_sample(docs: DataFrame, labels: DataFrame, classes: dict[str, Column], sample: int = SAMPLE) -> list:
    """At most ``sample`` rows (text, a 0/1 for each category), those whose ids hash smallest."""
    key = F.md5(F.col("doc_id").cast("string"))
    marked = labels.where(F.col("doc_id").isNotNull()).select("doc_id", *[c.cast("int").alias(n) for n, c in classes.items()])
    chosen = marked.orderBy(key, *classes).limit(sample)
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    joined = texts.join(F.broadcast(chosen), "doc_id")  # ``sample`` rows at most
    return joined.orderBy(key, F.md5("text"), *classes).limit(sample).select("text", *classes).collect()


def train(docs: DataFrame, labels: DataFrame, classes: dict[str, Column] | None = None, sample: int = SAMPLE) -> dict[str, Linear]:
    classes = classes or categories()
    rows = labelled_sample(docs, labels, classes, sample)
    models = fit_chain([r[0] for r in rows], [np.array([r[1 + k] or 0 for r in rows]) for k in range(len(classes))])
    return dict(zip(classes, models))


def _probabilities(texts: Sequence[str], models: Sequence[Linear]) -> list[np.ndarray]:
    used = np.zeros(1 << BITS, bool)
    for m in models:
        used[m.index] = True
    dense = [m.dense() for m in models]
    sums = np.zeros((len(models), len(texts)))
    for a, b in slices(texts):
        doc, feature = features(texts[a:b])
        hit = used[feature]
        both = np.unique(doc[hit] << BITS | feature[hit])
        for k, weights in enumerate(dense):
            sums[k, a:b] = np.bincount(both >> BITS, weights[both & (1 << BITS) - 1], b - a)
    out: list[np.ndarray] = []
    for k, m in enumerate(models):
        chained = sum((w * p for w, p in zip(m.chained, out)), np.zeros(len(texts)))
        out.append(_sigmoid(sums[k] + chained + m.intercept))
    return out


def score(docs: DataFrame, models: dict[str, Linear], text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep`` and p_<category> of each row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names, chain = [f"p_{n}" for n in models], list(models.values())
    kind = rows.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _probabilities(batch.column("text").to_pylist(), chain)
            yield pa.RecordBatch.from_arrays([batch.column("row"), *map(pa.array, found)], names=["row", *names])

    scored = rows.mapInArrow(lambda it: trimmed(run(it)), f"row {kind}, " + ", ".join(f"{n} double" for n in names))
    return scored.select("row.*", *names)


def is_toxic() -> Column:
    return F.col("p_toxic") >= THRESHOLD


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with their columns."""
    models = train(docs, labels)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("text").alias("text"))
    return score(held, models, keep=("__row",)).where(~is_toxic()).select("__row.*")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, models).withColumn("toxic", is_toxic())
