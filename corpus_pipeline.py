"""A corpus pipeline over ``documents``: each stage takes all that the one before it kept.

Each stage's result is written as Parquet in the shared folder and read again as the next one's documents. All but the last
return the columns of documents. Toxic documents go; of equal texts one stays; of each group of near copies one
stays; sources are mixed to their weights, whole documents once for every epoch that takes them; the last
stage returns the tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.llm import bpe, exact_dedup, jaccard_join, mixing, toxicity
from tabularium.llm.common import Scope, materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of each row; ids are little-endian unsigned 32-bit integers."""
    encoded = bpe.encode(docs, outputs=("ids", "ids_sha256", "decoded_sha256"))
    return encoded.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL has no counterpart of the classifier and of the tokenizer; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has written but for its result, and the result before it, are deleted when the stage is done."""
    docs, scope = table(spark, sf_dir, "documents"), Scope()
    for name, stage in STAGES[:-1]:
        with scope:
            docs = materialise(stage(spark, docs, sf_dir), name)
        scope.clear(keep=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
