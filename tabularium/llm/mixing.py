"""Mixing sources to target weights.

Every document gets a hash-random key (an MD5 of seed and id). The leading hex digits of the key are a range
partitioning of each source in key order, so a running sum inside a range plus the sum of the ranges before
it is the document's place in the source's random order: a distributed prefix sum with no task that holds a
source. Each source is cut at its exact budget of words; where the budget exceeds the source, whole epochs
come first and the rest is cut from the same order.

Targets fill up by weight: a source stops at ``epochs`` times its size and the excess is shared by weight
among the rest until none is above. With the sources in order of cap over weight, those that stop are a
prefix, which running sums over the table of sources find without a loop. That table has a row for each source and is
held by one task: sources are names, some millions of them at most.

Defined results: a null text has no words; a null source is a source of its own, last in order; a null id
hashes as the text "null"; rows with equal keys go by id, size and a hash of the text. Sources without words have target 0. An empty
table gives an empty result. Repeated ids are separate documents. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabularium.llm.common import WORD, materialise, reserved, same_rows, table

SEED = "mix"
WEIGHTS = (5, 2, 1)
EPOCHS = 3
#: Hex digits of the key that make a range: 16 ** 3 ranges a source.
RANGE_DIGITS = 3


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """``sizes`` has (source, source_size), a row per source. Adds target and the integral budget."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    cap = F.lit(epochs) * F.col("source_size")
    ordered = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    after = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = Window.partitionBy()
    level = (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    filled = sizes.withColumn("weight", weight).withColumn("cap", cap).withColumn("full", F.col("cap") / F.col("weight") <= level)
    rest = F.sum("source_size").over(all_rows) - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(all_rows)
    open_weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(all_rows)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * (rest / open_weight))
    return filled.withColumn("target", target).select("source", "source_size", "target", F.least(F.floor(F.col("target") + 0.5), F.col("cap")).alias("budget"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED, keep: Sequence[Column] = ()) -> DataFrame:
    """(id, source, key, size, source_size, target, taken) of each row, and the columns in ``keep``."""
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), key.alias("key"), words_in(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("__tie"), *keep)
    rows = materialise(rows, "mix-rows")
    named = rows.withColumn("null_source", F.col("source").isNull()).withColumn("name", F.coalesce("source", F.lit(""))).withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    ranges = named.groupBy("null_source", "name", "range").agg(F.sum("size").alias("range_size"))
    targets = materialise(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs), "mix-targets")
    targets = targets.withColumn("null_source", F.col("source").isNull()).withColumn("name", F.coalesce("source", F.lit(""))).drop("source")
    earlier = Window.partitionBy("null_source", "name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("null_source", "name", "range", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("null_source", "name", "range").orderBy("key", F.col("id").asc_nulls_last(), "size", "__tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = named.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["null_source", "name", "range"]).join(targets, ["null_source", "name"])
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(F.lit(0))
    left = F.col("budget") - whole * F.col("source_size") - F.col("offset") - F.col("inside")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return placed.select("id", "source", "key", "size", "source_size", "target", taken.cast("long").alias("taken"), *[c for c in rows.columns if c not in ("id", "source", "key", "size", "__tie")])


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mixture as rows of ``docs``: a document comes once for every epoch that takes it.

    Texts are not cut: the one document a source's budget ends in is taken whole, so that a source exceeds
    its target by less than that document. Documents without words carry nothing and are not taken. Columns of the names ``__row``, ``__id``,
    ``__copies``, ``__copy`` and ``__tie`` are an error, as are rows that a second scan numbers otherwise.
    """
    reserved(docs, ["__row", "__id", "__copies", "__copy", "__tie"])
    numbered = docs.withColumn("__row", F.monotonically_increasing_id())
    taken = mix(numbered, id_col, source_col, text_col, keep=[F.col("__row")], **options)
    copies = taken.where("taken > 0").select("__row", F.col("id").alias("__id"), F.ceil(F.col("taken") / F.col("size")).cast("int").alias("__copies"))
    joined = numbered.join(copies, "__row").where(same_rows(F.col(id_col), F.col("__id")))
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(concat('mix|', coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(3 * sum(size) AS BIGINT) AS cap,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM d GROUP BY source
), f AS (
  SELECT *, cap / weight <= (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS is_full
  FROM s
), t AS (
  SELECT *, CASE WHEN is_full THEN CAST(cap AS DOUBLE)
                 ELSE weight * ((sum(source_size) OVER () - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ())
                                / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ()) END AS target
  FROM f
), b AS (SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), cap) AS budget FROM t),
p AS (
  SELECT d.doc_id, d.source, d.size, b.source_size, b.target, b.budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id NULLS LAST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN b.source_size > 0 THEN b.budget // b.source_size ELSE 0 END AS whole
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, source, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, budget - whole * source_size - before)) AS BIGINT) AS taken
FROM p
"""
