"""Profiles all columns in one pass and decides their types."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularium.functions.expressions import is_numeric, is_text, kind_of, quoted

BINARY, CATEGORICAL, NUMERICAL, TEXTUAL = "Binary", "Categorical", "Numerical", "Textual"

#: What is done with each type.
STEPS = {
    BINARY: ["impute_mode", "as_int"],
    CATEGORICAL: ["impute_mode", "one_hot_encode"],
    NUMERICAL: ["impute_median", "standard_scale"],
    TEXTUAL: ["drop_or_embed"],
}

NUMERIC_SHARE = 0.8
TEXT_LEVELS, TEXT_SHARE, TEXT_LENGTH = 20, 0.05, 25
NUMERIC_LEVELS = 20


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(pos, column, dtype, kind, n_rows, n_null, n_unique, avg_len) of each column.

    Cells are dealt by (column, value) after partial aggregation, so a column's distinct values are counted
    without an aggregate per column. A text's key is its length and, beyond ``WHOLE`` bytes, a 128-bit digest, so no long text is
    shuffled; texts of equal length and digest count as one. ``avg_len`` is the mean length of a text column's values, else null.
    """
    names = list(columns if columns is not None else df.columns)
    cells = [F.struct(F.lit(k).alias("pos"), *[v.alias(n) for n, v in zip(_PARTS, _typed_key(df, c))]) for k, c in enumerate(names)]
    counted = df.select(F.explode(F.array(*cells)).alias("x")).groupBy("x.pos", *[f"x.{n}" for n in _PARTS]).agg(F.count(F.lit(1)).alias("n"))
    known = reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in _PARTS])
    length = F.sum(F.col("size") * F.col("n"))
    found = counted.groupBy("pos").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("n_null"),
        F.count(F.when(known, 1)).alias("n_unique"),
        (length / F.sum(F.when(known, F.col("n")))).alias("mean"),
    )
    schema = "pos int, column string, dtype string, kind string"
    rows = [(k, c, kind_of(df, c).simpleString(), "text" if is_text(kind_of(df, c)) else "number" if is_numeric(kind_of(df, c)) else "other") for k, c in enumerate(names)]
    listed = df.sparkSession.createDataFrame(rows, schema)
    zero = F.lit(0).cast("long")
    joined = listed.join(found, "pos", "left")
    return joined.select("pos", "column", "dtype", "kind", *[F.coalesce(n, zero).alias(n) for n in ("n_rows", "n_null", "n_unique")], F.when(F.col("kind") == "text", F.col("mean")).alias("avg_len"))


def approximate(df: DataFrame, columns: Sequence[str] | None = None, error: float = 0.01) -> DataFrame:
    """(pos, column, n_rows, n_null, n_unique) with estimated distinct counts and no shuffle of values; not for typing, which compares exact counts."""
    names = list(columns if columns is not None else df.columns)
    stats = [F.struct(F.lit(k).alias("pos"), F.lit(c).alias("column"), F.count(F.lit(1)).alias("n_rows"), F.sum(_key(df, c).isNull().cast("long")).alias("n_null"), F.approx_count_distinct(_key(df, c), error).alias("n_unique")) for k, c in enumerate(names)]
    return df.agg(F.array(*stats).alias("x")).select(F.explode("x").alias("x")).select("x.*")


#: A cell's value is in one of these, by its type, so that numbers need not become texts; of a text they are its length and key.
_PARTS = ("whole", "real", "size", "text")
#: Bytes of a text up to which it is its own key.
WHOLE = 16


def _typed_key(df: DataFrame, name: str) -> tuple[Column, Column, Column, Column]:
    kind, column = kind_of(df, name).simpleString(), F.col(quoted(name))
    none = [F.lit(None).cast(t) for t in ("long", "double", "int", "binary")]
    if kind in ("tinyint", "smallint", "int", "bigint", "boolean"):
        return column.cast("long"), *none[1:]
    if kind in ("float", "double"):
        return none[0], F.when(~F.isnan(column), column.cast("double") + 0.0), *none[2:]
    text = _key(df, name)
    raw = text.cast("binary")
    return none[0], none[1], F.length(text), F.when(F.octet_length(raw) <= WHOLE, raw).otherwise(F.unhex(F.md5(raw)))


def _key(df: DataFrame, name: str) -> Column:
    """A text that is equal for equal values; NaN is null."""
    kind = kind_of(df, name).simpleString()
    column = F.col(quoted(name))
    if kind in ("float", "double"):
        return F.when(~F.isnan(column), column + 0.0).cast("string")
    if kind == "binary":
        return F.hex(column)
    return F.to_json(F.struct(column)) if kind.startswith(("array", "map", "struct")) else column.cast("string")


def column_type(kind: Column, n_rows: Column, n_unique: Column, avg_len: Column) -> Column:
    few_words = (n_unique <= F.greatest(F.lit(float(TEXT_LEVELS)), TEXT_SHARE * n_rows)) & (F.coalesce(avg_len, F.lit(float("inf"))) <= TEXT_LENGTH)
    return (
        F.when(n_unique == 2, BINARY)
        .when((kind == "number") & (n_unique > NUMERIC_SHARE * n_rows), NUMERICAL)
        .when((kind == "text") & few_words, CATEGORICAL)
        .when(kind == "text", TEXTUAL)
        .when((kind == "number") & (n_unique <= NUMERIC_LEVELS), CATEGORICAL)
        .otherwise(NUMERICAL)
    )


def typed(profiled: DataFrame) -> DataFrame:
    """Adds ``type``."""
    return profiled.withColumn("type", column_type(*(F.col(c) for c in ("kind", "n_rows", "n_unique", "avg_len"))))


def planned(types: DataFrame) -> DataFrame:
    """Adds ``steps``, in order."""
    steps = F.create_map(*[x for t, s in STEPS.items() for x in (F.lit(t), F.array(*map(F.lit, s)))])
    return types.withColumn("steps", F.element_at(steps, F.col("type")))


def project(df: DataFrame, headers: Sequence[str], target: str | None) -> DataFrame:
    """The headers and the target that the table has; all columns if it has none of them."""
    names = [c for c in headers if c in df.columns]
    if target and target in df.columns and target not in names:
        names.append(target)
    return df.select(*[F.col(quoted(c)) for c in names]) if names else df
