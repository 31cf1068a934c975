"""Frames the target column as classes 0, 1, ... ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabularium.functions.expressions import is_text, is_time, kind_of, quoted, to_number, unused

MODES = ("auto", "binary", "multiclass")


def checked(df: DataFrame, target: str) -> None:
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not in data; columns: {', '.join(df.columns)}")
    if is_time(kind_of(df, target)):
        raise ValueError(f"target column {target!r} holds points in time")


def resolve(mode: str, text: bool, n_unique: int) -> str:
    """The mode that ``auto`` stands for: texts with more than two values are multiclass, all else is binary."""
    if mode not in MODES:
        raise ValueError(f"target mode {mode!r} is not one of {', '.join(MODES)}")
    if mode != "auto":
        return mode
    return "multiclass" if text and n_unique > 2 else "binary"


def binarized(value: Column, positive_from: float = 1.0) -> Column:
    """1 from ``positive_from`` on, else 0; null is 0."""
    return (F.coalesce(value, F.lit(0.0)) >= positive_from).cast("int")


def first_positions(df: DataFrame, column: str, order: str) -> DataFrame:
    """(value, code): distinct values numbered by first appearance in ``order``; null is not among them."""
    own = F.col(quoted(column))
    first = df.where(own.isNotNull()).groupBy(own.alias("value")).agg(F.min(order).alias("first"))
    return first.select("value", (F.row_number().over(Window.orderBy("first")) - 1).alias("code"))


def coded(df: DataFrame, column: str, order: str, out: str) -> DataFrame:
    """Adds the code of the column's value by first appearance, -1 for null; a column called ``out``, the target itself too, is replaced.

    The numbering runs over the table of distinct values, as a target has few.
    """
    value, code = unused("__value", df.columns), unused("__code", df.columns)
    codes = first_positions(df, column, order).select(F.col("value").alias(value), F.col("code").alias(code))
    joined = df.join(codes, F.col(quoted(column)) == F.col(value), "left")
    return joined.withColumn(out, F.coalesce(code, F.lit(-1))).drop(value, code)


def framed(df: DataFrame, target: str, order: str, mode: str = "auto", out: str = "y") -> DataFrame:
    """Adds ``out``. A text in binary mode with exactly two codes has the larger one as 1; a null is a code."""
    checked(df, target)
    kind = kind_of(df, target)
    text = is_text(kind)
    n_unique = df.select(F.count_distinct(F.col(quoted(target)))).first()[0] if mode == "auto" else 0
    mode = resolve(mode, text, n_unique)
    if text:
        return _two_codes(coded(df, target, order, out), out) if mode == "binary" else coded(df, target, order, out)
    number = to_number(F.col(quoted(target)), kind)
    if mode == "binary":
        return df.withColumn(out, binarized(number))
    if df.where(number.isNull()).limit(1).count():
        raise ValueError(f"target column {target!r} has missing values; a multiclass target cannot")
    return df.withColumn(out, number.cast("int"))


def _two_codes(df: DataFrame, out: str) -> DataFrame:
    """With exactly two codes the larger one becomes 1 and the other 0; else codes stay."""
    low, high, n = df.agg(F.min(out), F.max(out), F.count_distinct(out)).first()
    return df.withColumn(out, (F.col(out) == high).cast("int")) if n == 2 and low is not None else df


def n_classes(df: DataFrame, y: str = "y") -> int:
    return df.select(F.count_distinct(y)).first()[0]
