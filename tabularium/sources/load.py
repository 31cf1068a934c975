"""Loads a table by its file's extension."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabularium.functions.expressions import no_nan, quoted, unused
from tabularium.sources import delimited, spss, xlsx

ROW_ID = "_row_id"


def _loaded(spark: SparkSession, path: str) -> tuple[DataFrame, dict, str | None]:
    """The table, what the file says about it, and the name of a column of places if rows of many tasks have them."""
    extension = os.path.splitext(path.rstrip("/"))[1].lower()
    info: dict = {}
    place = None
    if extension in (".sav", ".zsav"):
        df, info = spss.read(spark, path)
    elif extension in (".csv", ".tsv"):
        df, place = delimited.read_with_places(spark, path, "\t" if extension == ".tsv" else ",")
    elif extension == ".xlsx":
        df = xlsx.read(spark, path)
    elif extension == ".xls":
        raise ValueError("Unsupported file extension: .xls (the binary workbook format); save it as .xlsx")
    elif extension == ".parquet":
        df, place = delimited.with_places(spark.read.parquet(path))
    else:
        raise ValueError(f"Unsupported file extension: {extension}")
    return no_nan(df), info, place


def load_any(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The table, NaN as null, and what the file says about it (labels of an SPSS file)."""
    df, info, place = _loaded(spark, path)
    return (df.drop(place) if place else df), info


def load_ordered(spark: SparkSession, path: str, name: str = ROW_ID) -> tuple[DataFrame, dict, str]:
    """As ``load_any``, with a long that ascends by file and place in the file, however Spark deals files to tasks; and the long's name, which no column has."""
    df, info, place = _loaded(spark, path)
    out, name = numbered(df, place, name) if place else with_row_id(df, name)
    return out, info, name


def numbered(df: DataFrame, place: str, name: str = ROW_ID) -> tuple[DataFrame, str]:
    """Turns places into row ids. The rows of a block are in one task, so a row for each block tells where its ids begin; these rows are summed up in one task."""
    name = unused(name, df.columns)
    file, block, first, before = (unused(f"__{n}", df.columns) for n in ("file", "block", "first", "before"))
    own = F.col(place)
    size = F.max(own["n"]) - F.min(own["n"]) + 1
    blocks = df.groupBy(own["file"].alias(file), own["block"].alias(block)).agg(F.min(own["n"]).alias(first), size.alias("size"))
    earlier = Window.orderBy(file, block).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(file, block, first, F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias(before))
    joined = df.join(blocks, (own["file"] == F.col(file)) & (own["block"] == F.col(block)))
    columns = [F.col(quoted(c)) for c in df.columns if c != place]
    return joined.select(*columns, (F.col(before) + own["n"] - F.col(first)).alias(name)), name


def with_row_id(df: DataFrame, name: str = ROW_ID) -> tuple[DataFrame, str]:
    """Adds a long that follows the order of reading, under a name that no column has."""
    name = unused(name, df.columns)
    return df.withColumn(name, F.monotonically_increasing_id()), name
