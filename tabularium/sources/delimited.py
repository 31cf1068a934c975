"""Delimited text with a header: every cell is read as text, and one pass decides the columns' types.

Cells in quotes may hold line feeds. A file is split all the same: whether a line starts inside quotes follows from what is before
it, and each line is a function from one of two states (outside, inside) to another.

1. One pass composes the lines' functions for every split of a file, without knowing in which state the split starts.
2. The splits' functions, a row for each, are composed in order, which tells the state at each split's start.
3. A second pass marks every line with the line that its record starts in. Records of one line, nearly all, go on as they are; only the lines of
   longer records are gathered, by record.

A quote opens a cell only at the cell's start, and elsewhere is a character like any other; in a quoted cell it is doubled. Where no line ends inside quotes, as
the lines alone tell, Spark's own reader takes the files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabularium.functions.expressions import MISSING, quoted, text_to_number, unused
from tabularium.functions.ship import ship

_INTEGER = r"^[+-]?\d+$"
_TRUE, _FALSE = ("True", "TRUE", "true"), ("False", "FALSE", "false")

#: The rest of a quoted cell, before the quote that closes it. Possessive, so that no text makes it slow.
_INSIDE = r'[^"]*+(?:""[^"]*+)*+'


def _open_at_end(line: Column, separator: str, inside: bool) -> Column:
    """Whether a line ends inside quotes, if it starts outside or inside."""
    s = rf"\x{ord(separator):02x}"
    cells = rf'(?:(?:"{_INSIDE}"[^{s}]*+|[^"{s}][^{s}]*+)?+{s})*+'
    opened = rf'{cells}"{_INSIDE}\z'
    pattern = rf'^{_INSIDE}(?:\z|"[^{s}]*+{s}{opened})' if inside else f"^{opened}"
    quoted = F.contains(line, F.lit('"'))
    return (~quoted | line.rlike(pattern)) if inside else (quoted & line.rlike(pattern))


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, line): the lines of files, in order within a block, and where the block begins."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


def has_line_feeds(spark: SparkSession, path: str, separator: str = ",") -> bool:
    """Whether a cell in quotes holds a line feed: then some line that starts outside quotes ends inside."""
    return bool(_lines(spark, path).where(_open_at_end(F.col("line"), separator, False)).limit(1).count())


def _marked(batches: Iterator[pa.RecordBatch], summed: bool) -> Iterator[pa.RecordBatch]:
    """For each line its number in its block, and, if the block starts outside or inside quotes, whether the line does (in_0, in_1) and the last line up to it that starts outside (of_0, of_1).

    ``summed`` gives a row for each block instead: the state behind it and the last line that starts outside.
    """
    where, number, state, of = None, 0, [False, True], [-1, -1]

    def block_row() -> pa.RecordBatch:
        cells = [pa.array([where[0]], pa.string()), pa.array([where[1]], pa.int64()), pa.array([number], pa.int64())]
        cells += [pa.array([state[h]], pa.bool_()) for h in (0, 1)] + [pa.array([of[h]], pa.int64()) for h in (0, 1)]
        return pa.RecordBatch.from_arrays(cells, names=["file", "block", "n", "in_0", "in_1", "of_0", "of_1"])

    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = batch.column("file"), batch.column("block").to_numpy()
        names = file.dictionary_encode()
        edge = np.flatnonzero((block[1:] != block[:-1]) | (np.diff(names.indices.to_numpy()) != 0)) + 1
        ends = [batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("out_opens", "in_stays")]
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(block)]):
            here = (file[a].as_py(), int(block[a]))
            if here != where:
                if summed and where is not None:
                    yield block_row()
                where, number, state, of = here, 0, [False, True], [-1, -1]
            opens, stays = ends[0][a:b], ends[1][a:b]
            at, fixed, flips = np.arange(b - a), opens == stays, np.cumsum(opens & ~stays)
            last = np.maximum.accumulate(np.where(fixed, at, -1))
            flipped = (flips - np.where(last >= 0, flips[last], 0)) % 2 == 1
            columns = []
            for h in (0, 1):
                after = np.where(last >= 0, opens[last], state[h]) ^ flipped
                before = np.concatenate([[state[h]], after[:-1]])
                starts = np.maximum.accumulate(np.where(before, -1, at + number))
                own = np.where(starts >= 0, starts, of[h])
                columns.append((before, own))
                state[h], of[h] = bool(after[-1]), int(own[-1])
            if not summed:
                cells = [file[a:b], pa.array(block[a:b]), batch.column("line")[a:b], pa.array(at + number), *[pa.array(columns[h][0]) for h in (0, 1)], *[pa.array(columns[h][1]) for h in (0, 1)]]
                yield pa.RecordBatch.from_arrays(cells, names=["file", "block", "line", "n", "in_0", "in_1", "of_0", "of_1"])
            number += b - a
    if summed and where is not None:
        yield block_row()


def _blocks(lines: DataFrame) -> DataFrame:
    """(file, block, inside, before): the state at each block's start, and the line (block, n) that starts the record which goes on there."""
    found = lines.drop("line").mapInArrow(lambda it: _marked(it, True), "file string, block long, n long, in_0 boolean, in_1 boolean, of_0 long, of_1 long")
    order = Window.partitionBy("file").orderBy("block")  # a row for each block
    upto, earlier = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("flips", F.sum((F.col("in_0") & ~F.col("in_1")).cast("long")).over(upto))
    fixed = F.last(F.when(F.col("in_0") == F.col("in_1"), F.struct("in_0", "flips")), ignorenulls=True).over(upto)
    after = F.coalesce(fixed["in_0"], F.lit(False)) != ((F.col("flips") - F.coalesce(fixed["flips"], F.lit(0))) % 2 == 1)
    found = found.withColumn("after", after)
    found = found.withColumn("inside", F.coalesce(F.lag("after").over(order), F.lit(False)))
    own = F.when(F.col("inside"), F.col("of_1")).otherwise(F.col("of_0"))
    begun = F.when(own >= 0, F.struct(F.col("block").alias("block"), own.alias("n")))
    return found.withColumn("before", F.last(begun, ignorenulls=True).over(earlier)).select("file", "block", "inside", "before")


def records(spark: SparkSession, path: str | list[str], separator: str = ",") -> DataFrame:
    """(file, block, n, record): the records of files whose cells may hold line feeds, with the block and number of their first lines."""
    ship(spark)
    line = F.col("line")
    lines = _lines(spark, path).select("*", _open_at_end(line, separator, False).alias("out_opens"), _open_at_end(line, separator, True).alias("in_stays"))
    marked = lines.mapInArrow(lambda it: _marked(it, False), "file string, block long, line string, n long, in_0 boolean, in_1 boolean, of_0 long, of_1 long")
    known = marked.withColumn("ends", _open_at_end(line, separator, False)).join(_blocks(lines), ["file", "block"])
    of = F.when(F.col("inside"), F.col("of_1")).otherwise(F.col("of_0"))
    starts = ~F.when(F.col("inside"), F.col("in_1")).otherwise(F.col("in_0"))
    whole = known.where(starts & ~F.col("ends")).select("file", "block", "n", line.alias("record"))
    first = F.when(of >= 0, F.struct("block", of.alias("n"))).otherwise(F.col("before"))
    parts = known.where(~(starts & ~F.col("ends"))).select("file", first.alias("first"), F.struct("block", "n", "line").alias("part"))
    gathered = parts.groupBy("file", "first").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p: p["line"]), "\n")
    long = gathered.select("file", "first.block", "first.n", joined.alias("record"))
    both = whole.unionByName(long).withColumn("record", F.regexp_replace("record", r"\r\z", ""))
    return both.where(F.trim("record") != "")


def _options(separator: str) -> dict[str, str]:
    return {"sep": separator, "quote": '"', "escape": '"', "encoding": "UTF-8"}


def _parsed(spark: SparkSession, path: str | list[str], separator: str) -> tuple[DataFrame, str]:
    """The cells of records that may be longer than a line, with the header of the first file; and the name of a column for their places."""
    found = records(spark, path, separator)
    first = found.where("block = 0").groupBy("file").agg(F.min_by("record", "n").alias("record"), F.min("n").alias("head"))  # a row for each file
    top = first.orderBy("file").limit(1).collect()
    if not top:
        return spark.createDataFrame([], "place struct<file: string, block: bigint, n: bigint>"), "place"
    header = spark.read.options(header=True, multiLine=True, **_options(separator)).csv(spark.sparkContext.parallelize([top[0].record], 1))
    kind = ", ".join(f"`{c.replace('`', '``')}` string" for c in header.columns)
    body = found.join(first.select("file", "head"), "file").where((F.col("block") > 0) | (F.col("n") > F.col("head")))
    cells = F.from_csv("record", kind, {**_options(separator), "multiLine": "true"})
    name = unused("place", header.columns)
    return body.select(cells.alias("x"), F.struct("file", "block", "n").alias("p")).select("x.*", F.col("p").alias(name)), name


def with_places(df: DataFrame) -> tuple[DataFrame, str]:
    """A table of files with the place (file, block, n) of each row, n ascending in a block of a file; and the column's name."""
    about, name = df.metadataColumn("_metadata"), unused("place", df.columns)
    place = F.struct(about["file_path"].alias("file"), about["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("n"))
    return df.select("*", place.alias(name)), name


def read_with_places(spark: SparkSession, path: str | list[str], separator: str = ",", multi_line: bool | None = None) -> tuple[DataFrame, str]:
    """The table and the name of its column of places."""
    whole = has_line_feeds(spark, path, separator) if multi_line is None else multi_line
    texts, name = _parsed(spark, path, separator) if whole else with_places(spark.read.options(header=True, inferSchema=False, **_options(separator)).csv(path))
    return inferred(texts, name), name


def read(spark: SparkSession, path: str | list[str], separator: str = ",", multi_line: bool | None = None) -> DataFrame:
    """``multi_line`` takes line feeds inside quotes into account; by default a pass over the lines decides whether there are any."""
    df, place = read_with_places(spark, path, separator, multi_line)
    return df.drop(place)


def missing_to_null(text: Column) -> Column:
    return F.when(~F.trim(text).isin(*MISSING), text)


def inferred(texts: DataFrame, *keep: str) -> DataFrame:
    """Texts that mean a missing value become null; then each column is bigint, double, boolean or text. Columns in ``keep`` stay, behind the others.

    Whole numbers with missing values are doubles, as are columns without any value. Dates stay texts.
    """
    names = [c for c in texts.columns if c not in keep]
    bare = {c: missing_to_null(F.col(quoted(c))) for c in names}
    stats = []
    for k, c in enumerate(names):
        cell = F.trim(bare[c])
        whole = cell.rlike(_INTEGER) & cell.try_cast("bigint").isNotNull()
        count = lambda test, k=k: F.sum(F.when(test, 1).otherwise(0))
        stats += [count(cell.isNull()).alias(f"null{k}"), count(whole).alias(f"int{k}"), count(text_to_number(bare[c]).isNotNull()).alias(f"num{k}"), count(cell.isin(*_TRUE, *_FALSE)).alias(f"bool{k}")]
    found = texts.agg(F.count(F.lit(1)).alias("n"), *stats).first()
    out = []
    for k, c in enumerate(names):
        n_null, n = found[f"null{k}"] or 0, found["n"]
        value = n - n_null
        if value == 0 or found[f"num{k}"] == value:
            kind = "bigint" if value and not n_null and found[f"int{k}"] == value else "double"
            out.append((F.trim(bare[c]).try_cast("bigint") if kind == "bigint" else text_to_number(bare[c])).alias(c))
        elif not n_null and found[f"bool{k}"] == value:
            out.append(F.trim(bare[c]).isin(*_TRUE).alias(c))
        else:
            out.append(bare[c].alias(c))
    return texts.select(*out, *keep)
