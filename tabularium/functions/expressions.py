"""Column expressions that the operators share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_INFINITE = r"(?i)^[+-]?inf(inity)?$"

#: Words that a table's cell may hold for a missing value (fixed values).
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def quoted(name: str) -> str:
    """A column's name as Spark parses it, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def unused(name: str, columns: Iterable[str]) -> str:
    """``name`` with as many underscores in front as make it differ from all columns, in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def is_text(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StringType, T.CharType, T.VarcharType))


def is_numeric(kind: T.DataType) -> bool:
    """Booleans count as numbers."""
    return isinstance(kind, (T.NumericType, T.BooleanType))


def is_time(kind: T.DataType) -> bool:
    return isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))


def kind_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def no_nan(df: DataFrame) -> DataFrame:
    """NaN is a missing value: null in every float and double column. Notes in the schema stay."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    columns = []
    for f in df.schema:
        column = F.col(quoted(f.name))
        columns.append(F.when(~F.isnan(column), column).alias(f.name, metadata=f.metadata) if f.name in floats else column)
    return df.select(*columns) if floats else df


def text_to_number(text: Column) -> Column:
    """Null where the text is no number. Suffixes and hexadecimal digits that Java takes are none."""
    bare = F.trim(text)
    sign = F.when(bare.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(bare.rlike(_NUMBER), bare.try_cast("double")).when(bare.rlike(_INFINITE), sign)


def to_number(column: Column, kind: T.DataType) -> Column:
    """A double, null on failure. Booleans are 0 and 1, points in time microseconds since 1970."""
    if is_text(kind):
        return text_to_number(column)
    if isinstance(kind, T.DateType):
        return (F.unix_date(column).cast("double")) * F.lit(86_400_000_000.0)
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(column.cast("timestamp")).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column).cast("double")
    return column.cast("double")


def label(column: Column, kind: T.DataType, as_float: bool = False) -> Column:
    """The text of a value in the names of encoded columns; whole doubles end in ``.0``."""
    if isinstance(kind, (T.FloatType, T.DoubleType)) or (as_float and isinstance(kind, T.NumericType)):
        value = column.cast("double")
        whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
        return F.when(whole, F.concat(value.cast("bigint").cast("string"), F.lit(".0"))).otherwise(value.cast("string"))
    if isinstance(kind, T.BooleanType):
        return F.initcap(column.cast("string"))
    return column.cast("string")


def logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
