"""What the operators share: table access, the shared folder, let-bindings in expressions.

Spaces are the six ASCII ones, ``[\\x20\\x09-\\x0D]``; a word is a longest run of other characters.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.functions.ship import ship
from tabularium.functions.storage import Scope, clean_up, delete, drop, materialise, shared_dir, store, write

__all__ = ["SPACE", "SPACE_BYTES", "WORD", "Scope", "clean_up", "delete", "drop", "let", "materialise", "reserved", "same_rows", "shared_dir", "small_batches", "store", "table", "trimmed", "write"]

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"

#: Rows of an Arrow batch sent to a Python worker; with texts of some hundred KB at most a batch stays near 50 MB, and Spark's own limit is 64 MB.
ARROW_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for a Python worker's memory, and have the package on the executors."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def reserved(docs: DataFrame, names: Sequence[str]) -> None:
    """Raises if the table has a column of a name that the operator needs for itself."""
    taken = sorted(set(names) & set(docs.columns))
    if taken:
        raise ValueError(f"columns named {', '.join(taken)} are reserved; rename them")


def same_rows(left: Column, right: Column, of: Column | None = None) -> Column:
    """A condition that is true, and an error where two ids of a row (of those that ``of`` marks) differ: a second scan has then numbered the rows in another order."""
    said = F.lit("the documents were not read in the same order twice; they must come from storage")
    same = left.eqNullSafe(right)
    return F.assert_true(same if of is None else ~of | same, said).isNull()


def trimmed(batches: Iterator) -> Iterator:
    """The batches; when a task has made its last one, memory it has freed goes back to the system, as workers live on."""
    try:
        yield from batches
    finally:
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)
