"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import math
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextvars import ContextVar, Token

from pyspark.sql import DataFrame, SparkSession

_MADE: list[str] = []
_OWN: list[str] = []
_LOCK = threading.Lock()
_WRITES: dict[int, tuple[int, str]] = {}
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, and so share every folder."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of spark.checkpoint.dir.

    Where the setting is absent a temporary folder is made if the session is local, as in tests; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not is_local(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        _OWN[:] = _OWN or ["file://" + tempfile.mkdtemp(prefix="shared-")]
        base = _OWN[0]
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    for scope in _OPEN.get():
        scope.paths.add(path)
    return path


def delete(spark: SparkSession, path: str) -> bool:
    """Deletes what is under ``path``, in whatever store it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    with _LOCK:
        if path in _MADE:
            _MADE.remove(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True))


def clean_up(spark: SparkSession) -> int:
    """Deletes what this session has written to the shared folder, once results that read it are stored. The number of paths."""
    return sum(delete(spark, path) for path in list(_MADE))


@contextlib.contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """While any write of the session is on its way, shuffle files go with their query; the setting returns to what it was when the last one ends."""
    key = id(spark._jsparkSession)
    with _LOCK:
        n, before = _WRITES.get(key, (0, ""))
        if not n:
            before = spark.conf.get(_CLEAN)
            spark.conf.set(_CLEAN, "true")
        _WRITES[key] = n + 1, before
    try:
        yield
    finally:
        with _LOCK:
            n, before = _WRITES.pop(key)
            if n > 1:
                _WRITES[key] = n - 1, before
            else:
                spark.conf.set(_CLEAN, before)


def write(df: DataFrame, path: str, *by: str) -> None:
    """Writes ``df`` as Parquet; shuffle files go as soon as it is written, as nothing reads them again."""
    with _cleaning(df.sparkSession):
        (df.write.partitionBy(*by) if by else df.write).parquet(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives a lost executor."""
    path = shared_dir(df.sparkSession, name)
    write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a task, at least if there is more than one, and about at most, where a table is dealt anew.
TASK_ROWS = (1 << 15, 1 << 19)


def dealt(df: DataFrame, name: str) -> DataFrame:
    """Writes a table that may be much smaller than what it comes from, then once more in files for as many tasks as there are cores, or more if it is large."""
    spark, found = df.sparkSession, materialise(df, name)
    n, (least, most) = found.count(), TASK_ROWS
    tasks = max(1, min(math.ceil(n / least), max(spark.sparkContext.defaultParallelism, math.ceil(n / most))))
    out = materialise(found.repartition(tasks), name)
    drop(found)
    return out


def _read_by(df: DataFrame) -> set[str]:
    """Paths in the shared folder that ``df`` reads. Their last parts are unique, and schemes may be written in more than one way."""
    files = df.inputFiles()
    return {path for path in _MADE if any(f"/{path.rsplit('/', 1)[1]}/" in f for f in files)}


def drop(*tables: DataFrame) -> None:
    """Deletes the files of materialised tables that nothing reads any more."""
    for df in tables:
        for path in _read_by(df):
            delete(df.sparkSession, path)


class Scope:
    """Owns what its ``with`` blocks write to the shared folder. What other threads write, or this one outside the blocks, is not its own."""

    def __init__(self) -> None:
        self.paths: set[str] = set()
        self._tokens: list[Token] = []

    def __enter__(self) -> Scope:
        self._tokens.append(_OPEN.set((*_OPEN.get(), self)))
        return self

    def __exit__(self, *_: object) -> None:
        _OPEN.reset(self._tokens.pop())

    def clear(self, keep: DataFrame) -> None:
        """Deletes it, but for what ``keep`` reads."""
        for path in self.paths - _read_by(keep):
            self.paths.discard(path)
            if path in _MADE:
                delete(keep.sparkSession, path)


_OPEN: ContextVar[tuple[Scope, ...]] = ContextVar("open scopes", default=())


def store(df: DataFrame, path: str) -> None:
    """Writes a result and deletes the tables in the shared folder that it was read from."""
    write(df, path)
    drop(df)


def put(spark: SparkSession, path: str, data: bytes) -> str:
    """Writes a small file from the driver, in whatever store it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return path
