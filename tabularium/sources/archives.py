"""Writes rows as members of ZIP archives, an archive for each group of rows."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.functions.ship import ship


def store(path: str):
    """The store of a path and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", path))


def _written(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Archives of rows (archive, member, content) that are sorted by archive; one is renamed when it is complete, so that a task may run again."""
    system, root = store(folder)
    system.create_dir(root, recursive=True)
    attempt = TaskContext.get().taskAttemptId()
    now, sink, packed, done, count = None, None, None, [], 0

    def close() -> None:
        packed.close()
        sink.close()
        system.move(f"{root}/_{now}-{attempt}", f"{root}/{now}")
        done.append((f"{folder}/{now}", count))

    for batch in batches:
        for archive, member, content in zip(*(batch.column(c).to_pylist() for c in ("archive", "member", "content"))):
            if archive != now:
                if packed is not None:
                    close()
                now, count = archive, 0
                sink = system.open_output_stream(f"{root}/_{now}-{attempt}", compression=None)
                packed = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED)
            packed.writestr(zipfile.ZipInfo(member), content or b"", zipfile.ZIP_DEFLATED)
            count += 1
    if packed is not None:
        close()
    yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["path", "members"])


def write(rows: DataFrame, folder: str) -> DataFrame:
    """(path, members) of the archives that the plan, when it runs, writes under ``folder``; ``rows`` has archive, member and content, none null but content."""
    ship(rows.sparkSession)
    kept = rows.select(F.col("archive").cast("string").alias("archive"), F.col("member").cast("string").alias("member"), F.col("content").cast("binary").alias("content"))
    return kept.repartition("archive").sortWithinPartitions("archive", "member").mapInArrow(lambda it: _written(it, folder), "path string, members long")
