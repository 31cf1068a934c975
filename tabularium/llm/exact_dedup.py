"""Exact deduplication by Grace hashing.

Two texts are equal when nothing differs but ASCII spaces. The job has three steps:

1. On the map side each task folds equal texts of its own rows together in an open-addressing table that
   compares complete contents, so a group of copies, however large, leaves a task as one record.
2. Records are dealt by hash. Each task puts them into a table within a memory budget; when they do not fit,
   it partitions them to spill files by the next bits of the hash and treats every file in the same way.
   The files belong to the task alone and are gone when it ends; a lost task starts over.
3. The verdict on each distinct text is joined to the rows by digest. Adaptive execution splits that join's
   skewed partitions.

Defined results: a null text is the empty text, and all empty or blank texts are one group. Of a group stays
the row with most code points in the original text, then smallest doc_id (null last), then the first read,
so of fully repeated rows one stays. An empty table gives an empty result. Columns other than the named
ones are not read.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.llm.common import SPACE_BYTES, reserved, same_rows, small_batches, table, trimmed

#: Bytes of distinct contents that one table holds.
MEMORY = 48 << 20
#: What an entry takes besides its content.
ENTRY = 400
FAN_BITS = 4
LEVELS = 64 // FAN_BITS

#: (rows, code points of the best row, its doc_id, its row number)
Meta = tuple[int, int, int | None, int]


class ContentTable:
    """Open addressing with linear probing; entries are equal only if their complete contents are."""

    def __init__(self) -> None:
        self.slots = array("q", [-1]) * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.metas: list[Meta] = []
        self.size = 0

    def add(self, h: int, content: bytes, meta: Meta) -> None:
        mask = len(self.slots) - 1
        at = h & mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == h and self.contents[entry] == content:
                self.metas[entry] = merge(self.metas[entry], meta)
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.metas.append(meta)
        self.size += len(content) + ENTRY
        if 2 * len(self.hashes) > len(self.slots):
            self._grow()

    def _grow(self) -> None:
        self.slots = array("q", [-1]) * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for entry, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry

    def entries(self) -> Iterator[tuple[int, bytes, Meta]]:
        return zip(self.hashes, self.contents, self.metas)


def merge(a: Meta, b: Meta) -> Meta:
    best = min(a, b, key=lambda m: (-m[1], m[2] is None, m[2] or 0, m[3]))
    return (a[0] + b[0], *best[1:])


def grace(records: Iterator[tuple[int, bytes, Meta]], memory: int = MEMORY, level: int = 0) -> Iterator[tuple[int, bytes, Meta]]:
    """One record per distinct content, its metas merged. ``level`` is how deep the partitioning is."""
    held = ContentTable()
    for record in records:
        held.add(*record)
        if held.size > memory and level < LEVELS:
            break
    else:
        yield from held.entries()
        return
    shift = 64 - FAN_BITS * (level + 1)
    files = [tempfile.TemporaryFile(prefix="grace-") for _ in range(1 << FAN_BITS)]
    try:
        for source in (held.entries(), records):
            for record in source:
                pickle.dump(record, files[record[0] >> shift & (1 << FAN_BITS) - 1], protocol=5)
        del held
        for file in files:
            file.seek(0)
            yield from grace(_spilled(file), memory, level + 1)
            file.close()
    finally:
        for file in files:
            file.close()


def _spilled(file) -> Iterator[tuple[int, bytes, Meta]]:
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def _bare(text: bytes | None) -> bytes:
    return (text or b"").translate(None, SPACE_BYTES)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, int | None, int, bytes]]:
    for row, key, chars, text in zip(*(batch.column(n).to_pylist() for n in ("row", "id", "chars", "text"))):
        yield row, key, chars, _bare(text)


_CONTENT = "h long, content binary, n long, chars long, id long, row long"
_VERDICT = "digest binary, keep_id long, keep_row long, group_size long"


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of about ``most`` bytes of binary."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, bytes))
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_CONTENT_ARROW = pa.schema([("h", pa.int64()), ("content", pa.binary()), ("n", pa.int64()), ("chars", pa.int64()), ("id", pa.int64()), ("row", pa.int64())])
_VERDICT_ARROW = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64())])
_MEMBER_ARROW = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("digest", pa.binary())])


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _fold(batches: Iterator[pa.RecordBatch], memory: int) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        held = ContentTable()
        for batch in batches:
            for row, key, chars, content in _rows(batch):
                h = int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "big")
                held.add(h, content, (1, chars, key, row))
            if held.size > memory:
                yield from held.entries()
                held = ContentTable()
        yield from held.entries()

    yield from _batches(((_signed(h), content, *meta) for h, content, meta in rows()), _CONTENT_ARROW)


def _judge(batches: Iterator[pa.RecordBatch], memory: int) -> Iterator[pa.RecordBatch]:
    def records() -> Iterator[tuple[int, bytes, Meta]]:
        for batch in batches:
            for h, content, *meta in zip(*(c.to_pylist() for c in batch.columns)):
                yield h & (1 << 64) - 1, content, tuple(meta)

    rows = ((hashlib.sha256(content).digest(), key, row, n) for _, content, (n, _, key, row) in grace(records(), memory))
    yield from _batches(rows, _VERDICT_ARROW)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = [hashlib.sha256(_bare(text)).digest() for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(digests, pa.binary())], schema=_MEMBER_ARROW)


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("chars"), text.cast("binary").alias("text"))


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = MEMORY) -> DataFrame:
    """(digest, keep_id, keep_row, group_size) of every distinct text.

    Row numbers are ``monotonically_increasing_id`` over ``docs``, which must be read from storage, so that a
    second scan numbers its rows alike.
    """
    small_batches(docs.sparkSession)
    folded = _numbered(docs, id_col, text_col).mapInArrow(lambda it: trimmed(_fold(it, memory // 2)), _CONTENT)
    return folded.repartition("h").mapInArrow(lambda it: trimmed(_judge(it, memory)), _VERDICT)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = MEMORY) -> DataFrame:
    """Every row's id, its group's verdict and whether the row stays."""
    small_batches(docs.sparkSession)
    members = _numbered(docs, id_col, text_col).mapInArrow(lambda it: trimmed(_digests(it)), "row long, id long, digest binary")
    joined = members.join(verdicts(docs, id_col, text_col, memory), "digest")
    checked = joined.where(same_rows(F.col("id"), F.col("keep_id"), F.col("row") == F.col("keep_row")))
    return checked.select("id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = MEMORY) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. A column ``__keep_row`` is an error, as are rows that a second scan numbers otherwise."""
    reserved(docs, ["__keep_row", "__keep_id"])
    kept = verdicts(docs, id_col, text_col, memory).select(F.col("keep_row").alias("__keep_row"), F.col("keep_id").alias("__keep_id"))
    rows = docs.withColumn("__keep_row", F.monotonically_increasing_id())
    return rows.join(kept, "__keep_row").where(same_rows(F.col(id_col).cast("long"), F.col("__keep_id"))).drop("__keep_row", "__keep_id")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(length(text), 0) AS chars, rowid_ AS r,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM (SELECT *, row_number() OVER () AS rowid_ FROM documents)
), w AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER g AS keep_id, first_value(r) OVER g AS keep_r
  FROM d WINDOW g AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST, r
                      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, r = keep_r AS kept, text_sha256 FROM w
"""
