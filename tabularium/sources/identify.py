"""Tells what kind of data a file holds, from its content, and which branch takes it.

Only parts of files are read. Spark lists the files, whatever their size; tasks read a file's first ``HEAD`` bytes, and of an archive its
directory, which is at its end. An archive's members become rows that are dealt to all tasks, each of which opens the archive at its members' places and
reads their first bytes; a member is read to its end, as a stream, only to see whether it is an archive itself. A workbook is recognised before it is
taken for an archive.

Tasks open local and mounted folders, ``s3a://`` and ``hdfs://`` (where executors have libhdfs); files of other stores come whole through Spark's binary reader.
"""

from __future__ import annotations

import io
import os
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.functions.ship import ship

#: Fixed values.
TABLES = {"csv", "tsv", "xls", "xlsx", "json", "jsonl", "txt", "parquet", "sav", "dta", "sas7bdat"}
IMAGES = {"jpeg", "jpg", "png", "bmp", "tiff", "gif", "webp"}
TABLE_EXTENSIONS = {"sav", "dta", "sas7bdat"}

#: Archives in archives that are opened, and bytes that an archive's members may have unpacked; beyond either it is a ``zip``.
DEPTH = 4
UNPACKED = 1 << 40
#: Bytes of a file that tell its kind.
HEAD = 1 << 16
#: Bytes at a ZIP's end that hold the mark of its directory.
_TAIL, _MARK = 65_557, b"PK\x05\x06"
#: Stores whose files tasks open themselves.
OPENED = ("file", "s3a", "s3", "hdfs")

_MAGIC = (
    (b"\x89PNG\r\n\x1a\n", "png"), (b"\xff\xd8\xff", "jpeg"), (b"GIF87a", "gif"), (b"GIF89a", "gif"), (b"BM", "bmp"),
    (b"II*\x00", "tiff"), (b"MM\x00*", "tiff"), (b"PAR1", "parquet"), (b"$FL2", "sav"), (b"$FL3", "sav"),
    (b"<stata_dta>", "dta"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "xls"), (b"%PDF-", "pdf"), (b"\x1f\x8b", "gzip"),
)
_SAS = bytes.fromhex("0000000000000000000000" "00c2ea8160b31411cfbd92080009c7318c181f1011")

Classifier = Callable[[bytes], str]


def classify(data: bytes, length: int | None = None) -> str:
    """A label from the first bytes, or from the look of a text. ``length`` is that of all bytes, if these are not all."""
    length = len(data) if length is None else length
    if not data:
        return "empty"
    for magic, name in _MAGIC:
        if data.startswith(magic) and (name != "bmp" or len(data) > 6 and struct.unpack("<I", data[2:6])[0] == length):
            return name
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp"
    if data.startswith(_SAS):
        return "sas7bdat"
    if b"\x00" in data[:4096]:
        return "unknown"
    try:
        text = data[:HEAD].decode("utf-8")
    except UnicodeDecodeError as error:
        if error.start < min(len(data), HEAD) - 4:
            return "unknown"
        text = data[: error.start].decode("utf-8")
    if length > HEAD and "\n" in text:
        text = text[: text.rindex("\n")]  # the last line is cut off
    return _text_label(text)


def _text_label(text: str) -> str:
    lines = [x for x in text.splitlines()[:50] if x.strip()]
    if not lines:
        return "txt"
    if all(x.lstrip().startswith("{") and x.rstrip().endswith("}") for x in lines) and len(lines) > 1:
        return "jsonl"
    if text.lstrip()[:1] in "{[":
        return "json"
    if text.lstrip()[:1] == "<":
        return "html" if "<html" in text[:1000].lower() or "<!doctype html" in text[:1000].lower() else "xml"
    body = lines[:-1] if len(lines) > 2 else lines
    for separator, name in (("\t", "tsv"), (",", "csv"), (";", "csv")):
        counts = {x.count(separator) for x in body}
        if min(counts) > 0 and max(counts) - min(counts) <= min(counts):
            return name
    return "txt"


def opened(path: str) -> BinaryIO:
    """A file that can be read from any place, in the stores that tasks open."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    system, name = fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", path))
    return system.open_input_file(name)


def _is_archive(file: BinaryIO) -> bool:
    try:
        return zipfile.is_zipfile(file)
    except (OSError, ValueError):
        return False


def _is_workbook(archive: zipfile.ZipFile) -> bool:
    return {"[Content_Types].xml", "xl/workbook.xml"} <= set(archive.namelist())


def _members(archive: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    return [x for x in archive.infolist() if not x.is_dir()]


def _called(label: Classifier, head: bytes, length: int) -> str:
    return label(head, length) if label is classify else label(head)


def _ends_like_archive(file: BinaryIO) -> bool:
    """Whether the mark of a ZIP's directory is near the end, from one pass over a stream."""
    tail = b""
    while chunk := file.read(1 << 20):
        tail = (tail + chunk)[-_TAIL:]
    return _MARK in tail


def _member(archive: zipfile.ZipFile, member: zipfile.ZipInfo, label: Classifier, depth: int, room: int) -> Iterator[tuple[str, str]]:
    """(name, label) of a member, or of what is in it. One that cannot be read, encrypted or damaged, is unknown."""
    try:
        with archive.open(member) as file:
            head = file.read(HEAD)
            nested = _MARK in head if member.file_size <= HEAD else _ends_like_archive(file)
        if nested:
            with archive.open(member) as file:
                if _is_archive(file):
                    file.seek(0)
                    yield from expand(member.filename, file, member.file_size, label, depth, room)
                    return
        yield member.filename, _called(label, head, member.file_size)
    except (RuntimeError, NotImplementedError, zipfile.BadZipFile, zlib.error, EOFError):
        yield member.filename, "unknown"


def expand(name: str, file: BinaryIO, length: int, label: Classifier = classify, depth: int = DEPTH, room: int = UNPACKED) -> Iterator[tuple[str, str]]:
    """(name, label) of a file, or of the files in an archive, from a file that can be read from any place."""
    archive = _archive(file)
    if archive is None:
        file.seek(0)
        yield name, _called(label, file.read(HEAD), length)
    elif _is_workbook(archive):
        yield name, "xlsx"
    elif depth == 0 or sum(x.file_size for x in _members(archive)) > room:
        yield name, "zip"
    else:
        for x in _members(archive):
            yield from _member(archive, x, label, depth - 1, room)


def _archive(file: BinaryIO) -> zipfile.ZipFile | None:
    if not _is_archive(file):
        return None
    try:
        return zipfile.ZipFile(file)
    except (zipfile.BadZipFile, OSError, ValueError):
        return None


def _parts(rows: Iterable[tuple[str, int, BinaryIO]], label: Classifier) -> Iterator[tuple[str, int, str | None, str | None]]:
    """(path, member, name, label): one row for a file, or one for each member of an archive, without name and label yet."""
    for path, length, file in rows:
        name = os.path.basename(path)
        archive = _archive(file)
        if archive is None:
            file.seek(0)
            yield path, -1, name, _called(label, file.read(HEAD), length)
        elif _is_workbook(archive):
            yield path, -1, name, "xlsx"
        elif sum(x.file_size for x in _members(archive)) > UNPACKED:
            yield path, -1, name, "zip"
        else:
            for k in range(len(_members(archive))):
                yield path, k, None, None


_PARTS = pa.schema([("path", pa.string()), ("member", pa.int64()), ("at", pa.int64()), ("name", pa.string()), ("label", pa.string())])
_PARTS_SQL = "path string, member long, at long, name string, label string"


def _batches(rows: Iterable[tuple], most: int = 10_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _PARTS)], schema=_PARTS)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _PARTS)], schema=_PARTS)


def _listed(batches: Iterator[pa.RecordBatch], label: Classifier) -> Iterator[pa.RecordBatch]:
    def files() -> Iterator[tuple[str, int, BinaryIO]]:
        for batch in batches:
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                with opened(path) as file:
                    yield path, length, file

    yield from _batches((path, k, 0, name, found) for path, k, name, found in _parts(files(), label))


def _looked_into(batches: Iterator[pa.RecordBatch], label: Classifier) -> Iterator[pa.RecordBatch]:
    """Names and labels of members. Those of one archive come one after the other, so it is opened once."""

    def rows() -> Iterator[tuple]:
        now, file, members = None, None, []
        for batch in batches:
            for path, k in zip(batch.column("path").to_pylist(), batch.column("member").to_pylist()):
                if path != now:
                    if file is not None:
                        file.close()
                    now, file = path, opened(path)
                    archive = zipfile.ZipFile(file)
                    members = _members(archive)
                for at, (name, found) in enumerate(_member(archive, members[k], label, DEPTH - 1, UNPACKED)):
                    yield path, k, at, name, found
        if file is not None:
            file.close()

    yield from _batches(rows())


def _whole(batches: Iterator[pa.RecordBatch], label: Classifier) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                for at, (name, found) in enumerate(expand(os.path.basename(path), io.BytesIO(data), len(data), label)):
                    yield path, 0, at, name, found

    yield from _batches(rows())


def file_kinds(spark: SparkSession, path: str | list[str], label: Classifier = classify) -> DataFrame:
    """(path, name, label), one row for each name in a file; of equal names in an archive the last counts. ``label`` gets a file's first bytes."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    ours = F.regexp_extract("path", "^([^:]*):", 1).isin(*OPENED)
    parts = files.where(ours).mapInArrow(lambda it: _listed(it, label), _PARTS_SQL)
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    inside = parts.where("name is null").repartition(count, "path", F.floor(F.col("member") / 64)).sortWithinPartitions("path", "member")
    found = parts.where("name is not null").unionByName(inside.mapInArrow(lambda it: _looked_into(it, label), _PARTS_SQL))
    if files.where(~ours).limit(1).count():
        others = spark.read.format("binaryFile").load(path).where(~ours).select("path", "content")
        found = found.unionByName(others.mapInArrow(lambda it: _whole(it, label), _PARTS_SQL))
    return found.groupBy("path", "name").agg(F.max_by("label", F.struct("member", "at")).alias("label"))


def _extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def routed(kinds: DataFrame) -> DataFrame:
    """(path, labels, data_kind): images before tables, and what is neither by its extension, by default a table."""
    by_file = kinds.groupBy("path").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    any_of = lambda names: F.arrays_overlap("labels", F.array(*[F.lit(n) for n in sorted(names)]))
    extension = _extension(F.col("path"))
    kind = (
        F.when(extension.isin(*TABLE_EXTENSIONS), "tabular")
        .when(any_of(IMAGES), "image")
        .when(any_of(TABLES), "tabular")
        .when(extension.isin(*IMAGES), "image")
        .otherwise("tabular")
    )
    return by_file.select("path", "labels", kind.alias("data_kind"))


def route(labels: Iterable[str], path: str) -> str:
    """As ``routed``, for one file."""
    extension, found = os.path.splitext(path)[1].lower().lstrip("."), set(labels)
    if extension in TABLE_EXTENSIONS:
        return "tabular"
    if found & IMAGES:
        return "image"
    if found & TABLES:
        return "tabular"
    return "image" if extension in IMAGES else "tabular"
