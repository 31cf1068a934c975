"""SPSS system files (.sav): numeric codes as they are, labels of variables and values apart.

A file is read by many tasks, each of which opens it at its own place. Without compression cases have one size, so places follow from their numbers. With bytecodes
(.sav) or zlib blocks of them (.zsav) the size of a group of eight codes follows from the codes: one pass over the file, which holds a few MB
and makes no values, notes about every ``SPLIT`` bytes where a group begins and how many cells are before it. A case belongs to the split that its first cell is in.

Tasks open local and mounted folders, ``s3a://`` and ``hdfs://`` (where executors have libhdfs); files of other stores come whole through Spark's binary reader.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabularium.functions.expressions import is_text, quoted
from tabularium.functions.ship import ship
from tabularium.functions.storage import materialise
from tabularium.sources.identify import OPENED, opened


@dataclass
class Variable:
    name: str
    width: int  # 0: a number
    label: str | None = None
    missing: tuple[float, ...] = ()
    missing_range: tuple[float, float] | None = None
    segments: int = 1  # of 255 bytes, of a very long text


@dataclass
class Header:
    variables: list[Variable]
    n_cases: int
    compression: int
    bias: float
    order: str
    encoding: str
    data_at: int
    value_labels: dict[str, dict[float | str, str]] = field(default_factory=dict)

    @property
    def slots(self) -> list[int]:
        """Eight-byte cells that each variable takes in a case."""
        return [1 if v.width == 0 else _slots(v) for v in self.variables]


def _slots(variable: Variable) -> int:
    if variable.width <= 255:
        return (variable.width + 7) // 8
    last = variable.width - (variable.segments - 1) * 252
    return (variable.segments - 1) * 32 + (last + 7) // 8


def header(data: bytes) -> Header:
    if data[:4] not in (b"$FL2", b"$FL3"):
        raise ValueError("not an SPSS system file")
    order = "<" if struct.unpack("<i", data[64:68])[0] in (2, 3) else ">"

    def ints(at: int, n: int = 1) -> tuple[int, ...]:
        return struct.unpack(f"{order}{n}i", data[at : at + 4 * n])

    _, _, compression, _, n_cases = ints(64, 5)
    bias = struct.unpack(f"{order}d", data[84:92])[0]
    at, encoding, raw = 176, "utf-8", []
    slots: list[int | None] = []  # of each slot, the place in raw
    labels: list[tuple[list[tuple[bytes, bytes]], list[int]]] = []
    long_names: dict[str, str] = {}
    long_widths: dict[str, int] = {}
    while (kind := ints(at)[0]) != 999:
        at += 4
        if kind == 2:
            width, has_label, n_missing, _, _ = ints(at, 5)
            name = data[at + 20 : at + 28]
            at += 28
            label = None
            if has_label:
                size = ints(at)[0]
                label = data[at + 4 : at + 4 + size]
                at += 4 + (size + 3) // 4 * 4
            missing = data[at : at + 8 * abs(n_missing)]
            at += 8 * abs(n_missing)
            if width >= 0:
                slots.append(len(raw))
                raw.append((name, width, label, n_missing, missing))
            else:
                slots.append(None)
        elif kind == 3:
            pairs = []
            n = ints(at)[0]
            at += 4
            for _ in range(n):
                value, size = data[at : at + 8], data[at + 8]
                pairs.append((value, data[at + 9 : at + 9 + size]))
                at += 8 + (size + 8) // 8 * 8
            if ints(at)[0] != 4:
                raise ValueError("value labels without variables")
            n = ints(at + 4)[0]
            labels.append((pairs, list(ints(at + 8, n))))
            at += 8 + 4 * n
        elif kind == 6:
            at += 4 + 80 * ints(at)[0]
        elif kind == 7:
            subtype, size, n = ints(at, 3)
            content = data[at + 12 : at + 12 + size * n]
            at += 12 + size * n
            if subtype == 20:
                encoding = content.decode("ascii").strip().lower()
            elif subtype == 13:
                long_names = dict(p.split("=", 1) for p in content.decode("utf-8", "replace").split("\t") if "=" in p)
            elif subtype == 14:
                entries = (p.split("=", 1) for p in content.replace(b"\x00\t", b"\x00").decode("utf-8", "replace").split("\x00") if "=" in p)
                long_widths = {k: int(v) for k, v in entries}
        else:
            raise ValueError(f"unknown record {kind} at {at - 4}")
    text = lambda b: b.decode(encoding, "replace").rstrip()
    variables, place, skip = [], {}, 0
    for k, (name, width, label, n_missing, missing) in enumerate(raw):
        if skip:
            skip -= 1
            place[k] = None
            continue
        short = text(name)
        one = Variable(long_names.get(short, short), width, text(label) if label is not None else None)
        if short in long_widths:
            one.width = long_widths[short]
            one.segments = (one.width + 251) // 252
            skip = one.segments - 1
        if width == 0 and n_missing:
            values = struct.unpack(f"{order}{abs(n_missing)}d", missing)
            if n_missing < 0:
                one.missing_range, values = values[:2], values[2:]
            one.missing = values
        place[k] = len(variables)
        variables.append(one)
    out = Header(variables, n_cases, compression, bias, order, encoding, at + 8)
    for pairs, numbers in labels:
        for number in numbers:
            k = place.get(slots[number - 1]) if slots[number - 1] is not None else None
            if k is not None:
                v = variables[k]
                out.value_labels[v.name] = {struct.unpack(f"{order}d", a)[0] if v.width == 0 else text(a): text(b) for a, b in pairs}
    return out


#: Bytes of cases, as they are before zlib, that a split has at least; bytes read at once.
SPLIT, CHUNK = 32 << 20, 4 << 20


def head_of(file) -> Header:
    """The header of a file that can be read from any place, of which as much is read as it takes."""
    size = CHUNK
    while True:
        data = file.read_at(min(size, file.size()), 0)
        try:
            return header(data)
        except (struct.error, IndexError):
            if len(data) >= file.size():
                raise ValueError("the header of an SPSS system file is cut off") from None
            size *= 4


def _stream(file, head: Header, start: int) -> Iterator[bytes]:
    """What follows the header, without zlib, from a place on, in chunks."""
    if head.compression != 2:
        for at in range(head.data_at + start, file.size(), CHUNK):
            yield file.read_at(min(CHUNK, file.size() - at), at)
        return
    _, trailer_at, _ = struct.unpack(f"{head.order}3q", file.read_at(24, head.data_at))
    n = struct.unpack(f"{head.order}i", file.read_at(4, trailer_at + 20))[0]
    entries, before = file.read_at(24 * n, trailer_at + 24), 0
    for k in range(n):
        _, at, plain, size = struct.unpack(f"{head.order}2q2i", entries[24 * k : 24 * k + 24])
        if before + plain > start:
            yield zlib.decompress(file.read_at(size, at))[max(0, start - before) :]
        before += plain


class _Bytes:
    """Reads chunks as one stream."""

    def __init__(self, chunks: Iterator[bytes]) -> None:
        self.chunks, self.held, self.at = chunks, b"", 0

    def read(self, n: int) -> bytes:
        """The next ``n`` bytes, fewer at the end."""
        while len(self.held) - self.at < n:
            chunk = next(self.chunks, None)
            if chunk is None:
                break
            self.held, self.at = self.held[self.at :] + chunk, 0
        self.at += n
        return self.held[self.at - n : self.at]


def _cells(file, head: Header, start: int) -> Iterator[bytes | None]:
    """The cells from a place on; None is the system-missing value."""
    missing = struct.pack(f"{head.order}d", -1.7976931348623157e308)
    read = _Bytes(_stream(file, head, start)).read
    if head.compression == 0:
        while len(cell := read(8)) == 8:
            yield None if cell == missing else cell
        return
    while len(codes := read(8)) == 8:
        for code in codes:
            if code == 252:
                return
            if code == 253:
                cell = read(8)
                yield None if cell == missing else cell
            elif code == 254:
                yield b" " * 8
            elif code == 255:
                yield None
            elif code:
                yield struct.pack(f"{head.order}d", code - head.bias)


def splits(file, head: Header, split: int = SPLIT) -> Iterator[tuple[int, int, int]]:
    """(start, skip, cases): where a split's cells begin, those of a case that began before, and how many cases are its own."""
    width = sum(head.slots)
    if not width:
        return
    if head.compression == 0:
        n = (file.size() - head.data_at) // (8 * width)
        n = min(n, head.n_cases) if head.n_cases >= 0 else n
        step = max(1, split // (8 * width))
        for k in range(0, n, step):
            yield 8 * width * k, 0, min(step, n - k)
        return
    marks, at, cells, mark = [(0, 0)], 0, 0, split
    read, done = _Bytes(_stream(file, head, 0)).read, False
    while not done and len(codes := read(8)) == 8:
        if at >= mark:
            marks.append((at, cells))
            mark = at + split
        if 252 in codes:
            codes, done = codes[: codes.index(252)], True
        values = 8 * codes.count(253)
        read(values)
        at += 8 + values
        cells += len(codes) - codes.count(0)
    n = cells // width if head.n_cases < 0 else min(head.n_cases, cells // width)
    firsts = [min(n, -(-before // width)) for _, before in marks] + [n]
    for (start, before), first, after in zip(marks, firsts, firsts[1:]):
        if after > first:
            yield start, first * width - before, after - first


def cases(file, head: Header, start: int, skip: int, n: int) -> Iterator[list]:
    """The values of the ``n`` cases of a split; user-missing numbers are null."""
    cells = islice(_cells(file, head, start), skip, None)
    for _ in range(n):
        row = []
        for variable, size in zip(head.variables, head.slots):
            own = list(islice(cells, size))
            if len(own) < size:
                return
            row.append(_value(own, variable, head))
        yield row


def _value(cells: list[bytes | None], variable: Variable, head: Header):
    if variable.width == 0:
        if cells[0] is None:
            return None
        x = struct.unpack(f"{head.order}d", cells[0])[0]
        low, high = variable.missing_range or (1.0, 0.0)
        return None if x in variable.missing or low <= x <= high else x
    raw = b"".join(c or b" " * 8 for c in cells)
    if variable.segments > 1:
        raw = b"".join(raw[256 * k : 256 * k + 255] for k in range(variable.segments))
    return raw[: variable.width].decode(head.encoding, "replace").rstrip()


def _schema(variables: list[Variable]) -> pa.Schema:
    return pa.schema([(v.name, pa.string() if v.width else pa.float64()) for v in variables])


def _described(batches: Iterator[pa.RecordBatch], split: int) -> Iterator[pa.RecordBatch]:
    """A row for each variable, and one for each split with its number and place."""
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.int64()]
    for path, file in _files(batches):
        head = head_of(file)
        rows = [(path, k, v.name, v.width, v.label, [str(x) for x in head.value_labels.get(v.name, {})], list(head.value_labels.get(v.name, {}).values()), None, None, None) for k, v in enumerate(head.variables)]
        rows += [(path, k, None, None, None, None, None, *x) for k, x in enumerate(splits(file, head, split))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in _DESCRIBED.split(", ")])


_DESCRIBED = "path string, pos long, name string, width long, label string, codes array<string>, texts array<string>, start long, skip long, cases long"


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.NativeFile]]:
    """Files by their paths, those that came whole from what they hold."""
    for batch in batches:
        whole = batch.column("content").to_pylist() if "content" in batch.schema.names else [None] * batch.num_rows
        for path, content in zip(batch.column("path").to_pylist(), whole):
            with opened(path) if content is None else pa.BufferReader(content) as file:
                yield path, file


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        starts = zip(*(batch.column(c).to_pylist() for c in ("start", "skip", "cases")))
        for (_, file), (start, skip, n) in zip(_files(iter([batch])), starts):
            head = head_of(file)
            schema, held = _schema(head.variables), []
            for row in cases(file, head, start, skip, n):
                held.append(row)
                if len(held) == 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def read(spark: SparkSession, path: str, split: int = SPLIT) -> tuple[DataFrame, dict]:
    """The table, and column_labels and value_labels by column. Rows are in the file's order, by partition."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path)
    ours = not files.where(~F.regexp_extract("path", "^([^:]*):", 1).isin(*OPENED)).limit(1).count()
    listed = files.select("path") if ours else files.select("path", "content")
    size = split if ours else 1 << 62  # a file that comes whole is one split
    found = materialise(listed.mapInArrow(lambda it: _described(it, size), _DESCRIBED), "spss-splits")
    described = found.where("name is not null").orderBy("path", "pos").limit(MOST_VARIABLES).collect()
    described = [r for r in described if r.path == described[0].path]
    kinds = ", ".join(f"`{r.name.replace('`', '``')}` {'string' if r.width else 'double'}" for r in described)
    parts = found.where("start is not null").withColumn("number", F.row_number().over(Window.orderBy("path", "pos")) - 1)  # a row for each split
    n = max(1, parts.count())
    count = min(MOST_TASKS, n)
    if not ours:
        parts = parts.join(files.select("path", "content"), "path")
    dealt = parts.repartitionById(count, F.floor(F.col("number") * count / n).cast("int")).sortWithinPartitions("number")
    table = dealt.select("path", "start", "skip", "cases", *([] if ours else ["content"])).mapInArrow(_parsed, kinds)
    info = {"column_labels": {r.name: r.label for r in described}, "value_labels": {r.name: dict(zip(r.codes, r.texts)) for r in described if r.codes}}
    noted = [F.col(quoted(r.name)).alias(r.name, metadata={"label": r.label or "", "value_labels": info["value_labels"].get(r.name, {})}) for r in described]
    return table.select(*noted), info


#: Variables that a file can have, and tasks that read a file at most; beyond, a task reads several splits.
MOST_VARIABLES, MOST_TASKS = 1 << 20, 1 << 15


# a writer, for tables whose texts are short


def _head_bytes(columns: list[tuple[str, int]], n_cases: int) -> bytes:
    """A header for columns of numbers (width 0) and texts of up to 255 bytes, with bytecodes."""
    pad = lambda x, n: x.encode()[:n].ljust(n)
    out = b"$FL2" + pad("@(#) SPSS DATA FILE", 60) + struct.pack("<5i", 2, sum(max(1, (w + 7) // 8) for _, w in columns), 1, 0, n_cases)
    out += struct.pack("<d", 100.0) + pad("01 Jan 70", 9) + pad("00:00:00", 8) + pad("", 64) + bytes(3)
    for k, (_, width) in enumerate(columns):
        out += struct.pack("<6i", 2, width, 0, 0, 0, 0) + pad(f"V{k}", 8)
        out += b"".join(struct.pack("<6i", 2, -1, 0, 0, 0, 0) + pad("", 8) for _ in range((width + 7) // 8 - 1))
    names = "\t".join(f"V{k}={name}" for k, (name, _) in enumerate(columns)).encode()
    return out + struct.pack("<4i", 7, 13, 1, len(names)) + names + struct.pack("<4i", 7, 20, 1, 5) + b"UTF-8" + struct.pack("<2i", 999, 0)


def _packed(rows: Iterator[tuple], columns: list[tuple[str, int]]) -> Iterator[bytes]:
    """Cases as groups of eight codes and what these do not say themselves."""
    codes, values = bytearray(), bytearray()
    for row in rows:
        cells: list[tuple[int, bytes]] = []
        for value, (_, width) in zip(row, columns):
            if width:
                raw = (value or "").encode().ljust(8 * ((width + 7) // 8))
                cells += [(254, b"") if not raw[k : k + 8].strip() else (253, raw[k : k + 8]) for k in range(0, len(raw), 8)]
            elif value is None:
                cells.append((255, b""))
            elif value == int(value) and -99 <= value <= 151:
                cells.append((int(value) + 100, b""))
            else:
                cells.append((253, struct.pack("<d", value)))
        for code, cell in cells:
            codes.append(code)
            values += cell
            if len(codes) == 8:
                yield bytes(codes + values)
                codes, values = bytearray(), bytearray()
    yield bytes((codes + bytearray([252])).ljust(8, b"\0")[:8] + values) if len(codes) < 8 else b""


def write(df: DataFrame, path: str) -> str:
    """One system file of the table's numbers and texts, in its order, by one task; the longest text of each column tells its width, 255 bytes at most."""
    from tabularium.sources.archives import store

    ship(df.sparkSession)
    texts = [f.name for f in df.schema if is_text(f.dataType)]
    sizes = df.agg(F.count(F.lit(1)).alias("__n"), *[F.max(F.octet_length(F.col(quoted(c)))).alias(c) for c in texts]).first()
    columns = [(c, max(1, sizes[c] or 0) if c in texts else 0) for c in df.columns]
    if any(w > 255 for _, w in columns):
        raise ValueError("texts are longer than 255 bytes")
    begin = _head_bytes(columns, sizes["__n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, name = store(path)
        system.create_dir(name.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(name, compression=None) as out:
            out.write(begin)
            rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(len(columns)))))
            for group in _packed(rows, columns):
                out.write(group)
        yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

    plain = df.select(*[F.col(quoted(c)).cast("string" if w else "double").alias(f"c{k}") for k, (c, w) in enumerate(columns)])
    return plain.coalesce(1).mapInArrow(run, "path string").first()[0]
