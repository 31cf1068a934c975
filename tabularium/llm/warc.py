"""WARC archives: a writer with revisit records and a splittable reader.

Writing: every task writes its rows as gzip members, one record each, to a file of its own in the shared
folder, under a working name that is renamed when the file is complete; a task that runs again writes the
same file again. Of records with equal payloads (SHA-1 and length) of at least ``min_bytes``, the one with the
largest page id is the response and the others are revisits that refer to it. Only digests are grouped; the
few that occur twice are joined to the pages, by broadcast if Spark finds them small enough.

Reading, in two passes. In both a task takes a range of bytes of a file and owns the records that start in it; it reads the last one beyond
the range's end. The first pass scans for gzip's magic number, decodes each candidate until its first bytes tell whether it is a WARC header, however
long the gzip header is, and tells where the range's last record ends. A candidate inside a record, such as an archive
that the record holds uncompressed, can pass for a record to the range that starts there; but a record of an earlier range then ends behind it.
So the second pass begins a range where the records of all earlier ranges have ended, and reads on from record to record.

Archives of other writers are read as well: record ids of any form, with or without digests and HTTP lengths, one record in a gzip member or many (``number`` is
its place among them; a member belongs to the task in whose range it starts, and is decoded as a stream, a record at a time). ``intact`` tells whether a
response's payload has the digest and length that its headers name, if they do. Files that are not gzip are not read.

A member that is damaged, cut off or has a malformed record gives the records before the damage and a row of record_type ``damaged`` with its place, and
reading goes on with the next member; ``strict`` makes it an error. A candidate that does not decode ends nowhere, so the range goes on one byte behind its start.

Defined results: a null payload is the empty payload, a null url an empty one. A null page id sorts below all
others and is read back as null, like an id that is no page's. A revisit's length and digest are those that its headers name, else null. Of repeated rows with the largest id, the first read one is the response. An
empty table gives archives without pages and an empty result. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Generator, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from tabularium.llm.common import drop, materialise, shared_dir, small_batches, table

MAGIC = b"\x1f\x8b\x08"
MIN_BYTES = 0
SPLIT = 64 << 20
BLOCK = 1 << 20
#: Bytes of an archive after which a task begins another one.
ARCHIVE = 1 << 30
#: Tasks of a pass at most; beyond, a task takes several ranges one after the other.
TASKS = 1 << 15
#: Bytes by which a candidate is decoded until they tell whether it is a record.
PROBE = 512
_HEAD = b"WARC/"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, row: int) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}:{row}>"


_OWN_ID = re.compile(r"<urn:x-page:(\d+|-\d+|null):\d+>")


def _page_id(record_id: str | None) -> int | None:
    """The page of a record id of this writer; null for others."""
    own = _OWN_ID.fullmatch(record_id or "")
    return None if own is None or own[1] == "null" else int(own[1])


def record(page_id: int | None, row: int, url: str, payload: bytes, refers_to: str | None) -> bytes:
    """A response record, or a revisit of ``refers_to``, uncompressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, row)}",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(url, safe=_URL_SAFE)}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to:
        head[5:5] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_URL_SAFE = ":/?#[]@!$&'()*+,;=-._~%"


def member(content: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(content) + packer.flush()


def _fields(head: bytes) -> dict[str, str]:
    """Of header lines after the first; a line that begins with a space goes on with the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


class Window:
    """A seekable file's bytes from a place on, read ahead by blocks."""

    def __init__(self, file) -> None:
        self.file, self.size, self.held, self.base = file, file.size(), b"", 0

    def _fill(self, start: int, end: int) -> None:
        """Holds the bytes between two places, as far as the file goes; what is before ``start`` may be forgotten."""
        if start < self.base or start > self.base + len(self.held):
            self.held, self.base = b"", start
        elif start - self.base > BLOCK:
            self.held, self.base = self.held[start - self.base :], start
        while self.base + len(self.held) < min(end, self.size):
            at = self.base + len(self.held)
            self.held += self.file.read_at(min(BLOCK, self.size - at), at)

    def get(self, start: int, end: int) -> memoryview:
        """The bytes of the file between two places, fewer at its end."""
        self._fill(start, end)
        return memoryview(self.held)[start - self.base : end - self.base]

    def find(self, what: bytes, start: int, end: int) -> int:
        """Where ``what`` begins first between two places, else -1."""
        self._fill(start, end)
        found = self.held.find(what, start - self.base, end - self.base)
        return found if found < 0 else self.base + found


def is_record(window: Window, at: int) -> bool:
    """Whether a gzip member at ``at`` begins with a WARC header."""
    decoder, out = zlib.decompressobj(31), b""
    try:
        while len(out) < len(_HEAD) and not decoder.eof and at < window.size:
            out += decoder.decompress(window.get(at, at + PROBE), len(_HEAD))
            at += PROBE
    except zlib.error:
        return False
    return out.startswith(_HEAD)


class Damage(ValueError):
    """A member that cannot be read to its end; ``after`` is its end if that is known."""

    def __init__(self, said: str, after: int | None = None) -> None:
        super().__init__(said)
        self.after = after


def _up_to_damage(decoder, chunk: bytes) -> bytes:
    """What a chunk decodes to before the byte at which decoding fails."""
    out = bytearray()
    for k in range(len(chunk)):
        try:
            out += decoder.decompress(chunk[k : k + 1])
        except zlib.error:
            break
    return bytes(out)


def records(window: Window, at: int) -> Generator[tuple[dict[str, str], bytes], None, int]:
    """Header fields, names in lower case, and the block of each record of the member at ``at``; its value is where the member ends."""
    decoder, held, tail, step = zlib.decompressobj(31), bytearray(), b"", 1 << 12
    broken = None

    def more() -> bool:
        nonlocal at, tail, step, broken
        if broken:
            raise broken
        if decoder.eof:
            return False
        chunk = tail or bytes(window.get(at, at + step))
        if not tail:
            at += len(chunk)
            step = min(2 * step, BLOCK)
        before = decoder.copy()
        try:
            out = decoder.decompress(chunk, BLOCK)
        except zlib.error as error:
            out, broken = _up_to_damage(before, chunk), Damage(f"a member does not decode: {error}")
        tail = decoder.unconsumed_tail
        if not (out or chunk or decoder.eof or broken):
            raise Damage("a member is cut off")
        held.extend(out)
        return True

    def need(there: Callable[[], bool]) -> None:
        while not there():
            if not more():
                raise Damage("a record is cut off", at - len(decoder.unused_data))

    while True:
        while not held.lstrip(b"\r\n"):
            held.clear()
            if not more():
                return at - len(decoder.unused_data)
        del held[: len(held) - len(held.lstrip(b"\r\n"))]
        need(lambda: len(held) >= len(_HEAD))
        if not held.startswith(_HEAD):
            while more():
                held.clear()
            raise Damage("what follows a record is none", at - len(decoder.unused_data))
        seen = 0

        def headed() -> bool:
            nonlocal seen
            before, seen = seen, max(0, len(held) - 3)
            return held.find(b"\r\n\r\n", before) >= 0

        need(headed)
        stop = held.find(b"\r\n\r\n")
        fields = _fields(bytes(held[:stop]))
        told = fields.get("content-length")
        if told is None or not told.isdigit():  # all that is left
            while more():
                pass
            length = len(held) - stop - 4
        else:
            length = int(told)
        need(lambda: len(held) >= stop + 4 + length)
        yield fields, bytes(held[stop + 4 : stop + 4 + length])
        del held[: stop + 4 + length]


def candidates(window: Window, at: int, end: int) -> Iterator[int]:
    """Places of records between two places, as far as their first bytes tell; send() the place to go on from."""
    while at < end:
        found, step = -1, 1 << 12
        while found < 0:
            found = window.find(MAGIC, at, at + step)
            if found < 0:
                if at + step >= window.size or at >= end:
                    return
                at += step - len(MAGIC) + 1
                step = min(2 * step, BLOCK)
        at = found
        if at >= end:
            return
        after = (yield at) if is_record(window, at) else None
        at = at + 1 if after is None else after


def _walked(file, start: int, end: int) -> Iterator[tuple[int, int, dict[str, str] | None, bytes | str, int | None]]:
    """(place, number, fields, block, None) of the records of the members that start in a range; at each member's end (place, records, None, what is wrong or empty, its end if known)."""
    window = Window(file)
    found = candidates(window, start, end)
    at = next(found, None)
    while at is not None:
        number, said, after = 0, "", None
        inner = records(window, at)
        while True:
            try:
                fields, block = next(inner)
            except StopIteration as done:
                after = done.value
                break
            except Damage as damage:
                said, after = str(damage), damage.after
                break
            yield at, number, fields, block, None
            number += 1
        yield at, number, None, said, after
        try:
            at = found.send(at + 1 if after is None else after)
        except StopIteration:
            return


def last_end(file, start: int, end: int) -> int:
    """Where the last member that starts in the range ends, ``start`` if there is none. A candidate that does not decode is none."""
    return max((after for *_, after in _walked(file, start, end) if after is not None), default=start)


def members(file, start: int, end: int) -> Iterator[tuple[int, int, dict[str, str] | None, bytes | str]]:
    """(place, number, fields, block) of the records that start in a range whose first one is the first to be found; for damage (place, number, None, what is wrong)."""
    for at, number, fields, block, _ in _walked(file, start, end):
        if fields is not None or block:
            yield at, number, fields, block


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", uri))


_WRITTEN = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    part, attempt = task.partitionId(), task.taskAttemptId()
    system, root = _file_system(folder)
    system.create_dir(root, recursive=True)
    done: list[tuple[str, int, int]] = []
    sink, size, count = None, 0, 0

    def working(k: int) -> str:
        return f"{root}/_working-{part:06d}-{k:04d}-{attempt}"

    def close() -> None:
        sink.close()
        name = f"pages-{part:06d}-{len(done):04d}.warc.gz"
        system.move(working(len(done)), f"{root}/{name}")
        done.append((f"{folder}/{name}", size, count))

    for batch in batches:
        for page_id, row, url, payload, first_id, first_row in zip(*(batch.column(n).to_pylist() for n in ("page_id", "row", "url", "payload", "first_id", "first_row"))):
            if sink is None:
                sink, size, count = system.open_output_stream(working(len(done)), compression=None), 0, 0
                info = member(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x-archive:%06d-%04d>\r\nWARC-Date: 2000-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: 18\r\n\r\nformat: WARC 1.1\r\n\r\n\r\n" % (part, len(done)))
                sink.write(info)
                size += len(info)
            refers_to = _record_id(first_id, first_row) if first_row is not None and first_row != row else None
            data = member(record(page_id, row, url, payload, refers_to))
            sink.write(data)
            size += len(data)
            count += 1
            if size > ARCHIVE:
                close()
                sink = None
    if sink is not None:
        close()
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done) if done else ([], [], []), _WRITTEN)], schema=_WRITTEN)


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write ``pages`` as archives under ``folder``; a row (path, bytes, records) of each file, already written."""
    small_batches(pages.sparkSession)
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "size": F.octet_length("payload")})
    order = F.struct(F.col("page_id").isNotNull().alias("has_id"), "page_id", (-F.col("row")).alias("back"))
    firsts = rows.where(F.col("size") >= min_bytes).groupBy("sha1", "size").agg(F.count(F.lit(1)).alias("n"), F.max(order).alias("first"))
    firsts = materialise(firsts.where("n > 1").select("sha1", "size", F.col("first.page_id").alias("first_id"), (-F.col("first.back")).alias("first_row")), "warc-firsts")
    joined = rows.join(firsts, ["sha1", "size"], "left").select("page_id", "row", "url", "payload", "first_id", "first_row")
    written = materialise(joined.mapInArrow(lambda it: _write(it, folder), "path string, bytes long, records long"), "warc-written")
    drop(firsts)
    return written


_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("path", pa.string()), ("offset", pa.int64()), ("number", pa.int32()), ("record_id", pa.string()), ("refers_to_id", pa.string()), ("intact", pa.bool_()), ("payload", pa.binary())])
_READ_SQL = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, path string, offset long, number int, record_id string, refers_to_id string, intact boolean"


def _row(fields: dict[str, str], block: bytes) -> tuple:
    """The columns of a record but for its place."""
    kind, payload, length = fields["warc-type"], block, None
    if fields.get("content-type", "application/http").lower().startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        told = _fields(http).get("content-length", "")
        length = int(told) if told.isdigit() else None
    told = fields.get("warc-payload-digest", "")
    digest = told.partition(":")[2] if ":" in told else told
    intact = None
    if kind == "response":
        intact = length in (None, len(payload))
        if told.lower().startswith("sha1:") or not told:
            own = payload_digest(payload)
            intact = intact and digest.upper() in ("", own)
            digest = own
        length = len(payload)
    refers_to = fields.get("warc-refers-to")
    url = fields.get("warc-target-uri", "").removeprefix("<").removesuffix(">")
    return _page_id(fields.get("warc-record-id")), url, length, digest or None, kind, _page_id(refers_to), fields.get("warc-record-id"), refers_to, intact, payload


def _read(batches: Iterator[pa.RecordBatch], with_payload: bool, strict: bool) -> Iterator[pa.RecordBatch]:
    schema = _READ if with_payload else pa.schema(list(_READ)[:-1])
    for batch in batches:
        for path, start, end in zip(*(batch.column(n).to_pylist() for n in ("path", "start", "end"))):
            system, name = _file_system(path)
            rows: list[tuple] = []
            size = 0
            with system.open_input_file(name) as file:
                for at, number, fields, block in members(file, start, end):
                    if fields is None:
                        if strict:
                            raise ValueError(f"{path} at {at}: {block}")
                        rows.append((None, None, None, None, "damaged", None, path, at, number, None, None, False, None)[: len(schema)])
                        continue
                    if fields.get("warc-type") not in ("response", "revisit"):
                        continue
                    *head, record_id, refers_to, intact, payload = _row(fields, block)
                    if strict and intact is False:
                        raise ValueError(f"{path} at {at}: the payload is not the one that its headers name")
                    rows.append((*head, path, at, number, record_id, refers_to, intact, payload)[: len(schema)])
                    size += len(payload)
                    if size > 16 << 20 or len(rows) > 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths, starts, ends = (batch.column(n).to_pylist() for n in ("path", "start", "end"))
        found = []
        for path, start, end in zip(paths, starts, ends):
            system, name = _file_system(path)
            with system.open_input_file(name) as file:
                found.append(last_end(file, start, end))
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(found, pa.int64())], names=["path", "start", "end", "upto"])


def read(files: DataFrame, split: int = SPLIT, with_payload: bool = True, strict: bool = False) -> DataFrame:
    """The response and revisit records of ``files``, which has path and bytes, and a row for damage. ``strict`` raises for damage and for a payload that is not intact."""
    spark = files.sparkSession
    small_batches(spark)
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split).cast("long")))
    splits = files.select("path", starts.alias("start")).withColumn("end", F.col("start") + split)
    count = min(TASKS, int(files.select(F.sum(F.greatest(F.ceil(F.col("bytes") / split), F.lit(1)))).first()[0] or 1))
    ends = materialise(splits.repartition(count).mapInArrow(_ends, "path string, start long, end long, upto long"), "warc-ends")
    earlier = Over.partitionBy("path").orderBy("start").rowsBetween(Over.unboundedPreceding, -1)  # a row for each split of a file
    exact = ends.withColumn("start", F.greatest("start", F.coalesce(F.max("upto").over(earlier), F.lit(0)))).where(F.col("start") < F.col("end")).select("path", "start", "end")
    return exact.repartition(count).mapInArrow(lambda it: _read(it, with_payload, strict), _READ_SQL + ", payload binary" * with_payload)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write(table(spark, sf_dir, "pages"), shared_dir(spark, "warc"))
    return read(files, with_payload=False, strict=True).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, row_number() OVER () AS r, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, r, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM p),
b AS (SELECT *, CAST(CAST(unhex(hex) AS BIT) AS VARCHAR) AS bits FROM d),
f AS (
  SELECT page_id, r, CAST(payload_bytes AS BIGINT) AS payload_bytes, hex,
         list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
           + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INTEGER) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INTEGER) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INTEGER)
           + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INTEGER) + CAST(substr(bits, 5 * i + 5, 1) AS INTEGER) AS INTEGER), 1)), lambda a, b: a || b) AS payload_digest
  FROM b
), g AS (
  SELECT *, first_value(r) OVER w AS first_r, first_value(page_id) OVER w AS first_id FROM f
  WINDOW w AS (PARTITION BY hex, payload_bytes ORDER BY page_id DESC NULLS LAST, r ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN r = first_r THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN r <> first_r THEN first_id END AS refers_to FROM g
"""
