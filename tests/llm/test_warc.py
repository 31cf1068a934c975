import base64
import hashlib
import zlib

import pyarrow as pa
import pytest

from tabularium.llm import warc


def brute(rows):
    groups = {}
    for key, html in rows:
        groups.setdefault((html or "").encode(), []).append(key)
    out = []
    for payload, keys in groups.items():
        top = max(keys, key=lambda k: (k is not None, k or 0))
        first = True
        for k in sorted(keys, key=lambda k: k != top):
            out.append((k, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if first else "revisit", None if first else top))
            first = False
    return sorted(out, key=str)


ROWS = [(k, h) for k, h in enumerate([None, "", "a" * 100, "a" * 100, "b\r\n\r\nWARC/1.1", "é" * 70000, None] + [f"p{k}" * 50 for k in range(40)])] + [(5, "twice"), (5, "twice"), (None, "a" * 100), (None, "alone")]


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages") / "t")
    spark.createDataFrame([(k, "http://x/é\n", h, "z") for k, h in ROWS], "page_id long, url string, html string, sha1 string").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def files(pages, tmp_path_factory):
    return warc.write(pages, f"file://{tmp_path_factory.mktemp('warc')}")


@pytest.mark.parametrize("split", [777, 5000, 1 << 26])
def test_round_trip(files, split):
    rows = warc.read(files, split=split).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str) == brute(ROWS)
    payloads = sorted(bytes(r.payload) for r in rows if r.record_type == "response")
    assert payloads == sorted({(h or "").encode() for _, h in ROWS})


def test_small_payloads_can_stay_responses(pages, tmp_path):
    rows = warc.read(warc.write(pages, f"file://{tmp_path}", min_bytes=101)).collect()
    assert all(r.record_type == "response" for r in rows)


class File(pa.BufferReader):
    pass


def by_ranges(data, step):
    """What two passes over ranges of ``step`` bytes find."""
    out, upto = [], 0
    for at in range(0, len(data), step):
        begin = max(at, upto)
        if begin < at + step:
            out += [x[2:] for x in warc.members(File(data), begin, at + step)]
        upto = max(upto, warc.last_end(File(data), at, at + step))
    return out


def parsed(content):
    """Fields and block of a record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = {n.lower(): v for n, v in (x.split(": ") for x in head.decode().split("\r\n")[1:])}
    return fields, rest[: int(fields["content-length"])]


def named(content, name):
    """A gzip member with a file name in its header."""
    plain = warc.member(content)
    return plain[:3] + bytes([plain[3] | 8]) + plain[4:10] + name + b"\0" + plain[10:]


def test_members_by_range():
    contents = [b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % n + bytes(k * 7 % 256 for k in range(n)) + b"\r\n\r\n" for n in (0, 10, 5000, 3)]
    data = b"".join(map(warc.member, contents))
    for step in (1, 7, 100, len(data)):
        assert by_ranges(data, step) == list(map(parsed, contents))
    assert by_ranges(b"junk\x1f\x8b\x08junk" + data, 10**6) == list(map(parsed, contents))


def test_an_archive_inside_a_record_at_every_split():
    """Stored without compression, so that its records' first bytes stand in the file; whole, cut off, and in a record that spans splits."""
    head = lambda n: b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % n
    inner = warc.member(head(3) + b"abc\r\n\r\n")
    packer = zlib.compressobj(0, zlib.DEFLATED, 31)
    block = inner * 3 + b"x" * 50 + inner[:-9]
    outer = packer.compress(head(len(block)) + block + b"\r\n\r\n") + packer.flush()
    assert inner in outer
    data = warc.member(head(1) + b"a\r\n\r\n") + outer + warc.member(head(1) + b"z\r\n\r\n")
    whole = by_ranges(data, len(data))
    assert len(whole) == 3
    for step in range(1, len(data) + 1):
        assert by_ranges(data, step) == whole


def test_long_headers():
    content = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    for size in (0, 600, 5000, 200_000):
        data = warc.member(content) + named(content, b"n" * size) + warc.member(content)
        for step in (64, 1000, len(data)):
            assert by_ranges(data, step) == [parsed(content)] * 3


def test_archives_of_other_writers(spark, tmp_path):
    def made(kind, record_id, block, *lines):
        return "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"Content-Length: {len(block)}", *lines]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    uuid = "<urn:uuid:8f3c7d5e-0000-4000-8000-00000000000{}>"
    http = b"HTTP/1.1 200 OK\r\n\r\npayload"
    good = base64.b32encode(hashlib.sha1(b"payload").digest()).decode()
    records = [
        made("warcinfo", uuid.format(0), b"x"),
        made("response", uuid.format(1), http, "Content-Type: application/http; msgtype=response", "WARC-Target-URI: <http://a/>"),
        made("response", uuid.format(2), http, "content-type:application/http", f"WARC-Payload-Digest: sha1:{good}", "X-Note: one", "  and more"),
        made("response", uuid.format(3), http, "Content-Type: application/http", "WARC-Payload-Digest: sha1:" + "A" * 32),
        made("response", uuid.format(4), b"dns answer", "Content-Type: text/dns"),
        made("revisit", uuid.format(5), b"HTTP/1.1 304 Not Modified\r\n\r\n", "Content-Type: application/http", f"WARC-Refers-To: {uuid.format(1)}"),
        made("request", uuid.format(6), b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http"),
    ]
    data = b"".join(map(warc.member, records))
    (tmp_path / "x.warc.gz").write_bytes(data)
    files = spark.createDataFrame([(f"file://{tmp_path}/x.warc.gz", len(data))], "path string, bytes long")
    for split in (100, 1 << 20):
        rows = sorted(warc.read(files, split=split).collect(), key=lambda r: r.record_id)
        assert [(r.page_id, r.record_type, r.payload_bytes, r.payload_digest, r.intact) for r in rows] == [
            (None, "response", 7, good, True), (None, "response", 7, good, True), (None, "response", 7, good, False),
            (None, "response", 10, warc.payload_digest(b"dns answer"), True), (None, "revisit", None, None, None),
        ]
        assert rows[0].url == "http://a/" and rows[4].refers_to_id == uuid.format(1) and rows[4].refers_to is None
        assert bytes(rows[0].payload) == b"payload"
    with pytest.raises(Exception, match="is not the one"):
        warc.read(files, strict=True).collect()


def response(block, *lines):
    return "\r\n".join(["WARC/1.0", "WARC-Type: response", f"Content-Length: {len(block)}", *lines]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_all_records_of_a_member_at_every_split():
    contents = [response(bytes([65 + k]) * (k * 40), f"X-N: {k}") for k in range(9)]
    data = warc.member(b"".join(contents[:5])) + warc.member(contents[5]) + warc.member(b"\r\n".join(contents[6:]))
    for step in range(1, len(data) + 1):
        assert by_ranges(data, step) == list(map(parsed, contents))
    places = [(x[0], x[1]) for x in warc.members(File(data), 0, len(data))]
    assert [n for _, n in places] == [0, 1, 2, 3, 4, 0, 0, 1, 2] and len({p for p, _ in places}) == 3


def test_a_long_member_is_read_as_a_stream():
    blocks = [b"%d" % k * 300_000 for k in range(8)] + [b""]
    data = warc.member(b"".join(map(response, blocks)))
    assert [x[3] for x in warc.members(File(data), 0, 1)] == blocks


@pytest.mark.parametrize("harm", ["cut", "bytes", "crc", "length", "junk"])
def test_damage_at_every_split(harm):
    """Records before the damage and all other members stay; at every split the same is found."""
    good = [warc.member(response(bytes([97 + k]) * 30)) for k in range(3)]
    two = response(b"first", "X-N: 1") + response(bytes(range(256)) * 3, "X-N: 2")
    bad = warc.member(two)
    if harm == "cut":
        bad = bad[:-40]
    elif harm == "bytes":
        bad = bad[:-60] + bytes(20) + bad[-40:]
    elif harm == "crc":
        bad = bad[:-8] + b"abcd" + bad[-4:]
    elif harm == "length":
        bad = warc.member(two[:-100])
    else:
        bad = warc.member(response(b"first") + b"no record")
    data = good[0] + bad + good[1] + good[2]
    whole = by_ranges(data, len(data))
    assert [b for f, b in whole if f and f["content-length"] == "30"] == [b"a" * 30, b"b" * 30, b"c" * 30]
    assert sum(f is None for f, _ in whole) == 1 and b"first" in [b for _, b in whole]
    for step in range(1, len(data) + 1):
        assert by_ranges(data, step) == whole


def test_damage_and_many_records_in_a_spark_read(spark, tmp_path):
    many = b"".join(response(b"HTTP/1.1 200 OK\r\n\r\nbody %d" % k, f"WARC-Record-ID: <urn:x-page:{k}:0>") for k in range(6))
    good, end = warc.member(many), warc.member(response(b"z", "WARC-Record-ID: <urn:x-page:9:0>", "Content-Type: text/plain"))
    data = good + good[:-30] + end
    (tmp_path / "x.warc.gz").write_bytes(data)
    (tmp_path / "cut.warc.gz").write_bytes(good[: len(good) // 2])
    files = spark.createDataFrame([(f"file://{tmp_path}/{n}", len(d)) for n, d in (("x.warc.gz", data), ("cut.warc.gz", good[: len(good) // 2]))], "path string, bytes long")
    found = []
    for split in (50, 1 << 20):
        rows = warc.read(files, split=split).collect()
        found.append(sorted((r.path[-8:], r.offset, r.number, r.record_type, r.page_id, bytes(r.payload or b"")) for r in rows if r.page_id is not None))
        damage = [(r.path.rsplit("/", 1)[1], r.offset, r.intact) for r in rows if r.record_type == "damaged"]
        assert sorted(damage) == [("cut.warc.gz", 0, False), ("x.warc.gz", len(good), False)]
    assert found[0] == found[1]
    assert [x[4] for x in found[0] if x[0] == ".warc.gz"[-8:] and x[1] == 0][:6] == [0, 1, 2, 3, 4, 5] and found[0][-1][4] == 9
    with pytest.raises(Exception, match="cut off|decode"):
        warc.read(files, strict=True).collect()


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.write(none, f"file://{tmp_path}/w")).count() == 0
