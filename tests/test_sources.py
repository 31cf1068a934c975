import csv
import io
import json
import random
import struct
import zipfile
import zlib

import pytest

from tabularium.sources import delimited, identify, load, spss, synthetic, xlsx


def test_delimited(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,name,gap,empty,day,flag,dash,note\n1,"Smith, A",1,NA,2020-01-01,True,-,"a ""b""\nc"\n2,n/a,,null,2020-01-02,False,x,\n3,Lee,2.5,,2020-01-03,True,y,z\n', encoding="utf-8")
    df, _ = load.load_any(spark, str(tmp_path / "t.csv"))
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("gap", "double"), ("empty", "double"), ("day", "string"), ("flag", "boolean"), ("dash", "string"), ("note", "string")]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "Smith, A", 1.0, None, "2020-01-01", True, "-", 'a "b"\nc'), (2, None, None, None, "2020-01-02", False, "x", None), (3, "Lee", 2.5, None, "2020-01-03", True, "y", "z")]
    (tmp_path / "t.tsv").write_text("a\tb\n1\tx,y\n2\tz\n")
    df, _ = load.load_any(spark, str(tmp_path / "t.tsv"))
    assert [tuple(r) for r in df.collect()] == [(1, "x,y"), (2, "z")]
    whole = spark.createDataFrame([("1",), (None,)], "a string")
    assert delimited.inferred(whole).dtypes == [("a", "double")]


def cells(n, seed):
    """Rows of cells with line feeds, quotes and separators, and quotes that open nothing."""
    rng = random.Random(seed)
    kinds = ["plain", "", '5" pipe', 'a "quoted" word', "line\nfeed", "two\r\nlines\n\n", "com,ma\ttab", '"', '""', "x" * 70, "\n", 'ü\n"y",z']
    return [[str(k), *rng.choices(kinds, k=3)] for k in range(n)]


@pytest.mark.parametrize("end, separator", [("\n", ","), ("\r\n", "\t")])
@pytest.mark.parametrize("split", ["67", "128m"])
def test_line_feeds_in_cells_of_split_files(spark, tmp_path, split, end, separator):
    rows = {f: cells(14, f) for f in range(2)}
    for f, own in rows.items():
        with open(tmp_path / f"{f}.csv", "w", newline="") as out:
            writer = csv.writer(out, lineterminator=end, delimiter=separator)
            writer.writerow(["id", 'two\nlines "x"', "a.b", "c`d"])
            writer.writerows(own)
            out.write(separator.join(["99", '5" pipe', '"open' + end + 'closed"', '7"']))
    expected = [[None if x == "" else x for x in row] for own in rows.values() for row in [*own, ["99", '5" pipe', f"open{end}closed", '7"']]]
    settings = {"spark.sql.files.maxPartitionBytes": split, "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1" if split == "128m" else "40"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert delimited.has_line_feeds(spark, str(tmp_path), separator)
        df, place = delimited._parsed(spark, str(tmp_path), separator)
        assert df.columns[:3] == ["id", 'two\nlines "x"', "a.b"]
        rows = df.orderBy(place).collect()
        assert [list(r)[:-1] for r in rows] == expected
        assert split == "128m" or len({(r[place].file, r[place].block) for r in rows}) > 5
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_line_feeds_are_only_seen_inside_quotes(spark, tmp_path):
    for name, text, there in (("a", 'x,y\n5" pipe,1\n', False), ("b", 'x,y\n"a ""b""",1\n', False), ("c", 'x,y\n1,"a\nb"\n', True), ("d", 'x,y\n5" pipe,"open\n"\n', True), ("e", "x,y\n", False), ("f", "", False)):
        (tmp_path / f"{name}.csv").write_text(text)
        assert delimited.has_line_feeds(spark, str(tmp_path / f"{name}.csv")) == there
    assert [tuple(r) for r in delimited.read(spark, str(tmp_path / "d.csv")).collect()] == [('5" pipe', "open\n")]
    assert delimited._parsed(spark, str(tmp_path / "f.csv"), ",")[0].count() == 0
    line = "a," * 200_000 + '"' + "b" * 300_000
    (tmp_path / "g.csv").write_text(line + "\n" + 'c"\n')
    assert delimited.has_line_feeds(spark, str(tmp_path / "g.csv"))


def test_parquet_and_nan(spark, tmp_path):
    spark.createDataFrame([(float("nan"),), (1.0,)], "x double").write.parquet(str(tmp_path / "t.parquet"))
    df, _ = load.load_any(spark, str(tmp_path / "t.parquet"))
    assert sorted(df.collect(), key=str) == sorted([(None,), (1.0,)], key=str)
    assert load.with_row_id(df)[0].columns == ["x", "_row_id"] and load.with_row_id(load.with_row_id(df)[0])[1] == "__row_id"


def test_unknown_extensions(spark):
    for path in ("a.json", "a.xls", "a"):
        with pytest.raises(ValueError, match="Unsupported file extension"):
            load.load_any(spark, path)


def workbook(rows):
    """A minimal xlsx: texts inline or shared, numbers, a date style, and gaps."""
    shared, lines = [], []
    for r, row in enumerate(rows, 1):
        cells = []
        for c, value in enumerate(row):
            at = f"{chr(65 + c)}{r}"
            if value is None:
                continue
            if isinstance(value, bool):
                cells.append(f'<c r="{at}" t="b"><v>{int(value)}</v></c>')
            elif isinstance(value, tuple):
                cells.append(f'<c r="{at}" s="1"><v>{value[0]}</v></c>')
            elif isinstance(value, str) and len(value) % 2:
                cells.append(f'<c r="{at}" t="s"><v>{len(shared)}</v></c>')
                shared.append(value)
            elif isinstance(value, str):
                cells.append(f'<c r="{at}" t="inlineStr"><is><t>{value}</t></is></c>')
            else:
                cells.append(f'<c r="{at}"><v>{value}</v></c>')
        lines.append(f'<row r="{r}">{"".join(cells)}</row>')
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId7" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>{''.join(f'<si><t>{s}</t></si>' for s in shared)}</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{''.join(lines)}</sheetData></worksheet>")
    return out.getvalue()


def test_xlsx(spark, tmp_path):
    (tmp_path / "t.xlsx").write_bytes(workbook([["id", "name", "x", "ok", "day", None, "last"], [1, "Ann", 1.5, True, (43831,), None, 1], [2, "Bo", None, False, (43832.5,), None, 2]]))
    df, _ = load.load_any(spark, str(tmp_path / "t.xlsx"))
    assert df.columns == ["id", "name", "x", "ok", "day", "Unnamed: 5", "last"]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "Ann", 1.5, True, "2020-01-01 00:00:00", None, 1), (2, "Bo", None, False, "2020-01-02 12:00:00", None, 2)]
    assert list(xlsx.rows(workbook([["a"]]))) == [["a"]]


def system_file(compression):
    """A system file with a number, a text of 12 bytes, labels and missing values."""
    ints = lambda *x: struct.pack(f"<{len(x)}i", *x)
    pad = lambda s, n: s.encode().ljust(n)
    head = b"$FL3" if compression == 2 else b"$FL2"
    out = head + pad("@(#) SPSS DATA FILE", 60) + ints(2, 4, compression, 0, 3) + struct.pack("<d", 100.0) + pad("01 Jan 20", 9) + pad("00:00:00", 8) + pad("t", 64) + b"\0" * 3
    label = b"How old".ljust(8)
    out += ints(2, 0, 1, 1, 0, 0) + pad("AGE", 8) + ints(7) + label + struct.pack("<d", 99.0)
    out += ints(2, 12, 0, 0, 0, 0) + pad("NAME", 8) + ints(2, -1, 0, 0, 0, 0) + pad("", 8)
    out += ints(2, 0, 0, 0, 0, 0) + pad("SEX", 8)
    out += ints(3, 2) + struct.pack("<d", 1.0) + b"\x06female"[:7].ljust(8) + struct.pack("<d", 2.0) + b"\x04male".ljust(8) + ints(4, 1, 4)
    long_names = b"AGE=age\tNAME=full_name\tSEX=gender"
    out += ints(7, 13, 1, len(long_names)) + long_names + ints(7, 20, 1, 5) + b"UTF-8"
    out += ints(999, 0)
    cases = [(50.0, "Zoë Ångström"[:11], 1.0), (None, "Bo", 2.0), (99.0, "", 1.5)]
    body = b""
    if compression == 0:
        for age, name, sex in cases:
            body += struct.pack("<d", -1.7976931348623157e308 if age is None else age) + name.encode()[:16].ljust(16) + struct.pack("<d", sex)
        return out + body
    codes, data = [], []
    for age, name, sex in cases:
        codes.append(255 if age is None else int(age) + 100)
        for k in (0, 8):
            piece = name.encode()[:16].ljust(16)[k : k + 8]
            codes.append(254 if not piece.strip() else 253)
            data += [] if not piece.strip() else [(len(codes) - 1, piece)]
        codes.append(int(sex) + 100 if sex == int(sex) else 253)
        data += [] if sex == int(sex) else [(len(codes) - 1, struct.pack("<d", sex))]
    codes.append(252)
    codes += [0] * (-len(codes) % 8)
    for k in range(0, len(codes), 8):
        body += bytes(codes[k : k + 8]) + b"".join(x for at, x in data if k <= at < k + 8)
    if compression == 1:
        return out + body
    packed, at = zlib.compress(body), len(out)
    trailer = struct.pack("<3q2i", -100, 0, 0x3FF000, 0, 1)[:24] + b""
    trailer = struct.pack("<3q", -100, 0, 0)[:16] + struct.pack("<2i", 0x3FF000, 1) + struct.pack("<2q2i", at, at + 24, len(body), len(packed))
    return out + struct.pack("<3q", at, at + 24 + len(packed), len(trailer)) + packed + trailer


@pytest.mark.parametrize("compression", [0, 1, 2])
def test_system_file(spark, tmp_path, compression):
    (tmp_path / "t.sav").write_bytes(system_file(compression))
    df, info = load.load_any(spark, str(tmp_path / "t.sav"))
    assert df.dtypes == [("age", "double"), ("full_name", "string"), ("gender", "double")]
    rows = [tuple(r) for r in df.collect()]
    assert [r[0] for r in rows] == [50.0, None, None] and [r[2] for r in rows] == [1.0, 2.0, 1.5]
    assert rows[0][1].startswith("Zoë Ångstr") and rows[1][1] == "Bo" and rows[2][1] == ""
    assert info == {"column_labels": {"age": "How old", "full_name": None, "gender": None}, "value_labels": {"gender": {"1.0": "female", "2.0": "male"}}}
    assert df.schema["gender"].metadata["value_labels"]["1.0"] == "female"
    with pytest.raises(ValueError):
        spss.header(b"no such file")


@pytest.mark.parametrize("kind", ["plain", "bytecodes", "zlib"])
def test_a_system_file_is_read_by_many_tasks(spark, tmp_path, kind, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1.0, 2.5, 151.0, 152.0, -99.0, 1e9]), rng.choice(["", "ab", "Zoë x", "y" * 23]), float(k)) for k in range(700)]
    df = spark.createDataFrame(rows, "number double, text string, row double").coalesce(1)
    path = spss.write(df, f"file://{tmp_path}/t.sav")
    data = (tmp_path / "t.sav").read_bytes()
    head = spss.header(data)
    body = data[head.data_at :]
    if kind == "plain":
        cells = b"".join(struct.pack("<d", -1.7976931348623157e308 if n is None else n) + t.encode().ljust(24) + struct.pack("<d", r) for n, t, r in rows)
        (tmp_path / "t.sav").write_bytes(data[:72] + struct.pack("<i", 0) + data[76 : head.data_at] + cells)
    elif kind == "zlib":
        parts = [body[k : k + 1001] for k in range(0, len(body), 1001)]
        packed, at = [zlib.compress(x) for x in parts], head.data_at + 24
        entries, before = b"", 0
        for plain, small in zip(parts, packed):
            entries += struct.pack("<2q2i", head.data_at + before, at, len(plain), len(small))
            at, before = at + len(small), before + len(plain)
        trailer = struct.pack("<2q2i", -100, 0, 1001, len(parts)) + entries
        made = b"$FL3" + data[4:72] + struct.pack("<i", 2) + data[76 : head.data_at] + struct.pack("<3q", head.data_at, at, len(trailer)) + b"".join(packed) + trailer
        (tmp_path / "t.sav").write_bytes(made)
    for split in (64, 999, 1 << 20):
        found, _ = spss.read(spark, path, split)
        assert [tuple(r) for r in found.collect()] == rows
        assert found.rdd.getNumPartitions() > 10 or split > 64
    monkeypatch.setattr(spss, "OPENED", ())
    assert [tuple(r) for r in spss.read(spark, path, 2000)[0].collect()] == rows
    (tmp_path / "t.sav").write_bytes(data[:300])
    with pytest.raises(Exception, match="cut off"):
        spss.read(spark, path)[0].collect()


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name.replace("__", "."), data)
    return out.getvalue()


CSV, PNG = b"a,b\n1,2\n3,4\n", b"\x89PNG\r\n\x1a\n123"


def test_kinds_of_files(spark, tmp_path):
    files = {
        "a.csv": (CSV, ["csv"], "tabular"),
        "a.tsv": (b"a\tb\n1\t2\n", ["tsv"], "tabular"),
        "b.xlsx": (workbook([["a"]]), ["xlsx"], "tabular"),
        "c.zip": (zipped(x__csv=CSV), ["csv"], "tabular"),
        "d.zip": (zipped(x__csv=CSV, y__png=PNG), ["csv", "png"], "image"),
        "e.zip": (zipped(inner__zip=zipped(x__csv=CSV)), ["csv"], "tabular"),
        "f.sav": (system_file(0), ["sav"], "tabular"),
        "g.png": (PNG, ["png"], "image"),
        "h.jpg": (b"\x00\x01", ["unknown"], "image"),
        "i.json": (json.dumps({"a": 1}).encode(), ["json"], "tabular"),
        "j.bin": (b"\x00\x01\x02", ["unknown"], "tabular"),
    }
    for name, (data, _, _) in files.items():
        (tmp_path / name).write_bytes(data)
    kinds = identify.file_kinds(spark, [str(tmp_path / n) for n in files])
    got = {r.path.rsplit("/", 1)[1]: (r.labels, r.data_kind) for r in identify.routed(kinds).collect()}
    assert got == {n: (labels, kind) for n, (_, labels, kind) in files.items()}
    assert all(identify.route(labels, n) == kind for n, (_, labels, kind) in files.items())
    deep = CSV
    for _ in range(6):
        deep = zipped(x__zip=deep)
    assert dict(identify.expand("deep", io.BytesIO(deep), len(deep))) == {"x.zip": "zip"}


def test_only_parts_of_files_are_read(spark, tmp_path):
    """Files above the limit of Spark's binary reader, archives of large members, archives in archives, and names that come twice."""
    before = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    rows = b"a,b\n" + b"1,2\n" * 200_000
    (tmp_path / "large file.csv").write_bytes(rows)
    (tmp_path / "lines.json").write_bytes(b'{"a": "' + b"x" * 5000 + b'"}\n' * 1 + (b'{"a": "' + b"x" * 5000 + b'"}\n') * 40)
    (tmp_path / "large.zip").write_bytes(zipped(x__csv=rows, y__tsv=b"a\tb\n1\t2\n" * 50_000, z__zip=zipped(inner__png=PNG + bytes(300_000), deep__zip=zipped(w__csv=rows))))
    (tmp_path / "many.zip").write_bytes(zipped(**{f"m{k}__csv": CSV for k in range(300)}, last__png=PNG))
    with zipfile.ZipFile(tmp_path / "twice.zip", "w") as z:
        z.writestr("a.dat", CSV)
        z.writestr("folder/", b"")
        with pytest.warns(UserWarning):
            z.writestr("a.dat", PNG)
    with zipfile.ZipFile(tmp_path / "zip64.zip", "w") as z, z.open(zipfile.ZipInfo("a.csv"), "w", force_zip64=True) as member:
        member.write(CSV)
    whole = zipped(a__csv=CSV, b__png=PNG)
    (tmp_path / "cut.zip").write_bytes(whole[:-30])
    (tmp_path / "harmed.zip").write_bytes(zipped(a__csv=CSV).replace(b"1,2", b"1,3"))
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        kinds = identify.file_kinds(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", before)
    found = {}
    for r in kinds:
        found.setdefault(r.path.rsplit("/", 1)[1], {})[r.name] = r.label
    assert found["large file.csv"] == {"large file.csv": "csv"} and found["lines.json"] == {"lines.json": "jsonl"}
    assert found["large.zip"] == {"x.csv": "csv", "y.tsv": "tsv", "inner.png": "png", "w.csv": "csv"}
    assert found["many.zip"] == {f"m{k}.csv": "csv" for k in range(300)} | {"last.png": "png"}
    assert found["twice.zip"] == {"a.dat": "png"} and found["zip64.zip"] == {"a.csv": "csv"}
    assert found["cut.zip"] == {"cut.zip": "unknown"} and found["harmed.zip"] == {"a.csv": "unknown"}


def test_other_stores_come_through_spark(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(identify, "OPENED", ())
    (tmp_path / "a.zip").write_bytes(zipped(x__csv=CSV, y__png=PNG))
    (tmp_path / "b.csv").write_bytes(CSV)
    found = {(r.path.rsplit("/", 1)[1], r.name): r.label for r in identify.file_kinds(spark, str(tmp_path)).collect()}
    assert found == {("a.zip", "x.csv"): "csv", ("a.zip", "y.png"): "png", ("b.csv", "b.csv"): "csv"}


def test_synthetic(spark):
    df = synthetic.generate(spark, 2000, 1)
    rows = df.collect()
    assert df.columns == [*synthetic.COLUMNS, "anxiety"] and len(rows) == 2000
    for name, kind in synthetic.COLUMNS.items():
        low, high = (0, 3) if kind == "severity" else (19, 105) if kind == "age" else kind
        values = {r[name] for r in rows}
        assert min(values) >= low and max(values) <= high and (kind == "age" or len(values) == high - low + 1)
    assert 0.3 < sum(r.anxiety > 0 for r in rows) / 2000 < 0.7
    assert 0.5 < sum(r.pain == 0 for r in rows) / 2000 < 0.6
