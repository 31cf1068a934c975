import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabularium.functions import masking
from tabularium.operators import anonymize

#: Text, what is left of it, and the labels that fire.
CASES = [
    ("123-45-6789", "****", ["PHONE"]),
    ("4111 1111 1111 1111", "****", ["PHONE"]),
    ("192.168.100.200", "****", ["PHONE"]),
    ("10.0.0.1", "****", ["IP"]),
    ("1.2.3.4", "****", ["IP"]),
    ("1990-01-01", "****", ["PHONE"]),
    ("01/02/1990", "****", ["DOB"]),
    ("1-2-90", "****", ["DOB"]),
    ("12-2-1990", "****", ["PHONE"]),
    ("MRN: 123456", "****", ["MRN"]),
    ("MRN:123456789", "MRN:****", ["PHONE"]),
    ("call 5+1234567890", "call 5+****", ["PHONE"]),
    ("a@b.co x", "**** x", ["EMAIL"]),
    ("2024-01-01 10:00:00", "****:00:00", ["PHONE"]),
    ("1234567.89", "****", ["PHONE"]),
    ("x123456789", "x****", ["PHONE"]),
    ("123 Main, 12345678", "123 Main, ****", ["MRN"]),
    ("nothing here", "nothing here", []),
    ("", "", []),
    (None, None, []),
]


def in_python(text):
    found = []
    for name, pattern in masking.PATTERNS.items():
        out = re.sub(pattern, masking.MASK, text, flags=re.IGNORECASE if name == "MRN" else 0)
        if out != text or re.search(pattern, text, re.IGNORECASE if name == "MRN" else 0):
            found.append(name)
        text = out
    return text, found


def test_cases(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(CASES)], "k int, t string")
    got = rows.orderBy("k").select(masking.mask(F.col("t")), masking.hits(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(m, h) for _, m, h in CASES]


@pytest.fixture(scope="module")
def drawn():
    return st.lists(st.text(alphabet="0123456789 -./+()@:#abMRNmrn_\n", max_size=40), min_size=50, max_size=50)


def test_random_texts(spark, drawn):
    @settings(max_examples=8, deadline=None)
    @given(drawn)
    def check(texts):
        rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
        once = masking.mask(F.col("t"))
        got = rows.orderBy("k").select("t", once, masking.hits(F.col("t")), masking.mask(once)).collect()
        for text, masked, found, twice in got:
            assert (masked, found) == in_python(text)
            assert twice == masked and not {"SSN", "CREDIT_CARD"} & set(found)

    check()


def test_columns(spark):
    df = spark.createDataFrame([("Ann", "mail a@b.co", 5551234567, None), (None, "none", 1, "x")], "Patient_Name string, note string, n long, filename string")
    out, report = anonymize.anonymize(df)
    assert [tuple(r) for r in out.collect()] == [("****", "mail ****", 5551234567, "****"), ("****", "none", 1, "****")]
    assert report.as_dict() == {"masked_columns": {"Patient_Name": "column_name_hint", "note": ["EMAIL"], "filename": "column_name_hint"}, "detected_types": ["EMAIL", "IDENTITY"]}
    assert anonymize.image_report(["a", "b"])["n_images"] == 2


def test_stream(spark, tmp_path):
    from tabularium.streaming.masking import masked_stream

    spark.createDataFrame([(1, "a@b.co"), (2, "plain")], "id int, note string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, note string").parquet(str(tmp_path / "in"))
    masked_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(1, "****"), (2, "plain")]


def test_each_pattern_replaces_once_in_a_report(spark):
    df = spark.createDataFrame([(t,) for t in ("a@b.com 123-45-6789", "tel 0171 555 66 77, 10.0.0.1", "१२३४५६७८९० é", "MRN: 1234567", "no", None)], "t string")
    found = anonymize.label_counts(df, ["t"])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") <= len(masking.PATTERNS)
    want = df.select(F.explode(masking.hits(F.col("t"))).alias("label")).groupBy("label").count()
    assert {(r.label, r.n) for r in found.collect()} == {tuple(r) for r in want.collect()}
