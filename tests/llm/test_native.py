"""Quality rules and licence scan: SQL and brute force, and edge cases."""

import random
import re

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tabularium.llm import license_scan, quality_rules

TEXTS = [
    None, "", "   \n\t ", "one", "a b c a b c a b c", "Home | About | Contact | Terms\nA proper sentence stands here.",
    "All rights reserved. Cookie policy.\n" + "Words go on and on in this line. " * 20, "x " * 5000, "# $ % & |\n#",
    "Zurück\nPRÉCÉDENT\nleer más\nZurück zur Natur.\nAlle Rechte vorbehalten.\nPolitique de CONFIDENTIALITÉ.\nTodos los derechos reservados.\nUn texto.\n" + "Words go on and on in this line. " * 20,
    "Same line here.\nSame line here.\nSame line here.\n" * 3, "é ü ñ words here.", "no end of sentence in this rather long line of words",
]


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)) + [(3, "one"), (None, "null id")], "doc_id long, text string")


def test_base_measures(docs):
    rows = quality_rules.measure(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_rules_as_sql(spark, docs):
    con = duckdb.connect()
    frame = docs.toPandas()
    con.register("documents", frame)
    want = con.execute(quality_rules.SQL).fetchdf()
    got = quality_rules.measure(docs).select(*quality_rules.COLUMNS).toPandas()
    columns = [c for c in quality_rules.COLUMNS if c != "doc_id"]
    assert sorted(map(str, want[columns].values.tolist())) == sorted(map(str, got[columns].values.tolist()))


def test_texts_are_searched_for_notices_by_their_stems(spark):
    """A text is lower-cased once, each notice is found alone and in capitals, and windows are sorted without a comparator."""
    assert all(any(stem in b for stem in quality_rules.STEMS) for b in quality_rules.BOILERPLATE)
    texts = [f"Here we have {b.upper()} in this line of words." for b in quality_rules.BOILERPLATE]
    texts += ["Cookies, terms and private javascript are words that stand here."]
    rows = quality_rules.measure(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.n_failed_lines for r in rows] == [1] * len(quality_rules.BOILERPLATE) + [0]
    text, flag = F.col("text"), F.lit(True)
    assert str(quality_rules._flags(text)[2]).count("lower(text)") == 1
    assert str(quality_rules.line_fails(text, flag, flag, flag)).count("lower(text)") == 1
    assert "array_sort" not in str(quality_rules.repeated_words(text))


def test_repeated_windows_of_random_words(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdé") for _ in range(rng.randrange(3, 60))) for _ in range(200)]
    rows = quality_rules.measure(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert [r.n_repeat_words for r in rows] == [brute(r.text)[4] for r in rows]


def test_lines_are_cleaned(spark):
    good = " ".join(f"word{k}" for k in range(80)) + "."
    menu = "Home | About | News | Contact"
    out = quality_rules.clean(spark.createDataFrame([(1, f"{menu}\n{good}\nlorem ipsum here.", "x"), (2, "\n".join([menu] * 30), "y")], "doc_id long, text string, __w string")).collect()
    assert out == [Row(doc_id=1, text=good, __w="x")]


def test_prose_of_other_scripts_and_long_lines_with_a_notice_are_kept(spark):
    line = lambda word, end, k: " ".join(f"{word}{k}x{i}" for i in range(6)) + end
    texts = ["\n".join(line(w, end, k) for k in range(30)) for w, end in (("शब्द", "।"), ("शब्द", "॥"), ("كلمة", "؟"), ("لفظ", "۔"), ("բառ", "։"), ("ቃል", "።"))]
    prose = " ".join(f"word{k}" for k in range(400)) + " is told in the privacy policy of the house."
    texts += [prose, "\n".join(["See our privacy policy here."] * 3 + [line("word", ".", k) for k in range(30)]), "function( a ) " + prose]
    rows = quality_rules.measure(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.kept for r in rows] == [True] * 8 + [False]
    assert [r.n_failed_lines for r in rows] == [0] * 7 + [3, 1]
    con = duckdb.connect()
    con.register("documents", spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").toPandas())
    want = con.execute(quality_rules.SQL).fetchdf()
    assert sorted(want[["doc_id", "kept", "n_failed_lines"]].values.tolist()) == [[r.doc_id, r.kept, r.n_failed_lines] for r in rows]


def test_rejects_what_loses_too_much(spark):
    lines = [" ".join(f"w{k}x{i}" for i in range(6)) for k in range(20)]
    texts = ["\n".join(f"{x}." for x in lines), "\n".join(f"{x} # $ % & ##" for x in lines)]
    rows = quality_rules.measure(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.base_failed, r.kept) for r in rows] == [(False, True), (False, False)]


LICENCES = [
    None, "", "MIT  License; GNU General Public LICENSE, version 3 cc-by-nc the MIT licensemit license", "gnu gnu general public license " * 3,
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "éMIT License mitK License CC BY", "mit " * 3000 + "license", "apache license" * 200, "cc by cc by cc\nby", "the licence of no one", "İapache license",
]


def test_base_phrases(spark):
    docs = spark.createDataFrame(list(enumerate(LICENCES)), "doc_id long, text string")
    for r in license_scan.scan(docs).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == license_scan.brute_force(r.text)
        assert 0 <= r.score <= 1
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}


def test_passages_need_their_key_phrases(spark):
    whole = license_scan.PASSAGES[9][1]
    docs = spark.createDataFrame([(1, f"some words {whole} more"), (2, whole.replace("source and binary", "source or binary")), (3, " ".join(reversed(whole.split())))], "doc_id long, text string")
    found = {r.doc_id: (r.labels, r.n_base) for r in license_scan.scan(docs).collect()}
    assert found == {1: ("bsd", 0), 2: ("", 0), 3: ("", 0)}


def places_of(text):
    """Labels and score by trying every place of every template, without gate, anchors or SQL."""
    words = re.findall(license_scan.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    labels, best = set(), 0.0
    for t in license_scan.TEMPLATES:
        for d in range(-len(t.words), len(words)):
            stands = lambda x, d=d: 0 <= d + x[0] < len(words) and words[d + x[0]] == x[1]
            share = 1.0 if t.base else sum(license_scan.WEIGHTS[x[1]] for x in t.rare if stands(x)) / t.total
            if all(map(stands, t.keys)) and (t.base or share >= license_scan.MIN_SHARE - 1e-9):
                labels.add(t.label)
                best = max(best, share)
    return ",".join(sorted(labels)), round(best, 9)


PASSAGES = [
    "Use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    *[p for _, p, _ in license_scan.PASSAGES],
    *[p.split(" ", 1)[1] for _, p, _ in license_scan.PASSAGES],
    *[p.replace(" ", " x ", 1) for _, p, _ in license_scan.PASSAGES],
    *[" ".join(k) for _, _, k in license_scan.PASSAGES],
    " and ".join(p for _, p, _ in license_scan.PASSAGES),
    "version 2 of the text and version 3 of the fee " * 40,
]


def test_passages_as_by_trying_every_place(spark):
    docs = spark.createDataFrame(list(enumerate([*LICENCES, *PASSAGES])), "doc_id long, text string")
    for r in license_scan.scan(docs).collect():
        assert (r.labels, r.score) == places_of(r.text), r.text
    found = {r.doc_id: r.labels for r in license_scan.scan(docs).collect()}
    assert found[len(LICENCES)] == "bsd" and found[len(LICENCES) + 1] == "isc"


def test_scan_as_sql(spark):
    frame = spark.createDataFrame(list(enumerate([*LICENCES, *PASSAGES])), "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", frame.toPandas())
    want = con.execute(f"SELECT doc_id, {', '.join(license_scan.RESULTS)} FROM ({license_scan.SQL}) ORDER BY doc_id").fetchall()
    assert want == [tuple(r) for r in license_scan.scan(frame).select("doc_id", *license_scan.RESULTS).orderBy("doc_id").collect()]


def test_gate_has_a_mandatory_word_of_every_template():
    for t in license_scan.TEMPLATES:
        assert re.search(license_scan.GATE, " ".join(w for _, w in t.keys))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert quality_rules.measure(none).count() == 0
    assert license_scan.scan(none).count() == 0


def test_no_python_in_the_plans(spark, docs):
    for df in (quality_rules.measure(docs), license_scan.scan(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas|Exchange", plan.split("Scan")[0])


def test_other_columns_do_not_clash(spark):
    docs = spark.createDataFrame([(1, "MIT License", "x")], "doc_id long, text string, words string")
    assert license_scan.scan(docs).select(F.col("words"), "labels").collect() == [Row(words="x", labels="mit")]
