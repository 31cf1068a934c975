import hashlib
import random

from tabularium.llm import exact_dedup as dedup


def brute(rows):
    groups = {}
    for k, (key, text) in enumerate(rows):
        bare = "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")
        groups.setdefault(bare, []).append((-len(text or ""), key is None, key or 0, k))
    out = []
    for bare, members in groups.items():
        best = min(members)
        keep = rows[best[3]][0]
        out += [(rows[m[3]][0], keep, len(members), m is best or m == best, hashlib.sha256(bare.encode()).hexdigest()) for m in members]
    return sorted(out, key=str)


def stored(spark, tmp_path, rows, schema="doc_id long, text string"):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "t"))
    return spark.read.parquet(str(tmp_path / "t"))


ROWS = [(1, "a b"), (2, "ab "), (3, "ab"), (4, "ab  \n"), (5, None), (6, ""), (7, "  "), (None, "ab \t\t"), (8, "é" * 50000), (9, "é " * 50000), (3, "ab"), (10, "x y"), (11, "xy"), (12, "same"), (12, "same")]


def test_against_brute_force(spark, tmp_path):
    got = dedup.groups(stored(spark, tmp_path, ROWS))
    assert sorted(map(tuple, got.collect()), key=str) == brute(ROWS)


def test_small_memory_spills(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, rng.choice(["abc def", "x" * 300]) + str(rng.randrange(60))) for k in range(500)]
    got = dedup.groups(stored(spark, tmp_path, rows), memory=4000)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_grace_partitions_until_it_fits():
    records = [(h << 60 | h, b"c%d" % (h % 40), (1, 1, h, h)) for h in range(200)]
    same = [(7, b"one", (1, 1, k, k)) for k in range(100)]
    out = list(dedup.grace(iter(records + same), memory=2000))
    assert sum(meta[0] for _, _, meta in out) == 300
    assert [meta for _, content, meta in out if content == b"one"] == [(100, 1, 0, 0)]


def test_equal_hashes_are_told_apart():
    table = dedup.ContentTable()
    for k in range(3000):
        table.add(5, b"%d" % (k % 1500), (1, 0, k, k))
    assert len(table.contents) == 1500 and all(m[0] == 2 for m in table.metas)


def test_deduplicate_keeps_columns(spark, tmp_path):
    docs = stored(spark, tmp_path, [(1, "a b", 7), (2, "ab", 8), (3, "c", 9)], "doc_id long, text string, digest int")
    out = dedup.deduplicate(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == [(1, "a b", 7), (3, "c", 9)]


def test_empty(spark, tmp_path):
    docs = stored(spark, tmp_path, [])
    assert dedup.groups(docs).count() == 0 and dedup.deduplicate(docs).count() == 0
