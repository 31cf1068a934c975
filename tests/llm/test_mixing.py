import duckdb
import pytest

from tabularium.llm import mixing


def stored(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, source string, text string, size string").write.parquet(str(tmp_path / "t"))
    return spark.read.parquet(str(tmp_path / "t"))


def targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight; what is above the cap goes to the others, again and again."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, out, open_ = float(sum(sizes.values())), {}, list(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
            open_.remove(s)
    return out


ROWS = [(k, s, " ".join(["w"] * (1 + k * 7 % 23)), "s") for s in ("a", "b", "c", "d", "é", None) for k in range(40 if s == "a" else 5)] + [(900, "z", None, "s"), (901, "z", "", "s"), (None, "b", "x y", "s"), (None, "b", "x y", "s"), (3, "b", "q", "s")]


def test_targets_and_cuts(spark, tmp_path):
    rows = mixing.mix(stored(spark, tmp_path, ROWS)).collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = targets(sizes)
    for s in sizes:
        own = [r for r in rows if r.source == s]
        assert all(r.target == pytest.approx(want[s]) for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= 0.5
        assert all(0 <= r.taken <= 3 * r.size for r in own)
        assert sum(0 < r.taken % r.size for r in own if r.size) <= 1


def test_as_sql_and_again(spark, tmp_path):
    docs = stored(spark, tmp_path, ROWS)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/t/*.parquet'")
    want = sorted(map(str, con.execute(mixing.SQL).fetchall()))
    columns = ("id", "source", "size", "source_size", "target", "taken")
    for _ in range(2):
        got = sorted(str(tuple(r[c] for c in columns)) for r in mixing.mix(docs.repartition(5)).collect())
        assert got == want


def test_documents_repeat_by_epoch(spark, tmp_path):
    docs = stored(spark, tmp_path, [(1, "a", "x y", "s"), (2, "b", "x " * 50, "s"), (3, "b", "y " * 50, "s"), (4, "b", None, "s")])
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    counts = {}
    for r in out.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert counts[1] == 3 and 4 not in counts and counts[2] + counts[3] in (1, 2)


def test_empty(spark, tmp_path):
    docs = stored(spark, tmp_path, [])
    assert mixing.mix(docs).count() == 0 and mixing.mixed_documents(docs).count() == 0
    blank = stored(spark, tmp_path / "b", [(1, "a", " ", "s")])
    assert [(r.taken, r.target) for r in mixing.mix(blank).collect()] == [(0, 0.0)]
