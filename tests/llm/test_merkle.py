import hashlib
import zlib

from tabularium.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute(rows):
    """Tuples of the result of each (doc_id, source, lang, n_chars, text), by building all levels of each tree in lists."""

    def field(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def tree(digests):
        """The root and the siblings of each leaf, level by level, with the place among them."""
        paths, at = [[] for _ in digests], list(range(len(digests)))
        while len(digests) > 1:
            for k, place in enumerate(at):
                run = digests[place // 3 * 3 : place // 3 * 3 + 3]
                paths[k].append((place % 3, run[: place % 3] + run[place % 3 + 1 :]))
            digests, at = [H(*digests[k : k + 3]) for k in range(0, len(digests), 3)], [p // 3 for p in at]
        return digests[0], paths

    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append((r, H(*map(field, r))))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    made = []
    for s in names:
        own = sorted(sources[s], key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        made.append((own, *tree([d for _, d in own])))
    root, upper = tree([m[1] for m in made]) if made else (None, [])
    out = []
    for (own, subroot, paths), top in zip(made, upper):
        for (r, leaf), path in zip(own, paths):
            folded = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                folded = H(*map(field, (*r[:4], r[4].replace("\n", ""))))
            for k, others in path + top:
                folded = H(*others[:k], folded, *others[k:])
            out.append((r[0], leaf, subroot, root, H(*[x for _, others in path + top for x in others]), folded, folded == root))
    return sorted(map(repr, out))


def compared(spark, tmp_path, rows, extra=""):
    spark.createDataFrame([(*r, *([0] * (2 if extra else 0))) for r in rows], f"doc_id long, source string, lang string, n_chars long, text string{extra}").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    out = merkle.op11_merkle_manifest(spark, str(tmp_path))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = list(map(tuple, out.collect()))
    assert sorted(map(repr, found)) == brute(rows)
    return found


def test_sources_of_all_sizes(spark, tmp_path):
    rows = [(1000 * n + k, f"s{n}", "en", k, f"line {k}\nmore") for n in (1, 2, 3, 4, 9, 10, 28, 100) for k in range(n)]
    odd = [(None, "s4", None, None, None), (4001, "s4", "en", 1, "line"), (4001, "s4", "en", 1, "line"), (7, None, "de", 0, ""), (8, "", "de", 0, None), (9, "\U0001f600é", "fr", 5, "ä\n\n"), (10, "￿", "fr", 5, "x" * 100_000 + "\n")]
    found = compared(spark, tmp_path, rows + odd, extra=", tree int, place int")
    assert {r[-1] for r in found} == {True, False}


def test_more_than_one_round(spark):
    rows = [(k, f"s{k % 40}" if k % 2 else "large", "en", 1, f"{k}\n") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    for height in (1, 2):
        assert sorted(repr(tuple(r)) for r in merkle.manifest(docs, height=height).collect()) == brute(rows)


def test_one_row_and_none(spark, tmp_path):
    (row,) = compared(spark, tmp_path / "a", [(2, "s", "en", 1, "a\nb")])
    assert row[4] == hashlib.sha256(b"").hexdigest() and row[1] == row[2] == row[3]
    assert compared(spark, tmp_path / "b", []) == []


def test_a_changed_row_is_found(spark):
    rows = [(k, "s", "en", 1, f"text {k}") for k in range(50)]
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    before = merkle.manifest(spark.createDataFrame(rows, schema)).first().root
    rows[17] = (17, "s", "en", 1, "text 17.")
    assert merkle.manifest(spark.createDataFrame(rows, schema)).first().root != before


def test_paths_fold():
    leaf, a, b = (hashlib.sha256(x).digest() for x in (b"0", b"1", b"2"))
    path = bytes([1, 2]) + a + b + bytes([0, 0])
    assert merkle.fold(leaf, path) == merkle.digest([merkle.digest([a, leaf, b])])
    assert merkle.proof(path) == merkle.digest([a, b]).hex()
