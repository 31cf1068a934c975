"""Merkle manifest of a table by supersteps over an RDD.

A leaf is the SHA-256 of a row. Leaves of a source ascend by id, then by digest, and every three consecutive nodes make
a parent, level by level, up to the source's subroot; subroots make the root in the same way.

1. Rows are sorted into ranges, and a row's place in its source is its place in its range plus the counts of the
   ranges before it, so no task numbers a source.
2. Vertices (tree, level, place) climb in rounds of ``HEIGHT`` supersteps. In each, nodes send their digests to
   their parents; a parent that has all its children (their number follows from the level's size) hashes them and is
   ready to send in the next. A round's partitioner keeps the subtree that a round makes together, so its messages
   are shuffled once, not once a level. What has climbed is written to the shared folder.
3. The rounds are taken again from the root down: subtrees climb once more, the path that came down to a subtree's
   top waits there as a message, and reverse supersteps hand every child its parent's path with the siblings
   put in front. A leaf that has its path folds its digest, of the tampered row where there is one, into a root.

A source of any size is many subtrees of ``3 ** HEIGHT`` leaves. Paths have a step a level and are only ever sent to
subtrees' tops. There are about log3(rows) / HEIGHT rounds.

Defined results: a null id comes first in its source and is not tampered with; a null source is a source of its own,
before all others. Repeated ids ascend by digest; rows that are equal have equal leaves and proofs of their own. A table
of one row has its leaf as root and an empty proof. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabularium.functions.ship import ship
from tabularium.llm.common import drop, materialise, table

FAN = 3
#: Levels of a round: its subtrees have 3 ** HEIGHT leaves at most.
HEIGHT = 6
#: Vertices that a partition of a round is to have at most, about.
PART_ROWS = 1 << 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_VERTICES = "tree long, place long, n long, digest binary"
_PATHS = "tree long, place long, path binary"
_PROOFS = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(parts: Iterable[bytes]) -> bytes:
    """The hash of digests as hexadecimal text."""
    return hashlib.sha256(b"".join(p.hex().encode() for p in parts)).digest()


def row_digest(*fields: Column) -> Column:
    """The hash of a row: each field ``-`` if null, else its length in bytes, a colon and itself."""
    texts = [f.cast("string") for f in fields]
    cells = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*cells).cast("binary"), 256))


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, source, digest, tampered, tie) of each row; ``tampered`` is null where a row stays as it is. The first field is the id, the second the source, the last the text."""
    own, text = [F.col(f"`{c}`") for c in fields], F.col(f"`{fields[-1]}`").cast("string")
    tampered = row_digest(*own[:-1], F.replace(text, F.lit("\n"), F.lit("")))
    chosen = F.crc32(own[0].cast("string").cast("binary")) % 2 == 0
    return docs.select(own[0].cast("long").alias("id"), own[1].cast("string").alias("source"), row_digest(*own).alias("digest"), F.when(chosen, tampered).alias("tampered"), F.monotonically_increasing_id().alias("tie"))


def placed(rows: DataFrame) -> DataFrame:
    """Adds tree, the source's number, n, its rows, and place, the row's in it, from 0."""
    order = [F.col("source").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("digest"), F.col("tie")]
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialise(ranges.select("id", "source", "digest", "tampered", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at")), "ranged")
    of_source, before = Window.partitionBy("source"), (Window.unboundedPreceding, -1)
    cells = ranged.groupBy("range", "source").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    earlier = F.coalesce(F.sum("rows").over(of_source.orderBy("range").rowsBetween(*before)), F.lit(0))
    cells = materialise(cells.withColumns({"earlier": earlier, "n": F.sum("rows").over(of_source), "begins": F.min("range").over(of_source) == F.col("range")}), "cells")
    begun = cells.groupBy("range").agg(F.count_if("begins").alias("k"))
    begun = begun.select("range", F.coalesce(F.sum("k").over(Window.orderBy("range").rowsBetween(*before)), F.lit(0)).alias("sooner"))  # over ranges, not rows
    number = F.col("sooner") + F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_first())) - 1
    trees = cells.where("begins").join(begun, "range").select(F.col("source").alias("__source"), number.alias("tree"))
    known = cells.join(trees, F.col("source").eqNullSafe(F.col("__source"))).select(F.col("range").alias("__range"), "__source", "tree", "n", "first", "earlier")
    known = materialise(known, "numbered")
    out = ranged.join(known, (F.col("range") == F.col("__range")) & F.col("source").eqNullSafe(F.col("__source")))
    out = materialise(out.select("id", "digest", "tampered", "tree", "n", (F.col("at") - F.col("first") + F.col("earlier")).alias("place")), "leaves")
    drop(ranged, cells, known)
    return out


def _home(key: tuple[int, int, int], height: int) -> int:
    """The number of a vertex's subtree of the round, for the partitioner."""
    tree, level, place = key
    return tree * 1_000_003 + place // FAN ** (height - level)


def _send(vertices: Iterator[tuple]) -> Iterator[tuple]:
    """Messages to the parents. The only vertex of its level goes up as it is, and what waits at a top stays."""
    for key, vertex in vertices:
        if vertex[0] == "path":
            yield key, vertex
        else:
            tree, level, place = key
            yield (tree, level + 1, place // FAN), (*vertex[:1], place % FAN, *vertex[2:])


def _complete(groups: Iterator[tuple]) -> Iterator[tuple]:
    """Vertices that have all their children: ("node", place among siblings, level's size, digest, children, row)."""
    for key, messages in groups:
        children = sorted((m for m in messages if m[0] == "node"), key=lambda m: m[1])
        yield from ((key, m) for m in messages if m[0] == "path")
        if not children:
            continue
        n = children[0][2]
        if n == 1:
            yield key, children[0]
        elif len(children) != min(FAN, n - FAN * key[2]):
            raise ValueError(f"vertex {key} has {len(children)} of its children; the table's ranks have gaps")
        else:
            yield key, ("node", 0, -(-n // FAN), digest(c[3] for c in children), tuple(children), None)


def climb(vertices: RDD, parts: int, height: int) -> RDD:
    """The tops of a round's subtrees, with all that is below them, and what waits there."""
    home = partial(_home, height=height)
    now = vertices.partitionBy(parts, home)
    for _ in range(height):
        now = now.mapPartitions(_send, preservesPartitioning=True).groupByKey(parts, home).mapPartitions(_complete, preservesPartitioning=True)
    return now


def _meet(records: Iterator[tuple]) -> Iterator[tuple]:
    """(tree, place, node, path) of the tops; what waits at a top comes just before it."""
    waits = None
    for key, record in records:
        if record[0] == "path":
            waits = key, record[1]
        elif waits is None or waits[0] != key:
            raise ValueError(f"no path has come down to vertex {key}")
        else:
            yield key[0], key[2], record, waits[1]


def _descend(nodes: Iterator[tuple]) -> Iterator[tuple]:
    """Children with their paths: a step is the place among the siblings, their number, and their digests, up from the leaf."""
    for tree, place, node, path in nodes:
        children = node[4]
        if not children:
            yield tree, place, node, path
        for k, child in enumerate(children):
            others = b"".join(c[3] for c in children if c is not child)
            yield tree, place * FAN + k, child, bytes([k, len(children) - 1]) + others + path


def steps(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    at = 0
    while at < len(path):
        k, n = path[at], path[at + 1]
        yield k, [path[at + 2 + 32 * i : at + 34 + 32 * i] for i in range(n)]
        at += 2 + 32 * n


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its siblings make."""
    for k, others in steps(path):
        leaf = digest([*others[:k], leaf, *others[k:]])
    return leaf


def proof(path: bytes) -> str:
    return digest(s for _, others in steps(path) for s in others).hex()


def _keyed(rows: Iterator[tuple]) -> Iterator[tuple]:
    for tree, place, n, own, *row in rows:
        yield (tree, 0, place), ("node", 0, n, bytes(own), (), tuple(row) or None)


def _waiting(rows: Iterator[tuple], height: int) -> Iterator[tuple]:
    for tree, place, path in rows:
        yield (tree, height, place), ("path", bytes(path))


def _parts(n: int, spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // PART_ROWS))


def _up(vertices: DataFrame, name: str, height: int) -> list[DataFrame]:
    """The rounds' vertices, (tree, place, n, digest, ...): the given ones, then tops of subtrees, until no tree has more than one."""
    spark, rounds = vertices.sparkSession, [vertices]
    while True:
        below = rounds[-1].where("n > 1")
        n = below.count()
        if not n:
            return rounds
        tops = climb(below.select("tree", "place", "n", "digest").rdd.mapPartitions(_keyed), _parts(n, spark), height)
        made = tops.map(lambda t: (t[0][0], t[0][2], t[1][2], t[1][3]))
        rounds.append(materialise(spark.createDataFrame(made, _VERTICES, verifySchema=False), name))


def _down(vertices: DataFrame, paths: DataFrame, height: int, extra: tuple[str, ...] = ()) -> RDD:
    """(tree, place, node, path) of a round's vertices, from the paths of the subtrees' tops."""
    spark, below = vertices.sparkSession, vertices.where("n > 1")
    own = below.select("tree", "place", "n", "digest", *extra).rdd.mapPartitions(_keyed)
    tops = climb(own.union(paths.rdd.mapPartitions(lambda rows: _waiting(rows, height))), _parts(below.count(), spark), height)
    nodes = tops.mapPartitions(_meet)
    for _ in range(height):
        nodes = nodes.mapPartitions(_descend)
    return nodes


def _all_paths(rounds: list[DataFrame], ends: DataFrame, height: int) -> DataFrame:
    """Paths of the first round's tops, or leaves that are tops, from those of the trees' last vertices (tree, path)."""
    spark = rounds[0].sparkSession
    paths, made = None, []
    for r in range(len(rounds) - 1, 0, -1):
        done = rounds[r].where("n = 1").join(ends, "tree").select("tree", "place", "path")
        below = _down(rounds[r], paths, height) if r < len(rounds) - 1 else None
        paths = materialise(done if below is None else done.unionByName(spark.createDataFrame(below.map(lambda x: (x[0], x[1], x[3])), _PATHS, verifySchema=False)), "tops")
        made.append(paths)
    drop(*made[:-1])
    return paths


def _proofs(rows: Iterator[tuple], root: bytes) -> Iterator[tuple]:
    """Rows of ``_PROOFS`` from (id, digest, tampered, path), the path with the subroot at its end."""
    for doc, own, tampered, path in rows:
        own, path, subroot = bytes(own), bytes(path[:-32]), bytes(path[-32:])
        folded = fold(own if tampered is None else bytes(tampered), path)
        yield doc, own.hex(), subroot.hex(), root.hex(), proof(path), folded.hex(), folded == root


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, height: int = HEIGHT) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row."""
    spark = docs.sparkSession
    ship(spark)
    rows = materialise(leaves(docs, fields), "digests")
    base = placed(rows)
    drop(rows)
    rounds = _up(base, "nodes", height)
    every = rounds[0].where("n = 1").select("tree", "digest")
    for r in rounds[1:]:
        every = every.unionByName(r.where("n = 1").select("tree", "digest"))
    every = materialise(every, "subroots")
    trees = every.count()
    if not trees:
        return spark.createDataFrame([], _PROOFS)
    zero = F.lit(0).cast("long")
    top = _up(every.select(zero.alias("tree"), F.col("tree").alias("place"), F.lit(trees).cast("long").alias("n"), "digest"), "top", height)
    root = bytes(top[-1].where("n = 1").first()["digest"])
    ends = spark.createDataFrame([(0, b"")], "tree long, path binary")
    if len(top) > 1:
        ends = spark.createDataFrame(_down(top[0], _all_paths(top, ends, height), height).map(lambda x: (x[1], x[3])), "tree long, path binary", verifySchema=False)
    ends = materialise(ends.join(every, "tree").select("tree", F.concat("path", "digest").alias("path")), "ends")
    found = base.where("n = 1").join(ends, "tree").select("id", "digest", "tampered", "path").rdd.map(tuple)
    if len(rounds) > 1:
        nodes = _down(base, _all_paths(rounds, ends, height), height, ("id", "tampered"))
        found = found.union(nodes.map(lambda x: (x[2][5][0], x[2][3], x[2][5][1], x[3])))
    return spark.createDataFrame(found.mapPartitions(lambda it: _proofs(it, root)), _PROOFS, verifySchema=False)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents."""
    return manifest(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def _sql(deep: int = 12, high: int = 5) -> str:
    """DuckDB SQL with a step for each of ``deep`` levels below subroots and ``high`` above. n: nodes, g: runs of three, f: rows on their way up."""

    def row(text: str) -> str:
        cells = [f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in (*FIELDS[:-1], text)]
        return f"sha256({' || '.join(cells)})"

    bits = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"list_reduce([4294967295::BIGINT] || {bits}, lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, (c % 2) * 3988292384) END)"
    joined = "coalesce(array_to_string({}, ''), '')".format
    others = joined("list_filter(g.nodes, lambda x, i: i <> f.spot % 3 + 1)")
    mine = joined("list_transform(g.nodes, lambda x, i: CASE WHEN i = f.spot % 3 + 1 THEN f.fold ELSE x END)")
    parts = [
        f"d AS (SELECT doc_id, source, {row('text')} AS leaf, {row("replace(text, chr(10), '')")} AS cut, {crc} % 2 = 1 AS chosen FROM documents)",
        "a AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM d)",
        "n0 AS (SELECT tree, place, leaf AS digest FROM a)",
        "f0 AS (SELECT doc_id, leaf, tree, place AS spot, CASE WHEN chosen THEN cut ELSE leaf END AS fold, '' AS proof, '' AS subroot FROM a)",
    ]
    for k in range(deep + high):
        if k == deep:  # subroots are the leaves of the last tree
            parts += [f"s AS (SELECT 0 AS tree, tree AS place, digest FROM n{k})", f"r AS (SELECT f.* REPLACE (0 AS tree, f.tree AS spot, n.digest AS subroot) FROM f{k} f JOIN n{k} n USING (tree))"]
        nodes, rows = ("s", "r") if k == deep else (f"n{k}", f"f{k}")
        parts += [
            f"g{k} AS (SELECT tree, place // 3 AS place, list(digest ORDER BY place) AS nodes, any_value(size) AS size FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS size FROM {nodes}) GROUP BY ALL)",
            f"n{k + 1} AS (SELECT tree, place, CASE WHEN size > 1 THEN sha256(array_to_string(nodes, '')) ELSE nodes[1] END AS digest FROM g{k})",
            f"f{k + 1} AS (SELECT f.* REPLACE (spot // 3 AS spot, CASE WHEN size > 1 THEN sha256({mine}) ELSE fold END AS fold, CASE WHEN size > 1 THEN proof || {others} ELSE proof END AS proof) FROM {rows} f JOIN g{k} g ON g.tree = f.tree AND g.place = f.spot // 3)",
        ]
    last = deep + high
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, n.digest AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = n.digest AS verified FROM f{last} JOIN n{last} n USING (tree)"


SQL = _sql()
