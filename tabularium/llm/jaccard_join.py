"""Similarity join on word shingles with Bayesian pruning of candidates.

Two texts are linked if the sets of their shingles, five consecutive lower-case words each, have a Jaccard
similarity of 0.8 or more. A text of one to four words is one shingle.

1. Each text gets a MinHash signature of 128 values. Texts with equal shingle sets (128-bit digests of the
   sorted sets) form a class, and only a representative of it goes on.
2. Representatives that agree in a band of four values meet in a bucket. With 32 bands, all values, a pair at similarity
   0.8 is missed with a probability of (1 - 0.8^4)^32 = 4.8e-8. A pair belongs to the first band it agrees in.
3. Buckets are cut into blocks and a task takes pairs of blocks, so no bucket, however large, lands in one task. A bucket of up to
   ``WAYS * MOST`` representatives has ``WAYS`` blocks at most, so that it sends no row more than ``WAYS`` times. The pairs of blocks of a bucket are
   dealt to the partitions one after the other.
   A pair's signatures are compared 16 values at a time; it is dropped as soon as the posterior probability, under a
   uniform prior, that its similarity reaches the threshold falls below 1e-6. Over all eight steps a pair at similarity 0.8
   is dropped with a probability of 8.9e-6, which is most of what the join misses.
4. The pairs that are left are verified exactly, on the shingles of the whole texts. A block pair's candidates leave as compressed lists;
   links between thousands of near copies are never rows of their own.
   Joins are merge joins at every size, so that a small input runs as a large one does.
5. Verified pairs are summed to numbers of links, with each class counted in full, and a spanning forest of every
   block pair gives the connected components.

Shingles are compared as 64-bit hashes. There is no limit on a bucket's size or on partners.

Defined results: a null text is empty; texts without words have no links and are classes of their own. Copies
are linked to each other. Ids may repeat or be null: rows count, each with its own links. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from math import comb

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.llm.common import drop, materialise, reserved, same_rows, small_batches, table, trimmed
from tabularium.llm.components import components
from tabularium.llm.hashing import mix, slices, word_hashes

SHINGLE = 5
#: The threshold as a fraction, for exact comparisons.
NUMERATOR, DENOMINATOR = 4, 5
HASHES, STEP = 128, 16
BANDS, BAND = 32, 4
TOLERANCE = 1e-6
#: Representatives of a bucket that make a block while there are few blocks, blocks of a bucket, and representatives of a block in the largest buckets.
BLOCK, WAYS, MOST = 256, 32, 4096
#: Candidates that are held as one list.
LIST = 1 << 17

_SALTS = np.frombuffer(hashlib.shake_128(b"minhash").digest(8 * HASHES), np.uint32).reshape(2, HASHES)
_MULTIPLY, _ADD = _SALTS[0] | np.uint32(1), _SALTS[1]
_PLACES = np.frombuffer(hashlib.shake_128(b"shingle").digest(8 * SHINGLE), np.uint64) | np.uint64(1)


def shingles(texts: Sequence[str]) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    out: list[np.ndarray] = []
    for a, b in slices(texts):
        doc, words = word_hashes([(t or "").lower() for t in texts[a:b]])
        at = np.searchsorted(doc, np.arange(b - a + 1))
        summed = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
        for k in range(SHINGLE):
            summed += words[k : k + len(summed)] * _PLACES[k]
        summed = mix(summed, 7)
        for i, j in zip(at, at[1:]):
            if j - i >= SHINGLE:
                out.append(np.unique(summed[i : j - SHINGLE + 1]))
            elif j > i:
                out.append(mix(np.array([(words[i:j] * _PLACES[: j - i]).sum() + np.uint64(j - i)], np.uint64), 8))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: Sequence[np.ndarray]) -> np.ndarray:
    """A row of HASHES minima for each set; sets are not empty."""
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), HASHES), np.uint32)
    room = np.empty_like(x)
    for k in range(HASHES):
        np.multiply(x, _MULTIPLY[k], out=room)
        room += _ADD[k]
        out[:, k] = np.minimum.reduceat(room, at)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature; keys of different bands differ."""
    parts = signature[:, : BANDS * BAND].astype(np.uint64).reshape(-1, BANDS, BAND)
    keys = np.zeros(parts.shape[:2], np.uint64)
    for k in range(BAND):
        keys = mix(keys ^ parts[:, :, k], k + 11)
    return mix(keys + np.arange(BANDS, dtype=np.uint64), 5)


def least_matches(threshold: float = NUMERATOR / DENOMINATOR, tolerance: float = TOLERANCE) -> dict[int, int]:
    """By values compared, the matches below which a pair is dropped.

    With a uniform prior and m of n values equal the posterior is Beta(m + 1, n - m + 1), and its mass from t on
    is the probability of at most m successes in n + 1 trials with chance t.
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        mass, m = 0.0, -1
        while mass < tolerance:
            m += 1
            mass += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


LEAST = least_matches()


def candidates(signature: np.ndarray, keys: np.ndarray, band: int, left: np.ndarray, right: np.ndarray) -> Iterator[np.ndarray]:
    """Lists of pairs (place in left, place in right) of a bucket that are not dropped; left is right for a block with itself."""
    found: list[np.ndarray] = []
    count = 0
    same = left is right
    for i, a in enumerate(left):
        others = right[i + 1 :] if same else right
        if not len(others):
            continue
        place = np.arange(i + 1 if same else 0, len(right))
        if band:
            fresh = ~(keys[others, :band] == keys[a, :band]).any(axis=1)
            others, place = others[fresh], place[fresh]
        matches = np.zeros(len(others), np.int64)
        for n in range(STEP, HASHES + 1, STEP):
            matches += (signature[others, n - STEP : n] == signature[a, n - STEP : n]).sum(axis=1)
            likely = matches >= LEAST[n]
            if not likely.all():
                others, place, matches = others[likely], place[likely], matches[likely]
            if not len(others):
                break
        if len(place):
            found.append(np.column_stack([np.full(len(place), i), place]))
            count += len(place)
            if count > LIST:
                yield np.concatenate(found)
                found, count = [], 0
    if found:
        yield np.concatenate(found)


def pack(pairs: np.ndarray) -> bytes:
    """Rows of pairs, mostly runs, as compressed differences."""
    first = np.diff(pairs[:, 0], prepend=0).astype(np.int32)
    second = np.diff(pairs[:, 1], prepend=0).astype(np.int32)
    return zstandard.ZstdCompressor(level=1).compress(first.tobytes() + second.tobytes())


def unpack(data: bytes) -> np.ndarray:
    both = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int32).reshape(2, -1)
    return np.cumsum(both, axis=1, dtype=np.int64).T


class Verifier:
    """Compares sets exactly."""

    def __init__(self, sets: Sequence[np.ndarray]) -> None:
        self.lengths = np.array([len(s) for s in sets])
        self.number = np.unique(np.concatenate(sets), return_inverse=True)[1]
        self.begin = np.concatenate([[0], np.cumsum(self.lengths)])
        self.marked = np.zeros(int(self.number.max()) + 1, bool)

    def similar(self, pairs: np.ndarray) -> np.ndarray:
        """Those of the pairs of places that reach the threshold."""
        good = np.zeros(len(pairs), bool)
        order = np.argsort(pairs[:, 0], kind="stable")
        firsts, at = np.unique(pairs[order, 0], return_index=True)
        for a, rows in zip(firsts, np.split(order, at[1:])):
            own = self.number[self.begin[a] : self.begin[a + 1]]
            self.marked[own] = True
            for part in np.array_split(rows, max(1, int(self.lengths[pairs[rows, 1]].sum() >> 19))):
                b = pairs[part, 1]
                at_b = np.concatenate([[0], np.cumsum(self.lengths[b])])
                taken = np.arange(at_b[-1]) - np.repeat(at_b[:-1] - self.begin[b], self.lengths[b])
                shared = np.add.reduceat(self.marked[self.number[taken]].astype(np.int64), at_b[:-1])
                good[part] = DENOMINATOR * shared >= NUMERATOR * (self.lengths[a] + self.lengths[b] - shared)
            self.marked[own] = False
        return pairs[good]


def join_up(label: np.ndarray, pairs: np.ndarray) -> list[tuple[int, int]]:
    """Those of the pairs that join two components for the first time; ``label`` names each place's component and is brought up to date."""
    kept = []
    order = np.argsort(pairs[:, 0], kind="stable")
    firsts, at = np.unique(pairs[order, 0], return_index=True)
    for a, rows in zip(firsts.tolist(), np.split(order, at[1:])):
        others = pairs[rows, 1]
        apart = others[label[others] != label[a]]
        while len(apart):
            kept.append((a, int(apart[0])))
            label[label == label[apart[0]]] = label[a]
            apart = apart[label[apart] != label[a]]
    return kept


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["row", "id", "n", "set_1", "set_2", "signature"]
    for batch in batches:
        texts, rows = batch.column("text").to_pylist(), batch.column("row").to_pylist()
        ids = batch.column("id")
        for a, b in slices(texts):
            sets = shingles(texts[a:b])
            full = [k for k, s in enumerate(sets) if len(s)]
            sketch = signatures([sets[k] for k in full]) if full else np.zeros((0, HASHES), np.uint32)
            signature: list[bytes | None] = [None] * len(sets)
            for k, line in zip(full, sketch):
                signature[k] = line.tobytes()
            digests = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) if len(s) else (row, -1) for s, row in zip(sets, rows[a:b])]
            yield pa.RecordBatch.from_arrays([pa.array(rows[a:b], pa.int64()), ids[a:b], pa.array([len(s) for s in sets], pa.int64()), pa.array([int(d[0]) for d in digests], pa.int64()), pa.array([int(d[1]) for d in digests], pa.int64()), pa.array(signature, pa.binary())], names=names)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        signature = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, HASHES)
        keys = band_keys(signature).view(np.int64)
        ends = pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))], names=["rep", "keys"])


def _groups(batches: Iterator[pa.RecordBatch], columns: Sequence[str]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Runs of rows with equal (key, i, j), from rows sorted by these."""
    group, held = None, {c: [] for c in columns}
    for batch in batches:
        if not batch.num_rows:
            continue
        key, i, j = (batch.column(c).to_numpy() for c in ("key", "i", "j"))
        edge = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        values = {c: batch.column(c).to_pylist() for c in columns}
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(key)]):
            own = (int(key[a]), int(i[a]), int(j[a]))
            if own != group:
                if group is not None:
                    yield group, held
                group, held = own, {c: [] for c in columns}
            for c in columns:
                held[c] += values[c][a:b]
    if group is not None:
        yield group, held


_PAIRED = pa.schema([("slot", pa.int64()), ("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("part", pa.int32()), ("reps", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("pairs", pa.binary())])
_PAIRED_SQL = "slot long, key long, i int, j int, part int, reps array<long>, sizes array<long>, pairs binary"


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block pair: the representatives that are in a candidate, and lists of candidates as places among them."""
    out: list[tuple] = []
    size = 0

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PAIRED)], schema=_PAIRED)

    for (key, i, j), held in _groups(batches, ("slot", "band", "block", "rep", "size", "signature")):
        block = np.array(held["block"])
        left = np.flatnonzero(block == i)
        right = left if i == j else np.flatnonzero(block == j)
        signature = np.frombuffer(b"".join(held["signature"]), np.uint32).reshape(-1, HASHES)
        used, lists = np.zeros(len(block), bool), []
        for found in candidates(signature, band_keys(signature), held["band"][0], left, right):
            used[left[found[:, 0]]] = used[right[found[:, 1]]] = True
            lists.append(pack(found))
        local = np.cumsum(used) - 1
        for part, data in enumerate(lists):
            found = unpack(data)
            pairs = pack(np.column_stack([local[left[found[:, 0]]], local[right[found[:, 1]]]]))
            reps = [held["rep"][k] for k in np.flatnonzero(used)] if part == 0 else []
            sizes = [held["size"][k] for k in np.flatnonzero(used)] if part == 0 else []
            out.append((held["slot"][0], key, i, j, part, reps, sizes, pairs))
            size += len(pairs) + 16 * len(reps)
            if size > 1 << 20:
                yield packed()
                out, size = [], 0
    if out:
        yield packed()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])
    for _, held in _groups(batches, ("rep", "size", "data")):
        first = next(k for k, rep in enumerate(held["rep"]) if rep is not None)
        reps, sizes = held["rep"][first:], np.array(held["size"][first:], np.int64)
        verifier = Verifier(shingles([d.decode() for d in held["data"][first:]]))
        links, label, tree = np.zeros(len(reps), np.int64), np.arange(len(reps)), []
        for data in held["data"][:first]:
            pairs = verifier.similar(unpack(data))
            if len(pairs):
                links += (np.bincount(pairs[:, 0], sizes[pairs[:, 1]], len(reps)) + np.bincount(pairs[:, 1], sizes[pairs[:, 0]], len(reps))).astype(np.int64)
                tree += join_up(label, pairs)
        some = np.flatnonzero(links)
        if not len(some):
            continue
        a = [reps[k] for k in some] + [reps[x] for x, _ in tree]
        b = [None] * len(some) + [reps[y] for _, y in tree]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([*links[some].tolist(), *[0] * len(tree)], pa.int64())], schema=schema)


def block_count(m: Column, block: int) -> Column:
    """Blocks of a bucket of ``m`` representatives, each of which is sent once for every block."""
    return F.greatest(F.least(F.ceil(m / block), F.lit(WAYS)), F.ceil(m / MOST)).cast("int")


def _spread(df: DataFrame, *order: str) -> DataFrame:
    """Block pairs by their slots: those of one bucket go to partitions one after the other."""
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionById(count, F.pmod("slot", F.lit(count)).cast("int")).sortWithinPartitions("key", "i", "j", *order)


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(row, id, class_id, class_row, n_links) of each row.

    ``row`` is ``monotonically_increasing_id`` over ``docs``, which must be read from storage. A class's id and row are
    those of its member with the least id, null last.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sketches = materialise(rows.mapInArrow(lambda it: trimmed(_sketch(it)), "row long, id long, n long, set_1 long, set_2 long, signature binary"), "sketches")
    classes = sketches.groupBy("set_1", "set_2").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("size"))
    classes = materialise(classes, "classes")
    reps = sketches.where("n > 0").join(classes.select(F.col("rep").alias("row"), "size").hint("merge"), "row").select(F.col("row").alias("rep"), "size", "signature")
    banded = reps.mapInArrow(_bands, "rep long, keys array<long>").select("rep", F.posexplode("keys").alias("band", "key"))
    banded = materialise(banded, "bands")
    buckets = materialise(banded.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "buckets")  # a join to an aggregate could not be split
    placed = banded.join(buckets.hint("merge"), "key").withColumn("blocks", block_count(F.col("m"), block)).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("rep", "band", "key", "block", "blocks", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    slot = F.shiftright(F.xxhash64("key"), 16) + F.col("i") * F.col("blocks") + F.col("j")
    met = _spread(dealt.withColumn("slot", slot).drop("blocks").join(reps.hint("merge"), "rep"), "rep")
    paired = materialise(met.mapInArrow(lambda it: trimmed(_prune(it)), _PAIRED_SQL), "pairs")
    drop(banded, buckets)
    active = paired.where("part = 0").select("slot", "key", "i", "j", F.posexplode(F.arrays_zip("reps", "sizes")).alias("pos", "x"))
    texts = rows.select("row", F.col("text").cast("binary").alias("data"))
    members = active.select("slot", "key", "i", "j", "pos", F.col("x.reps").alias("row"), F.col("x.sizes").alias("size")).join(texts.hint("merge"), "row")
    lists = paired.select("slot", "key", "i", "j", (-1 - F.col("part")).alias("pos"), F.lit(None).cast("long").alias("rep"), F.lit(None).cast("long").alias("size"), F.col("pairs").alias("data"))
    together = _spread(lists.unionByName(members.withColumnRenamed("row", "rep")), "pos")
    found = materialise(together.mapInArrow(lambda it: trimmed(_verify(it)), "a long, b long, links long"), "links")
    drop(paired)
    links = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    stars = components(found.where("b is not null").select(F.col("a").alias("u"), F.col("b").alias("v")))
    reps = classes.join(stars.select(F.col("u").alias("rep"), F.col("v").alias("top")), "rep", "left").join(links, "rep", "left")
    reps = reps.select("set_1", "set_2", F.coalesce("top", "rep").alias("top"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    labelled = sketches.select("row", "id", "set_1", "set_2").join(reps.hint("merge"), ["set_1", "set_2"])
    labelled = materialise(labelled.select("row", "id", "top", "n_links"), "labelled")
    drop(sketches, classes, found, stars)
    first = materialise(labelled.groupBy("top").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first")), "firsts")
    return labelled.join(first, "top").select("row", "id", F.col("first.id").alias("class_id"), F.col("first.row").alias("class_row"), "n_links")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that come first in their class, with their columns. A column ``__row`` is an error, as are rows that a second scan numbers otherwise."""
    reserved(docs, ["__row", "__id"])
    kept = join(docs, id_col, text_col).where("row = class_row").select(F.col("row").alias("__row"), F.col("id").alias("__id"))
    numbered = docs.withColumn("__row", F.monotonically_increasing_id())
    return numbered.join(kept, "__row").where(same_rows(F.col(id_col).cast("long"), F.col("__id"))).drop("__row", "__id")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "n_links")


SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
  UNION ALL SELECT r, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4
), n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
b AS (SELECT x.r AS a, y.r AS b, count(*) AS shared FROM s x JOIN s y ON x.x = y.x AND x.r <> y.r GROUP BY ALL),
e AS (SELECT a, b FROM b JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 5 * shared >= 4 * (na.n + nb.n - shared)),
c(r, top) AS (SELECT r, r FROM d UNION SELECT e.b, c.top FROM c JOIN e ON e.a = c.r),
t AS (SELECT r, min(top) AS top FROM c GROUP BY r),
k AS (SELECT t.r, d.doc_id, t.top FROM t JOIN d USING (r)),
m AS (SELECT top, min(doc_id) AS class_id FROM k GROUP BY top),
l AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT doc_id, class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links FROM k JOIN m USING (top) LEFT JOIN l ON l.a = k.r
"""
