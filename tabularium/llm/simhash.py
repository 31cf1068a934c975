"""SimHash near-duplicates, found with tables of distances to pivots.

A text's fingerprint has 64 bits; a bit is set if it is set in over half of the hashes of its shingles (four lower-case
words each, repeats included). Fingerprints link at four differing bits or fewer.

1. Equal fingerprints become one row.
2. Fingerprints are cut into six spans of bits. Two that differ in four bits at most agree in two spans at least, so
   each goes to fifteen buckets, one for every two spans, and linked ones meet in one of them for certain.
3. A bucket is cut into blocks, and a task takes pairs of blocks, so no bucket lands in one task.
4. A task precomputes each fingerprint's Hamming distances to ``PIVOTS`` reference fingerprints. By the triangle inequality
   the distances of a linked pair to any pivot differ by four at most: rows are sorted by the first pivot's, so that only a
   window is looked at, and pairs are discarded by the other pivots in turn. Survivors are verified on all 64 bits.
5. Each pair of blocks leaves a spanning forest of its links, never all of them; the forests give the components.

Pivots alone would have to look at all pairs, as distances to them are near 32 for most texts; the spans say which pairs are looked
at, and lose none. There is no limit on a bucket's size.

Defined results: a null text is empty; texts without words have fingerprint zero and are linked like others. Ids may
repeat or be null; a component without ids has a null id. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.llm.common import drop, materialise, small_batches, table, trimmed
from tabularium.llm.components import components
from tabularium.llm.hashing import slices
from tabularium.llm.jaccard_join import _groups, _spread, block_count, join_up

SHINGLE, SEED = 4, 42
DISTANCE = 4
#: Bits of each span, from the lowest.
SPANS = (11, 11, 11, 11, 10, 10)
PIVOTS = 24
#: Fingerprints of a block while there are few blocks.
BLOCK = 1024
#: Pairs that are looked at together.
PAIRS = 1 << 20

_PIVOTS = np.frombuffer(hashlib.shake_128(b"pivots").digest(8 * PIVOTS), np.uint64)
_ONES = np.uint64(0x0101010101010101)


def majority(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of hashes, from the end of the one before it to its own.

    Bits are summed in the eight bytes of a word at once, 255 hashes at most in a sum.
    """
    sizes = np.diff(ends, prepend=0)
    out = np.zeros(len(ends), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    chunks = -(-sizes[full] // 255)
    owner = np.repeat(np.arange(len(full)), chunks)
    first = np.cumsum(chunks) - chunks
    starts = (ends - sizes)[full][owner] + 255 * (np.arange(len(owner)) - first[owner])
    counts = np.empty((len(full), 64), np.int64)
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & _ONES, starts)
        counts[:, k::8] = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
    bits = (2 * counts > sizes[full][:, None]).astype(np.uint64)
    out[full] = (bits << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(texts: Sequence[str | None]) -> np.ndarray:
    hashes: list[int] = []
    ends = []
    digest = xxhash.xxh64_intdigest
    for text in texts:
        words = (text or "").encode().lower().split()  # A-Z and the six spaces, as these are bytes
        if words:
            joined = b" ".join(words)
            stop = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
            start = [0, *[x + 1 for x in stop[:-1]]]
            last = stop[SHINGLE - 1 :] or stop[-1:]
            hashes += [digest(joined[a:b], SEED) for a, b in zip(start, last)]
        ends.append(len(hashes))
    return majority(np.array(hashes, np.uint64), np.array(ends, np.int64))


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in slices(texts, 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("id")[a:b], pa.array(fingerprints(texts[a:b]).view(np.int64))], names=["id", "bits"])


def distances(bits: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The table of Hamming distances: a row for each of ``to``."""
    return np.bitwise_count(bits[None, :] ^ to[:, None]).astype(np.int8)


def linked(left: np.ndarray, right: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs (place in left, place in right) of fingerprints that link; ``left is right`` for a block with itself, each pair once.

    Both tables are sorted by the first pivot; each row of left has a window of right, and pairs go through the pivots in turn.
    """
    order, order_r = np.argsort(np.bitwise_count(left ^ _PIVOTS[0]), kind="stable"), np.argsort(np.bitwise_count(right ^ _PIVOTS[0]), kind="stable")
    mine, theirs = distances(left[order], _PIVOTS), distances(right[order_r], _PIVOTS)
    lo = np.arange(1, len(left) + 1) if left is right else np.searchsorted(theirs[0], mine[0] - np.int8(DISTANCE))
    hi = np.maximum(lo, np.searchsorted(theirs[0], mine[0] + np.int8(DISTANCE), "right"))
    upto = np.cumsum(hi - lo)
    a = 0
    while a < len(left):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right")))
        width = hi[a:b] - lo[a:b]
        i = np.repeat(np.arange(a, b), width)
        j = np.arange(len(i)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(lo[a:b], width)
        for p in range(1, PIVOTS):
            near = np.abs(mine[p][i] - theirs[p][j]) <= DISTANCE
            i, j = i[near], j[near]
        same = np.bitwise_count(left[order[i]] ^ right[order_r[j]]) <= DISTANCE
        yield np.column_stack([order[i[same]], order_r[j[same]]])
        a = b


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links of each pair of blocks."""
    found: list[tuple[int, int]] = []

    def out() -> pa.RecordBatch:
        u, v = (pa.array([x[k] for x in found], pa.int64()) for k in (0, 1))
        return pa.RecordBatch.from_arrays([u, v], names=["u", "v"])

    for (_, i, j), held in _groups(batches, ("block", "bits")):
        block, bits = np.array(held["block"]), np.array(held["bits"], np.int64)
        left = np.flatnonzero(block == i)
        right = left if i == j else np.flatnonzero(block == j)
        mine = bits[left].view(np.uint64)
        label = np.arange(len(bits))
        for pairs in linked(mine, mine if i == j else bits[right].view(np.uint64)):
            if len(pairs):
                found += [(int(bits[a]), int(bits[b])) for a, b in join_up(label, np.column_stack([left[pairs[:, 0]], right[pairs[:, 1]]]))]
        if len(found) > 1 << 16:
            yield out()
            found = []
    if found:
        yield out()


def bucket_keys(bits: Column) -> list[Column]:
    """A key for every two spans; the keys of different ones differ in their highest bits."""
    at = [sum(SPANS[:k]) for k in range(len(SPANS))]
    span = [F.shiftrightunsigned(bits, a).bitwiseAND((1 << n) - 1) for a, n in zip(at, SPANS)]
    return [F.lit(k << 32) + F.shiftleft(span[a], 16) + span[b] for k, (a, b) in enumerate(combinations(range(len(SPANS)), 2))]


def edges(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """(u, v), links that join all linked fingerprints of ``prints``, distinct longs in a column ``bits``."""
    met = materialise(prints.select("bits", F.explode(F.array(*bucket_keys(F.col("bits")))).alias("key")), "spans")
    buckets = materialise(met.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "buckets")  # a join to an aggregate could not be split
    placed = met.join(buckets.hint("merge"), "key").withColumn("blocks", block_count(F.col("m"), block)).withColumn("block", F.pmod(F.xxhash64("bits"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    slot = F.shiftright(F.xxhash64("key"), 16) + F.col("i") * F.col("blocks") + F.col("j")
    dealt = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).withColumn("slot", slot)
    found = _spread(dealt.select("slot", "key", "i", "j", "block", "bits"), "bits").mapInArrow(lambda it: trimmed(_compare(it)), "u long, v long")
    found = materialise(found, "links")
    drop(met, buckets)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, bits, component_id) of each row; ``bits`` is the fingerprint as a signed long."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    printed = materialise(rows.mapInArrow(lambda it: trimmed(_fingerprinted(it)), "id long, bits long"), "fingerprints")
    prints = materialise(printed.groupBy("bits").agg(F.min("id").alias("least")), "prints")
    links = edges(prints)
    tops = components(links)
    named = prints.join(tops.select(F.col("u").alias("bits"), "v"), "bits", "left").select("bits", "least", F.coalesce("v", "bits").alias("top"))
    named = materialise(named, "named")
    drop(prints, links, tops)
    least = materialise(named.groupBy("top").agg(F.min("least").alias("component_id")), "least")
    known = materialise(named.join(least.hint("merge"), "top").select("bits", "component_id"), "components")
    drop(named, least)
    return printed.join(known.hint("merge"), "bits").select("id", "bits", "component_id")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")
