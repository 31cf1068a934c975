"""Language-model scores from a hierarchical Pitman-Yor model of word pairs.

Every word has a restaurant for the tokens that follow it; a text starts after the end of another. All these restaurants share a
parent, the restaurant of words without context, whose own parent is uniform over the training vocabulary and one unknown word. A
customer of a restaurant who opens a table sends a customer to the parent. So the statistics are those of all pairs of neighbouring words of the
whole corpus, and grow with it.

Seating is sampled by Gibbs moves. What the predictive rule needs of a crowd, the ``c`` customers of one word in one restaurant, is the
number ``t`` of its tables; the sizes of the tables are integrated out. A move takes a random customer of the crowd away, who was alone with the
probability S(c-1, t-1) / S(c, t) of generalised Stirling numbers, and seats the customer again by the predictive rule, given all other seats. A crowd of one
has one table always. Crowds start as the predictive rule seats them one by one, from 64 customers on in growing groups. Beyond ``EXACT``
customers the share of those alone is taken at its limit for large crowds, d (t - 1) / (c - 1).

Random numbers are hashes of (pair, move), and all statistics are counted over the corpus, so scores do not depend on how rows are dealt to
files, tasks or blocks.

1. Texts become blocks of words, written once. Ranges of the words' 64-bit hashes count their words and number them, and the blocks are written anew with
   these numbers.
2. A block's distinct pairs and counts are dealt by the pairs' 64-bit hashes into buckets: a frequent word's pairs are spread over all. A bucket
   merges its counts, and tells the restaurants' and words' first totals, of one table for each pair.
3. In each of ``ROUNDS`` rounds, totals by word are summed in ranges of words' hashes and sent to the buckets that ask for them; a bucket
   moves its crowds and tells how the totals change. Only crowds of two and more take part. The last round averages over ``KEEP`` samples.
4. Each block is sent its pairs' and its words' averages, which make the predictive probabilities: (c - d t + (s + d T) p) / (s + C) with
   the restaurant's customers C and tables T and the parent's probability p. As t and T are averages of the same samples and so are p's, a restaurant's
   probabilities sum to one. Of the product of T and p the product of the averages is taken.

Discounts come from the counts of counts of pairs, and of words by the restaurants that they are in; the strength is a parameter.
Nothing but some sums over the corpus reaches the driver.

Defined results: a null text is empty and has one token, the end. A null id counts as training. Repeated rows count
and are scored one by one. With an empty table, or without training rows, the vocabulary is empty and each token has probability 1. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.llm.common import delete, drop, materialise, shared_dir, small_batches, table, trimmed, write
from tabularium.llm.hashing import mix, slices, word_hashes

BLOCK_BYTES = 8 << 20
#: Tokens of the corpus for each bucket of pairs, and buckets for each range of words, as powers of two.
BUCKET_BITS, RANGE_BITS = 21, 3
#: Partitions of a shuffle at most, as a power of two.
PARTITION_BITS = 16
ROUNDS = 2
#: Moves of each crowd before samples are kept, samples, and moves between these.
BURN, KEEP, BETWEEN = 12, 4, 3
STRENGTH = 1.0
#: Customers up to which Stirling numbers are computed.
EXACT = 256
#: Bits of a word's number for its rank in its range.
RANK_BITS = 40
END = np.uint64(0x5851F42D4C957F2D)
_FACTOR = 0x9E3779B97F4A7C15


def pair_keys(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(u, 31) * np.uint64(_FACTOR) + w, 32)


def uniform(key: np.ndarray, number: int) -> np.ndarray:
    """The key's random number of this number, in [0, 1)."""
    return (mix(key + np.uint64(number * _FACTOR & (1 << 64) - 1), 33) >> np.uint64(11)) * 2.0**-53


# blocks


@dataclass
class Block:
    """The distinct words' numbers; the place of each token's word among them; the place of END; each text's tokens, whether it is held out, its id or none."""

    numbers: np.ndarray
    index: np.ndarray
    end: int
    sizes: np.ndarray
    held: np.ndarray
    ids: pa.Array

    @classmethod
    def of(cls, row: dict) -> Block:
        n = len(row["d"]) // 9
        ids, flags = np.frombuffer(row["d"], np.int64, n), np.frombuffer(row["d"], np.uint8, n, 8 * n)
        sizes = unpack(row["c"]).astype(np.int64)
        return cls(unpack(row["b"]), unpack(row["a"]).astype(np.int64), int(row["of"]), sizes, flags & 1 > 0, pa.array(ids, mask=flags & 2 == 0))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs as places of context and word, in the order of their keys; these keys; each token's place in them."""
        before = np.concatenate([[self.end], self.index[:-1]])
        keys, place = np.unique(pair_keys(self.numbers[before], self.numbers[self.index]), return_inverse=True)
        some = np.empty(len(keys), np.int64)
        some[place] = np.arange(len(place))
        return before[some], self.index[some], keys, place

    def training(self, place: np.ndarray, n: int) -> np.ndarray:
        """How often each of ``n`` places occurs in texts that are not held out."""
        return np.bincount(place[~np.repeat(self.held, self.sizes)], minlength=n)


def _tokens(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, each token's place in them, and the number of tokens of each text; every text ends with END."""
    hashes, sizes = [], []
    for a, b in slices(texts):
        doc, words = word_hashes([t.lower() for t in texts[a:b]])
        size = np.bincount(doc, minlength=b - a) + 1
        tokens = np.full(len(words) + b - a, END)
        tokens[np.arange(len(words)) + doc] = words
        hashes.append(tokens)
        sizes.append(size)
    words, index = np.unique(np.concatenate(hashes), return_inverse=True)
    return words, index.astype(np.uint32), np.concatenate(sizes).astype(np.uint32)


def pack(x: np.ndarray) -> bytes:
    """Numbers from 0 on, in as few bytes as the largest needs, byte by byte of their places, compressed."""
    x = np.ascontiguousarray(x, np.uint64)
    width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(x).to_bytes(8, "little") + bytes([width]) + _compressor().compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), data[8]
    planes = np.frombuffer(_decompressor().decompress(data[9:]), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.view(np.uint64).reshape(n)


@lru_cache
def _compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=1)


@lru_cache
def _decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def floats(x: np.ndarray) -> bytes:
    return _compressor().compress(np.ascontiguousarray(x, np.float32).tobytes())


def unfloats(data: bytes) -> np.ndarray:
    return np.frombuffer(_decompressor().decompress(data), np.float32).astype(float)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


# what is sent: a kind, where to (bucket, range or block), where from, and arrays

_SENT = pa.schema([("kind", pa.int32()), ("to", pa.int64()), ("of", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary()), ("e", pa.binary()), ("stats", pa.list_(pa.float64()))])
_SENT_SQL = "kind int, to long, of long, a binary, b binary, c binary, d binary, e binary, stats array<double>"
#: In a bucket: its crowds, then pairs of blocks. In a range: totals and their changes, then questions; an answer goes where its question came from.
#: In a block: answers, its texts, values of its pairs. Stats are numbers for the driver to sum up.
CROWDS, PAIRS, TOTALS, ANSWERS, TEXTS, VALUES = range(6)


def _message(kind: int, to: int, of: int = 0, *data: bytes, stats: Sequence[float] | None = None) -> tuple:
    return (kind, to, of, *data, *[None] * (5 - len(data)), list(map(float, stats)) if stats is not None else None)


def _packed(messages: Iterator[tuple], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for m in messages:
        held.append(m)
        size += sum(len(x) for x in m[3:8] if x) + 64
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _SENT)], schema=_SENT)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _SENT)], schema=_SENT)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[dict]]]:
    """Rows by ``to``, by which they are sorted; each run must be used up before the next."""
    rows, held = _each(batches), []

    def run(to: int) -> Iterator[dict]:
        while held and held[0]["to"] == to:
            yield held.pop()
            held.extend(x for x in [next(rows, None)] if x is not None)

    held.extend(x for x in [next(rows, None)] if x is not None)
    while held:
        to = held[0]["to"]
        yield to, run(to)


# texts to blocks


def _block_message(number: int, ids: list, held: list, texts: list[bytes]) -> tuple:
    """a: index, b: words' hashes, c: sizes, d: ids and flags (1 for held out, 2 for an id), e: each word's training tokens; of: END's place."""
    words, index, sizes = _tokens(texts)
    flags = np.array(held, np.uint8) + 2 * np.array([x is not None for x in ids], np.uint8)
    numbers = np.array([x or 0 for x in ids], np.int64)
    counts = np.bincount(index[~np.repeat(np.array(held, bool), sizes)], minlength=len(words))
    end = int(np.searchsorted(words, END))
    return _message(TEXTS, number, end, pack(index), words.tobytes(), pack(sizes), numbers.tobytes() + flags.tobytes(), pack(counts), stats=[len(index)])


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple]:
    """A task's rows in blocks that close with the row that fills them."""
    number, filled = TaskContext.get().partitionId() << 32, 0
    ids, held, texts = [], [], []
    for batch in batches:
        for key, out, text in zip(*(batch.column(c).to_pylist() for c in ("id", "held_out", "text"))):
            ids.append(key)
            held.append(out)
            texts.append(text)
            filled += len(text)
            if filled >= size:
                yield _block_message(number, ids, held, texts)
                number, filled, ids, held, texts = number + 1, 0, [], [], []
    if ids:
        yield _block_message(number, ids, held, texts)


def _parts(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(number, from, to) of the runs of sorted keys with equal leading bits."""
    number = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    first, at = np.unique(number, return_index=True)
    yield from zip(first.tolist(), at.tolist(), [*at[1:].tolist(), len(keys)])


def _ask_numbers(batches: Iterator[pa.RecordBatch], range_bits: int) -> Iterator[tuple]:
    for row in _each(batches):
        words, counts = np.frombuffer(row["b"], np.uint64), unpack(row["e"])
        for number, a, b in _parts(words, range_bits):
            yield _message(PAIRS, number, row["to"], words[a:b].tobytes(), pack(counts[a:b]))


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of each range of hashes: to the blocks the numbers of their words, which are range and rank, and their training tokens; words and tokens in all."""
    for number, rows in _runs(batches):
        blocks, words, counts = [], [], []
        for r in rows:
            blocks.append(r["of"])
            words.append(np.frombuffer(r["a"], np.uint64))
            counts.append(unpack(r["b"]))
        distinct, rank = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(rank, np.concatenate(counts), len(distinct)).astype(np.uint64)
        stats = [(total > 0).sum(), total.sum()]
        for block, own in zip(blocks, np.split(rank, np.cumsum([len(x) for x in words])[:-1])):
            yield _message(ANSWERS, block, number, pack(own), pack(total[own]), stats=stats)
            stats = None


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Blocks with b: words' numbers, e: their training tokens in all."""
    for _, rows in _runs(batches):
        text, numbers, totals = None, [], []
        for r in rows:
            if r["kind"] == TEXTS:
                text = r
            else:
                numbers.append(unpack(r["a"]) | np.uint64(r["of"] << RANK_BITS))
                totals.append(unpack(r["b"]))
        yield _message(TEXTS, text["to"], text["of"], text["a"], pack(np.concatenate(numbers)), text["c"], text["d"], pack(np.concatenate(totals)))


def _send_pairs(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[tuple]:
    for row in _each(batches):
        block = Block.of(row)
        u, w, keys, place = block.pairs()
        counts = block.training(place, len(keys))
        for bucket, a, b in _parts(keys, bits):
            yield _message(PAIRS, bucket, row["to"], pack(block.numbers[u[a:b]]), pack(block.numbers[w[a:b]]), pack(counts[a:b]))


def _by_range(numbers: np.ndarray, *values: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(range, ranks, values) of the runs of sorted numbers of words in one range."""
    found, at = np.unique(numbers >> np.uint64(RANK_BITS), return_index=True)
    rank = numbers & np.uint64((1 << RANK_BITS) - 1)
    for k, a, b in zip(found.tolist(), at.tolist(), [*at[1:].tolist(), len(numbers)]):
        yield k, [rank[a:b], *(v[a:b] for v in values)]


def _summed(words: Sequence[np.ndarray], values: Sequence[Sequence[np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct words, sorted, and the integer sums of each list of values."""
    distinct, place = np.unique(np.concatenate(words), return_inverse=True)
    return distinct, [np.bincount(place, np.concatenate(v), len(distinct)).astype(np.int64) for v in values]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of each bucket: for each block a code of each of its pairs (0 unseen, 1 a crowd of one, 2 and more the place of its crowd), the crowds, the first totals."""
    for bucket, rows in _runs(batches):
        blocks, us, ws, counts = [], [], [], []
        for r in rows:
            blocks.append(r["of"])
            us.append(unpack(r["a"]))
            ws.append(unpack(r["b"]))
            counts.append(unpack(r["c"]))
        u, w = np.concatenate(us), np.concatenate(ws)
        keys, place = np.unique(pair_keys(u, w), return_inverse=True)
        some = np.empty(len(keys), np.int64)
        some[place] = np.arange(len(place))
        count = np.bincount(place, np.concatenate(counts), len(keys)).astype(np.int64)
        u, w = u[some], w[some]
        crowd = count > 1
        code = np.where(crowd, np.cumsum(crowd) + 1, count)
        for block, own in zip(blocks, np.split(code[place], np.cumsum([len(x) for x in us])[:-1])):
            yield _message(PAIRS, bucket, block, pack(own))
        yield _message(CROWDS, bucket, 0, pack(u[crowd]), pack(w[crowd]), pack(count[crowd]), pack(np.ones(crowd.sum())), stats=[(count == 1).sum(), (count == 2).sum()])
        used = count > 0
        one = np.ones(int(used.sum()), np.int64)
        none = np.zeros_like(one)
        words, sums = _summed([u[used], w[used]], [[one, none], [none, one]])
        for number, parts in _by_range(words, *sums):
            yield _message(TOTALS, number, 0, *map(pack, parts))


@dataclass
class Numbers:
    """Of the whole corpus: tokens, vocabulary, discounts of pairs and of words, customers and tables of the parent."""

    tokens: int
    vocabulary: int
    discount: float
    parent_discount: float
    customers: float
    tables: float
    strength: float

    @property
    def uniform(self) -> float:
        return 1 / (self.vocabulary + 1)

    def parent(self, own: np.ndarray) -> np.ndarray:
        """Probabilities without context, from customers less discounts of each word."""
        return (own + (self.strength + self.parent_discount * self.tables) * self.uniform) / (self.strength + self.customers)


def discount_of(one: float, two: float) -> float:
    """From how many crowds have one and two customers."""
    return float(np.clip(one / max(1.0, one + 2 * two), 0.05, 0.95))


# Gibbs moves


@lru_cache(maxsize=4)
def alone_table(d: float) -> np.ndarray:
    """[c, t]: the probability that a random one of c customers at t tables is alone, S(c-1, t-1) / S(c, t)."""
    out = np.zeros((EXACT + 1, EXACT + 2))
    log = np.full(EXACT + 2, -np.inf)
    log[1] = 0.0
    out[1, 1] = 1.0
    t = np.arange(EXACT + 2)
    for c in range(2, EXACT + 1):
        stay = np.full(EXACT + 2, -np.inf)
        stay[1:c] = np.log(c - 1 - d * t[1:c]) + log[1:c]
        opened = np.concatenate([[-np.inf], log[:-1]])
        grown = np.logaddexp(stay, opened)
        out[c, 1 : c + 1] = np.exp(opened[1 : c + 1] - grown[1 : c + 1])
        log = grown
    return out


def alone(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    few = c <= EXACT
    out = np.minimum(1.0, d * (t - 1) / np.maximum(1, c - 1))
    out[few] = alone_table(d)[c[few], t[few]]
    return out


def seated(key: np.ndarray, c: np.ndarray, base: np.ndarray, slope: np.ndarray, d: float) -> np.ndarray:
    """Tables of crowds whose customers come one by one; base + slope * t is the weight of a new table beside t tables."""
    order = np.argsort(-c, kind="stable")
    key, left, base, slope = key[order], c[order], base[order], slope[order]
    tables = (left > 0).astype(np.int64)
    n = 1
    while (m := int(np.searchsorted(-left, -n, "left"))) > 0:
        step = 1 if n < 64 else n // 8
        t = tables[:m]
        weight = base[:m] + slope[:m] * t
        tables[:m] += (np.minimum(step, left[:m] - n) * weight / (weight + n - d * t) + uniform(key[:m], n)).astype(np.int64)
        n += step
    out = np.empty_like(tables)
    out[order] = tables
    return out


def moved(key: np.ndarray, c: np.ndarray, t: np.ndarray, base: np.ndarray, slope: np.ndarray, d: float, first: int, moves: int) -> np.ndarray:
    """Tables after Gibbs moves ``first``, ``first + 1``, ... of crowds of two and more."""
    for k in range(first, first + moves):
        rest = t - (uniform(key, (1 << 40) + 2 * k) < alone(c, t, d))
        weight = base + slope * rest
        t = rest + (uniform(key, (1 << 40) + 2 * k + 1) < weight / (weight + c - 1 - d * rest))
    return t


def _gibbs(batches: Iterator[pa.RecordBatch], numbers: Numbers, turn: int, last: bool) -> Iterator[tuple]:
    """Of each bucket: its crowds after a round (in the last one the tables are sums over the samples), and how totals by word change."""
    d, scale = numbers.discount, KEEP if last else 1
    for bucket, rows in _runs(batches):
        crowds, words, tables, own = None, [], [], []
        for r in rows:
            if r["kind"] == CROWDS:
                crowds = r
            else:
                words.append(unpack(r["a"]) | np.uint64(r["of"] << RANK_BITS))
                tables.append(np.frombuffer(r["b"], np.float64))
                own.append(np.frombuffer(r["c"], np.float64))
        u, w = unpack(crowds["a"]), unpack(crowds["b"])
        c, t = unpack(crowds["c"]).astype(np.int64), unpack(crowds["d"]).astype(np.int64)
        total = t
        if len(u):
            key = pair_keys(u, w)
            known = np.concatenate(words)  # ranges come in order, so numbers are sorted
            customers = np.concatenate(own)[np.searchsorted(known, w)]
            parent = numbers.parent(customers if turn else customers - numbers.parent_discount)  # at first each word has a table of its own there
            others = np.concatenate(tables)[np.searchsorted(known, u)] - t
            base, slope = (numbers.strength + d * others) * parent, d * parent
            total = now = moved(key, c, t if turn else seated(key, c, base, slope, d), base, slope, d, turn * (BURN + KEEP * BETWEEN), BURN)
            if last:
                total = np.zeros_like(now)
                for k in range(KEEP):
                    now = moved(key, c, now, base, slope, d, turn * (BURN + KEEP * BETWEEN) + BURN + k * BETWEEN, BETWEEN)
                    total += now
        yield _message(CROWDS, bucket, 0, crowds["a"], crowds["b"], crowds["c"], pack(total))
        change = total - scale * t
        zero = np.zeros_like(change)
        names, sums = _summed([u, w], [[change, zero], [zero, change]])
        for number, (rank, by_u, by_w) in _by_range(names, *sums):
            yield _message(TOTALS, number, 1, pack(rank), by_u.tobytes(), by_w.tobytes())


def _ask_crowds(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for row in _each(batches):
        for number, (ranks,) in _by_range(np.unique(np.concatenate([unpack(row["a"]), unpack(row["b"])]))):
            yield _message(ANSWERS, number, row["to"], pack(ranks))


def _ask_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for row in _each(batches):
        for number, (ranks,) in _by_range(unpack(row["b"])):
            yield _message(ANSWERS, number, row["to"], pack(ranks))


@dataclass
class Known:
    """By rank in a range: tables of a word's restaurant, its customers in the parent, tables in the parent."""

    tables: np.ndarray
    customers: np.ndarray
    seats: np.ndarray


def _known(number: int, ranks: list[np.ndarray], sums: list[list[np.ndarray]], most: int, scale: int, numbers: Numbers | None) -> Known:
    at = np.concatenate([*ranks, np.zeros(0, np.uint64)]).astype(np.int64)
    tables, customers = (np.bincount(at, np.concatenate([*x, np.zeros(0)]), most) / scale for x in sums)
    seats = (customers > 0).astype(float)
    if numbers is not None:
        d = numbers.parent_discount
        c = np.round(customers).astype(np.int64)
        some = np.flatnonzero(c > 1)
        key, c = mix(some.astype(np.uint64) | np.uint64(number << RANK_BITS), 34), c[some]
        base = np.full(len(some), (numbers.strength + d * (numbers.tables - 1)) * numbers.uniform)
        slope = np.full(len(some), d * numbers.uniform)
        t, total = seated(key, c, base, slope, d), np.zeros(len(some))
        for k in range(KEEP):
            t = moved(key, c, t, base, slope, d, k * BETWEEN, BETWEEN)
            total += t
        seats[some] = total / KEEP
    return Known(tables, customers, seats)


def _answer(batches: Iterator[pa.RecordBatch], numbers: Numbers | None, scale: int, to_blocks: bool) -> Iterator[tuple]:
    """Of each range of words: its totals with their changes, which were multiplied by ``scale``; answers; as stats, numbers of the parent.

    Totals are, by word: tables of its restaurant, its customers in the parent. Without ``numbers`` each word has one table in the parent.
    """
    for number, rows in _runs(batches):
        ranks: list[np.ndarray] = []
        sums: list[list[np.ndarray]] = [[], []]
        questions: list[tuple[int, np.ndarray]] = []
        for r in rows:
            rank = unpack(r["a"])
            if r["kind"] == TOTALS:
                ranks.append(rank)
                for part, name in zip(sums, "bc"):
                    part.append(np.frombuffer(r[name], np.int64) if r["of"] == 1 else unpack(r[name]).astype(np.int64) * scale)
            else:
                questions.append((r["of"], r["a"]))
        asked = [int(unpack(q).max()) for _, q in questions]
        most = 1 + max([-1, *asked, *(int(x.max()) for x in ranks if len(x))])
        known = _known(number, ranks, sums, most, scale, numbers)
        own = known.customers - known.seats * (numbers.parent_discount if numbers else 0.0)
        stats = [known.customers.sum(), known.seats.sum(), (known.customers == 1).sum(), (known.customers == 2).sum()]
        yield _message(TOTALS, number, 0, pack(np.arange(most)), pack(known.tables), pack(known.customers), stats=stats)
        for of, question in questions:
            rank = unpack(question).astype(np.int64)
            if to_blocks:  # in the order of the block's words
                yield _message(ANSWERS, of, number, floats(known.tables[rank]), floats(own[rank]))
            else:
                yield _message(ANSWERS, of, number, question, known.tables[rank].tobytes(), own[rank].tobytes())


# scores


def _values(batches: Iterator[pa.RecordBatch], discount: float) -> Iterator[tuple]:
    """Customers less discounts of each block's pairs."""
    for bucket, rows in _runs(batches):
        value = np.array([0.0, 1.0 - discount])
        for r in rows:
            if r["kind"] == CROWDS:
                value = np.concatenate([value, unpack(r["c"]) - discount * unpack(r["d"]) / KEEP])
            else:
                yield _message(VALUES, r["of"], bucket, floats(value[unpack(r["a"]).astype(np.int64)]))


def _score(batches: Iterator[pa.RecordBatch], numbers: Numbers, token_logs: bool) -> Iterator[pa.RecordBatch]:
    for _, rows in _runs(batches):
        text, answers, values = None, [], []
        for r in rows:
            if r["kind"] == TEXTS:
                text = r
            elif r["kind"] == ANSWERS:
                answers.append((unfloats(r["a"]), unfloats(r["b"])))
            else:
                values.append(unfloats(r["a"]))
        block, tokens = Block.of(text), unpack(text["e"]).astype(float)
        u, w, _, place = block.pairs()
        tables, own = (np.concatenate(x) for x in zip(*answers))
        p = (np.concatenate(values) + (numbers.strength + numbers.discount * tables[u]) * numbers.parent(own)[w]) / (numbers.strength + tokens[u])
        logs = np.log10(p)[place]
        base = np.log10((tokens + 1.0) / (numbers.tokens + numbers.vocabulary + 1.0))[block.index]
        at = np.cumsum(block.sizes) - block.sizes
        columns = [block.ids, pa.array(block.held), pa.array(block.sizes), pa.array(np.add.reduceat((tokens > 0).astype(np.int64)[block.index], at)), pa.array(np.full(len(at), numbers.tokens, np.int64)), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(logs, at))]
        if token_logs:
            columns.append(pa.array(np.split(logs, at[1:]), pa.list_(pa.float64())))
        yield pa.RecordBatch.from_arrays(columns, names=_NAMES[: len(columns)])


_NAMES = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "token_scores"]
_SCORES = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _map(df: DataFrame, task) -> DataFrame:
    return df.mapInArrow(lambda it: trimmed(_packed(task(it))), _SENT_SQL)


def _dealt(df: DataFrame, bits: int) -> DataFrame:
    """A partition for each bucket or range; of very many, several of the same size share one, and are taken one after the other."""
    few = min(bits, PARTITION_BITS)
    return df.repartitionById(1 << few, F.shiftright("to", bits - few).cast("int")).sortWithinPartitions("to", "kind", "of")


@dataclass
class Blocks:
    """How blocks are numbered: by the task that read them, and by their order in it."""

    tasks: int
    most: int
    count: int

    @classmethod
    def of(cls, texts: DataFrame) -> Blocks:
        row = texts.agg(F.max(F.shiftright("to", 32)), F.max(F.col("to").bitwiseAND((1 << 32) - 1)), F.count(F.lit(1))).first()
        return cls(row[0] + 1, row[1] + 1, row[2])

    def dealt(self, df: DataFrame) -> DataFrame:
        """A partition for each block, or for several of very many; where tasks read very different numbers of blocks, as many partitions by hash."""
        number = F.shiftright("to", 32) * self.most + F.col("to").bitwiseAND((1 << 32) - 1)
        most = 1 << PARTITION_BITS
        even = self.tasks * self.most <= 4 * self.count
        slots = min(self.tasks * self.most, most)
        parted = df.repartitionById(slots, F.pmod(number, F.lit(slots)).cast("int")) if even else df.repartition(min(self.count, most), "to")
        return parted.sortWithinPartitions("to", "kind", "of")


class _Stored:
    """Messages in the shared folder, in a folder for each kind."""

    def __init__(self, messages: DataFrame, name: str) -> None:
        self.spark = messages.sparkSession
        self.path = shared_dir(self.spark, name)
        write(messages, self.path, "kind")
        self.all = self.spark.read.schema(_SENT_SQL).parquet(self.path).select(*[x.name for x in _SENT])

    def of(self, kind: int) -> DataFrame:
        return self.all.where(F.col("kind") == kind)

    def numbers(self, n: int) -> list[float]:
        """The sums of the ``n`` numbers told; zeros if none were."""
        found = self.all.where("stats is not null").select(F.posexplode("stats").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
        return [x for _, x in sorted(map(tuple, found))] or [0.0] * n

    def drop(self, *kinds: int) -> None:
        for path in [f"{self.path}/kind={k}" for k in kinds] or [self.path]:
            delete(self.spark, path)


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, strength: float = STRENGTH, rounds: int = ROUNDS, token_scores: bool = False) -> DataFrame:
    """Trains on the rows that are not ``held_out`` and scores all: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``token_scores`` adds each token's log10 probability, the end's last.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = _SCORES + ", token_scores array<double>" * token_scores
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    read = materialise(_map(rows, lambda it: _blocks(it, block_bytes)), "lm-words")
    tokens = read.agg(F.sum(F.get("stats", 0))).first()[0]
    if not tokens:
        return spark.createDataFrame([], kind)
    bits = (int(tokens) >> BUCKET_BITS).bit_length()
    range_bits = max(0, bits - RANGE_BITS)
    told = _Stored(_map(_dealt(_map(read, lambda it: _ask_numbers(it, range_bits)), range_bits), _number), "lm-numbers")
    vocabulary, train_tokens = told.numbers(2)
    blocks = Blocks.of(read)
    texts = materialise(_map(blocks.dealt(read.withColumn("b", F.lit(None).cast("binary")).unionByName(told.of(ANSWERS))), _numbered), "lm-texts")
    drop(read)
    told.drop()
    merged = _Stored(_map(_dealt(_map(texts, lambda it: _send_pairs(it, bits)), bits), _merge), "lm-pairs")
    one, two = merged.numbers(2)
    totals = _Stored(_map(_dealt(merged.of(TOTALS).unionByName(_map(merged.of(CROWDS), _ask_crowds)), range_bits), lambda it: _answer(it, None, 1, False)), "lm-totals")
    merged.drop(TOTALS)
    customers, tables, parent_one, parent_two = totals.numbers(4)
    numbers = Numbers(int(train_tokens), int(vocabulary), discount_of(one, two), discount_of(parent_one, parent_two), customers, tables, strength)
    crowds = merged
    for turn in range(rounds):
        numbers, crowds, totals = _one_round(texts, crowds, totals, numbers, turn, turn + 1 == rounds, bits, range_bits)
    values = _map(_dealt(merged.of(PAIRS).unionByName(crowds.of(CROWDS)), bits), lambda it: _values(it, numbers.discount))
    together = blocks.dealt(texts.unionByName(totals.of(ANSWERS)).unionByName(values))
    return together.mapInArrow(lambda it: trimmed(_score(it, numbers, token_scores)), kind)


def _one_round(texts: DataFrame, crowds: _Stored, totals: _Stored, numbers: Numbers, turn: int, last: bool, bits: int, range_bits: int) -> tuple[Numbers, _Stored, _Stored]:
    """Moves all crowds and sums up their totals; in the last round the answers go to the blocks."""
    now = _Stored(_map(_dealt(crowds.of(CROWDS).unionByName(totals.of(ANSWERS)), bits), lambda it: _gibbs(it, numbers, turn, last)), "lm-crowds")
    crowds.drop(CROWDS)
    asked = _map(texts, _ask_blocks) if last else _map(now.of(CROWDS), _ask_crowds)
    changed = totals.of(TOTALS).unionByName(now.of(TOTALS)).unionByName(asked)
    after = _Stored(_map(_dealt(changed, range_bits), lambda it: _answer(it, numbers, KEEP if last else 1, last)), "lm-totals")
    totals.drop()
    now.drop(TOTALS)
    customers, tables, _, _ = after.numbers(4)
    return replace(numbers, customers=customers, tables=tables), now, after


def held_out_by_id(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), held_out_by_id()).withColumnRenamed("id", "doc_id")
