"""BPE encoding and decoding with reuse of content-defined chunks.

A text is cut into chunks where a rolling hash of its last bytes meets a mask, so documents that share a
passage share chunks, wherever the passage stands. A worker keeps chunks and their tokens in a table of bounded
size, least recently used first out. What lies between the chunks of a text that the table knows is encoded in one go, the whole text if it knows none,
and new chunks take their tokens from there, as slices between safe places: no text is encoded twice to fill the table.

Cutting changes the tokens near a cut, so of a known chunk only the tokens between its first and last safe place are taken, and each join is
repaired: the text between two known chunks is encoded with a guard on either side, the span from one safe place to the next
that the chunks have as well. If the guards' tokens agree with the chunks', the join is exact; else the chunk is left out, and its text is encoded with the rest.

A safe place is a space or line feed after a visible character. The pre-tokenizer's pattern ends a token
there whatever stands before or after, so encodings of the two sides can be joined.

Tokens are those of the ``tokenizers`` library, with special tokens found in the text. Spans of plain and
Latin characters, whose classes no Unicode version disputes, are encoded by ``tiktoken`` with the ranks of
the same file, which gives the same tokens; other spans go to ``tokenizers`` itself.

Reuse is within a worker, from task to task, as far as its table reaches: about 13 MB of distinct text. Sharing over the whole corpus would send
chunks and tokens through two shuffles; the README has what it could save. Tasks need no shuffle at all and
no group of copies is gathered anywhere.

Defined results: a null text is the empty text, with no tokens. Texts of any length are encoded whole.
Repeated rows each get their row. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import OrderedDict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.llm.common import small_batches, table, trimmed
from tabularium.llm.hashing import slices

#: A cut where these bits of the rolling hash are zero: chunks of 1024 bytes on average.
CUT_BITS = 10
WINDOW = 16
#: Bytes of chunks and tokens that a worker keeps, and what a chunk takes besides.
TABLE = 32 << 20
ENTRY = 600

_PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e\\xa1-\\u017f\\u2010-\\u2027\\u20ac]*")


def safe_places(raw: np.ndarray) -> np.ndarray:
    """Places of a space or line feed after a visible character, in order: ASCII, or of the two bytes of U+00A1 to U+017F."""
    if len(raw) < 2:
        return np.zeros(0, np.int64)
    gap = (raw[1:] == 0x20) | (raw[1:] == 0x0A)
    at = np.flatnonzero(gap) + 1
    last, lead = raw[at - 1], raw[np.maximum(at - 2, 0)]
    plain = (last >= 0x21) & (last <= 0x7E)
    latin = (at >= 2) & (last >= 0x80) & (last <= 0xBF) & (lead >= 0xC2) & (lead <= 0xC5) & ~((lead == 0xC2) & ((last <= 0xA0) | (last == 0xAD)))
    return at[plain | latin]


def cuts(raw: np.ndarray, bits: int = CUT_BITS) -> np.ndarray:
    """Places to cut bytes at, in order, always between characters; none in the first WINDOW bytes."""
    if len(raw) <= WINDOW:
        return np.zeros(0, np.int64)
    gear = _gear()[raw]
    step = 1
    while step < WINDOW:  # sums of the last 2, 4, 8, 16 values, each shifted by its distance
        gear[step:] = gear[step:] + (gear[:-step] << np.uint32(step))
        step *= 2
    at = np.flatnonzero(gear[WINDOW - 1 : -1] >> np.uint32(32 - bits) == 0) + WINDOW
    return at[raw[at] & 0xC0 != 0x80]


@lru_cache
def _gear() -> np.ndarray:
    return np.frombuffer(hashlib.shake_128(b"gear").digest(1024), np.uint32)


_NONE = np.zeros(0, np.uint32)


@dataclass(frozen=True, slots=True)
class Chunk:
    """Tokens from the first safe place to the last, how many of them are before the second and after the last but one, and the places of these two."""

    body: np.ndarray
    n_head: int
    n_tail: int
    second: int
    but_one: int


#: Stands for a chunk without safe places enough.
NO_CHUNK = Chunk(_NONE, 0, 0, 0, 0)


class Encoder:
    """``encoded``, ``reused`` and ``grown`` count chunks that were kept, taken from the table, and left out as a join did not agree."""

    def __init__(self, path: str, room: int = TABLE, bits: int = CUT_BITS) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.no_truncation()
        self.full.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        alphabet = _byte_alphabet()
        vocabulary = {bytes(alphabet[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in self.special}
        self.plain = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=vocabulary, special_tokens=self.special)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.room, self.bits, self.used = room, bits, 0
        self.chunks: OrderedDict[bytes, Chunk | tuple[np.ndarray, int]] = OrderedDict()
        self.lengths = np.zeros(1 + max(vocabulary.values()), np.int64)
        for token, k in vocabulary.items():
            self.lengths[k] = len(token)
        self.encoded = self.reused = self.grown = 0

    def forget(self) -> None:
        """Empties the table."""
        self.chunks.clear()
        self.used = 0

    def ids(self, text: str) -> np.ndarray:
        """Tokens of a text without special tokens."""
        if _PLAIN.fullmatch(text):
            return np.asarray(self.plain.encode_to_numpy(text, disallowed_special=()), np.uint32)
        return np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, data: bytes, spans: list[tuple[int, int]], start: int, ids: np.ndarray) -> None:
        """Keeps the spans as chunks; ``ids`` are the tokens of ``data`` from ``start`` on. They are cut out when a chunk is first met again."""
        self.encoded += len(spans)
        for a, b in spans:
            piece = data[a:b]
            self.chunks[piece] = (ids, a - start)
            self.used += 2 * (b - a) + ENTRY
        while self.used > self.room and len(self.chunks) > 1:
            old, _ = self.chunks.popitem(last=False)
            self.used -= 2 * len(old) + ENTRY

    def _known(self, piece: bytes) -> Chunk | None:
        """The chunk of these bytes, if the table has it and it has safe places enough for guards."""
        found = self.chunks.get(piece)
        if found is None:
            return None
        self.chunks.move_to_end(piece)
        if isinstance(found, tuple):
            ids, start = found
            safe = safe_places(np.frombuffer(piece, np.uint8))
            found = NO_CHUNK
            if len(safe) >= 3:
                first, second, but_one, last = np.searchsorted(np.cumsum(self.lengths[ids]), start + safe[[0, 1, -2, -1]], "right").tolist()  # a token ends at each safe place
                found = Chunk(ids[first:last].copy(), second - first, last - but_one, int(safe[1]), int(safe[-2]))
            self.chunks[piece] = found
        return found

    def _piece(self, text: str, data: bytes, at: list[int]) -> Iterator[np.ndarray]:
        """Tokens of a text without special tokens, in order, given its cuts."""
        if not data:
            return
        ends = [0, *at, len(data)]
        known: list[tuple[int, Chunk]] = []
        new: list[tuple[int, int]] = []
        for a, b in zip(ends, ends[1:]):
            found = self._known(data[a:b])
            if found is None:
                new.append((a, b))
            elif found is not NO_CHUNK:
                known.append((a, found))
        done, guard = 0, _NONE  # the tokens before ``done`` are out, but for those of the guard, which go before the next join
        for at, chunk in [*known, (len(data), None)]:
            head = chunk.body[: chunk.n_head] if chunk else _NONE
            upto = at + chunk.second if chunk else len(data)
            ids = self.ids(text if not done and chunk is None else data[done:upto].decode())
            n = len(ids) - len(head)
            if n < len(guard) or (ids[: len(guard)] != guard).any() or (ids[n:] != head).any():  # the pattern excludes it; the chunk is left out
                if chunk is None:
                    raise RuntimeError("a join does not agree with the chunk before it")
                self.grown += 1
                continue
            yield ids[len(guard) : n]
            own = [x for x in new if done <= x[0] and x[1] <= upto]
            if own:
                self._learn(data, own, done, ids)
            if chunk:
                self.reused += 1
                yield chunk.body
                done, guard = at + chunk.but_one, chunk.body[len(chunk.body) - chunk.n_tail :]

    def encode_all(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. Cuts are found for about a MB of texts at once."""
        out: list[bytes] = []
        for a, b in slices(texts, 1 << 20):
            data = [t.encode() for t in texts[a:b]]
            raw = np.frombuffer(b"".join(data), np.uint8)
            begin = np.concatenate([[0], np.cumsum([len(d) for d in data])])
            at = cuts(raw, self.bits)
            at_of, at_to = np.searchsorted(at, begin + WINDOW), np.searchsorted(at, begin)
            for k, text in enumerate(texts[a:b]):
                if self.split and self.split.search(text):
                    out.append(self.encode(text))
                    continue
                own = (at[at_of[k] : at_to[k + 1]] - begin[k]).tolist()
                out.append(b"".join(x.astype("<u4", copy=False).tobytes() for x in self._piece(text, data[k], own)))
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out: list[np.ndarray] = []
        for part in self.split.split(text) if self.split else [text]:
            if (special := self.special.get(part)) is not None:
                out.append(np.array([special], np.uint32))
            else:
                data = part.encode()
                out += self._piece(part, data, cuts(np.frombuffer(data, np.uint8), self.bits).tolist())
        return b"".join(x.astype("<u4").tobytes() for x in out)

    def decode(self, ids: bytes) -> str:
        return self.plain.decode_bytes(np.frombuffer(ids, "<u4").tolist()).decode("utf-8", "replace")


_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, room: int = TABLE) -> Encoder:
    """A worker's encoder, whose vocabulary later tasks of the worker find loaded."""
    if (path, room) not in _ENCODERS:
        _ENCODERS[path, room] = Encoder(path, room)
    return _ENCODERS[path, room]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, room: int = TABLE, outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """(id, n_tokens, ids binary, decoded) of each row; ids are little-endian unsigned 32-bit integers.

    ``outputs`` names what is returned besides id and n_tokens, from ids, decoded, ids_sha256,
    decoded_sha256. ``vocabulary`` is a tokenizer file that every executor has at this path.
    """
    small_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    kinds = {"ids": ("binary", pa.binary()), "decoded": ("string", pa.string()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), *((k, kinds[k][1]) for k in outputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, room)
        for batch in batches:
            columns: list[list] = [[] for _ in schema]
            for ids in own.encode_all([text or "" for text in batch.column("text").to_pylist()]):
                row = {"n_tokens": len(ids) // 4, "ids": ids}
                if "ids_sha256" in outputs:
                    row["ids_sha256"] = hashlib.sha256(ids).hexdigest()
                if "decoded" in outputs or "decoded_sha256" in outputs:
                    row["decoded"] = own.decode(ids)
                    row["decoded_sha256"] = hashlib.sha256(row["decoded"].encode()).hexdigest()
                for column, field in zip(columns[1:], list(schema)[1:]):
                    column.append(row[field.name])
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, f.type) for c, f in zip(columns[1:], list(schema)[1:]))], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda it: trimmed(run(it)), "id long, n_tokens long" + "".join(f", {k} {kinds[k][0]}" for k in outputs))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), outputs=("ids_sha256", "decoded_sha256")).withColumnRenamed("id", "doc_id")
