"""Vectorised hashing of the words of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~_SPACES
#: Lower-case letters, digits and what is not ASCII.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            grown = np.full(n, base, np.uint64)
            grown[0] = 1
            grown = np.cumprod(grown)
            if base == _BASE:
                _POWERS = grown
            else:
                _INVERSES = grown
    return _POWERS, _INVERSES


def mix(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt * 0xD6E8FEB86659FD93 & _ALL)) * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of texts: which text each is in, where it starts and ends, and hashes of spans."""

    def __init__(self, texts: Sequence[str | bytes], kind: np.ndarray = NOT_SPACE) -> None:
        parts = [t if isinstance(t, bytes) else t.encode() for t in texts]
        self.data = b" ".join(parts) + b" "
        raw = np.frombuffer(self.data, np.uint8)
        inside = np.zeros(len(raw) + 2, bool)
        inside[1:-1] = kind[raw]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        self.doc = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), self.start, "right")
        power, self._inverse = powers(len(raw) + 1)
        self._total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(raw * power[: len(raw)], out=self._total[1:])

    def spans(self, start: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
        return mix((self._total[end] - self._total[start]) * self._inverse[start], salt)


def word_hashes(texts: Sequence[str | bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text's place, hash) of every word, in order."""
    words = Words(texts)
    return words.doc, words.spans(words.start, words.end, 1)


def slices(texts: Sequence[str | bytes], most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters; a longer text is a range of its own."""
    begin = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text or "") > most:
            yield begin, k
            begin, size = k, 0
        size += len(text or "")
    if begin < len(texts):
        yield begin, len(texts)
