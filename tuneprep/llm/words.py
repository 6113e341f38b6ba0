"""Words as the operators of this package count them, hashed a batch of texts at a time.

A word is a longest run of characters other than space and 0x09 to 0x0D; A-Z are lower-cased
and nothing else is, so the UTF-8 bytes can be worked on directly: none of these bytes occurs
inside a longer character.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: The pattern of one word, for Java, Python and DuckDB alike.
WORD = r"[^\x20\x09-\x0D]+"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_U64 = (1 << 64) - 1
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Texts joined into one array at a time; a longer text is an array of its own.
BATCH_BYTES = 1 << 17


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) & _U64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CODES = mix(np.arange(1, 257, dtype=np.uint64), 11)


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown as texts need them."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            self.up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]))
            self.down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, inverse)]))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _hash_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of every word of an array of bytes."""
    blank = _BLANK[data]
    edges = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    if not len(start):
        return start, np.zeros(0, dtype=np.uint64)
    up, down = _POWERS.upto(len(data) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_CODES[_LOWER[data]] * up[: len(data)], dtype=np.uint64)])
    return start, mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """For each text the hashes of its words in order; none for an empty or absent text."""
    batch: list[bytes] = []
    size = 0
    for text in texts:
        raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
        if batch and size + len(raw) > BATCH_BYTES:
            yield from _split(batch)
            batch, size = [], 0
        batch.append(raw)
        size += len(raw) + 1
    yield from _split(batch)


def _split(batch: list[bytes]) -> Iterator[np.ndarray]:
    if not batch:
        return
    start, hashes = _hash_words(np.frombuffer(b" ".join(batch), dtype=np.uint8))
    firsts = np.cumsum([0] + [len(raw) + 1 for raw in batch])
    cuts = np.searchsorted(start, firsts)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield hashes[a:b]


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; fewer words are one run."""
    if not len(words):
        return words
    size = min(size, len(words))
    total = np.zeros(len(words) - size + 1, dtype=np.uint64)
    for k in range(size):
        total = mix(total + words[k : len(words) - size + 1 + k], k + 1)
    return np.unique(total)
