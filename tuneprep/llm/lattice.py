"""The lattice of a word's segmentations into pieces of a fixed vocabulary.

A unigram model gives each piece a probability; a word's probability is the sum over all
segmentations of the product of their pieces. The forward recursion adds them up in log space;
with the backward one it gives the expected number of times each piece is used. Words are
their UTF-8 bytes after the mark of a word's start, and single bytes are pieces, so every word
has a segmentation. Words of one length are worked on together.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from tuneprep.llm.words import mix

#: What sentencepiece writes for the start of a word.
START = "▁".encode()
#: Longer words are worked on one by one.
LONG = 48
#: Words of one length at once.
BATCH = 4096

_SLOT_BITS = 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CODES = mix(np.arange(1, 257, dtype=np.uint64), 31)


def _log_add(a: float, b: float) -> float:
    return float(np.logaddexp(a, b))


class Lattice:
    """Pieces as byte strings, with natural log-probabilities."""

    def __init__(self, pieces: Sequence[bytes], log_p: np.ndarray) -> None:
        self.pieces = list(pieces)
        self.log_p = np.asarray(log_p, dtype=np.float64)
        self.index = {piece: k for k, piece in enumerate(self.pieces)}
        self.longest = max(map(len, self.pieces))
        hashes = np.array([self._hash(p) for p in self.pieces], dtype=np.uint64)
        self._order = np.argsort(hashes)
        self._hashes = hashes[self._order]
        # The piece of a slot; -2 where two pieces share it, which a search tells apart.
        slots = (hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        self._of_piece = hashes
        self._slots = np.full(1 << _SLOT_BITS, -1, dtype=np.int32)
        self._slots[slots] = np.arange(len(slots))
        self._slots[slots[self._slots[slots] != np.arange(len(slots))]] = -2
        powers = [np.uint64(1)]
        with np.errstate(over="ignore"):
            for _ in range(self.longest):
                powers.append(powers[-1] * _BASE)
        self._powers = np.array(powers, dtype=np.uint64)

    @staticmethod
    def _hash(piece: bytes) -> int:
        value = 0
        for b in piece:
            value = (value * int(_BASE) + int(_CODES[b])) & ((1 << 64) - 1)
        return value

    def with_log_p(self, log_p: np.ndarray) -> Lattice:
        other = object.__new__(Lattice)
        other.__dict__.update(self.__dict__)
        other.log_p = np.asarray(log_p, dtype=np.float64)
        return other

    def _edges(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end, word and piece of every piece in words of one length, by start."""
        count, size = rows.shape
        sums = np.zeros((size + 1, count), dtype=np.uint64)
        for k in range(size):
            sums[k + 1] = sums[k] * _BASE + _CODES[rows[:, k]]
        parts = []
        for start in range(size):
            most = min(self.longest, size - start)
            values = (sums[start + 1 : start + most + 1] - sums[start] * self._powers[1 : most + 1, None]).ravel()
            slot = self._slots[values >> np.uint64(64 - _SLOT_BITS)]
            some = np.flatnonzero(slot != -1)
            piece, found = slot[some], values[some]
            shared = np.flatnonzero(piece == -2)
            piece[shared] = self._order[np.minimum(np.searchsorted(self._hashes, found[shared]), len(self._hashes) - 1)]
            hit = self._of_piece[piece] == found
            length, word = np.divmod(some[hit], count)
            parts.append((np.full(len(word), start), start + 1 + length, word, piece[hit]))
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True))

    def _forward(self, edges: tuple, count: int, size: int) -> np.ndarray:
        start, end, word, piece = edges
        forward = np.full((size + 1, count), -np.inf)
        forward[0] = 0.0
        cuts = np.searchsorted(start, np.arange(size + 1))
        for k in range(size):
            # From one start each word has one piece for an end, so no place is written twice.
            e, w = end[cuts[k] : cuts[k + 1]], word[cuts[k] : cuts[k + 1]]
            forward[e, w] = np.logaddexp(forward[e, w], forward[k, w] + self.log_p[piece[cuts[k] : cuts[k + 1]]])
        return forward

    def _backward(self, edges: tuple, count: int, size: int) -> np.ndarray:
        order = np.argsort(edges[1], kind="stable")
        start, end, word, piece = (c[order] for c in edges)
        back = np.full((size + 1, count), -np.inf)
        back[size] = 0.0
        cuts = np.searchsorted(end, np.arange(size + 2))
        for k in range(size, 0, -1):
            s, w = start[cuts[k] : cuts[k + 1]], word[cuts[k] : cuts[k + 1]]
            back[s, w] = np.logaddexp(back[s, w], back[k, w] + self.log_p[piece[cuts[k] : cuts[k + 1]]])
        return back

    def _batches(self, words: Sequence[bytes]):
        """Indices and rows of words of one length; long words come alone."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        for n in np.unique(lengths):
            own = np.flatnonzero(lengths == n)
            step = BATCH if n <= LONG else 1
            for k in range(0, len(own), step):
                part = own[k : k + step]
                yield part, b"".join(START + words[i] for i in part), int(n) + len(START)

    def log_probabilities(self, words: Sequence[bytes]) -> np.ndarray:
        """The natural logarithm of each word's marginal probability over all its segmentations."""
        out = np.empty(len(words))
        for own, raw, size in self._batches(words):
            if size > LONG + len(START):
                out[own] = self._long(raw)[-1]
                continue
            rows = np.frombuffer(raw, dtype=np.uint8).reshape(len(own), size)
            out[own] = self._forward(self._edges(rows), len(own), size)[-1]
        return out

    def _long(self, word: bytes, log_p: np.ndarray | None = None) -> list[float]:
        """The forward values of one word."""
        values = [-np.inf] * (len(word) + 1)
        values[0] = 0.0
        for start in range(len(word)):
            for end in range(start + 1, min(len(word), start + self.longest) + 1):
                piece = self.index.get(word[start:end])
                if piece is not None:
                    values[end] = _log_add(values[end], values[start] + self.log_p[piece])
        return values

    def _long_expected(self, word: bytes, times: float, counts: np.ndarray) -> None:
        forward, back = self._long(word), [-np.inf] * (len(word) + 1)
        back[-1] = 0.0
        for start in range(len(word) - 1, -1, -1):
            for end in range(start + 1, min(len(word), start + self.longest) + 1):
                piece = self.index.get(word[start:end])
                if piece is not None:
                    edge = self.log_p[piece] + back[end]
                    back[start] = _log_add(back[start], edge)
                    counts[piece] += times * np.exp(forward[start] + edge - forward[-1])

    def expected(self, words: Sequence[bytes], times: np.ndarray) -> np.ndarray:
        """For each piece, how often segmentations of the words, each ``times`` seen, use it on average."""
        counts = np.zeros(len(self.pieces))
        for own, raw, size in self._batches(words):
            if size > LONG + len(START):
                self._long_expected(raw, float(times[own[0]]), counts)
                continue
            rows = np.frombuffer(raw, dtype=np.uint8).reshape(len(own), size)
            edges = self._edges(rows)
            start, end, word, piece = edges
            forward, back = self._forward(edges, len(own), size), self._backward(edges, len(own), size)
            weight = forward[start, word] + self.log_p[piece] + back[end, word] - forward[size, word]
            counts += np.bincount(piece, weights=np.exp(weight) * times[own[word]], minlength=len(counts))
        return counts
