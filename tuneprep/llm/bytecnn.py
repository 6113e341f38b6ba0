"""A convolutional network over bytes: filters of several widths, max pooling, softmax.

It is trained in numpy on windows of fixed length. For prediction the first layer becomes a
table: what two adjacent bytes add to every filter. A window's response is then a sum of table
rows, which is several times faster than multiplying matrices.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

from tuneprep.llm.familiar import Familiar

WINDOW = 256
WIDTHS = (2, 3, 4)
#: Windows whose responses are held at once.
BLOCK = 64


def windows(raw: bytes, size: int = WINDOW) -> np.ndarray:
    """The text's bytes in rows of ``size``, the last one filled up with zeros; no row for no bytes."""
    count = -(-len(raw) // size)
    return np.frombuffer(raw + bytes(count * size - len(raw)), dtype=np.uint8).reshape(count, size)


@dataclass
class ByteCNN:
    classes: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]  # one (width, embedding, filters) for each width
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    familiar: Familiar | None = None  # what tells texts in none of the classes
    _tables: tuple | None = field(default=None, repr=False)

    @classmethod
    def blank(cls, classes: Sequence[str], dim: int = 8, count: int = 12, seed: int = 3) -> ByteCNN:
        rng = np.random.default_rng(seed)
        filters = [rng.normal(0, np.sqrt(2 / (w * dim)), (w, dim, count)).astype(np.float32) for w in WIDTHS]
        total = count * len(WIDTHS)
        return cls(
            list(classes),
            rng.normal(0, 1, (256, dim)).astype(np.float32),
            filters,
            np.zeros(total, dtype=np.float32),
            rng.normal(0, np.sqrt(1 / total), (total, len(classes))).astype(np.float32),
            np.zeros(len(classes), dtype=np.float32),
        )

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tables": None}

    def _parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, self.bias, self.out, self.out_bias]

    def fit(self, rows: np.ndarray, labels: np.ndarray, steps: int = 500, batch: int = 64, rate: float = 0.004, seed: int = 5) -> None:
        """Adam on the cross-entropy of ``rows``, windows as ``windows`` gives them."""
        rng = np.random.default_rng(seed)
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self._parameters()]
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(rows), min(batch, len(rows)))
            grads = self._gradients(rows[pick], labels[pick])
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for p, g, (m, v) in zip(self._parameters(), grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        self._tables = None

    def _gradients(self, rows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        padded = np.pad(rows, ((0, 0), (0, max(WIDTHS) - 1)))
        embedded = self.embedding[padded]
        n, length = rows.shape
        places, values = [], []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            response = sum(embedded[:, k : k + length] @ f[k] for k in range(w))
            place = response.argmax(axis=1)
            places.append(place)
            values.append(np.take_along_axis(response, place[:, None, :], axis=1)[:, 0])
        raw = np.concatenate(values, axis=1) + self.bias
        hidden = np.maximum(raw, 0)
        error = _softmax(hidden @ self.out + self.out_bias)
        error[np.arange(n), labels] -= 1
        error /= n
        back = (error @ self.out.T) * (raw > 0)
        d_embedding, d_filters, at = np.zeros_like(self.embedding), [], 0
        for w, f, place in zip(WIDTHS, self.filters, places, strict=True):
            g = back[:, at : at + f.shape[2]]
            at += f.shape[2]
            read = padded[np.arange(n)[:, None, None], place[:, :, None] + np.arange(w)]
            d_filters.append(np.einsum("bfkd,bf->kdf", self.embedding[read], g))
            np.add.at(d_embedding, read, np.einsum("bf,kdf->bfkd", g, f))
        return [d_embedding, *d_filters, back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]

    def _build(self) -> tuple:
        """(offset, columns, table of byte pairs or of bytes) for each part of the first layer."""
        if self._tables is None:
            parts, at = {}, 0
            for w, f in zip(WIDTHS, self.filters, strict=True):
                columns = slice(at, at + f.shape[2])
                at = columns.stop
                single = [self.embedding @ f[k] for k in range(w)]
                for k in range(0, w - 1, 2):
                    pair = (single[k][:, None, :] + single[k + 1][None, :, :]).reshape(65536, -1)
                    parts.setdefault((k, True), []).append((columns, pair))
                if w % 2:
                    parts.setdefault((w - 1, False), []).append((columns, single[-1]))
            joined = []
            for (offset, pairs), own in parts.items():
                columns = slice(own[0][0].start, own[-1][0].stop)
                if columns.stop - columns.start == sum(t.shape[1] for _, t in own):
                    joined.append((offset, pairs, columns, np.ascontiguousarray(np.concatenate([t for _, t in own], axis=1))))
                else:
                    joined.extend((offset, pairs, c, np.ascontiguousarray(t)) for c, t in own)
            self._tables = tuple(sorted(joined, key=lambda x: x[0]))
        return self._tables

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        """The softmax of each window."""
        tables, length = self._build(), rows.shape[1]
        pooled = np.empty((len(rows), len(self.bias)), dtype=np.float32)
        for k in range(0, len(rows), BLOCK):
            padded = np.pad(rows[k : k + BLOCK], ((0, 0), (0, max(WIDTHS)))).astype(np.intp)
            pairs = padded[:, :-1] * 256 + padded[:, 1:]
            response = None
            for offset, paired, columns, table in tables:
                found = table.take((pairs if paired else padded)[:, offset : offset + length], axis=0)
                if response is None and found.shape[2] == len(self.bias):
                    response = found
                    continue
                if response is None:
                    response = np.zeros((*found.shape[:2], len(self.bias)), dtype=np.float32)
                response[:, :, columns] += found
            pooled[k : k + BLOCK] = response.max(axis=1)
        return _softmax(np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)
