"""How familiar a text's letters are: runs of three bytes under what was learned of each language.

A softmax over known languages always finds one of them; this measure falls on text in none
of them, however many languages there are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

#: Cells that runs of three bytes are hashed to; a language's sample has some thousands of runs.
CELLS = 1 << 18
#: What an unseen run counts as, in occurrences.
UNSEEN = 0.1
#: Part of the learned windows, scored without themselves, that may lie below the bound, and nats that the bound lies lower yet.
OUTLIERS, MARGIN = 0.005, 0.5
#: Runs of a text for which the bound lies lower by MARGIN once more: a few odd words in a short text say little.
SHORT = 64

# ASCII letters in lower case, bytes of other letters as they are, all else a blank.
_FOLD = np.array([b if b >= 128 or chr(b).islower() else b + 32 if chr(b).isupper() else 0 for b in range(256)], dtype=np.uint32)


def runs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window the cells of its runs of three bytes, and which of them have a letter."""
    folded = _FOLD[rows]
    codes = folded[:, :-2] << 16 | folded[:, 1:-1] << 8 | folded[:, 2:]
    return (codes * np.uint32(2654435761)) >> np.uint32(32 - 18), codes != 0


@dataclass
class Familiar:
    """Occurrences of runs in each language (cells, counts), and the least mean log-probability of a long text."""

    counts: list[tuple[np.ndarray, np.ndarray]]
    bound: float = -np.inf
    _table: np.ndarray | None = field(default=None, repr=False)

    @classmethod
    def of(cls, rows: np.ndarray, labels: np.ndarray, classes: int) -> Familiar:
        cells, lettered = runs(rows)
        return cls([np.unique(cells[labels == k][lettered[labels == k]], return_counts=True) for k in range(classes)])

    @classmethod
    def calibrated(cls, rows: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> Familiar:
        """Learned from all windows; the bound is from each half's windows under the other half alone.

        ``weights`` are the probabilities of the languages for each window. Every language has
        its quantile, and the lowest one counts.
        """
        classes, half = weights.shape[1], np.zeros(len(rows), dtype=int)
        for k in range(classes):
            half[labels == k] = np.arange(np.count_nonzero(labels == k)) % 2
        means = np.full(len(rows), np.nan)
        for h in (0, 1):
            own = half == h
            sums, n = cls.of(rows[~own], labels[~own], classes).sums(rows[own], weights[own])
            means[own] = np.where(n > 0, sums / np.maximum(n, 1), np.nan)
        lowest = [np.quantile(m, OUTLIERS) for k in range(classes) if len(m := means[(labels == k) & ~np.isnan(means)])]
        out = cls.of(rows, labels, classes)
        out.bound = float(min(lowest)) - MARGIN if lowest else -np.inf
        return out

    def holds(self, total: float, n: int) -> bool:
        """``n`` runs with the log-probability ``total`` are not below the bound; no runs are not."""
        return not n or total / n >= self.bound - MARGIN * SHORT / n

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_table": None}

    def sums(self, rows: np.ndarray, weights: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each window the log-probability of its runs with a letter under the languages mixed by ``weights``, and their number."""
        if self._table is None:
            self._table = np.empty((CELLS, len(self.counts)), dtype=np.float32)
            for k, (cells, n) in enumerate(self.counts):
                total = n.sum() + UNSEEN * CELLS
                self._table[:, k] = UNSEEN / total
                self._table[cells, k] = (n + UNSEEN) / total
        cells, lettered = runs(rows)
        mixed = np.einsum("wrk,wk->wr", self._table[cells], np.asarray(weights, dtype=np.float32))
        return np.where(lettered, np.log(mixed), 0).sum(axis=1, dtype=np.float64), lettered.sum(axis=1)
