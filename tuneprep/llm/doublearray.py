"""Tries in two arrays (Aoe 1989), walked by many positions at once.

The child of ``state`` under ``symbol`` is ``base[state] + symbol`` if ``check`` there holds
``state``.
"""

from __future__ import annotations

import numpy as np

#: Places tried at once, and how often, before the arrays grow.
_TRIED, _ROUNDS = 64, 8


class DoubleArray:
    """The sequences of ``rows`` (symbols from 0, padded with -1 at the end; no two are equal).

    ``accept[state]`` is the row that ends at a state, or -1. State 0 is the root.
    """

    def __init__(self, rows: np.ndarray) -> None:
        order = np.lexsort(rows.T[::-1]) if rows.size else np.zeros(0, dtype=np.int64)
        rows = rows[order]
        # Nodes by level: parent, symbol, and the row that ends there.
        parents, symbols, ends = [], [], [np.full(1, -1, dtype=np.int64)]
        at = np.zeros(len(rows), dtype=np.int64)
        live, known = np.arange(len(rows)), 1
        for level in range(rows.shape[1]):
            live = live[rows[live, level] >= 0]
            if not len(live):
                break
            symbol = rows[live, level]
            new = np.ones(len(live), dtype=bool)
            new[1:] = (at[live][1:] != at[live][:-1]) | (symbol[1:] != symbol[:-1])
            parents.append(at[live][new])
            symbols.append(symbol[new])
            at[live] = known + np.cumsum(new) - 1
            known += int(new.sum())
            last = (rows[live, level + 1] < 0) if level + 1 < rows.shape[1] else np.ones(len(live), dtype=bool)
            end = np.full(int(new.sum()), -1, dtype=np.int64)
            end[at[live[last]] - known + len(end)] = order[live[last]]
            ends.append(end)
        parent = np.concatenate(parents) if parents else np.zeros(0, dtype=np.int64)
        symbol = np.concatenate(symbols) if symbols else np.zeros(0, dtype=np.int64)
        base, slot = self._place(parent, symbol, known)
        size = int(max(slot.max(initial=0), base.max(initial=0) + symbol.max(initial=0)) + 1)
        self.base, self.check = np.zeros(size, dtype=np.int64), np.full(size, -1, dtype=np.int64)
        self.accept = np.full(size, -1, dtype=np.int64)
        self.base[slot] = base
        self.check[slot[1:]] = slot[parent]
        self.accept[slot] = np.concatenate(ends)
        self.symbols = int(symbol.max(initial=-1)) + 1
        self.base = np.concatenate([self.base, np.zeros(self.symbols, dtype=np.int64)])
        self.check = np.concatenate([self.check, np.full(self.symbols, -1, dtype=np.int64)])

    @staticmethod
    def _place(parent: np.ndarray, symbol: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
        """Base of every node, and its slot: no two nodes share one."""
        base, slot = np.zeros(nodes, dtype=np.int64), np.zeros(nodes, dtype=np.int64)
        if nodes == 1:
            return base, slot
        first = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
        many = np.diff(np.concatenate([first, [len(parent)]]))
        span = int(symbol.max()) + 1
        free = np.ones(2 * nodes + 2 * span, dtype=bool)
        free[0] = False
        rng = np.random.default_rng(0)
        # The largest families first, while the arrays are empty.
        for k in np.argsort(-many, kind="stable"):
            if many[k] == 1:
                break
            own = symbol[first[k] : first[k] + many[k]]
            place = -1
            for _ in range(_ROUNDS):
                tried = rng.integers(0, len(free) - span, _TRIED)
                fits = free[tried[:, None] + own].all(axis=1)
                if fits.any():
                    place = int(tried[np.argmax(fits)])
                    break
            if place < 0:
                place = len(free)
                free = np.concatenate([free, np.ones(max(span, len(free) // 2) + span, dtype=bool)])
            free[place + own] = False
            base[parent[first[k]]] = place
            slot[1 + first[k] : 1 + first[k] + many[k]] = place + own
        # An only child takes any slot from ``span`` on, so that its parent's base is not negative.
        alone = first[many == 1]
        if short := max(0, len(alone) - int(free[span:].sum())):
            free = np.concatenate([free, np.ones(short, dtype=bool)])
        slots = span + np.flatnonzero(free[span:])[: len(alone)]
        slot[1 + alone] = slots
        base[parent[alone]] = slots - symbol[alone]
        return base, slot

    def advance(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The next state of each position, -1 where there is none or the symbol is negative."""
        there = self.base[states] + np.maximum(symbols, 0)
        return np.where((symbols >= 0) & (self.check[there] == states), there, -1)
