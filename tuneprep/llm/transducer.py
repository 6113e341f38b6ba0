"""Small weighted finite-state transducers over classes of words.

A transducer reads the symbols of a clause and multiplies what a symbol is worth by a weight
for each step. Composing two of them gives one that steps through both and multiplies both
weights, so a clause is read once however many patterns the grammar has.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

#: Classes of words; OTHER is any other word.
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "insult", "threat", "target", "negation", "report", "other"
SYMBOLS = (INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER)
HARMFUL = (INSULT, THREAT)


@dataclass(frozen=True)
class Transducer:
    """``steps[state][symbol]`` is the next state and the weight; state 0 is the first."""

    steps: tuple[dict[str, tuple[int, float]], ...]

    def compose(self, other: Transducer) -> Transducer:
        """The transducer whose weights are the products of both, with the states that can be reached."""
        states, order, steps = {(0, 0): 0}, [(0, 0)], []
        for a, b in order:
            row = {}
            for symbol in SYMBOLS:
                (x, v), (y, w) = self.steps[a][symbol], other.steps[b][symbol]
                if (x, y) not in states:
                    states[x, y] = len(order)
                    order.append((x, y))
                row[symbol] = (states[x, y], v * w)
            steps.append(row)
        return Transducer(tuple(steps))

    def score(self, symbols: Iterable[str], worth: Sequence[float]) -> float:
        """The summed worth of the symbols, each times the weight of its step."""
        state, total = 0, 0.0
        for symbol, value in zip(symbols, worth, strict=True):
            state, weight = self.steps[state][symbol]
            total += weight * value
        return total


def _plain(next_state: int = 0) -> dict[str, tuple[int, float]]:
    return {symbol: (next_state, 1.0) for symbol in SYMBOLS}


def harm() -> Transducer:
    """Weights 1 for insults and threats, 0 for all that is harmless by itself."""
    return Transducer(({symbol: (0, 1.0 if symbol in HARMFUL else 0.0) for symbol in SYMBOLS},))


def scope(symbol: str, weight: float, reach: int) -> Transducer:
    """What follows ``symbol`` within ``reach`` words is worth ``weight`` times as much; reach 0 is the whole rest."""
    if not reach:
        rest = {s: (1, weight if s in HARMFUL else 1.0) for s in SYMBOLS}
        return Transducer((_plain() | {symbol: (1, 1.0)}, rest))
    rows = [_plain() | {symbol: (reach, 1.0)}]
    for left in range(1, reach + 1):
        rows.append({s: (left - 1, weight if s in HARMFUL else 1.0) for s in SYMBOLS} | {symbol: (reach, 1.0)})
    return Transducer(tuple(rows))


def grammar(negated: float = 0.5, reported: float = 0.5, targeted: float = 1.5, reach: int = 3) -> Transducer:
    """Insults and threats, weaker under a negation or in reported speech, stronger after a target."""
    parts = (scope(NEGATION, negated, reach), scope(REPORT, reported, 0), scope(TARGET, targeted, reach))
    whole = harm()
    for part in parts:
        whole = whole.compose(part)
    return whole
