"""An inverted index of test items with BM25 impacts and block maxima.

Items are sorted so that items of like words are neighbours, and cut into blocks. For every
term the index holds its largest impact in each block. A passage can only have an item above
the threshold in a block if the maxima of its terms there add up to it; that is tested for
many passages at once. In a block that passes, items are visited as in WAND: terms are ordered
by their next item, an item is scored if the maxima of the terms up to it reach the threshold.

Impacts are divided by the item's score against itself, so 1 is the item's own text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np

# Scripts written without blanks: Thai, Lao, Myanmar, Khmer, kana and Han. Each character is a word.
_DENSE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_DENSE_CHAR = re.compile(f"[{_DENSE}]")
_WORD = re.compile(r"\w+")
_WORD_OR_CHAR = re.compile(rf"[{_DENSE}]|[^\W{_DENSE}]+")
#: Items of one block.
BLOCK = 4
K1, B = 1.2, 0.75
#: Rounding that bounds allow for.
SLACK = 1e-5


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of word characters; in scripts without blanks, single characters."""
    if not text:
        return []
    text = text.lower()
    pattern = _WORD if text.isascii() or not _DENSE_CHAR.search(text) else _WORD_OR_CHAR
    return pattern.findall(text)


@dataclass
class Statistics:
    """Of all items: how many hold each word, how many there are, their mean number of words."""

    df: Mapping[str, int]
    total: int
    mean: float


class Index:
    """``items`` are lists of words; an item's number is its place in them.

    Where the items are a part of a larger collection, ``known`` holds the statistics of all of it,
    so an item's impacts do not depend on the part it is in.
    """

    def __init__(self, items: Sequence[list[str]], known: Statistics | None = None) -> None:
        counts = [Counter(words) for words in items]
        df = Counter(w for c in counts for w in c)
        total = len(items)
        self.terms = {w: k for k, w in enumerate(sorted(df))}
        if known is None:
            known = Statistics(df, total, sum(map(len, items)) / max(1, total))
        idf = {w: math.log(1 + (known.total - known.df[w] + 0.5) / (known.df[w] + 0.5)) for w in df}
        mean = max(1.0, known.mean)
        impacts = []
        for words, c in zip(items, counts, strict=True):
            norm = K1 * (1 - B + B * len(words) / mean)
            raw = {w: idf[w] * n * (K1 + 1) / (n + norm) for w, n in c.items()}
            own = sum(raw.values())
            impacts.append({self.terms[w]: v / own for w, v in raw.items()} if own else {})
        # Items that share common words stand together, so the maxima of a block are tight.
        common = {w for w, n in df.items() if n >= max(2, total // 20)}
        self.order = sorted(range(total), key=lambda k: (sorted((df[w], w) for w in counts[k] if w in common)[::-1][:3], k))
        self.impacts = [impacts[k] for k in self.order]
        self.blocks = -(-total // BLOCK)
        self.maxima = np.zeros((len(self.terms), self.blocks), dtype=np.float32)
        self.postings: list[dict[int, list[tuple[int, float]]]] = [{} for _ in range(self.blocks)]
        for place, own in enumerate(self.impacts):
            block = place // BLOCK
            for term, value in own.items():
                self.maxima[term, block] = max(self.maxima[term, block], np.float32(value))
                self.postings[block].setdefault(term, []).append((place, value))

    def candidates(self, passages: np.ndarray, terms: np.ndarray, count: int, least: float) -> list[tuple[int, int, float]]:
        """(passage, item, score) with a score of at least ``least``.

        ``passages`` and ``terms`` are distinct pairs sorted by passage; ``count`` passages.
        """
        if not len(terms):
            return []
        found, firsts = [], np.flatnonzero(np.diff(passages, prepend=-1))
        for k in range(0, len(firsts), 512):
            low = firsts[k]
            high = firsts[k + 512] if k + 512 < len(firsts) else len(terms)
            bounds = np.add.reduceat(self.maxima[terms[low:high]], firsts[k : k + 512] - low, axis=0)
            for at, block in np.argwhere(bounds >= least - SLACK):
                a = firsts[k + at]
                b = firsts[k + at + 1] if k + at + 1 < len(firsts) else len(terms)
                found.extend((int(passages[a]), self.order[place], score) for place, score in self._wand(int(block), terms[a:b].tolist(), least))
        return found

    def _wand(self, block: int, terms: list[int], least: float) -> list[tuple[int, float]]:
        lists = self.postings[block]
        # Per term: its postings in the block, its place in them, its maximum.
        cursors = [[lists[t], 0, self.maxima[t, block].item()] for t in terms if t in lists]
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[0][c[1]][0])
            total, pivot = 0.0, None
            for c in cursors:
                total += c[2]
                if total >= least - SLACK:
                    pivot = c[0][c[1]][0]
                    break
            if pivot is None:
                break
            if cursors[0][0][cursors[0][1]][0] == pivot:
                score = 0.0
                for c in cursors:
                    if c[0][c[1]][0] == pivot:
                        score += c[0][c[1]][1]
                        c[1] += 1
                if score >= least:
                    found.append((pivot, score))
            else:
                for c in cursors:
                    while c[1] < len(c[0]) and c[0][c[1]][0] < pivot:
                        c[1] += 1
            cursors = [c for c in cursors if c[1] < len(c[0])]
        return found
