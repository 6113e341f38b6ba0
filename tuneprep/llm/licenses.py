"""Licence scans: Dice coefficient of word bigrams against templates.

A text is compared line by line, paragraph by paragraph and as a whole, and, with ``runs``, by
any run of consecutive lines. Two bigram sets of sizes a and b have a Dice coefficient of at most 2 min(a, b) / (a + b), so only templates whose
size is within bounds of a segment's are compared with it, and only those that share a bigram.
Both rules lose nothing. Of runs, those are left out that are no worse without their first or
last line. Nothing moves between tasks.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneprep.llm.license_texts import TEMPLATES

#: Least Dice coefficient of a match.
LEAST = 0.8

_WORD = re.compile(r"\w+")
_BLANK_LINES = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
_OWNER, _YEAR = re.compile(r"copyright|\(c\)|©"), re.compile(r"\d{4}")

Bigram = tuple[str, str]


def bigrams(text: str) -> frozenset[Bigram]:
    """Pairs of adjacent words of the normalised text: lower case, no punctuation, no notices of who owns it since when."""
    words = _words(text)
    return frozenset(zip(words, words[1:], strict=False))


def _words(text: str) -> list[str]:
    text = text.lower()
    if "copyright" in text or "(c)" in text or "©" in text:
        text = "\n".join(map(_without_notice, text.split("\n")))
    return _WORD.findall(text)


def _without_notice(line: str) -> str:
    """The line up to its first mark of an owner, if a year follows that mark."""
    owner = _OWNER.search(line)
    return line[: owner.start()] if owner and _YEAR.search(line, owner.end()) else line


def dice(a: frozenset, b: frozenset) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


class TemplateIndex:
    """Templates by size and by bigram."""

    def __init__(self, templates: Mapping[str, Sequence[str]], least: float = LEAST) -> None:
        pairs = sorted(((bigrams(t), name) for name, texts in templates.items() for t in texts), key=lambda x: (len(x[0]), x[1]))
        self.sets = [s for s, _ in pairs]
        self.names = [n for _, n in pairs]
        self.sizes = [len(s) for s in self.sets]
        self.least = least
        self.postings: dict[Bigram, list[int]] = {}
        for k, own in enumerate(self.sets):
            for pair in own:
                self.postings.setdefault(pair, []).append(k)
        self.known = frozenset(self.postings)
        #: A larger segment matches no template.
        self.most = max(self.sizes, default=0) * (2 - least) / least

    def best(self, segment: frozenset[Bigram]) -> tuple[float, str] | None:
        """The template with the highest coefficient from ``least`` on; the first name of equals."""
        size = len(segment)
        hits = segment & self.known if size <= self.most else None
        if not hits:
            return None
        # dice >= t needs size * t / (2 - t) <= other <= size * (2 - t) / t.
        low = bisect_left(self.sizes, size * self.least / (2 - self.least) - 1e-9)
        high = bisect_right(self.sizes, size * (2 - self.least) / self.least + 1e-9)
        shared = Counter(k for pair in hits for k in self.postings[pair] if low <= k < high)
        found = [(2 * n / (size + self.sizes[k]), self.names[k]) for k, n in shared.items()]
        found = [f for f in found if f[0] >= self.least]
        return min(found, key=lambda f: (-f[0], f[1])) if found else None

    def scan(self, text: str | None, runs: bool = False) -> list[tuple[str, float, int, int]]:
        """(licence, coefficient, start, end) of the lines, paragraphs, the whole text and, with ``runs``, runs of lines that match.

        A span within which, or around which, another one matches the same licence better is
        left out. Ends are exclusive.
        """
        if not text:
            return []
        found, at, lines = [], 0, []
        for line in text.split("\n"):
            own = bigrams(line)
            lines.append((at, own))
            best = self.best(own)
            if best:
                found.append((best[1], best[0], at, at + len(line)))
            at += len(line) + 1
        if len(lines) > 1:
            edges = [0, *(x for m in _BLANK_LINES.finditer(text) for x in m.span()), len(text)]
            segments = {(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True)} | {(0, len(text))}
            for a, b in sorted(segments):
                best = self.best(bigrams(text[a:b])) if "\n" in text[a:b] and self._fits(lines, a, b) else None
                if best:
                    found.append((best[1], best[0], a, b))
            if runs:
                found.extend(self._runs(text, found))
        return sorted((f for f in found if not any(_better(g, f) for g in found)), key=lambda f: (f[2], f[3], f[0]))

    def _runs(self, text: str, found: list[tuple[str, float, int, int]]) -> list[tuple[str, float, int, int]]:
        """Matching runs of two lines or more, best first, without those that overlap a span at least as good."""
        words, line_of, edges, at = [], [], [], 0
        for k, line in enumerate(text.split("\n")):
            own = _words(line)
            words.extend(own)
            line_of.extend([k] * len(own))
            edges.append((at, at + len(line)))
            at += len(line) + 1
        pairs = list(zip(words, words[1:], strict=False))
        # A match shares at least this part of the template's bigrams.
        part = self.least / (2 - self.least)
        shared = Counter(k for pair in self.known.intersection(pairs) for k in self.postings[pair])
        matches = []
        for k, n in shared.items():
            if n >= part * self.sizes[k] - 1e-9:
                matches.extend((d, self.names[k], edges[i][0], edges[j][1]) for d, i, j in self._runs_of(k, pairs, line_of))
        out = []
        for d, name, a, b in sorted(matches, key=lambda m: (-m[0], m[3] - m[2], m[1], m[2])):
            # A short statement of another licence within the run does not matter.
            rivals = (f for f in (*found, *out) if f[2] < b and a < f[3] and f[1] >= d)
            if not any(f[0] == name or 2 * (f[3] - f[2]) >= b - a for f in rivals):
                out.append((name, d, a, b))
        return out

    def _runs_of(self, k: int, pairs: list[Bigram], line_of: list[int]) -> Iterator[tuple[float, int, int]]:
        """(coefficient, first line, last line) of runs that match a template.

        A run begins at a line with a bigram of the template that no later line of it has: without
        that line it would match as well. So each line is read for at most as many beginnings as
        the template has bigrams.
        """
        own, size = self.sets[k], self.sizes[k]
        most = size * (2 - self.least) / self.least + 1e-9
        places = [p for p, pair in enumerate(pairs) if pair in own]
        until: dict[int, int] = {}
        following: dict[Bigram, list[int]] = {}
        for p in reversed(places):
            # The places of the bigram in the nearest line so far, and the end of its first place in a later line.
            line, near = line_of[p], following.get(pairs[p])
            if near is None:
                following[pairs[p]] = near = [line, line_of[p + 1], len(line_of)]
            elif near[0] == line:
                near[1] = line_of[p + 1]
            else:
                near[:] = [line, line_of[p + 1], near[1]]
            until[line] = max(until.get(line, 0), near[2])
        first: dict[int, int] = {}
        for p in range(len(line_of) - 1, -1, -1):
            if line_of[p] in until:
                first[line_of[p]] = p
        for line, end in until.items():
            seen: set[Bigram] = set()
            same, best = 0, None
            for p in range(first[line], len(pairs)):
                if line_of[p + 1] >= end or len(seen) > most:
                    break
                pair = pairs[p]
                if pair not in seen:
                    seen.add(pair)
                    same += pair in own
                last = line_of[p + 1]
                if last > line and (p + 1 == len(pairs) or line_of[p + 2] > last):
                    score = 2 * same / (len(seen) + size)
                    if score >= self.least and (best is None or score > best[0]):
                        best = (score, line, last)
            if best:
                yield best

    def _fits(self, lines: list[tuple[int, frozenset[Bigram]]], a: int, b: int) -> bool:
        """False if the lines of a segment alone have more bigrams than any template allows."""
        seen: set[Bigram] = set()
        for k in range(bisect_left(lines, a, key=lambda x: x[0]), len(lines)):
            if lines[k][0] >= b or len(seen) > self.most:
                break
            seen |= lines[k][1]
        return len(seen) <= self.most


def _better(g: tuple, f: tuple) -> bool:
    """g covers f or lies in it, has the same licence, and matches better or equally well on more text."""
    nested = (g[2] <= f[2] and f[3] <= g[3]) or (f[2] <= g[2] and g[3] <= f[3])
    return g != f and g[0] == f[0] and nested and (g[1], g[3] - g[2]) > (f[1], f[3] - f[2])


def _scanner(index: TemplateIndex, runs: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                which, rows = [], []
                for k, text in enumerate(part.column("text").to_pylist()):
                    for row in index.scan(text, runs):
                        which.append(k)
                        rows.append(row)
                columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(which, pa.int64())),
                        pa.array(columns[0], pa.string()),
                        pa.array(columns[1], pa.float64()),
                        pa.array(columns[2], pa.int64()),
                        pa.array(columns[3], pa.int64()),
                    ],
                    names=["doc_id", "license", "dice", "start", "stop"],
                )

    return scan


def scan_licenses(docs: DataFrame, templates: Mapping[str, Sequence[str]] | None = None, least: float = LEAST, runs: bool = False) -> DataFrame:
    """Rows (``doc_id``, ``license``, ``dice``, ``start``, ``stop``): one for each matching span of a text.

    With ``runs``, a template is found wherever it stands between line ends, whatever blank lines it has.

    * A null or empty text, and one without two adjacent words, matches nothing.
    * Repeated rows are scanned each. Of templates that match equally well the first name counts.
    * Other columns are not read. An empty table gives no rows.
    """
    index = TemplateIndex(TEMPLATES if templates is None else templates, least)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_scanner(index, runs), f"doc_id {kind}, license string, dice double, start long, stop long")
