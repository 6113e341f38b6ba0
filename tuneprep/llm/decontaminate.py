"""Benchmark decontamination: passages of training texts that hold test items.

Every passage of every text is a query against a BM25 index of the test items. Items above
the threshold are then verified: most of the runs of words of the item's question, and of its
answer, must occur around the passage.

How many items hold a word, and their mean length, are counted by Spark once over all items;
the items then are a table in groups of bounded size, each with the counts of its own words, so
no score depends on the groups. A pass over the texts takes ``PER_PASS`` groups; the driver
reads the groups of one pass at a time. Texts are not moved.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneprep.llm.bm25 import Index, Statistics, words_of
from tuneprep.llm.stage import written

#: Words of a passage, and of the part of an item that is indexed as one; passages overlap by half.
PASSAGE, PART = 128, 64
#: Bytes of test items of one group, about, which is one index; and groups of one pass over the texts.
GROUP_BYTES, PER_PASS = 1 << 18, 8
#: Least BM25 score, where 1 is the item's own text.
RETRIEVED = 0.5
#: Part of the question's, and of the answer's, runs of words that must occur, and their length.
VERIFIED, RUN = 0.6, 3

_SENTENCE = re.compile(r"(?<=[.?!])\s+|(?<=[\u3002\uff1f\uff01])\s*")
_COUNTED = "item_id long, text string, words array<struct<word:string,n:long>>, parts long, length long"


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The words of an item before its last sentence, and of that one.

    An item of one sentence, or whose last one has fewer than three words, is cut at two thirds.
    """
    sentences = [words_of(s) for s in _SENTENCE.split(text.strip())]
    sentences = [s for s in sentences if s]
    if len(sentences) > 1 and len(sentences[-1]) >= RUN:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = words_of(text)
    cut = -(-2 * len(words) // 3)
    return words[:cut], words[cut:]


def _runs(words: list[str]) -> set[tuple[str, ...]]:
    size = min(RUN, len(words))
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if words else set()


@dataclass
class Item:
    item_id: int | None
    size: int
    question: set[tuple[str, ...]]
    answer: set[tuple[str, ...]]

    def overlaps(self, words: list[str]) -> tuple[float, float]:
        """Part of the question's, and of the answer's, runs that occur in ``words``; 1 for no runs."""
        out = []
        for part in (self.question, self.answer):
            sizes = {len(r) for r in part}
            there = {tuple(words[k : k + n]) for n in sizes for k in range(len(words) - n + 1)}
            out.append(len(part & there) / len(part) if part else 1.0)
        return out[0], out[1]


def parts_of(words: list[str]) -> list[list[str]]:
    """An item's parts, of PART words; the last one has at least half of them unless it is the only one."""
    return [words[k : k + PART] for k in range(0, len(words), PART) if k == 0 or len(words) - k >= PART // 2]


class Items:
    """A group of test items with the index of their parts."""

    def __init__(self, rows: list[tuple[int | None, str]], known: Statistics | None = None) -> None:
        self.items: list[Item] = []
        self.owner: list[int] = []
        parts = []
        for item_id, text in rows:
            words = words_of(text)
            if len(words) < RUN:
                continue
            question, answer = question_and_answer(text)
            for part in parts_of(words):
                parts.append(part)
                self.owner.append(len(self.items))
            self.items.append(Item(item_id, len(words), _runs(question), _runs(answer)))
        self.index = Index(parts, known)

    def hits(self, words: list[list[str]]) -> list[tuple[int, int | None, float, float, float]]:
        """(text, item_id, score, question, answer) of the verified items of each text, the best passage of each."""
        step, known = PASSAGE // 2, self.index.terms
        first, passages, terms, base = [], [], [], 0
        for own in words:
            ids = np.fromiter((known.get(w, -1) for w in own), dtype=np.int64, count=len(own))
            at = np.flatnonzero(ids >= 0)
            # A word stands in the passage that starts at its half, and in the one before.
            half = at // step
            passages.extend([base + half, base + np.maximum(half - 1, 0)])
            terms.extend([ids[at], ids[at]])
            first.append(base)
            base += max(1, -(-len(own) // step))
        codes = np.unique(np.concatenate(passages) * max(1, len(known)) + np.concatenate(terms)) if words else np.zeros(0, np.int64)
        passage, term = codes // max(1, len(known)), codes % max(1, len(known))
        best: dict[tuple[int, int], float] = {}
        places: dict[tuple[int, int], set[int]] = {}
        for p, part, score in self.index.candidates(passage, term, base, RETRIEVED):
            text = int(np.searchsorted(first, p, side="right")) - 1
            key = (text, self.owner[part])
            best[key] = max(best.get(key, 0.0), score)
            places.setdefault(key, set()).add(p - first[text])
        out = []
        for (text, item), score in best.items():
            own, found = words[text], self.items[item]
            around = max(found.size, step)
            overlaps = (0.0, 0.0)
            for p in places[text, item]:
                overlaps = max(overlaps, found.overlaps(own[max(0, p * step - around) : p * step + PASSAGE + around]), key=min)
            if min(overlaps) >= VERIFIED:
                out.append((text, found.item_id, score, *overlaps))
        return out


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item that is long enough, with the number of its parts that hold each of its words."""
    for batch in batches:
        rows = []
        for item_id, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            parts = parts_of(words_of(text))
            if parts and sum(map(len, parts)) >= RUN:
                n = Counter(w for part in parts for w in set(part))
                rows.append((item_id, text, [{"word": w, "n": k} for w, k in n.items()], len(parts), sum(map(len, parts))))
        types = [pa.int64(), pa.string(), pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())])), pa.int64(), pa.int64()]
        columns = zip(*rows, strict=True) if rows else [[]] * len(types)
        names = ["item_id", "text", "words", "parts", "length"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def item_groups(benchmark: DataFrame) -> Iterator[list[Items]]:
    """The items of each pass, in groups of about GROUP_BYTES; items without text, or of fewer than three words, are none.

    What the driver holds at once is about GROUP_BYTES * PER_PASS, or one item that is longer.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = written(items.where("text is not null").distinct().mapInArrow(_counter, _COUNTED), "items")
    total, length, size = items.agg(F.sum("parts"), F.sum("length"), F.sum(F.octet_length("text"))).first()
    if not total:
        return
    groups = -(-size // GROUP_BYTES)
    grouped = items.withColumn("group", F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)))
    words = grouped.select("group", F.inline("words"))
    counts = words.groupBy("word").agg(F.sum("n").alias("n"))
    # A word may be in every group, but once.
    counts = written(words.select("group", "word").distinct().join(counts, "word"), "item-words")
    grouped = written(grouped.select("group", "item_id", "text"), "item-groups")
    for low in range(0, groups, PER_PASS):
        own = F.col("group").between(low, low + PER_PASS - 1)
        rows: dict[int, list[tuple[int | None, str]]] = {}
        for r in grouped.where(own).collect():
            rows.setdefault(r["group"], []).append((r["item_id"], r["text"]))
        df: dict[int, dict[str, int]] = {k: {} for k in rows}
        for r in counts.where(own).collect():
            df[r["group"]][r["word"]] = r["n"]
        order = {k: sorted(v, key=lambda x: (x[0] is None, x[0] or 0, x[1])) for k, v in sorted(rows.items())}
        yield [Items(v, Statistics(df[k], total, length / total)) for k, v in order.items()]


def _hits(tests: list[Items], texts: pa.Array) -> list[tuple[int, int | None, float, float, float]]:
    words = [words_of(t) for t in texts.to_pylist()]
    found = [row for group in tests for row in group.hits(words)]
    return sorted(found, key=lambda row: (row[0], row[1] is None, row[1] or 0))


def _searcher(tests: list[Items]):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = _hits(tests, part.column("text"))
                columns = list(zip(*rows, strict=True)) if rows else [[], [], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.float64()) for c in columns[2:])],
                    names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
                )

    return search


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (``doc_id``, ``item_id``, ``score``, ``question_overlap``, ``answer_overlap``): test items that texts hold.

    ``score`` is the best passage's BM25 score as a part of the item's own.

    * A null or empty text holds nothing. Items without text or of fewer than three words (in scripts
      without blanks, characters) are not searched: they say too little to be verified.
    * An item whose ``item_id`` is null is searched like others; its rows have a null ``item_id``.
    * Repeated rows of ``docs`` give repeated rows; a repeated item counts once.
    * Other columns are not read. Empty tables give no rows.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, item_id long, score double, question_overlap double, answer_overlap double"
    found = docs.sparkSession.createDataFrame([], schema)
    for tests in item_groups(benchmark):
        found = found.union(rows.mapInArrow(_searcher(tests), schema))
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no test item, with all columns."""
    at = docs.columns.index("text")

    def keeper(tests: list[Items]):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = set()
                for k in range(0, batch.num_rows, 64):
                    hit.update(k + row[0] for row in _hits(tests, batch.column(at).slice(k, 64)))
                yield batch.filter(pa.array([k not in hit for k in range(batch.num_rows)], pa.bool_()))

        return keep

    for tests in item_groups(benchmark):
        docs = docs.mapInArrow(keeper(tests), docs.schema)
    return docs
