"""Words one edit apart, by a frontier of states that moves down tries level by level.

The words are kept in tries: one for the words of each length read forwards, one for them read
backwards. The forward tries begin with the first half of a word, the backward tries with the
second, because a pair one edit apart has one of these halves in common; a state starts below
the half that its word shares with the trie and never meets words of another half. Chains of
nodes with one child are one edge, so there are as many levels as forks on a path, however long
the words are.

The edge table (node, label, child, leaf) is distributed by node. A state (text, pos, node,
edits) is joined with the edges of its node: it moves on without an edit where the label is
what the text has next, and with its one edit where the label differs from it by one replaced
or left out character. States that reach a leaf with one edit are neighbours.

A node is the hash of what is read down to it. Two nodes with one hash only add states, and
every pair is compared in full at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneprep.llm.stage import is_empty, written
from tuneprep.llm.words import _POWERS, mix

#: A word as it is read from one side: the depth at which its tries begin (``first``), its nodes
#: from there to its end, and its node in the trie of the words one shorter, which begins at
#: ``below_first``.
_READ = "text string, side int, first int, nodes array<long>, below_first int, below long"


def _first(length: np.ndarray, side: int) -> np.ndarray:
    """Where tries of words of this length begin."""
    return length // 2 if side == 0 else length - length // 2


def _sums(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the texts in their joined code points, and the running hash sums."""
    length = np.array([len(t) for t in texts], dtype=np.int64)
    start = np.concatenate([[0], np.cumsum(length)[:-1]])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    up, _ = _POWERS.upto(len(codes) + 1)
    return start, length, np.concatenate([[np.uint64(0)], np.cumsum(mix(codes, 3) * up[: len(codes)], dtype=np.uint64)])


def _nodes(start: np.ndarray, depth: np.ndarray, length: np.ndarray, side: int, sums: np.ndarray) -> np.ndarray:
    """Hash of the first ``depth`` characters in the trie of words of ``length``."""
    _, down = _POWERS.upto(len(sums))
    read = (sums[start + depth] - sums[start]) * down[start]
    return mix(read + mix(depth.astype(np.uint64), 5) + mix(length.astype(np.uint64) * np.uint64(2) + np.uint64(side), 7)).view(np.int64)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column("word").to_pylist()
        if not words:
            continue
        for side in (0, 1):
            texts = words if side == 0 else [w[::-1] for w in words]
            start, length, sums = _sums(texts)
            first, below_first = _first(length, side), _first(length - 1, side)
            each = length - first + 1
            ends = np.concatenate([[0], np.cumsum(each)])
            own = np.repeat(np.arange(len(words)), each)
            depth = np.arange(ends[-1]) - ends[own] + first[own]
            nodes = _nodes(start[own], depth, length[own], side, sums)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(texts, pa.string()),
                    pa.array(np.full(len(words), side, dtype=np.int32)),
                    pa.array(first.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(nodes)),
                    pa.array(below_first.astype(np.int32)),
                    pa.array(_nodes(start, below_first, length - 1, side, sums)),
                ],
                names=["text", "side", "first", "nodes", "below_first", "below"],
            )


def trie_edges(read: DataFrame) -> DataFrame:
    """Rows (``node``, ``label``, ``child``, ``leaf``): the edges of the tries of ``read``.

    ``leaf`` is the text that ends at the child, null above the leaves.
    """
    steps = read.select("text", "side", F.posexplode("nodes").alias("k", "node"), "nodes")
    steps = steps.where(F.col("k") + 1 < F.size("nodes")).withColumn("child", F.element_at("nodes", F.col("k") + 2)).drop("nodes")
    forks = steps.groupBy("node").agg(F.min("child").alias("a"), F.max("child").alias("b")).where("a <> b").select("node")
    marks = steps.where("k > 0").join(forks, "node", "left_semi").groupBy("text", "side").agg(F.collect_list("k").alias("marks"))
    cut = read.join(marks, ["text", "side"], "left").withColumn("last", F.size("nodes") - 1)
    none = F.array().cast("array<int>")
    cut = cut.withColumn("cuts", F.array_sort(F.concat(F.array(F.lit(0)), F.coalesce("marks", none), F.array("last"))))
    pairs = F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), lambda i: F.struct(F.element_at("cuts", i).alias("a"), F.element_at("cuts", i + 1).alias("b")))
    edges = cut.where("last > 0").select("text", "first", "nodes", "last", F.explode(pairs).alias("e"))
    return edges.select(
        F.element_at("nodes", F.col("e.a") + 1).alias("node"),
        F.substring("text", F.col("first") + F.col("e.a") + 1, F.col("e.b") - F.col("e.a")).alias("label"),
        F.element_at("nodes", F.col("e.b") + 1).alias("child"),
        F.when(F.col("e.b") == F.col("last"), F.col("text")).alias("leaf"),
    ).distinct()


def _moved(states: DataFrame, edges: DataFrame) -> DataFrame:
    """The states one edge further down, those at a leaf included."""
    size = F.length("label")
    ahead = F.substring("text", F.col("pos") + 1, size)
    longer = F.substring("text", F.col("pos") + 1, size + 1)
    replaced = ~F.col("shorter") & (F.levenshtein(ahead, F.col("label"), 1) == 1)
    left_out = F.col("shorter") & (F.length(longer) > size) & (F.levenshtein(longer, F.col("label"), 1) == 1)
    move = (
        F.when(ahead == F.col("label"), F.struct(size.alias("by"), F.col("edits").alias("edits")))
        .when((F.col("edits") == 0) & replaced, F.struct(size.alias("by"), F.lit(1).alias("edits")))
        .when((F.col("edits") == 0) & left_out, F.struct((size + 1).alias("by"), F.lit(1).alias("edits")))
    )
    moved = states.join(edges, "node").withColumn("move", move).where("move IS NOT NULL")
    return moved.select(
        "text", "side", "shorter", (F.col("pos") + F.col("move.by")).alias("pos"), F.col("child").alias("node"), F.col("move.edits").alias("edits"), "leaf"
    )


def one_edit_pairs(words: DataFrame) -> DataFrame:
    """Rows (``word``, ``near``): all pairs of words that differ by exactly one inserted, deleted
    or replaced code point, each in both orders.

    ``words`` has distinct, not null strings of at least three code points in ``word``. Other
    columns are not read. An empty table gives no rows.
    """
    read = written(words.select("word").mapInArrow(_read, _READ), "read")
    edges = written(trie_edges(read), "trie-edges")
    own = read.select("text", "side", F.lit(False).alias("shorter"), F.col("first").alias("pos"), F.element_at("nodes", 1).alias("node"))
    below = read.select("text", "side", F.lit(True).alias("shorter"), F.col("below_first").alias("pos"), F.col("below").alias("node"))
    states = own.union(below).withColumn("edits", F.lit(0))
    found = []
    while found == [] or not is_empty(states):
        level = written(_moved(states, edges), "frontier")
        # A text one longer than the leaf, and no edit so far: its last character is left out.
        found.append(level.where("leaf IS NOT NULL AND (edits = 1 OR shorter)"))
        states = level.where("leaf IS NULL").drop("leaf")
    ends = reduce(DataFrame.unionAll, found)
    way = [F.when(F.col("side") == 1, F.reverse(c)).otherwise(F.col(c)) for c in ("text", "leaf")]
    pairs = ends.select(way[0].alias("word"), way[1].alias("near"), "shorter").where(F.levenshtein("word", "near", 1) == 1)
    return pairs.select("word", "near").union(pairs.where("shorter").select(F.col("near").alias("word"), F.col("word").alias("near"))).distinct()
