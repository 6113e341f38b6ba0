"""Connected components of a graph whose edges are a table.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014). A step needs the least neighbour of each node, which is a
``min`` that Spark pre-aggregates, and one join, whose hot side Spark splits; neighbours are
never gathered in one place. The number of edges never grows, and the number of steps grows
with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneprep.llm.stage import written


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("u", "v") % 1000003).alias("s")
    ).first()
    return row["n"], (row["x"], row["s"])


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (``node``, ``component``): every node of an edge and the least node it can reach.

    ``a`` and ``b`` are integer columns; rows where one is null, and loops, say nothing. Nodes
    without an edge are absent: each of them is its own component.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    )
    pairs = written(pairs.distinct(), "edges")
    before = _state(pairs)
    while before[0]:
        # Large star: larger neighbours of u move to the least of u and its neighbours.
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        )
        # Small star: smaller neighbours of u, and u, move to the least of them.
        large = written(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        pairs = written(small, "small-star")
        after = _state(pairs)
        if after == before:
            break
        before = after
    ends = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.union(pairs.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
