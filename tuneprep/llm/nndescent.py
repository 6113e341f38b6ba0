"""Nearest neighbours of vectors: a neighbour graph by NN-descent, searched greedily.

Equal vectors are one node. The graph starts from the nearest within cells around pivots, each
node in the two nearest cells, and within random samples, and gets better in rounds (Dong et al., "Efficient k-nearest neighbor graph
construction for generic similarity measures", 2011): a join brings the vectors of each node's
neighbours together, in both directions of an edge, and neighbours of a common node that are
nearer to each other than what they have so far become neighbours. Nodes of one cell are worked
on in one task, which needs a vector once for all of them. The rounds end when few edges change.

A search is a beam for each query. Every round joins the best nodes of a beam that were not
looked at yet with the graph, and their neighbours with the vectors; all queries move at once,
and the search of one ends when its best nodes have all been looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tuneprep.llm.stage import is_empty, written

#: Neighbours of a node in the graph, and the most edges towards it that a round uses.
DEGREE, BACK = 16, 16
#: Nodes for one pivot, on average, and the most pivots, which are sent to the tasks.
PER_PIVOT, PIVOTS = 192, 2048
#: Nodes of a cell that are worked on together, about.
CHUNK = 512
#: The rounds end when at most this share of all edges is new, or after ROUNDS.
SETTLED, ROUNDS = 0.004, 10
#: Nodes of a beam, those looked at in one round, and pivots at which a search starts.
BEAM, STEP, STARTS = 256, 64, 16
#: Pairs whose distances are worked out at once.
PAIRS = 1 << 14

_NODE = "node long, dim int, vec binary"
_FOUND = "node long, other long, d double"


@dataclass
class Graph:
    """``nodes`` (``node``, ``dim``, ``vec``), ``links`` (``node``, ``other``), both ways, and
    ``members`` (``node``, ``vec_id``, ``nth``) of each node, the least ids only. ``pivots`` are nodes of
    each dimension with their vectors."""

    nodes: DataFrame
    links: DataFrame
    members: DataFrame
    pivots: dict[int, tuple[np.ndarray, np.ndarray]]


def _packer(names: list[str]):
    """The ``emb`` column, arrays of doubles, as bytes; -0.0 becomes 0.0."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("emb")
            values, ends = column.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0, column.offsets.to_numpy()
            vec = [values[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(vec, pa.binary())], names=[*names, "vec"])

    return pack


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(-1, dim)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows."""
    with np.errstate(over="ignore"):
        return np.sqrt(((a - b) ** 2).sum(axis=1))


def _nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` nearest pivots of each vector, nearest first; all, if there are fewer."""
    with np.errstate(over="ignore", invalid="ignore"):
        near = (pivots**2).sum(axis=1)[None, :] - 2 * (vectors @ pivots.T)
    near = np.nan_to_num(near, nan=np.inf)
    k = min(k, len(pivots))
    few = np.argpartition(near, k - 1, axis=1)[:, :k]
    return np.take_along_axis(few, np.argsort(np.take_along_axis(near, few, axis=1), axis=1, kind="stable"), axis=1)


def _cells(pivots: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Three rows for each node: its nearest cells, of which ``home`` marks the first, and cell -1."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                near = _nearest_pivots(_matrix(own.column("vec"), dim), pivots[dim][1], 2) if dim in pivots else np.zeros((own.num_rows, 1), dtype=np.int64)
                near = np.concatenate([near, np.full((own.num_rows, 1), -1)], axis=1)
                for j in range(near.shape[1]):
                    extra = [pa.array(near[:, j].astype(np.int32)), pa.array(np.full(own.num_rows, j == 0))]
                    yield pa.RecordBatch.from_arrays([*own.columns, *extra], names=["node", "dim", "vec", "cell", "home"])

    return cells


def _best(a: np.ndarray, b: np.ndarray, d: np.ndarray, keep: int) -> np.ndarray:
    """Places of the ``keep`` nearest of each ``a``."""
    order = np.lexsort((b, d, a))
    a = a[order]
    start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, dtype=np.int64)
    nth = np.arange(len(a)) - np.repeat(start, np.diff(np.concatenate([start, [len(a)]])))
    return order[nth < keep]


def _found(nodes: np.ndarray, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> pa.Table:
    return pa.table({"node": pa.array(nodes[a]), "other": pa.array(nodes[b]), "d": pa.array(d)})


def _all_pairs(table: pa.Table) -> pa.Table:
    """The nearest within a chunk of about CHUNK nodes."""
    dim = table.column("dim")[0].as_py()
    nodes, vectors = table.column("node").to_numpy(), _matrix(table.column("vec"), dim)
    found = []
    for k in range(len(nodes)):
        d = _apart(vectors, vectors[k])
        d[k] = np.inf
        near = np.argpartition(d, DEGREE)[:DEGREE] if len(d) > DEGREE else np.arange(len(d))
        near = near[near != k]
        found.append((np.full(len(near), k), near, d[near]))
    return _found(nodes, *(np.concatenate(x) for x in zip(*found, strict=True)))


def _local_join(lists: pa.Table, table: pa.Table) -> pa.Table:
    """Pairs that meet at a node of the chunk and are nearer than what one of them has.

    ``lists`` (``others``, ``fresh``) are the neighbours of each node of the chunk, ``table`` all of these
    neighbours with their vectors, what they are linked with and their farthest neighbour.
    """
    if not table.num_rows or not lists.num_rows:
        return _found(np.zeros(0, dtype=np.int64), *[np.zeros(0, dtype=np.int64)] * 2, np.zeros(0))
    dim = table.column("dim")[0].as_py()
    order = np.argsort(table.column("node").to_numpy(), kind="stable")
    nodes = table.column("node").to_numpy()[order]
    vectors, far = _matrix(table.column("vec"), dim)[order], table.column("far").to_numpy()[order]
    size = len(nodes)
    linked = table.column("linked").combine_chunks()
    own = np.argsort(order)[np.repeat(np.arange(size), np.diff(linked.offsets.to_numpy()))]
    others = linked.flatten().to_numpy()
    place = np.minimum(np.searchsorted(nodes, others), size - 1)
    here = nodes[place] == others
    known = np.unique(own[here] * size + place[here])
    codes = []
    for others, fresh in zip(lists.column("others").to_pylist(), lists.column("fresh").to_pylist(), strict=True):
        at = np.searchsorted(nodes, np.array(others, dtype=np.int64))
        new = np.array(fresh, dtype=bool)
        a, b = np.nonzero(new[:, None] | new[None, :])
        codes.append((at[a] * size + at[b])[at[a] != at[b]])
    codes = np.setdiff1d(np.unique(np.concatenate(codes)), known, assume_unique=True)
    a, b = codes // size, codes % size
    d = np.concatenate([np.zeros(0), *(_apart(vectors[a[k : k + PAIRS]], vectors[b[k : k + PAIRS]]) for k in range(0, len(codes), PAIRS))])
    near = d < far[a]
    a, b, d = a[near], b[near], d[near]
    best = _best(a, b, d, DEGREE)
    return _found(nodes, a[best], b[best], d[best])


def _linked(edges: DataFrame) -> DataFrame:
    """``DEGREE`` nearest of each node: rows (``node``, ``list`` of (``d``, ``other``, ``old``))."""
    once = edges.groupBy("node", "other").agg(F.min("d").alias("d"), F.max("old").alias("old"))
    lists = once.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("d", "other", "old"))).alias("list"))
    return lists.withColumn("list", F.slice("list", 1, DEGREE))


def _edges(lists: DataFrame) -> DataFrame:
    return lists.select("node", F.explode("list").alias("e")).select("node", F.col("e.other").alias("other"), F.col("e.d").alias("d"), F.col("e.old").alias("old"))


def _both_ways(edges: DataFrame, back: int) -> DataFrame:
    """The edges, and of those towards a node the ``back`` newest and shortest, turned round."""
    turned = edges.select(F.col("other").alias("node"), F.col("node").alias("other"), "d", "old")
    nth = F.row_number().over(Window.partitionBy("node").orderBy("old", "d", "other"))
    turned = turned.withColumn("nth", nth).where(F.col("nth") <= back).drop("nth")
    return edges.unionByName(turned).groupBy("node", "other").agg(F.min("d").alias("d"), F.min("old").alias("old"))


def _round(homes: DataFrame, lists: DataFrame) -> DataFrame:
    """One round: the graph after neighbours of common nodes have met."""
    edges = _edges(lists)
    around = _both_ways(edges, BACK).join(homes.select("node", "chunk"), "node").groupBy("chunk", "node").agg(
        F.collect_list("other").alias("others"), F.collect_list(~F.col("old")).alias("fresh")
    )
    around = written(around.where(F.exists("fresh", lambda x: x)), "around")
    needed = around.select(F.col("chunk").alias("place"), F.explode("others").alias("node")).distinct()
    state = lists.select("node", F.transform("list", lambda e: e["other"]).alias("linked"), F.when(F.size("list") < DEGREE, float("inf")).otherwise(F.element_at("list", -1)["d"]).alias("far"))
    rows = needed.join(homes.select("node", "dim", "vec").join(state, "node"), "node")
    met = around.groupBy("chunk").cogroup(rows.groupBy("place")).applyInArrow(_local_join, _FOUND)
    both = edges.withColumn("old", F.lit(True)).unionByName(met.withColumn("old", F.lit(False)))
    return written(_linked(both), "graph")


def _valid(vectors: DataFrame) -> DataFrame:
    """Rows (``vec_id``, ``dim``, ``vec``) of the vectors that take part."""
    emb = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), emb.alias("emb")).where("vec_id IS NOT NULL")
    fine = F.forall("emb", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("emb", lambda x: x != 0)
    rows = rows.where(F.coalesce(fine, F.lit(False))).withColumn("dim", F.size("emb"))
    return rows.mapInArrow(_packer(["vec_id", "dim"]), "vec_id long, dim int, vec binary")


def build_graph(vectors: DataFrame, k: int = 10) -> Graph:
    """The neighbour graph of all distinct vectors of ``vectors`` (``vec_id``, ``embedding``).

    Searches for up to ``k`` neighbours can be made on it. Odd rows are as in ``search``.
    """
    spark = vectors.sparkSession
    valid = written(_valid(vectors), "valid")
    nodes = written(valid.groupBy("dim", "vec").agg(F.min("vec_id").alias("node")).select("node", "dim", "vec"), "nodes")
    nth = F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))
    # A query's own id may be among them, so one more than can be asked for.
    same = valid.join(nodes.select("dim", "vec", "node"), ["dim", "vec"]).select("node", "vec_id").distinct()
    members = written(same.withColumn("nth", nth).where(F.col("nth") <= k + 1), "members")
    count = nodes.count()
    one_in = max(1, count // PIVOTS, PER_PIVOT)
    # About count / one_in nodes, by their content, and the first of each dimension.
    picked = nodes.where(F.pmod(F.xxhash64("vec"), F.lit(one_in)) == 0).unionAll(
        nodes.groupBy("dim").agg(F.min_by(F.struct("node", "dim", "vec"), "node").alias("first")).select("first.*")
    )
    by_dim: dict[int, dict[int, bytes]] = {}
    for row in picked.collect():
        by_dim.setdefault(row["dim"], {})[row["node"]] = bytes(row["vec"])
    pivots = {
        dim: (np.array(sorted(own)), np.frombuffer(b"".join(own[n] for n in sorted(own)), dtype="<f8").reshape(-1, dim)) for dim, own in by_dim.items()
    }
    sent = spark.sparkContext.broadcast(pivots)
    celled = written(nodes.mapInArrow(lambda batches: _cells(sent.value)(batches), _NODE + ", cell int, home boolean"), "celled")
    sizes = celled.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("parts"))
    # A large cell is cut at random, for each cell anew; the rounds join what that has cut. All
    # nodes are in cell -1, whose parts are random samples: they link what lies in other cells.
    part = F.pmod(F.xxhash64("node", "cell"), F.col("parts"))
    chunked = written(celled.join(sizes, ["dim", "cell"]).withColumn("chunk", F.concat_ws(":", "dim", "cell", part)).drop("parts"), "chunked")
    first = chunked.groupBy("chunk").applyInArrow(_all_pairs, _FOUND)
    lists = written(_linked(first.withColumn("old", F.lit(False))), "graph")
    homes = chunked.where("home")
    for _ in range(ROUNDS):
        new = lists.agg(F.sum(F.size(F.filter("list", lambda e: ~e["old"])))).first()[0] or 0
        if new <= SETTLED * DEGREE * count:
            break
        lists = _round(homes, lists)
    links = written(_both_ways(_edges(lists).withColumn("old", F.lit(True)), DEGREE).groupBy("node").agg(F.collect_list("other").alias("others")), "links")
    return Graph(nodes, links, members, pivots)


def _starts(pivots: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Rows (query, other): the pivots nearest to a query."""

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                if dim in pivots:
                    own = batch.filter(pa.array(dims == dim))
                    near = _nearest_pivots(_matrix(own.column("vec"), dim), pivots[dim][1], STARTS)
                    query = np.repeat(own.column("query").to_numpy(), near.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(pivots[dim][0][near.ravel()])], names=["query", "other"])

    return starts


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distances of rows with two vectors."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            own = batch.filter(pa.array(dims == dim))
            d = _apart(_matrix(own.column("vec"), dim), _matrix(own.column("qvec"), dim))
            yield pa.RecordBatch.from_arrays([own.column("query"), own.column("other"), pa.array(d)], names=["query", "other", "d"])


def search(graph: Graph, queries: DataFrame, k: int = 10) -> DataFrame:
    """Rows (``query_id``, ``rank``, ``vec_id``, ``score``): the ``k`` nearest vectors found for each row of
    ``queries`` (``vec_id``, ``embedding``), other than its own id, nearest first.

    ``score`` is the Euclidean distance in double precision. Equal distances are ranked by ``vec_id``.
    If there are at most ``k`` candidates, all are returned.

    * Vectors that are null, empty or zero or have a null, infinite or NaN component, and rows with
      a null id, take no part, as queries or candidates. Only vectors of equal length are compared.
    * Equal vectors are found together. A repeated row is one candidate and one query; an id with
      two vectors is two candidates, and two queries, each with its own ranks.
    * Labels and other columns are not read. An empty table gives no rows.
    """
    asked = written(_valid(queries).dropDuplicates(["vec_id", "vec"]).withColumn("query", F.monotonically_increasing_id()), "queries")
    starts = asked.select("query", "dim", "vec").mapInArrow(_starts(graph.pivots), "query long, other long")
    own = asked.join(graph.nodes, ["dim", "vec"]).select("query", F.col("node").alias("other"))
    beams = asked.select("query", F.array().cast("array<struct<d:double,other:long,done:boolean>>").alias("beam"), F.array().cast("array<long>").alias("seen"))
    ahead = starts.union(own).distinct()
    vectors = graph.nodes.select(F.col("node").alias("other"), "vec")
    query_vectors = asked.select("query", "dim", F.col("vec").alias("qvec"))
    while True:
        met = ahead.join(vectors, "other").join(query_vectors, "query").select("query", "other", "dim", "vec", "qvec")
        met = met.mapInArrow(_measure, "query long, other long, d double").groupBy("query").agg(
            F.collect_list(F.struct("d", "other", F.lit(False).alias("done"))).alias("met")
        )
        merged = beams.join(met, "query", "left")
        none = F.array().cast("array<struct<d:double,other:long,done:boolean>>")
        fresh = F.coalesce("met", none)
        merged = merged.select(
            "query", F.slice(F.array_sort(F.concat("beam", fresh)), 1, BEAM).alias("beam"), F.concat("seen", F.transform(fresh, lambda e: e["other"])).alias("seen")
        )
        # The best that were not looked at yet are looked at now.
        merged = merged.withColumn("open", F.slice(F.filter("beam", lambda e: ~e["done"]), 1, STEP))
        marked = F.transform("beam", lambda e: F.struct(e["d"].alias("d"), e["other"].alias("other"), (e["done"] | F.array_contains("open", e)).alias("done")))
        beams = written(merged.select("query", marked.alias("beam"), "seen", F.transform("open", lambda e: e["other"]).alias("open")), "beams")
        opened = beams.select("query", F.explode("open").alias("node"))
        if is_empty(opened):
            break
        near = opened.join(graph.links, "node").select("query", F.explode("others").alias("other"))
        near = near.groupBy("query").agg(F.collect_set("other").alias("others")).join(beams.select("query", "seen"), "query")
        ahead = near.select("query", F.explode(F.array_except("others", "seen")).alias("other"))
    found = beams.select("query", F.explode("beam").alias("e")).select("query", F.col("e.other").alias("node"), F.col("e.d").alias("score"))
    found = found.join(graph.members, "node").join(asked.select("query", F.col("vec_id").alias("query_id")), "query").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
