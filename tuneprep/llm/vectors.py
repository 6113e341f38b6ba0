"""Near-duplicate vectors: exact threshold pairs by dual traversal of cover trees.

Equal vectors of a label are one class. Vectors go to the nearest of the pivots of their label,
which are drawn by content; neighbouring pivots make a block of about ``CHUNK`` vectors. One
task makes a block's classes, a cover tree for each pivot's, and finds the links within the
block. A label of several blocks has them as files in the scratch folder, and each pair of its
blocks is traversed by a task that reads the two files, so a vector moves once, however many
partners its block has. Node pairs too far apart are dropped, node pairs wholly within the limit
are counted without being listed, and the rest is descended into. Pivots only make the bounds
tight: any choice of them gives the same links.

Of the links a task keeps a count for each class and a spanning forest, so a group of near
copies never becomes all its pairs.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuneprep.llm.components import components
from tuneprep.llm.covertree import CoverTree, Grove, forest, grove_links, rounding, unit, within_reach
from tuneprep.llm.stage import spread, written
from tuneprep.session import scratch_dir
from tuneprep.sources.files import filesystem

#: Vectors of one block, on average, and their bytes in single precision.
CHUNK = 1 << 16
CHUNK_BYTES = 64 << 20
#: One pivot for so many vectors at least, on average.
PER_PIVOT = 160
#: Bytes of all pivots, on average; they are sent to the tasks.
PIVOTS = 32 << 20
#: Classes of one cover tree at most.
TREE = 1024
#: Pairs of blocks with the same first one that follow one another in a task.
FOLLOW = 4

_CELL = "label int, dim int, k1 long, k2 long, block int, cell int, rep long, mult long, vec binary"
#: Kind 0: class a (label, dim, k1, k2, rep, mult) has b links. Kind 1: an edge between classes a and b.
#: Kind 2: block a is in the file path. Kind 3: a class as of kind 0 whose component's least row is a.
_FOUND = "kind int, a long, b long, label int, dim int, k1 long, k2 long, rep long, mult long, path string"
_FIELDS = pa.schema(
    [("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("label", pa.int32()), ("dim", pa.int32())]
    + [(x, pa.int64()) for x in ("k1", "k2", "rep", "mult")]
    + [("path", pa.string())]
)


def _vectors(column: pa.ListArray, rows: np.ndarray, dim: int) -> np.ndarray:
    """Some rows of a column, all of one length, with one zero instead of two."""
    starts, values = column.offsets.to_numpy()[rows], column.values.to_numpy(zero_copy_only=False)
    out, step = np.empty((len(rows), dim), dtype=values.dtype), max(1, (1 << 20) // dim)
    for k in range(0, len(rows), step):
        out[k : k + step] = values[starts[k : k + step, None] + np.arange(dim)]
    out += 0.0
    return out


def _binary(vectors: np.ndarray) -> pa.Array:
    width = vectors.shape[1] * vectors.itemsize
    ends = np.arange(len(vectors) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(vectors), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(vectors))])


def nearest(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The nearest pivot of each unit vector; equal vectors have the same one, whatever is beside them."""
    out, single = np.empty(len(units), dtype=np.int64), units.astype(np.float32)
    error = 2 * rounding(units.shape[1])
    step = max(1, (1 << 19) // len(pivots))
    room = np.empty(step * len(pivots), dtype=np.float32)
    for k in range(0, len(units), step):
        own = single[k : k + step]
        cos = np.matmul(own, pivots.T, out=room[: len(own) * len(pivots)].reshape(len(own), -1))
        row, pivot = np.divmod(np.flatnonzero(cos >= (cos.max(axis=1) - error)[:, None]), len(pivots))
        if len(row) > len(cos):
            # Sums along a row do not depend on other rows, as products of matrices may.
            value = (units[k + row] * pivots[pivot]).sum(axis=1)
            sort = np.lexsort([pivot, -value, row])
            sort = sort[np.unique(row[sort], return_index=True)[1]]
            row, pivot = row[sort], pivot[sort]
        out[k + row] = pivot
    return out


def _celler(pivots: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]) -> Callable:
    """The classes of a batch, with the nearest pivot of their label and dimension, and its block.

    Labels without pivots have one cell, and those of one block have block -1.
    """

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(x).to_numpy() for x in ("label", "dim", "k1", "k2")]
            ids = batch.column("vec_id").to_numpy()
            sort = np.lexsort(keys)
            new = np.ones(len(sort), dtype=bool)
            new[1:] = np.any([k[sort[1:]] != k[sort[:-1]] for k in keys], axis=0)
            at = np.flatnonzero(new)
            if not len(at):
                continue
            first, rep = sort[at], np.minimum.reduceat(ids[sort], at)
            mult = np.diff(np.append(at, len(sort)))
            labels, dims = keys[0][first], keys[1][first]
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                vectors = _vectors(batch.column("emb"), first[own], dim)
                block, cell = np.full(len(own), -1, dtype=np.int32), np.zeros(len(own), dtype=np.int32)
                for label in np.unique(labels[own]).tolist():
                    if (label, dim) in pivots:
                        table, of = pivots[label, dim]
                        rows = np.flatnonzero(labels[own] == label)
                        cell[rows] = nearest(unit(vectors[rows].astype(np.float64)), table)
                        block[rows] = of[cell[rows]]
                columns = [*(pa.array(k[first[own]]) for k in keys), block, cell, rep[own], mult[own], _binary(vectors)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[x.split()[0] for x in _CELL.split(", ")])

    return cells


def _packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrays as bytes."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            own = np.flatnonzero(dims == dim)
            vec = _binary(_vectors(batch.column("emb"), own, dim))
            yield pa.RecordBatch.from_arrays([batch.column("label").take(pa.array(own)), pa.array(dims[own]), vec], names=["label", "dim", "vec"])


def _dealt(pivots: np.ndarray, size: int) -> np.ndarray:
    """Pivots dealt to blocks of neighbours of at most ``size``, by cuts across the widest coordinate."""
    block, stack, n = np.zeros(len(pivots), dtype=np.int32), [np.arange(len(pivots))], 0
    while stack:
        own = stack.pop()
        if len(own) <= size:
            block[own] = n
            n += 1
            continue
        axis = int(np.argmax(pivots[own].var(axis=0)))
        sort = own[np.argsort(pivots[own, axis], kind="stable")]
        parts = -(-len(own) // size)
        cut = len(own) * (parts // 2) // parts
        stack += [sort[:cut], sort[cut:]]
    return block


def _rows(kind: int, a, b=None, label=None, dim=None, classes: dict | None = None, which=None, path: str | None = None) -> pa.RecordBatch:
    """Rows of ``_FOUND``."""
    n = len(a)
    columns = [pa.array(np.full(n, kind, dtype=np.int32)), pa.array(a, pa.int64()), pa.nulls(n, pa.int64()) if b is None else pa.array(b, pa.int64())]
    columns += [pa.nulls(n, pa.int32()) if x is None else pa.array(np.full(n, x, dtype=np.int32)) for x in (label, dim)]
    columns += [pa.nulls(n, pa.int64()) if classes is None else pa.array(classes[x][which]) for x in ("k1", "k2", "rep", "mult")]
    columns.append(pa.array([path] * n, pa.string()))
    return pa.RecordBatch.from_arrays(columns, schema=_FIELDS)


def _grow(cosine: float, folder: str, kind: str) -> Callable:
    """The classes of a block, its trees and the links within it."""

    def grow(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        label, dim, block = (table.column(x)[0].as_py() for x in ("label", "dim", "block"))
        cell, k1, k2, rep, mult = (table.column(x).to_numpy() for x in ("cell", "k1", "k2", "rep", "mult"))
        vectors = np.frombuffer(b"".join(table.column("vec").to_pylist()), dtype=kind).reshape(-1, dim)
        sort = np.lexsort([k2, k1, cell])
        new = np.ones(len(sort), dtype=bool)
        new[1:] = np.any([x[sort[1:]] != x[sort[:-1]] for x in (cell, k1, k2)], axis=0)
        again = np.flatnonzero(~new)
        if (vectors[sort[again]] != vectors[sort[again - 1]]).any():
            raise ValueError("two different vectors have the same hashes of 128 bits")
        at = np.flatnonzero(new)
        classes = {"k1": k1[sort[at]], "k2": k2[sort[at]], "rep": np.minimum.reduceat(rep[sort], at), "mult": np.add.reduceat(mult[sort], at)}
        cell, vectors = cell[sort[at]], vectors[sort[at]]
        trees, order = [], []
        for own in np.split(np.arange(len(cell)), np.flatnonzero(np.diff(cell)) + 1):
            parts = -(-len(own) // TREE)
            if parts > 1:
                units = unit(vectors[own].astype(np.float64))
                own = own[np.argsort(-(units @ units.mean(axis=0)), kind="stable")]
            for part in np.array_split(own, parts):
                trees.append(CoverTree(vectors[part]))
                order.append(part[trees[-1].points])
        order = np.concatenate(order)
        classes = {k: v[order] for k, v in classes.items()}
        grove = Grove(trees, cosine)
        del trees, table
        links, _, x, y = grove_links(grove, grove, classes["mult"], classes["mult"], cosine)
        some = np.flatnonzero((links > 0) | (classes["mult"] > 1))
        if block < 0:
            component, least = np.arange(len(links)), classes["rep"].copy()
            component[x] = y
            np.minimum.at(least, component, classes["rep"])
            found = [_rows(3, least[component[some]], links[some], label, dim, classes, some)]
        else:
            first = block << 32
            outline = pickle.dumps(grove.outline(), protocol=5)
            path = f"{folder}/{block}-{uuid.uuid4().hex}"
            fs, inner = filesystem(path)
            fs.create_dir(inner.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(inner) as out:
                out.write(len(outline).to_bytes(8, "little"))
                out.write(outline)
                out.write(pickle.dumps((grove, classes), protocol=5))
            found = [
                _rows(0, first + some, links[some], label, dim, classes, some),
                _rows(1, first + x, first + y),
                _rows(2, [block], None, label, dim, path=path),
            ]
        return pa.Table.from_batches(found, _FIELDS)

    return grow


class _Block:
    """A block's file; the trees are read when they are needed."""

    def __init__(self, path: str) -> None:
        self.path, self.loaded = path, None
        fs, inner = filesystem(path)
        with fs.open_input_file(inner) as f:
            self.size = int.from_bytes(f.read(8), "little")
            self.outline = pickle.loads(f.read(self.size))

    def load(self) -> tuple[Grove, dict]:
        if self.loaded is None:
            fs, inner = filesystem(self.path)
            with fs.open_input_file(inner) as f:
                f.seek(8 + self.size)
                grove, classes = pickle.loads(f.read())
            self.loaded = grove.ready(), classes
        return self.loaded


def _traverse(cosine: float) -> Callable:
    """Links between the blocks of each pair."""

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = None
        for batch in batches:
            for row in batch.to_pylist():
                if a is None or a.path != row["path_a"]:
                    a = _Block(row["path_a"])
                b = _Block(row["path_b"])
                if not within_reach(a.outline, b.outline, cosine).any():
                    continue
                (left, of_a), (right, of_b) = a.load(), b.load()
                deg_a, deg_b, x, y = grove_links(left, right, of_a["mult"], of_b["mult"], cosine)
                for deg, classes, block in ((deg_a, of_a, row["block_a"]), (deg_b, of_b, row["block_b"])):
                    some = np.flatnonzero(deg)
                    yield _rows(0, (block << 32) + some, deg[some], row["label"], row["dim"], classes, some)
                number = np.concatenate([(row["block_a"] << 32) + np.arange(len(deg_a)), (row["block_b"] << 32) + np.arange(len(deg_b))])
                yield _rows(1, number[x], number[y])

    return traverse


def _pivots(rows: DataFrame, fine: Column, kind: str) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """Pivots of each label and dimension of many rows, and the block of each pivot or -1 if there is one block only.

    Pivots are drawn by content, so copies count once; there are more of them for a vector in
    a larger label, five for each square root of its rows at most.
    """
    spark = rows.sparkSession
    counts = rows.where("label IS NOT NULL AND dim > 0").groupBy("label", "dim").count().where(F.col("count") >= 2 * PER_PIVOT).collect()
    one_in = {(r["label"], r["dim"]): max(PER_PIVOT, math.isqrt(r["count"]) // 5) for r in counts}
    weight = sum(r["count"] / one_in[r["label"], r["dim"]] * 4 * r["dim"] for r in counts) / PIVOTS
    one_in = {key: math.ceil(n * max(1.0, weight)) for key, n in one_in.items()}
    if not one_in:
        return {}
    rates = spark.createDataFrame([(*key, n) for key, n in one_in.items()], "label int, dim int, one_in long")
    # Few rows; left to itself, Spark moves the vectors instead, as it does not know their number.
    drawn = rows.join(F.broadcast(rates), ["label", "dim"]).where(F.pmod("k1", "one_in") == 0).where(fine)
    # Of several equal vectors one is drawn.
    drawn = drawn.groupBy("label", "dim", "k1", "k2").agg(F.first("emb").alias("emb")).select("label", "dim", "emb")
    found: dict[tuple[int, int], list[bytes]] = {}
    for row in drawn.mapInArrow(_packer, "label int, dim int, vec binary").collect():
        found.setdefault((row["label"], row["dim"]), []).append(bytes(row["vec"]))
    out, blocks = {}, 0
    for key in sorted(found):
        table = unit(np.frombuffer(b"".join(sorted(found[key])), dtype=kind).reshape(-1, key[1]).astype(np.float64)).astype(np.float32)
        block = _dealt(table, max(1, min(CHUNK, CHUNK_BYTES // (4 * key[1])) // one_in[key]))
        many = int(block.max()) + 1
        out[key] = table, block + blocks if many > 1 else np.full(len(table), -1, dtype=np.int32)
        blocks += many if many > 1 else 0
    return out


def near_vectors(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """Rows (``vec_id``, ``n_links``, ``component_id``, ``kept``), one for each row of ``vectors``.

    Two rows are linked if their labels are equal and the cosine of their embeddings is at least
    ``cosine``. ``n_links`` counts the other rows linked directly, ``component_id`` is the least
    ``vec_id`` that links reach.

    * Rows whose label, ``vec_id`` or embedding is null, whose embedding is empty or zero or
      has a null, infinite or NaN component, are linked with nothing and are kept.
    * Embeddings of different length are never linked.
    * A repeated row is another row: it is linked with its copies. Rows that share an id and
      have different embeddings or labels are rows of their own, too.
    * Other columns are not read. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"
    emb = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), emb.alias("emb"))
    low, high = F.array_min("emb"), F.array_max("emb")
    # NaN is the largest value; least and largest pass over nulls.
    fine = (high < float("inf")) & (low > -float("inf")) & ((low != 0) | (high != 0)) & F.forall("emb", lambda x: x.isNotNull())
    fine = F.coalesce(fine & F.col("vec_id").isNotNull() & F.col("label").isNotNull(), F.lit(False))
    # Two hashes of 64 bits stand for an embedding; that they tell all apart is checked where classes are made.
    keys = {"dim": F.size("emb"), "k1": F.xxhash64(F.lit(1), "emb"), "k2": F.xxhash64(F.lit(2), "emb")}
    pivots = _pivots(rows.withColumns(keys), fine, kind)
    celled = rows.where(fine).withColumns(keys).select("vec_id", "label", "dim", "k1", "k2", "emb").mapInArrow(_celler(pivots), _CELL)
    found = written(celled.groupBy("label", "dim", "block").applyInArrow(_grow(cosine, scratch_dir(spark, "blocks"), kind), _FOUND), "found")
    known = found.where("kind = 3").select("label", "dim", "k1", "k2", (F.col("mult") - 1 + F.col("b")).alias("n_links"), F.col("a").alias("component_id"))
    if any((block >= 0).any() for _, block in pivots.values()):
        files = found.where("kind = 2")
        ends = [files.select("label", "dim", F.col("a").alias(f"block_{x}"), F.col("path").alias(f"path_{x}")) for x in "ab"]
        pairs = ends[0].join(ends[1], ["label", "dim"]).where("block_a < block_b")
        order = F.row_number().over(Window.partitionBy("block_a").orderBy("block_b"))
        pairs = pairs.withColumn("run", F.floor(order / FOLLOW)).repartition(spread(spark), "block_a", "run").sortWithinPartitions("block_a", "run")
        across = written(pairs.mapInArrow(_traverse(cosine), _FOUND), "across")
        both = found.where("kind < 2").union(across)
        classes = both.where("kind = 0").groupBy(F.col("a").alias("node"), "label", "dim", "k1", "k2", "rep", "mult").agg(F.sum("b").alias("links"))
        groups = components(both.where("kind = 1"), "a", "b")
        classes = written(classes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")), "grouped")
        least = classes.groupBy("component").agg(F.min("rep").alias("component_id"))
        classes = classes.join(least, "component").select("label", "dim", "k1", "k2", (F.col("mult") - 1 + F.col("links")).alias("n_links"), "component_id")
        known = known.union(classes)
    # Rows that are not fine match nothing; what stands for their keys deals them out.
    keys = {x: F.when(fine, key).otherwise(F.lit(-1) if x == "dim" else F.xxhash64("vec_id", "label", "emb")) for x, key in keys.items()}
    every = rows.select("vec_id", F.coalesce("label", F.lit(0)).alias("label"), *[key.alias(x) for x, key in keys.items()])
    out = every.join(known, ["label", "dim", "k1", "k2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
