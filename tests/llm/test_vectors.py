"""Threshold pairs of vectors against all pairs."""

import numpy as np
import pytest

from tuneprep.llm import covertree
from tuneprep.llm import vectors as V
from tuneprep.llm.covertree import CoverTree, Grove, forest, grove_links, linked, unit

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine):
    ids = [r[0] for r in rows]
    good = [k for k, r in enumerate(rows) if r[0] is not None and r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    parent, links = {k: k for k in ids if k is not None}, [0] * len(rows)

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    units = {k: np.array(rows[k][1], dtype=np.float32).astype(np.float64) for k in good}
    for n, i in enumerate(good):
        for j in good[:n]:
            v, w = units[i], units[j]
            if rows[i][2] == rows[j][2] and len(v) == len(w) and v @ w / (np.sqrt(v @ v) * np.sqrt(w @ w)) >= cosine:
                links[i] += 1
                links[j] += 1
                x, y = sorted((top(ids[i]), top(ids[j])))
                parent[y] = x
    return sorted((r[0], links[k], None if r[0] is None else top(r[0])) for k, r in enumerate(rows) if r[0] is not None)


def clustered(seed, n, dim=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    rows = []
    for k in range(n):
        c = centres[rng.integers(6)] + rng.normal(size=dim) * rng.choice([0.0, 0.05, 0.1, 0.2, 1.0])
        rows.append((1000 + 7 * k % (7 * n), [float(x) for x in (c * rng.choice([1.0, 2.0])).astype(np.float32)], int(rng.choice([1, 1, 1, 2]))))
    return rows


def result(df, cosine=0.98):
    return sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in V.near_vectors(df, cosine).collect() if r["vec_id"] is not None)


@pytest.mark.parametrize("chunk,per_pivot", [(1024, 1024), (40, 30)])
def test_links_are_those_of_all_pairs(spark, monkeypatch, chunk, per_pivot):
    monkeypatch.setattr(V, "CHUNK", chunk)
    monkeypatch.setattr(V, "PER_PIVOT", per_pivot)
    rows = clustered(chunk, 300)
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows, 0.98)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (4, [1.0, 0.0], None), (5, None, 1),
        (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, [], 1), (11, [1.0], 1),
        (12, [1.0, 0.0], 2), (13, [-1.0, 0.0], 1), (14, [1e-30, 0.0], 1), (15, [3e38, 1e37], 1),
    ]
    df = spark.createDataFrame([*rows, (None, [1.0, 0.0], 1)], SCHEMA).selectExpr("*", "5 AS rep", "'x' AS emb", "1 AS cell")
    assert result(df) == brute(rows, 0.98)
    lone = [r for r in V.near_vectors(df).collect() if r["vec_id"] is None]
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in lone] == [(0, None, True)]


def test_empty_table(spark):
    assert V.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_tree_covers_and_halves():
    rng = np.random.default_rng(3)
    tree = CoverTree(np.concatenate([rng.normal(size=(200, 8)), np.ones((50, 8)) + rng.normal(size=(50, 8)) * 0.01, np.ones((4, 8))]))
    assert sorted(tree.points) == list(range(254))
    for node in range(len(tree.centre)):
        own = tree.points[tree.start[node] : tree.stop[node]]
        apart = np.linalg.norm(tree.units[own] - tree.units[tree.centre[node]], axis=1)
        assert apart.max() <= tree.radius[node] + 1e-7 and tree.centre[node] in own
        kids = range(tree.first[node], tree.last[node])
        if kids:
            assert tree.centre[kids[0]] == tree.centre[node]
            assert all(tree.radius[k] <= tree.radius[node] / 2 + 1e-7 for k in kids)
            assert sum(tree.stop[k] - tree.start[k] for k in kids) == len(own)


def test_traversal_counts_links_of_dense_groups_in_whole():
    rng = np.random.default_rng(4)
    dense = np.ones((400, 8)) + rng.normal(size=(400, 8)) * 0.01
    tree, mult = CoverTree(dense), rng.integers(1, 4, 400)
    deg, _, x, y = linked(tree, tree, mult, mult, 0.98)
    assert (deg == mult.sum() - mult).all() and len(x) == 399 and len(forest(x, y, 400)[0]) == 399


def test_no_tree_is_sent_once_for_each_pair_of_blocks(spark, monkeypatch):
    """A tree that moves to each of its partners made the disk needed quadratic in the rows of a label."""
    monkeypatch.setattr(V, "CHUNK", 40)
    monkeypatch.setattr(V, "PER_PIVOT", 10)
    dealt, frame = [], type(spark.range(1))
    monkeypatch.setattr(frame, "repartition", lambda self, *a, f=frame.repartition: dealt.append(dict(self.dtypes)) or f(self, *a))
    rows = [(i, e, 1) for i, e, _ in clustered(5, 400)]
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows, 0.98)
    assert dealt and not any(kind == "binary" or kind.startswith("array") for types in dealt for kind in types.values())


def test_odd_rows_among_pivots(spark, monkeypatch):
    monkeypatch.setattr(V, "CHUNK", 4)
    monkeypatch.setattr(V, "PER_PIVOT", 2)
    rng, nan = np.random.default_rng(8), float("nan")
    good = [(i, [float(x) for x in rng.choice([-1.0, 0.0, 0.01, 1.0, 1.02], 2) + 0.001], 1) for i in range(60)]
    odd = [[1.0, None], [nan, 1.0], [0.0, -0.0], [], None, [1.0, 0.0, 0.0]]
    rows = good + [(100 + i, odd[i % 6], 1) for i in range(36)] + [(200 + i, [1.0, 0.0], None) for i in range(9)]
    rows += [(300, [1.0, -0.0], 1), (301, [1.0, 0.0], 1), (301, [1.0, 0.0], 1)]
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows, 0.98)


def test_rows_that_share_an_id_are_rows_of_their_own(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.01], 1), (3, [0.0, 1.0], 2), (4, [1.0, 0.02], 1)]
    assert result(spark.createDataFrame(rows, SCHEMA)) == [(1, 0, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 2, 1)]


def test_embeddings_of_doubles_keep_their_precision(spark):
    near = [1.0, 1e-9]
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, near, 1), (3, near, 1)], "vec_id long, embedding array<double>, label int")
    assert result(df, 1 - 1e-15) == [(1, 2, 1), (2, 2, 1), (3, 2, 1)]
    assert result(df.selectExpr("vec_id", "array(embedding[0], 1e5 * embedding[1]) AS embedding", "label"), 1 - 1e-15) == [(1, 0, 1), (2, 1, 2), (3, 1, 2)]


def grove(vectors, parts):
    trees = [CoverTree(vectors[own]) for own in np.array_split(np.arange(len(vectors)), parts)]
    starts = np.cumsum([0, *(len(t.points) for t in trees)])
    return Grove(trees, 0.98), np.concatenate([t.points + s for t, s in zip(trees, starts, strict=False)])


@pytest.mark.parametrize("dim,spread,flat,listed", [(2, 0.01, 4, 0), (8, 0.05, 1 << 14, 1 << 12), (64, 0.02, 64, 10), (64, 0.002, 4, 0)])
def test_groves_have_the_links_of_all_pairs(monkeypatch, dim, spread, flat, listed):
    for name, value in (("FLAT", flat), ("LISTED", listed), ("ROWS", 16), ("TILE", 1000), ("EDGES", 1)):
        monkeypatch.setattr(covertree, name, value)
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(15, dim))
    points = [(centres[rng.integers(15, size=n)] + rng.normal(size=(n, dim)) * spread * rng.choice([0.1, 1, 4], size=(n, 1))).astype(np.float32) for n in (500, 300)]
    (a, order_a), (b, order_b) = grove(points[0], 4), grove(points[1], 3)
    units = [unit(p.astype(np.float64))[o] for p, o in zip(points, (order_a, order_b), strict=True)]
    mult = [rng.integers(1, 4, len(p)) for p in points]
    for left, right, u, v, m, n in ((a, b, units[0], units[1], mult[0], mult[1]), (a, a, units[0], units[0], mult[0], mult[0])):
        near = u @ v.T >= 0.98
        if left is right:
            np.fill_diagonal(near, False)
        deg_a, deg_b, x, y = grove_links(left, right, m, n, 0.98)
        assert (deg_a == near @ n).all() and (left is right or (deg_b == near.T @ m).all())
        shift = 0 if left is right else len(u)
        r, c = np.nonzero(near)
        label, expected = np.arange(shift + len(v)), np.arange(shift + len(v))
        ends, roots = forest(x, y, len(label))
        label[ends] = roots
        ends, roots = forest(r, c + shift, len(label))
        expected[ends] = roots
        assert near.any() and (label == expected).all()


def test_the_nearest_pivot_does_not_depend_on_other_rows():
    rng = np.random.default_rng(6)
    pivots = unit(rng.integers(-1, 2, (40, 8)) + 0.0001).astype(np.float32)
    units = unit(rng.integers(-1, 2, (500, 8)) + 0.0001)
    one_by_one = np.concatenate([V.nearest(units[k : k + 1], pivots) for k in range(500)])
    assert (V.nearest(units, pivots) == one_by_one).all()
    assert np.allclose((units * pivots[one_by_one]).sum(axis=1), (units @ pivots.T).max(axis=1), atol=1e-6)
