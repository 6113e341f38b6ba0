"""Neighbours found on the graph against all distances."""

import numpy as np
import pyarrow as pa
import pytest

from tuneprep.llm import nndescent as N
from tuneprep.llm import queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def valid(rows):
    fine = [(i, np.array(e, dtype=np.float32).astype(np.float64)) for i, e, *_ in rows if i is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    return list({(i, e.tobytes()): (i, e) for i, e in fine}.values())


def brute(rows, asked, k=10):
    out = {}
    for q, v in valid(asked):
        near = [(float(np.sqrt(((v - e) ** 2).sum())), i) for i, e in valid(rows) if i != q and len(e) == len(v)]
        out[q] = sorted(near)[:k]
    return {q: near for q, near in out.items() if near}


def found(df, asked, k=10):
    out = {}
    for r in sorted(N.search(N.build_graph(df, k), asked, k).collect(), key=lambda r: (r["query_id"], r["rank"])):
        own = out.setdefault(r["query_id"], [])
        own.append((r["score"], r["vec_id"]))
        assert r["rank"] == len(own)
    return out


def clustered(seed, n, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = []
    for k in range(n):
        v = centres[rng.integers(12)] + rng.normal(size=dim) * rng.choice([0.05, 0.2, 0.6])
        rows.append((k, [float(x) for x in v.astype(np.float32)], k % 3))
    copies = [(n + k, rows[5][1], 1) for k in range(60)]
    return rows + copies


@pytest.mark.parametrize("per_pivot,chunk", [(192, 512), (40, 30)])
def test_recall_and_exact_scores(spark, monkeypatch, per_pivot, chunk):
    monkeypatch.setattr(N, "PER_PIVOT", per_pivot)
    monkeypatch.setattr(N, "CHUNK", chunk)
    rows = clustered(per_pivot, 1500)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got, expected = found(df, df.where("vec_id % 10 = 0")), brute(rows, [r for r in rows if r[0] % 10 == 0])
    assert got.keys() == expected.keys() and all(len(got[q]) == 10 for q in got)
    everything = dict(valid(rows))
    hits = 0
    for q, near in got.items():
        assert near == sorted(near) and len({i for _, i in near}) == 10
        assert all(abs(d - np.sqrt(((everything[q] - everything[i]) ** 2).sum())) < 1e-12 for d, i in near)
        hits += len({i for _, i in near} & {i for _, i in expected[q]})
    assert hits >= 0.95 * 10 * len(expected)
    # Copies are ties: the least ids come first.
    assert [i for _, i in got[1500]] == [5, *range(1501, 1510)]


def test_rounds_make_the_graph_better(spark, monkeypatch):
    # Cells cut into tiny random parts: only the rounds can find most neighbours.
    monkeypatch.setattr(N, "CHUNK", 24)
    monkeypatch.setattr(N, "PER_PIVOT", 2000)
    rows = clustered(9, 800)
    df = spark.createDataFrame(rows, SCHEMA)

    def share():
        links = {r["node"]: set(r["others"]) for r in N.build_graph(df).links.collect()}
        near = brute(rows[:800], rows[:200], 5)
        return np.mean([len({i for _, i in near[q]} & links[q]) / 5 for q in near])

    after = share()
    monkeypatch.setattr(N, "ROUNDS", 0)
    assert after > 0.9 and share() < 0.6


@pytest.mark.parametrize("n", [1, 2, 5, 12, 18])
def test_few_candidates_are_all_found(spark, n):
    rng = np.random.default_rng(n)
    rows = [(k * 3, [float(x) for x in rng.normal(size=4)], 0) for k in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    got, expected = found(df, df), brute(rows, rows)
    assert {q: [i for _, i in near] for q, near in got.items()} == {q: [i for _, i in near] for q, near in expected.items()}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [1.0, 0.0], None), (2, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1),
        (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, [], 1), (11, [1.0], 1), (12, [1.0, -0.0], 2), (13, [-1.0, 0.0], 1), (14, [3e38, 1e37], 1), (None, [1.0, 0.0], 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "5 AS node", "'x' AS emb", "1 AS cell", "2 AS query", "3 AS other")
    assert found(df, df) == brute(rows, rows)
    outside = spark.createDataFrame([(100, [1.5, 0.5], 0), (11, [2.0], 0), (101, [1.0, 2.0, 3.0], 0)], SCHEMA)
    got = found(df, outside)
    assert got.keys() == {100} and len(got[100]) == 6


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, [1.0], 0), (2, [2.0], 0)], SCHEMA)
    assert N.search(N.build_graph(empty), some).collect() == [] == N.search(N.build_graph(some), empty).collect()


def test_local_join_gives_pairs_that_meet_and_improve():
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(6, 3))
    nodes = [40, 10, 60, 20, 50, 30]
    lists = pa.table({"others": pa.array([[10, 20, 30], [40, 50]]), "fresh": pa.array([[True, False, False], [False, True]])})
    table = pa.table({
        "node": pa.array(nodes), "dim": pa.array([3] * 6, pa.int32()), "vec": pa.array([v.tobytes() for v in vectors], pa.binary()),
        "linked": pa.array([[50], [20], [], [10], [60], []], pa.list_(pa.int64())), "far": pa.array([np.inf] * 5 + [0.0]),
    })
    got = {(r["node"], r["other"]): r["d"] for r in N._local_join(lists, table).to_pylist()}
    # 10 and 20, and 40 with 50, are linked already; 20 with 30 met before; 30 has nothing to gain.
    assert got.keys() == {(10, 30), (50, 40)}
    assert got[10, 30] == pytest.approx(np.linalg.norm(vectors[1] - vectors[5]))


def test_query_against_all_distances(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    expected = brute(rows, [r for r in rows if r[0] % 100 == 0])
    got = {}
    for r in queries.op13_nn_descent(spark, sf_dir).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = sum(len(got[q] & {i for _, i in near}) for q, near in expected.items())
    assert got.keys() == expected.keys() and hits >= 0.95 * sum(map(len, expected.values()))
