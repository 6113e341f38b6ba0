"""The mix against water-filling by rounds and a walk through the drawn order."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest

from tuneprep.llm.mixing import mix_sources, mixed_documents, water_fill
from tuneprep.llm.words import WORD

SCHEMA = "doc_id long, text string, source string"


def rounds(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Clamp what exceeds its cap and share the excess by weight, until nothing does."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def brute(rows):
    words = [len(re.findall(WORD, t or "")) for _, t, _ in rows]
    sizes, taken = defaultdict(int), {}
    for (_, _, s), n in zip(rows, words, strict=True):
        sizes[s] += n
    target = rounds(sizes)
    places = defaultdict(lambda: defaultdict(int))
    for (d, t, s), n in zip(rows, words, strict=True):
        digest = hashlib.md5(":".join(["17"] + ([str(d)] if d is not None else []) + ([t] if t is not None else [])).encode()).hexdigest()
        places[s][int(digest[:15], 16)] += n
        taken[d] = (s, int(digest[:15], 16), n)
    out = {}
    for d, (s, place, n) in taken.items():
        whole = math.floor(target[s] / sizes[s] + 1e-12) if sizes[s] else 0
        extra = target[s] - whole * sizes[s]
        before = sum(v for p, v in places[s].items() if p < place)
        part = min(1.0, max(0.0, (extra - before) / places[s][place])) if places[s][place] else 0.0
        out[d] = (n, sizes[s], target[s], whole * n + part * n)
    return out


def rows_of(seed, n=300):
    rng = random.Random(seed)
    names = ["a", "b", "Ä", None, "z", "hot", "hot", "hot", "hot", "\U0001f600", "ｚ"]
    return [(k, " ".join("w" for _ in range(rng.choice([0, 1, 5, 40, 700]))), rng.choice(names)) for k in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_taken_words(spark, seed):
    rows = rows_of(seed)
    expected = brute(rows)
    got = {r["doc_id"]: r for r in mix_sources(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got.keys() == expected.keys()
    for d, (n, size, target, taken) in expected.items():
        r = got[d]
        assert (r["size"], r["source_size"]) == (n, size) and r["target"] == pytest.approx(target)
        assert abs(r["taken"] - taken) <= 1 and r["taken"] <= 2 * n
    sums = defaultdict(int)
    for d, r in got.items():
        sums[r["source"]] += r["taken"]
    assert all(abs(sums[r["source"]] - r["target"]) <= 2 for r in got.values())


def test_water_level_equals_rounds(spark):
    rng = random.Random(3)
    for _ in range(4):
        sizes = {f"s{k:02}": rng.choice([0, 1, 10, 1000, 12345]) for k in range(rng.randrange(1, 12))}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in water_fill(df, (5, 2, 1), 1.5, 2.0).collect()}
        assert got == pytest.approx(rounds(sizes) if any(sizes.values()) else dict.fromkeys(sizes, 0.0))


def test_reruns_agree_whatever_the_partitions(spark):
    df = spark.createDataFrame(rows_of(4), SCHEMA)
    a, b = (sorted(map(tuple, mix_sources(x).collect()), key=str) for x in (df, df.repartition(7)))
    assert a == b


def test_mixed_documents_repeat_rows_with_all_columns(spark):
    rows = rows_of(5)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS size", "2 AS copies", "3 AS `cut`", "4 AS place", "'x' AS of", "5 AS `row`")
    copies = {r["doc_id"]: r["copies"] for r in mix_sources(df).collect()}
    out = mixed_documents(df)
    assert out.columns == df.columns
    seen = defaultdict(int)
    for r in out.collect():
        seen[r["doc_id"]] += 1
    assert seen == {d: n for d, n in copies.items() if n} and set(copies.values()) <= {0, 1, 2}


def test_odd_tables(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA)).collect() == []
    assert mixed_documents(spark.createDataFrame([], SCHEMA)).collect() == []
    blank = mix_sources(spark.createDataFrame([(1, None, "a"), (2, " ", None)], SCHEMA)).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in blank] == [(0, 0.0, 0)] * 2
    same = mix_sources(spark.createDataFrame([(1, "a b c", "s")] * 4 + [(None, "d", "s")], SCHEMA)).collect()
    assert len(same) == 5 and sum(r["taken"] for r in same) == pytest.approx(1.5 * 13, abs=4)


def test_no_python_runs(spark):
    for df in (mix_sources(spark.createDataFrame(rows_of(6, 20), SCHEMA)), mixed_documents(spark.createDataFrame(rows_of(6, 20), SCHEMA))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
