"""Shards against a sort of all rows."""

import hashlib
import random
from collections import defaultdict

import pytest

from tuneprep.llm import sharding as S

SCHEMA = "doc_id long, text string"


def brute(rows, shards, tolerance):
    """Shard and slot of each row, by the definition over sorted keys."""

    def half(value, bits):
        return int(hashlib.md5(value.encode()).hexdigest()[:8], 16) >> (32 - bits)

    keyed = sorted((half(t or "", 32) << 31 | half("" if d is None else str(d), 31), d if d is not None else -1, len((t or "").encode()) + 8) for d, t in rows)
    total = sum(k[2] for k in keyed)
    sizes, groups = defaultdict(int), defaultdict(int)
    for key, _, size in keyed:
        sizes[key] += size
        groups[key >> 31] += size
    firsts, at, starts = [], 0, {}
    for key in sorted(sizes):
        starts.setdefault(key >> 31, at)
        for part in range(1, shards):
            if shards * at <= part * total < shards * (at + sizes[key]):
                group, target = key >> 31, part * total / shards
                start, end = starts[group], starts[group] + groups[group]
                if target - start <= tolerance * total / shards and target - start <= end - target:
                    firsts.append(group << 31)
                elif end - target <= tolerance * total / shards:
                    firsts.append((group + 1) << 31)
                else:
                    firsts.append(key if target - at <= at + sizes[key] - target else key + 1)
        at += sizes[key]
    out, slots = [], defaultdict(int)
    for key, d, size in keyed:
        shard = sum(f <= key for f in firsts)
        out.append((d, size, shard, slots[shard]))
        slots[shard] += 1
    return sorted(out)


def texts(n, seed=1):
    rng = random.Random(seed)
    common = "the same text " * 20
    return [(k, common if rng.random() < 0.4 else "é" * rng.choice([0, 1, 30, 400, 3000]) + str(k % 50)) for k in range(n)]


def result(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["shard"], r["slot"]) for r in df.collect())


@pytest.mark.parametrize("tolerance", [0.0, 0.01, 0.3])
def test_shards_and_slots(spark, tolerance):
    rows = texts(500)
    got = S.shard_rows(spark.createDataFrame(rows, SCHEMA).repartition(5), 7, tolerance)
    assert result(got) == brute(rows, 7, tolerance)


def test_bytes_are_near_equal_though_one_text_is_hot(spark):
    rows = texts(3000, seed=2)
    sums = defaultdict(int)
    for r in S.shard_rows(spark.createDataFrame(rows, SCHEMA), 6).collect():
        sums[r["shard"]] += r["size"]
    mean = sum(sums.values()) / 6
    assert len(sums) == 6 and all(abs(s - mean) <= 0.02 * mean + 6100 for s in sums.values())


def test_odd_rows_and_clashing_columns(spark):
    rows = [(1, None), (2, ""), (None, "a"), (3, "x" * 50_000), (4, "b"), (4, "b"), (5, "ü")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'s' AS shard", "'k' AS key", "1 AS piece", "2 AS size", "3 AS slot", "4 AS `a.b`")
    got = S.shard_rows(df, 3, 0.0)
    assert got.columns == ["doc_id", "text", "key", "piece", "a.b", "size", "shard", "slot"]
    assert result(got) == brute(rows, 3, 0.0)


def test_empty_table_and_more_shards_than_rows(spark):
    assert S.shard_rows(spark.createDataFrame([], SCHEMA), 4).collect() == []
    got = S.shard_rows(spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA), 24, 0.0).collect()
    assert len(got) == 2 and all(0 <= r["shard"] < 24 and r["slot"] == 0 for r in got)


def test_rows_move_once_and_no_python_runs(spark):
    plan = S.shard_rows(spark.createDataFrame(texts(50), SCHEMA), 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Arrow" not in plan
