import random

import pytest
from pyspark.sql import functions as F

from tuneprep.functions.logs import is_milestone
from tuneprep.operators.checkpoints import (
    best_train_checkpoint,
    best_val_checkpoint,
    loss_series,
    parse_log_lines,
    pre_overfit_checkpoint,
    resolve_checkpoints,
    train_loss_as_of,
)
from tuneprep.operators.ordered import OrderedRuns


def frames(spark, curves):
    """curves: run -> {step: (val, train)}; every step is a checkpoint."""
    losses = [(r, s, m, v) for r, c in curves.items() for s, two in c.items() for m, v in zip(("val", "train"), two) if v is not None]
    saved = [(r, s, f"{r}/{s}") for r, c in curves.items() for s in c]
    return (
        spark.createDataFrame(saved, "run_id string, step long, path string"),
        spark.createDataFrame(losses, "run_id string, step long, metric string, value double"),
    )


def by_walking(curve):
    """The pre-overfit rule as a walk along one curve."""
    steps = sorted(curve)
    low, seen, rises, previous = None, [], 0, None
    for s in steps:
        v = curve[s]
        if low is None or v < low:
            low, rises = v, 0
        else:
            rises = rises + 1 if v > previous else 0
            if rises == 2 or (v - low) / max(low, 1e-8) > 0.05:
                break
        previous = v
        seen.append(s)
    best = min(seen, key=lambda s: (curve[s], s))
    limit = curve[best] + max(0.005, 0.02 * max(0.0, curve[steps[0]] - curve[best]))
    return next(s for s in steps if s <= best and curve[s] <= limit)


def random_curves(n, seed):
    rng = random.Random(seed)
    curves = {}
    for i in range(n):
        level, curve = rng.uniform(0.5, 3), {}
        for k in range(rng.randint(1, 14)):
            level = max(0.0, level + rng.choice([-0.4, -0.1, -0.01, 0, 0, 0.01, 0.03, 0.2]))
            curve[100 * (k + 1)] = round(level, 2)
        curves[f"r{i}"] = curve
    return curves


@pytest.mark.parametrize("hot_rows", [10**6, 3])
def test_pre_overfit_random(spark, hot_rows):
    curves = random_curves(300, 7)
    saved, losses = frames(spark, {r: {s: (v, None) for s, v in c.items()} for r, c in curves.items()})
    got = {r["run_id"]: r["step"] for r in pre_overfit_checkpoint(saved, losses, hot_rows=hot_rows).collect()}
    assert got == {r: by_walking(c) for r, c in curves.items()}


@pytest.mark.parametrize(
    "curve, step",
    [
        ({100: 2.0, 200: 1.5, 300: 1.2, 400: 1.3, 500: 1.1}, 300),
        ({100: 2.0, 200: 1.0, 300: 1.01, 400: 1.02, 500: 0.5}, 200),
        ({100: 1.0}, 100),
    ],
)
def test_pre_overfit_known(spark, curve, step):
    saved, losses = frames(spark, {"r": {s: (v, None) for s, v in curve.items()}})
    assert pre_overfit_checkpoint(saved, losses).first()["step"] == step


@pytest.mark.parametrize("hot_rows", [10**6, 2])
def test_as_of(spark, hot_rows):
    curve = {50: (None, 3.0), 100: (1.0, None), 150: (None, 2.0), 200: (0.5, 1.5), 300: (0.5, None), 10: (4.0, None)}
    saved, losses = frames(spark, {"r": curve})
    got = {r["step"]: r["train_loss"] for r in train_loss_as_of(saved, losses, hot_rows=hot_rows).collect()}
    assert got == {50: 3.0, 100: 3.0, 150: 2.0, 200: 1.5, 300: 1.5}
    assert best_train_checkpoint(saved, losses).first()["step"] == 200
    assert best_val_checkpoint(saved, losses).first()["step"] == 200


@pytest.mark.parametrize("hot_rows", [10**6, 5])
def test_running_values(spark, hot_rows):
    rng = random.Random(8)
    rows = [(k, s, float(rng.randint(0, 9)), rng.choice([None, float(s)])) for k in ("a", "b") for s in range(1, rng.randint(40, 60))]
    df = spark.createDataFrame(rows, "k string, s long, v double, n double").repartition(5)
    runs = OrderedRuns(df, "k", "s", hot_rows=hot_rows, pieces=8)
    assert runs.chunked is (hot_rows == 5)
    out = runs.min_before("low", "v").previous("prev", "v").last_known("known", "n").result().collect()
    for key in ("a", "b"):
        mine = sorted((r for r in out if r["k"] == key), key=lambda r: r["s"])
        source = sorted(r for r in rows if r[0] == key)
        assert len(mine) == len(source)
        for i, r in enumerate(mine):
            before = [x[2] for x in source[:i]]
            known = [x[3] for x in source[: i + 1] if x[3] is not None]
            assert (r["low"], r["prev"]) == (min(before, default=None), before[-1] if before else None)
            assert r["known"] == (known[-1] if known else None)


def test_strategies(spark):
    saved, losses = frames(spark, {"r": {100: (2.0, 1.0), 200: (1.0, 0.5), 300: (1.5, 0.25)}, "bare": {10: (None, None), 20: (None, None)}})
    got = {s: {r["run_id"]: (r["step"], r["label"]) for r in resolve_checkpoints(saved, losses, s).collect()} for s in ("last", "min_val_loss", "knee", "best_train_loss")}
    assert got["last"] == {"r": (300, "Final trained adapter"), "bare": (20, "Final trained adapter")}
    assert got["min_val_loss"]["r"] == (200, "Adapter with minimal validation loss (step 200, val loss 1.0000)")
    assert got["min_val_loss"]["bare"] == (20, "Final trained adapter (fallback: no val loss in log)")
    assert got["knee"]["r"] == (200, "Pre-overfit knee adapter (step 200, val loss 1.0000)")
    assert got["best_train_loss"]["r"][0] == 300
    every = {(r["run_id"], r["step"]): r["label"] for r in resolve_checkpoints(saved, losses, "all").collect()}
    assert every[("r", 100)] == "Adapter step 100 (val loss 2.0000, train loss 1.0000)"
    assert every[("bare", 10)] == "Adapter step 10"


LINES = [
    "Iter 100: Train loss 1.450, Learning Rate 1.000e-05, It/sec 1.150, Tokens/sec 1200.0",
    "Iter 200: Val loss 2.100, Val It/sec 2.000",
    "Iter 200: Val loss = 1.9",
    "Iter 300: nothing here",
    "Loading",
    "Iter 400: Train loss 1.2.3",
    "  Iter 500: VAL LOSS: 0.75 train loss 0.5",
]


def test_log_lines(spark):
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate(LINES)], "run_id string, line_no int, line string")
    rows = {r["line_no"]: r for r in parse_log_lines(df).collect()}
    assert sorted(rows) == [0, 1]
    first = rows[0]
    assert (first["train_loss"], first["learning_rate"], first["it_per_sec"], first["tokens_per_sec"]) == (1.45, 1e-5, 1.15, 1200.0)
    assert (rows[1]["val_loss"], rows[1]["val_it_per_sec"], rows[1]["it_per_sec"]) == (2.1, 2.0, None)
    series = {(r["step"], r["metric"]): r["value"] for r in loss_series(df).collect()}
    assert series == {(100, "train"): 1.45, (200, "val"): 1.9, (500, "val"): 0.75, (500, "train"): 0.5}
    assert df.where(is_milestone(F.col("line"))).count() == 3


@pytest.mark.parametrize("hot_rows, scans", [(5_000_000, 2), (3, 4)])
def test_plans_of_curves_read_little(spark, tmp_path, hot_rows, scans):
    saved = [("r", 100 * k) for k in range(1, 9)]
    losses = [("r", 100 * k, "val", abs(5 - k) + 1.0) for k in range(1, 9)]
    spark.createDataFrame(saved, "run_id string, step long").write.parquet(str(tmp_path / "saved"))
    spark.createDataFrame(losses, "run_id string, step long, metric string, value double").write.parquet(str(tmp_path / "losses"))
    found = pre_overfit_checkpoint(spark.read.parquet(str(tmp_path / "saved")), spark.read.parquet(str(tmp_path / "losses")), hot_rows=hot_rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= scans and plan.count("Exchange") <= 4 and found.first()["step"] == 500
