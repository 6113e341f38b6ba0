import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tuneprep.operators.formatting import format_records
from tuneprep.plans.mapping import ColumnMapping, Format
from tuneprep.streaming.logs import (
    append_to,
    log_stream,
    metric_stream,
    milestone_stream,
    overfit_alerts,
    rocksdb_state,
    running_best,
)
from tuneprep.streaming import table
from tuneprep.streaming.progress import FILES, RecordCounts, count_records
from tuneprep.streaming.records import record_stream, write_formatted
from tuneprep.streaming.table import keep_latest, latest, save_batch


def test_formatting_is_the_same_as_in_batch(spark, tmp_path):
    rows = spark.range(100).select("id", F.concat(F.lit(" t"), "id").alias("text"))
    rows.repartition(6).write.json(str(tmp_path / "in"))
    mapping = ColumnMapping(text_col="text", default_system_prompt="S")
    stream = record_stream(spark, str(tmp_path / "in"), rows.schema, files_per_trigger=2)
    query = write_formatted(stream, Format.TEXT, mapping, str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    written = sorted(json.loads(r["value"])["text"] for r in spark.read.text(str(tmp_path / "out")).collect())
    assert written == sorted(r["text"] for r in format_records(rows, Format.TEXT, mapping).collect())
    assert sum(p["observedMetrics"]["rows"]["records"] for p in query.recentProgress) == 100 and len(query.recentProgress) >= 3


def test_running_log(spark, tmp_path):
    """Lines arrive in two steps; the second run goes on from the first one's checkpoint."""
    logs, out, best, check = (str(tmp_path / n) for n in ("logs", "out", "best", "check"))
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "run-a.log").write_text("Iter 1: Val loss 3.0, Val It/sec 2.0\nLoading\nIter 1: Train loss 2.5\n")

    def advance():
        for stream, path, start in (
            (metric_stream(log_stream(spark, logs)), out, append_to),
            (running_best(log_stream(spark, logs)), best, keep_latest),
            (milestone_stream(log_stream(spark, logs)), out + "-m", append_to),
        ):
            start(stream, path, f"{check}-{path.rsplit('/', 1)[-1]}").awaitTermination()

    advance()
    assert latest(spark, best).first()["best_val_loss"] == 3.0
    (tmp_path / "logs" / "run-b.log").write_text("Iter 9: val loss = 1.0\n")
    (tmp_path / "logs" / "run-a.2.log").write_text("x\n")
    advance()
    got = {r["run_id"]: (r["best_val_loss"], r["best_step"], r["n_val"]) for r in latest(spark, best).collect()}
    assert got == {"run-a": (3.0, 1, 1), "run-b": (1.0, 9, 1)}
    assert spark.read.parquet(out).count() == 2
    assert {r["milestone"] for r in spark.read.parquet(out + "-m").collect()} == {"Iter 1: Val loss 3.0, Val It/sec 2.0", "Iter 9: val loss = 1.0"}


POINTS = "run_id string, step long, seq int, val_loss double"


def stop(curve):
    """The first step at which the rule stops a whole curve {step: loss}."""
    low, rises, previous = None, 0, None
    for step in sorted(curve):
        loss = curve[step]
        if low is None or loss < low:
            low, rises = loss, 0
        else:
            rises = rises + 1 if loss > previous else 0
            if (loss - low) / max(low, 1e-8) > 0.05 or rises == 2:
                return step
        previous = loss
    return None


def follow(spark, folder, batches, **options):
    """The rows of the alert table after each batch; every batch is a run of its own from the checkpoint."""
    source, out, check = (str(folder / n) for n in ("in", "out", "check"))
    seen = []
    for batch in batches:
        spark.createDataFrame(batch, POINTS).repartition(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(POINTS).parquet(source)
        with rocksdb_state(spark):
            keep_latest(overfit_alerts(stream, **options), out, check).awaitTermination()
        seen.append({r["run_id"]: (r["stop_step"], r["settled"], r["late"]) for r in latest(spark, out).collect()} if (folder / "out").exists() else {})
    return seen


def test_late_and_repeated_points_give_the_answer_of_the_whole_curve(spark, tmp_path):
    rng = np.random.default_rng(5)
    curves, batches = {}, [[] for _ in range(5)]
    for run in map(str, range(25)):
        loss = np.round(np.cumsum(rng.normal(-0.02, 0.04, 40)) + 3, 3)
        for step, value in enumerate(loss.tolist()):
            if rng.random() < 0.9:
                at = min(4, step // 10 + int(rng.integers(0, 2)))
                batches[at].append((run, step, 2, value))
                if rng.random() < 0.2:  # an earlier or later line about the same step that counts less
                    batches[int(rng.integers(0, 5))].append((run, step, 1, value * 9))
                curves.setdefault(run, {})[step] = value
    for batch in batches:
        batch.append(("0", None, 0, 1.0))
        batch.append(("0", 1, 0, None))
    got = follow(spark, tmp_path, batches)[-1]
    expected = {run: stop(curve) for run, curve in curves.items()}
    assert {run: got.get(run, (None,))[0] for run in curves} == expected and None in expected.values()
    assert all(late == 0 and not settled for _, settled, late in got.values())


def test_an_alert_is_corrected_settles_and_counts_what_is_too_late(spark, tmp_path):
    batches = [
        [("a", 10, 0, 2.0), ("a", 30, 0, 3.0)],
        [("a", 20, 0, 1.0)],  # in its place: 30 is a rebound from 1.0
        [("a", 30, 1, 0.9)],  # the line that counts: no stop any more
        [("a", 40, 0, 0.8), ("a", 50, 0, 2.0), ("a", 5, 0, 0.1)],
        [("a", 60, 0, 2.0), ("a", 70, 0, 2.0)],
        [("a", 1, 0, 0.1)],
    ]
    seen = follow(spark, tmp_path, batches, wait=2)
    assert [s.get("a") for s in seen] == [(30, False, 0), (30, False, 0), (None, False, 0), (50, False, 1), (50, True, 1), (50, True, 1)]


def test_points_of_a_silent_run_settle(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    spark.createDataFrame([("a", 10, 0, 1.0), ("a", 20, 0, 2.0), ("b", 10, 0, 1.0)], POINTS).write.parquet(source)
    with rocksdb_state(spark):
        stream = spark.readStream.schema(POINTS).parquet(source)
        query = keep_latest(overfit_alerts(stream, idle_seconds=1.0), out, check, available_now=False)
    try:
        until, got = time.monotonic() + 90, {}
        while time.monotonic() < until and got != {"a": (20, True), "b": (None, True)}:
            time.sleep(1)
            assert query.isActive
            if (tmp_path / "out" / "delta").exists() and any((tmp_path / "out" / "delta").glob("*/_SUCCESS")):
                got = {r["run_id"]: (r["stop_step"], r["settled"]) for r in latest(spark, out).collect()}
    finally:
        query.stop()
    assert got == {"a": (20, True), "b": (None, True)}


def test_a_run_costs_two_messages_about_its_state():
    from pyspark.sql import Row
    from tuneprep.streaming.logs import _RiseWatch

    class Handle:
        """One value; each access is a message to the JVM."""

        def __init__(self):
            self.value, self.messages = None, []

        def getValueState(self, name, schema):
            return self

        def get(self):
            self.messages.append("get")
            return self.value

        def update(self, value):
            self.messages.append("update")
            self.value = value

    handle, watch, told = Handle(), _RiseWatch(2, None), []
    watch.init(handle)
    for steps in ([(10, 2.0), (30, 3.0)], [(20, 1.0), (None, 1.0)], [(40, 0.8), (50, 2.0)]):
        told.append([r.stop_step for r in watch.handleInputRows(("a",), iter([Row("a", step, 0, loss) for step, loss in steps]), None)])
    assert told == [[30], [], [30]] and handle.messages == ["get", "update"] * 3


def test_the_table_of_last_rows_stays_small(spark, tmp_path):
    path = str(tmp_path / "t")
    expected = {}
    for n in range(60):
        rows = [(f"k{n % 7}", "x", n), (f"k{n}", "y", -n), (None, "x", n)]
        expected |= {(a, b): v for a, b, v in rows}
        save_batch(spark.createDataFrame(rows, "a string, b string, v long"), n, path, ["a", "b"], every=8)
        if n % 13 == 0:
            save_batch(spark.createDataFrame(rows, "a string, b string, v long"), n, path, ["a", "b"], every=8)
        folders = len(list((tmp_path / "t" / "delta").iterdir())) + (len(list((tmp_path / "t" / "snapshot").iterdir())) if n >= 7 else 0)
        assert folders <= 2 * 8 + 2
    assert {(r["a"], r["b"]): r["v"] for r in latest(spark, path, ["a", "b"]).collect()} == expected
    # One snapshot and the deltas after it are read.
    assert len(latest(spark, path, ["a", "b"]).inputFiles()) <= 1 + 3 * 8


def test_a_snapshot_that_was_not_finished_is_not_read(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    for n in range(5):
        save_batch(spark.createDataFrame([("a", n)], "run_id string, v long"), n, path, ["run_id"], every=3)
    (tmp_path / "t" / "snapshot" / "upto=9").mkdir()
    assert latest(spark, path).first()["v"] == 4
    monkeypatch.setattr(table, "_drop", lambda p: None)
    save_batch(spark.createDataFrame([("a", 9)], "run_id string, v long"), 9, path, ["run_id"], every=3)
    assert latest(spark, path).first()["v"] == 9
    with pytest.raises(ValueError, match="no batch"):
        latest(spark, str(tmp_path / "none"))


def test_records_are_counted_beyond_the_progress_that_spark_keeps(spark, tmp_path):
    (tmp_path / "in").mkdir()
    mapping = ColumnMapping(text_col="text")
    done = 0
    for files in (70, 50):
        for n in range(done, done + files):
            (tmp_path / "in" / f"{n:04}.json").write_text("".join(json.dumps({"text": f"t{n}"}) + "\n" for _ in range(n % 3 + 1)))
        done += files
        counts = count_records(spark, str(tmp_path / "counts"))
        stream = record_stream(spark, str(tmp_path / "in"), "text string", files_per_trigger=1)
        query = write_formatted(stream, Format.TEXT, mapping, str(tmp_path / "out"), str(tmp_path / "check"))
        query.awaitTermination()
        assert counts.total(query) == sum(n % 3 + 1 for n in range(done))
        spark.streams.removeListener(counts)
    assert len(list((tmp_path / "counts" / str(query.id)).iterdir())) <= FILES + 2


def test_a_batch_that_runs_again_counts_once(tmp_path):
    counts = RecordCounts(str(tmp_path))
    for n in range(130):
        counts._add("q", n, n)
        counts._add("q", n, n)
        counts._add("q", max(0, n - 60), 10**6)  # long since added up
    _, total, later = counts._state(*counts._folder("q"))
    replaced = sum(10**6 - n for n in later if n <= 69)
    assert total + sum(later.values()) - replaced >= sum(range(130)) and len(later) <= FILES
