"""Line numbers: every range against the whole text."""

import bz2
import gzip
import json
import os
import re

import numpy as np
import pytest

from tuneprep.sources import lines as L
from tuneprep.sources.evalset import read_eval_samples


def expected(data: bytes) -> list[str]:
    text = data.removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace")
    found = re.split("\r\n|\r|\n", text)
    return found[:-1] if found[-1] == "" else found


def in_ranges(path, monkeypatch, size, chunk):
    """Lines of all ranges and their counts, read without Spark."""
    monkeypatch.setattr(L, "RANGE_BYTES", size)
    monkeypatch.setattr(L, "CHUNK_BYTES", chunk)
    got, counts = [], []
    for r in L._ranges([str(path)]):
        blocks = list(L._blocks(r))
        counts.append(sum(b.count(b"\n") + 1 for b in blocks))
        got += [x for b in blocks for x in L._lines(b).to_pylist()]
    return got, counts


ODD = [
    b"", b"\n", b"\r", b"\r\n", b"a", b"a\n", b"\n\na", b"a\r\rb\r\n\r\nc", b"\xef\xbb\xbfa\nb", b"\xef\xbb\xbf", b"a\r", b"a\nb\r\n",
    "ä€😀\nü\r\n".encode() * 5, b"\xff\xfe bad\n\xc3\nok", b"x" * 100, b"x" * 40 + b"\r\n" + b"y" * 40 + b"\r\n",
]


@pytest.mark.parametrize("size,chunk", [(4, 1), (5, 3), (6, 2), (7, 64), (64, 5), (1000, 1000)])
def test_ranges_hold_every_line_once(tmp_path, monkeypatch, size, chunk):
    rng = np.random.default_rng(size)
    cases = ODD + [bytes(rng.choice([10, 13, 97, 98], 60).tolist()) for _ in range(30)]
    for k, data in enumerate(cases):
        path = tmp_path / f"{k}.txt"
        path.write_bytes(data)
        got, counts = in_ranges(path, monkeypatch, size, chunk)
        assert got == expected(data) and sum(counts) == len(got), data


def numbered(df):
    return [(r["file"].rsplit("/", 1)[-1], r["line_no"], r["line"]) for r in df.orderBy("file", "line_no").collect()]


def test_numbers_do_not_depend_on_how_spark_cuts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "RANGE_BYTES", 10_000)
    texts = {"a.txt": [f"a{i} " + "x" * (i % 50) for i in range(3000)], "b.log": ["", "b", ""], "sub/c.txt": ["c"] * 700}
    (tmp_path / "sub").mkdir()
    for name, own in texts.items():
        (tmp_path / name).write_text("\n".join(own) + "\n")
    (tmp_path / "_SUCCESS").write_text("no line\n")
    want = [(n.rsplit("/", 1)[-1], i + 1, x) for n, own in texts.items() for i, x in enumerate(own)]
    settings = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum", "spark.sql.leafNodeDefaultParallelism")
    df = L.numbered_lines(spark, [str(tmp_path)])
    assert df.rdd.getNumPartitions() > 8
    try:
        for value in ("1000000", "5000", "3"):
            for name in settings:
                spark.conf.set(name, value)
            # Both a plan made under other settings and a new one.
            assert numbered(df) == want == numbered(L.numbered_lines(spark, [str(tmp_path)]))
    finally:
        for name in settings:
            spark.conf.unset(name)
    across = L.numbered_lines(spark, [str(tmp_path / "sub"), str(tmp_path / "a.txt")], across=True)
    assert [r["line_no"] for r in across.orderBy("line_no").collect()] == list(range(1, 3701))
    assert across.where("line = 'c'").agg({"line_no": "min"}).first()[0] == 3001


def test_no_line_moves(spark, tmp_path):
    (tmp_path / "x.txt").write_text("a\nb\n")
    plan = L.numbered_lines(spark, [str(tmp_path)])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_compressed_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "RANGE_BYTES", 50)
    data = "\n".join(f"zeile {i} ä" for i in range(500)).encode()
    (tmp_path / "x.txt.gz").write_bytes(gzip.compress(data))
    (tmp_path / "y.txt.bz2").write_bytes(bz2.compress(data))
    got = numbered(L.numbered_lines(spark, [str(tmp_path)]))
    assert got == [(n, i + 1, f"zeile {i} ä") for n in ("x.txt.gz", "y.txt.bz2") for i in range(500)]
    (tmp_path / "z.snappy").write_bytes(b"")
    with pytest.raises(ValueError, match="compression"):
        L.numbered_lines(spark, [str(tmp_path)])


def test_nothing_and_changed_files(spark, tmp_path):
    (tmp_path / "x.txt").write_text("")
    assert L.numbered_lines(spark, [str(tmp_path)]).collect() == [] == L.numbered_lines(spark, []).collect()
    (tmp_path / "x.txt").write_text("a\nb\n")
    df = L.numbered_lines(spark, [str(tmp_path)])
    (tmp_path / "x.txt").write_text("a\nb\nc\n")
    with pytest.raises(Exception, match="changed between"):
        df.collect()
    with pytest.raises(FileNotFoundError):
        L.numbered_lines(spark, [str(tmp_path / "none")])


def test_samples_keep_their_line_over_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "RANGE_BYTES", 300)
    own = [json.dumps({"prompt": f"p{i}", "completion": "c" * (i % 90)}) if i % 7 else ["", "{", "[1]"][i % 3] for i in range(400)]
    (tmp_path / "t.jsonl").write_text("\n".join(own))
    got = {r["id"]: r["prompt"] for r in read_eval_samples(spark, [str(tmp_path / "t.jsonl")]).collect()}
    assert got == {i + 1: f"p{i}" for i in range(400) if i % 7}
    first = read_eval_samples(spark, [str(tmp_path / "t.jsonl")], limit=9).collect()
    assert [r["id"] for r in first] == sorted(got)[:9]


def test_small_files_share_tasks_and_are_read_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "FILES_PER_TASK", 40)
    for run in range(130):
        (tmp_path / f"run_id={run:03}").mkdir()
        (tmp_path / f"run_id={run:03}" / "part.txt").write_text(f"a{run}\nb{run}\n")
    (tmp_path / "_temporary").mkdir()
    (tmp_path / "_temporary" / "x.txt").write_text("hidden\n")
    loaded = []
    load = L._load
    monkeypatch.setattr(L, "_load", lambda spark, ranges, count: loaded.append(count) or load(spark, ranges, count))
    df = L.numbered_lines(spark, [str(tmp_path)])
    # No number depends on another file, so nothing is counted first.
    assert loaded == [False] and df.rdd.getNumPartitions() == 4
    got = sorted((r["file"].rsplit("/", 2)[1], r["line_no"], r["line"]) for r in df.collect())
    assert got == [(f"run_id={run:03}", k + 1, f"{x}{run}") for run in range(130) for k, x in enumerate("ab")]
    across = L.numbered_lines(spark, [str(tmp_path)], across=True)
    assert [r["line"] for r in across.orderBy("line_no").collect()] == [f"{x}{run}" for run in range(130) for x in "ab"]


def test_many_runs_are_few_log_files(spark, tmp_path, monkeypatch):
    from tuneprep.queries import sources

    monkeypatch.setattr(sources, "_folder", lambda spark, name: str(tmp_path / name))
    events = "event_id bigint, user_id bigint, event_type string, value double"
    rows = [(i, i % 300, "view", float(i)) for i in range(900)] + [(900, None, "click", 1.5)]
    spark.createDataFrame(rows, events).write.parquet(f"{tmp_path}/events.parquet")
    df = sources.training_log_scan(spark, str(tmp_path))
    assert len(list((tmp_path / "logs").rglob("*.txt"))) <= 4
    got = {(r["run_id"], r["step"], r["metric"]): r["value"] for r in df.collect()}
    assert got == {(i % 300, i // 10, "val"): float(i) for i in range(900)} | {(None, 90, "train"): 1.5}


def test_scratch_is_removed(spark):
    from tuneprep.session import clear_scratch, local_path, scratch_dir

    clear_scratch(spark)
    folders = [scratch_dir(spark, "gone") for _ in range(3)]
    for folder in folders[:2]:
        spark.range(3).write.parquet(folder)
    assert clear_scratch(spark) == 2 and not any(os.path.exists(local_path(f)) for f in folders)
