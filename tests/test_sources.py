import io
import json
import sqlite3
import tarfile

import pyarrow as pa
import pyarrow.ipc as ipc
import pytest
from pyspark.sql import functions as F

from tuneprep.operators.formatting import format_records
from tuneprep.operators.splitting import SPLIT
from tuneprep.plans.convert import convert, inspect, preview
from tuneprep.plans.mapping import ColumnMapping, Format, MappingError
from tuneprep.sinks.evals import append_leaderboard, export_leaderboard, read_leaderboard, write_run_artifacts
from tuneprep.sinks.records import read_manifest, write_records
from tuneprep.sources import tar
from tuneprep.sources.arrow_ipc import read_arrow
from tuneprep.sources.encoding import detect_encoding, read_any_encoding
from tuneprep.sources.evalset import read_eval_samples
from tuneprep.sources.files import file_kind, path_list, split_table
from tuneprep.sources.jsonl import read_json_array, read_jsonl
from tuneprep.sources.load import SchemaMismatch, load
from tuneprep.sources.sqlite import choose_tables, read_sqlite, read_sqlite_table


def qa(n, start=0):
    return [{"id": i, "instruction": f"q{i}", "output": f"a{i}"} for i in range(start, start + n)]


def write_jsonl(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def rows(df):
    return sorted((tuple(r.asDict(recursive=True).items()) for r in df.collect()), key=repr)


def test_jsonl_dirty(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('﻿{"a": 1}\n\n{"a": 2, "b": "t x"}\n{"a":\n[{"c": 1}]\n7\n"s"\n{"a": 3} tail\n  {"a": 4}  \n')
    df = read_jsonl(spark, [str(path)])
    assert sorted(r["a"] for r in df.collect()) == [1, 2, 4]
    assert df.where("a = 2").first()["b"] == "t x"
    from pyspark.sql.types import LongType, StructField, StructType

    given = StructType([StructField("a", LongType()), StructField("b", LongType())])
    assert sorted((r["a"], r["b"]) for r in read_jsonl(spark, [str(path)], given).collect()) == [(1, None), (2, None), (4, None)]


def test_json_array(spark, tmp_path):
    path = tmp_path / "x.json"
    path.write_text(json.dumps([{"a": 1, "t": "[x]"}, [1], None, {"a": 2}, 5], indent=2))
    assert sorted((r["a"], r["t"]) for r in read_json_array(spark, [str(path)]).collect()) == [(1, "[x]"), (2, None)]
    (tmp_path / "u.json").write_bytes(json.dumps([{"a": "é"}], ensure_ascii=False).encode("utf-16"))
    assert load(spark, str(tmp_path / "u.json")).df.first()["a"] == "é"


def test_csv_tsv(spark, tmp_path):
    (tmp_path / "x.csv").write_text('prompt,completion\n"a ""q"", b\nc",d\n007,\n')
    got = load(spark, str(tmp_path / "x.csv")).df.drop(SPLIT).collect()
    assert [tuple(r) for r in got] == [('a "q", b\nc', "d"), ("007", None)]
    (tmp_path / "x.tab").write_text("p\tq\n1\t2\n")
    assert tuple(load(spark, str(tmp_path / "x.tab")).df.drop(SPLIT).first()) == ("1", "2")
    (tmp_path / "u.csv").write_bytes("p,q\né,ü\n".encode("utf-16"))
    assert tuple(load(spark, str(tmp_path / "u.csv")).df.drop(SPLIT).first()) == ("é", "ü")
    (tmp_path / "w.csv").write_bytes("p,q\né,€\n".encode("cp1252"))
    assert tuple(load(spark, str(tmp_path / "w.csv"), encoding="detect").df.drop(SPLIT).first()) == ("é", "€")


@pytest.mark.parametrize(
    "text, columns, first",
    [
        ("q one\ta one\n q two\ta\ttwo \n\nq three\n" + "x\ty\n" * 9, ["prompt", "completion", "text"], None),
        ("what a day@happy\nso sad@very sad\n", ["prompt", "completion", "text"], ("what a day", "happy")),
        ("a@b.com\nc d@sad\n", ["text"], None),
        ("a::b\nc::d::e\n", ["prompt", "completion", "text"], None),
        ("a||b\nc||d\n", ["prompt", "completion", "text"], ("a", "b")),
        ("a|b\nc|d\n", ["prompt", "completion", "text"], ("a", "b")),
        ("just\nlines\n", ["text"], None),
        ("x@this label has far too many words in it\n" * 3, ["text"], None),
    ],
)
def test_delimited(spark, tmp_path, text, columns, first):
    path = tmp_path / "x.txt"
    path.write_text(text)
    df = load(spark, str(path)).df.drop(SPLIT)
    assert df.columns == columns
    assert df.count() == len([x for x in text.splitlines() if x.strip()])
    if first:
        assert first in {tuple(r)[:2] for r in df.collect()}
    if "q three" in text:
        got = {r["text"]: (r["prompt"], r["completion"]) for r in df.collect()}
        assert got["q three"] == ("q three", "") and got["q two\ta\ttwo"] == ("q two\ta", "two")


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16", "utf-16-le", "utf-16-be", "utf-32", "utf-32-be", "latin-1", "cp1252"])
def test_encodings(spark, tmp_path, encoding):
    text = "naïve café, größe\nzweite Zeile ñ\n" + ("€ “quoted”\n" if encoding not in ("latin-1",) else "")
    path = tmp_path / "x.txt"
    path.write_bytes(text.encode(encoding))
    got = [r["line"] for r in read_any_encoding(spark, [str(path)]).orderBy("line_no").collect()]
    assert got == text.splitlines()


def test_encoding_fallbacks(tmp_path):
    def found(data):
        (tmp_path / "x").write_bytes(data)
        return detect_encoding(str(tmp_path / "x"))

    assert found("€".encode("cp1252")) == "cp1252"
    assert found(b"\x81 caf\xe9") == "iso-8859-15"  # no cp1252, and a control that latin-1 text has not
    assert found(b"") == "utf-8"


def test_text_in_utf16(spark, tmp_path):
    path = tmp_path / "x.txt"
    path.write_bytes("é\tü\nß\tñ\n".encode("utf-16-le") )
    got = {tuple(r)[:2] for r in load(spark, str(path)).df.select("prompt", "completion").collect()}
    assert got == {("é", "ü"), ("ß", "ñ")}


def test_arrow(spark, tmp_path):
    inner = pa.struct([("role", pa.string()), ("content", pa.string())])
    swapped = pa.struct([("content", pa.large_string()), ("role", pa.string())])
    one = pa.table({"a": pa.array([1, 2]), "m": pa.array([[{"role": "u", "content": "c"}], None], pa.list_(inner)), "d": pa.array(["x", "y"]).dictionary_encode()})
    two = pa.table({"m": pa.array([[{"role": "u2", "content": "c2"}]], pa.large_list(swapped)), "a": pa.array([3], pa.int32())})
    with ipc.new_file(str(tmp_path / "1.arrow"), one.schema) as w:
        for batch in one.to_batches(max_chunksize=1):
            w.write_batch(batch)
    with ipc.new_stream(str(tmp_path / "2.arrow"), two.schema) as w:
        w.write_table(two)
    paths = [str(tmp_path / "1.arrow"), str(tmp_path / "2.arrow")]
    got = {r["a"]: r for r in read_arrow(spark, paths).collect()}
    assert got[1]["m"][0]["role"] == "u" and got[1]["d"] == "x" and got[2]["m"] is None
    assert got[3]["m"][0]["role"] == "u2" and got[3]["m"][0]["content"] == "c2" and got[3]["d"] is None
    assert read_arrow(spark, paths, columns=["a"]).columns == ["a"]
    from tuneprep.sources import arrow_ipc

    reader = arrow_ipc.ArrowIpcReader(paths[:1], read_arrow(spark, paths).schema)
    arrow_ipc.BYTES_PER_TASK, kept = 400, arrow_ipc.BYTES_PER_TASK
    try:
        pieces = reader.partitions()
    finally:
        arrow_ipc.BYTES_PER_TASK = kept
    assert len(pieces) == 2 and sum(b.num_rows for p in pieces for b in reader.read(p)) == 2


def database(path, tables):
    db = sqlite3.connect(path)
    for name, n in tables.items():
        columns = "x INTEGER" if name.startswith("odd") else "id INTEGER, t TEXT, r REAL"
        db.execute(f'CREATE TABLE "{name}" ({columns})')
        if not name.startswith("odd"):
            db.executemany(f'INSERT INTO "{name}" VALUES (?, ?, ?)', [(i, f"t{i}", i / 2) for i in range(n)])
    db.commit()
    db.close()
    return str(path)


@pytest.mark.parametrize(
    "tables, chosen",
    [
        ({"train": 3, "Validation": 2, "extra": 1}, {"train": ["train"], "valid": ["Validation"]}),
        ({"valid": 3, "dev": 2}, {"valid": ["valid", "dev"]}),
        ({"only": 3}, {"default": ["only"]}),
        ({"odd": 0, "Records": 2}, {"default": ["Records"]}),
        ({"a": 1, "b": 2}, {"a": ["a"], "b": ["b"]}),
        ({"a": 1, "odd": 2}, {"default": ["a"]}),
    ],
)
def test_sqlite_tables(tmp_path, tables, chosen):
    assert choose_tables(database(tmp_path / "x.db", tables)) == chosen


def test_sqlite_read(spark, tmp_path):
    path = database(tmp_path / "x.sqlite", {"train": 50, "test": 7, "my t": 3})
    df = read_sqlite_table(spark, path, "train", tasks=4)
    assert df.rdd.getNumPartitions() == 4 and df.count() == 50 and df.agg(F.sum("r")).first()[0] == sum(range(50)) / 2
    assert {r[SPLIT]: r["count"] for r in read_sqlite(spark, path).groupBy(SPLIT).count().collect()} == {"train": 50, "test": 7}
    assert load(spark, f"{path}::my t").df.count() == 3
    assert read_sqlite_table(spark, path, "train", columns=["t"]).columns == ["t"]
    with pytest.raises(ValueError, match="no table"):
        choose_tables(path, "nope")


def test_sqlite_rowids_far_apart(spark, tmp_path):
    path = str(tmp_path / "far.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, x TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [(-(1 << 62), "a"), (1, "b"), (10**12, "c"), ((1 << 63) - 1, "d")])
    db.close()
    df = read_sqlite_table(spark, path, "t")
    assert df.rdd.getNumPartitions() == 1 and sorted(r["x"] for r in df.collect()) == ["a", "b", "c", "d"]
    two = read_sqlite_table(spark, path, "t", tasks=2)
    assert two.rdd.getNumPartitions() == 2 and sorted(r["x"] for r in two.collect()) == ["a", "b", "c", "d"]


def test_split_file_keeps_the_split_it_is_named_for(spark, tmp_path):
    database(tmp_path / "train.db", {"train": 5, "test": 2})
    database(tmp_path / "valid.db", {"dev": 3, "validation": 4})
    got = {r[SPLIT]: r["count"] for r in load(spark, str(tmp_path)).df.groupBy(SPLIT).count().collect()}
    assert got == {"train": 5, "valid": 7}
    database(tmp_path / "test.db", {"train": 5, "dev": 2})
    with pytest.raises(ValueError, match="stands for the split 'test'"):
        load(spark, str(tmp_path))


def test_eight_bit_files_are_read_right_by_default(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("k,v\n1,café “x”\n".encode("cp1252"))
    (tmp_path / "b.csv").write_bytes("k,v\n2,naïve\n".encode("utf-8"))
    (tmp_path / "c d.jsonl").write_bytes('{"k": "3", "v": "über"}\n'.encode("latin-1"))
    got = {r["k"]: r["v"] for r in load(spark, str(tmp_path)).df.collect()}
    assert got == {"1": "café “x”", "2": "naïve", "3": "über"}
    assert load(spark, str(tmp_path / "a.csv")).df.first()["v"] == "café “x”"
    late = tmp_path / "late.txt"
    late.write_bytes(b"plain line\n" * 20_000 + "né\n".encode("latin-1"))
    assert "né" in {r[0] for r in load(spark, str(late)).df.select("text").distinct().collect()}


def test_csv_is_split_unless_quotes_span_lines(spark, tmp_path):
    plain, quoted = tmp_path / "plain.csv", tmp_path / "quoted.csv"
    plain.write_text("a,b\n" + "".join(f'{k},"x ""{k}"" y"\n' for k in range(20_000)))
    quoted.write_text('a,b\n1,"two\nlines"\n2,x\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        rows = load(spark, str(plain)).df
        assert rows.rdd.getNumPartitions() > 2 and rows.count() == 20_000
        assert rows.where("a = '7'").first()["b"] == 'x "7" y'
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r["a"]: r["b"] for r in load(spark, str(quoted)).df.collect()} == {"1": "two\nlines", "2": "x"}


def test_lines_that_are_no_objects_add_no_columns(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": 1}\n[{"other": 5}]\n"text"\n{"a": 2, "b": "x"}\n')
    df = load(spark, str(path)).df.drop(SPLIT)
    assert df.dtypes == [("a", "bigint"), ("b", "string")] and df.count() == 2


def test_shards_of_a_folder_share_a_reader(spark, tmp_path):
    for k in range(20):
        (tmp_path / f"part{k:02}.jsonl").write_text(f'{{"k": {k}}}\n' + ('{"k": 1, "more": "x"}\n' if k == 7 else ""))
    rows = load(spark, str(tmp_path)).df
    assert rows.count() == 21 and set(rows.columns) == {"k", "more", SPLIT}
    assert rows._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_a_callable_is_a_source(spark):
    assert load(spark, lambda s: s.range(3)).df.columns == ["id", SPLIT]


def test_ids_go_on_from_file_to_file(spark, tmp_path):
    for name, n in (("b", 2), ("a", 3)):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(f'{{"prompt": "{name}{k}", "completion": "x"}}' for k in range(n)) + "\n")
    paths = [str(tmp_path / "b.jsonl"), str(tmp_path / "a.jsonl")]
    got = [(r["id"], r["prompt"]) for r in read_eval_samples(spark, paths).orderBy("id").collect()]
    assert got == [(1, "a0"), (2, "a1"), (3, "a2"), (4, "b0"), (5, "b1")]


def archive(path, members, mode="w"):
    with tarfile.open(path, mode) as out:
        for name, content in members:
            info = tarfile.TarInfo(name)
            data = content if isinstance(content, bytes) else content.encode()
            info.size = len(data)
            out.addfile(info, io.BytesIO(data))
    return str(path)


def test_tar_samples(spark, tmp_path):
    members = [(f"{i:05}.json", json.dumps({"instruction": f"q{i}", "id": i})) for i in range(5)]
    members += [(f"{i:05}.txt", f" text {i} ") for i in range(5)]
    df = load(spark, archive(tmp_path / "x.tar", members)).df
    assert set(df.columns) == {"__key__", "instruction", "id", "text", SPLIT}
    assert df.where("__key__ = '00003'").select("id", "text").first() == (3, "text 3")
    fields = [(f"train/s{i}.{f}.txt", f"{f}{i}") for i in range(4) for f in ("prompt", "completion")] + [("train/s0.prompt.txt", "last")]
    df = load(spark, archive(tmp_path / "y.tgz", fields, "w:gz")).df
    assert rows(df.select("prompt", "completion", SPLIT))[0] == (("prompt", "last"), ("completion", "completion0"), (SPLIT, "train"))
    odd = [("k.json", "[1, 2]"), ("b.json", "{broken"), ("plain", "x"), ("c.CLS", "5")]
    got = {r["__key__"]: r for r in load(spark, archive(tmp_path / "z.tar.bz2", odd, "w:bz2")).df.collect()}
    assert got["plain"]["text"] == "x" and got["c"]["cls"] == "5" and got["b"]["json"] == "{broken"


def test_tar_tables(spark, tmp_path):
    lines = "".join(json.dumps(r) + "\n" for r in qa(8))
    path = archive(tmp_path / "x.tar", [("README", "x"), ("d/train.jsonl", lines), ("d/test.csv", "id,instruction\n9,csv\n")])
    df = load(spark, path).df
    assert {r[SPLIT]: r["count"] for r in df.groupBy(SPLIT).count().collect()} == {"train": 8, "test": 1}


def test_tar_members_are_read_once_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tar, "RANGE_BYTES", 40_000)
    members = [(f"train/{'n' * 120 if i % 9 == 0 else ''}{i:05}.{f}", f"{f} {i} " + "x" * 300) for i in range(200) for f in ("txt", "cls")]
    path = archive(tmp_path / "x.tar", members)
    tar.index_archives(spark, [path]).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    own = index.where("name IS NOT NULL").drop("plain", "tables").crossJoin(index.where("name IS NULL").select("plain", "tables"))
    assert index.where("name IS NULL").select("plain", "tables").collect() == [(True, False)]
    got = tar._read_ranges(own)
    assert got.rdd.getNumPartitions() >= 3
    read = [(r["key"], r["field"], json.loads(r["value"])) for r in got.where("field <> '__key__'").collect()]
    expected = [(n.split("/")[1].split(".")[0], "text" if n.endswith("txt") else "cls", c.strip()) for n, c in members]
    assert sorted(read) == sorted(expected)
    plan = tar.archive_records(spark, [path])._jdf.queryExecution().executedPlan().toString()
    # One exchange deals the index to tasks, one brings the content of a sample together.
    assert plan.count("hashpartitioning(archive") == 2, plan
    assert load(spark, path).df.count() == 200


@pytest.mark.parametrize("mode,name", [("w", "x.tar"), ("w:gz", "x.tar.gz")])
def test_tar_members_in_any_encoding(spark, tmp_path, mode, name):
    words = {"utf-8": "größe €", "cp1252": "größe € “q”", "utf-16": "größe €", "latin-1": "größe"}
    path = archive(tmp_path / name, [(f"{e}.txt", w.encode(e)) for e, w in words.items()], mode)
    assert {r["__key__"]: r["text"] for r in load(spark, path).df.collect()} == words
    tables = archive(tmp_path / f"t{name}", [("train.csv", "id,w\n1,größe €\n".encode("cp1252")), ("test.jsonl", '{"id": "2", "w": "ä"}\n'.encode("utf-16"))], mode)
    assert {(r["id"], r["w"], r[SPLIT]) for r in load(spark, tables).df.collect()} == {("1", "größe €", "train"), ("2", "ä", "test")}


def test_tar_hot_key_and_tables_without_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tar, "HOT_MEMBERS", 5)
    members = [("a.txt", f"v{i}") for i in range(12)] + [("a.cls", "c"), ("b.txt", "w")]
    for name, mode in (("x.tar", "w"), ("y.tgz", "w:gz")):
        got = {r["__key__"]: (r["text"], r["cls"]) for r in load(spark, archive(tmp_path / name, members, mode)).df.collect()}
        assert got == {"a": ("v11", "c"), "b": ("w", None)}
        plain = load(spark, archive(tmp_path / f"t{name}", [("t.csv", "only,header\n"), ("u.txt", "x")], mode)).df
        assert {r["__key__"] for r in plain.collect()} == {"t", "u"}


def test_folders(spark, tmp_path):
    d = tmp_path / "splits"
    d.mkdir()
    write_jsonl(d / "train.jsonl", qa(20))
    write_jsonl(d / "valid.jsonl", qa(5))
    (d / "train.csv").write_text("x\n1\n")
    report = inspect(load(spark, str(d)))
    assert (report["total_rows"], report["split_counts"]) == (25, {"train": 20, "valid": 5})
    assert report["suggested_mappings"]["prompt_completion"]["is_valid"] and len(report["sample_records"]) == 3
    m = tmp_path / "mixed"
    m.mkdir()
    write_jsonl(m / "b.jsonl", qa(3))
    (m / "a.csv").write_text("id,instruction,output\n7,q,a\n")
    (m / "notes.md").write_text("no data")
    assert load(spark, str(m)).df.count() == 4
    p = tmp_path / "parquet"
    spark.range(10).repartition(2).write.parquet(str(p / "train"))
    spark.range(3).write.parquet(str(p / "test"))
    assert load(spark, str(p)).df.count() == 13


def test_saved_dictionary(spark, tmp_path):
    d = tmp_path / "saved"
    for split, n in (("train", 4), ("test", 2)):
        (d / split).mkdir(parents=True)
        with ipc.new_stream(str(d / split / "data-00000.arrow"), pa.schema([("label", pa.int64())])) as w:
            w.write_table(pa.table({"label": list(range(n))}))
        (d / split / "dataset_info.json").write_text(json.dumps({"features": {"label": {"names": ["no", "yes"], "_type": "ClassLabel"}}}))
    (d / "dataset_dict.json").write_text(json.dumps({"splits": ["train", "test"]}))
    data = load(spark, str(d))
    assert {r[SPLIT]: r["count"] for r in data.df.groupBy(SPLIT).count().collect()} == {"train": 4, "test": 2}
    assert data.features == {"label": ["no", "yes"]} and data.df.schema["label"].metadata["names"] == ["no", "yes"]


def test_merge(spark, tmp_path):
    a, b = write_jsonl(tmp_path / "a.jsonl", qa(30)), write_jsonl(tmp_path / "b.jsonl", qa(20, 30))
    for spec in ([a, b], f"{a}\n{b}", f"{a}, {b}"):
        assert load(spark, spec).df.count() == 50
    out = str(tmp_path / "out")
    report = convert(spark, [a, b], out, key="id")
    assert report["splits"] == {"train": 40, "valid": 5, "test": 5} and report["format"] == "prompt_completion"
    other = write_jsonl(tmp_path / "c.jsonl", [{"id": 1, "question": "q", "output": "a"}])
    with pytest.raises(SchemaMismatch, match="Missing.*instruction.*Extra.*question"):
        load(spark, [a, other])
    with pytest.raises(FileNotFoundError):
        load(spark, [a, str(tmp_path / "none.jsonl")])


def test_convert(spark, tmp_path):
    source = write_jsonl(tmp_path / "a.jsonl", qa(100))
    out = str(tmp_path / "out")
    report = convert(spark, source, out, "chat", key="id", gold=True, default_system_prompt="S", label_map="a1:one")
    assert report["total_records"] == 100 and read_manifest(spark, out) == report
    assert {k: v["records"] for k, v in report["files"].items()} == {"train": 80, "valid": 10, "test": 10}
    back = load(spark, out).df
    assert back.count() == 100 and back.where(F.element_at("messages", -1)["content"] == "one").count() == 1
    gold = spark.read.json(f"{out}/_test_gold")
    assert gold.count() == 10 and set(gold.columns) == {"prompt", "expected"}
    again = str(tmp_path / "again")
    convert(spark, source, again, "chat", key="id", default_system_prompt="S", label_map="a1:one", shuffle=False)
    assert rows(load(spark, again).df) == rows(back)
    with pytest.raises(MappingError):
        convert(spark, source, out, "dpo")
    keep = convert(spark, out, str(tmp_path / "kept"), "chat", keep_splits=True)
    assert keep["splits"] == report["splits"] and keep["seed_used"] is None
    only_train = convert(spark, source, str(tmp_path / "t"), "text", ColumnMapping(text_col="output"), key="id", shuffle=False)
    assert only_train["format"] == "text"


def test_convert_counts_while_it_writes(spark, tmp_path):
    source = write_jsonl(tmp_path / "a.jsonl", qa(100))
    tracker, group = spark.sparkContext.statusTracker(), "convert-jobs"
    spark.sparkContext.setJobGroup(group, "")
    df = load(spark, source).df.withColumn(SPLIT, F.when(F.col("id") < 30, "a").otherwise("b"))
    records = format_records(df, Format.TEXT, ColumnMapping(text_col="output"), keep=[SPLIT])
    before = len(tracker.getJobIdsForGroup(group))
    counts = write_records(records, Format.TEXT, str(tmp_path / "r"), None, ["a", "b", "c"])
    assert counts == {"a": 30, "b": 70, "c": 0} and len(tracker.getJobIdsForGroup(group)) == before + 1
    spark.sparkContext.setJobGroup("", "")
    with pytest.raises(ValueError, match="70 records"):
        write_records(records, Format.TEXT, str(tmp_path / "s"), None, ["a"])


def test_convert_replaces_its_own_folder_only_when_complete(spark, tmp_path):
    source, out = write_jsonl(tmp_path / "a.jsonl", qa(50)), tmp_path / "out"
    first = convert(spark, source, str(out), "chat", key="id", gold=True)
    before = {p.relative_to(out): p.read_bytes() for p in out.rglob("*") if p.is_file()}

    def failing(name, n):
        raise RuntimeError("stop")

    with pytest.raises(RuntimeError, match="stop"):
        convert(spark, source, str(out), "text", key="id", progress=failing)
    bad = load(spark, source).df.withColumn("output", F.when(F.col("id") == 7, F.raise_error(F.lit("broken"))).otherwise(F.col("output")))
    with pytest.raises(Exception, match="broken"):
        convert(spark, lambda s: bad, str(out), "text", ColumnMapping(text_col="output"), key="id")
    assert {p.relative_to(out): p.read_bytes() for p in out.rglob("*") if p.is_file()} == before
    assert read_manifest(spark, str(out)) == first
    second = convert(spark, write_jsonl(tmp_path / "b.jsonl", qa(20)), str(out) + "/", "text", ColumnMapping(text_col="output"), key="id")
    assert second["total_records"] == 20 == load(spark, str(out)).df.count() and read_manifest(spark, str(out)) == second
    assert not (out / "_test_gold").exists() and sorted(p.name for p in tmp_path.iterdir()) == ["a.jsonl", "b.jsonl", "out"]
    for part in second["files"].values():
        found = list((tmp_path / "out" / part["path"].rsplit("/", 1)[1]).glob("part-*"))
        assert (len(found), sum(p.stat().st_size for p in found)) == (part["files"], part["size_bytes"])


def test_a_foreign_folder_is_refused(spark, tmp_path):
    source = write_jsonl(tmp_path / "a.jsonl", qa(5))
    (tmp_path / "mine").mkdir()
    (tmp_path / "mine" / "thesis.txt").write_text("x")
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileExistsError, match="holds other files"):
        convert(spark, source, str(tmp_path / "mine"), "chat", key="id")
    with pytest.raises(FileExistsError):
        write_run_artifacts(spark.range(1).withColumnRenamed("id", "run_id"), spark.range(1).withColumnRenamed("id", "run_id"), str(tmp_path / "mine"))
    assert [p.name for p in (tmp_path / "mine").iterdir()] == ["thesis.txt"]
    assert convert(spark, source, str(tmp_path / "empty"), "chat", key="id")["total_records"] == 5
    for n in (1, 2):
        own = spark.range(n).withColumnRenamed("id", "run_id").withColumn("v", F.lit(n))
        write_run_artifacts(own, own, str(tmp_path / "runs"))
    assert spark.read.json(str(tmp_path / "runs" / "summary")).count() == 2


def test_convert_an_empty_source(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, text string")
    report = convert(spark, lambda s: empty, str(tmp_path / "out"), "text", ColumnMapping(text_col="text"), key="id")
    assert report["total_records"] == 0 and report["files"] == {} == report["splits"]


def test_preview(spark):
    df = spark.range(9).select(F.col("id").cast("string").alias("text"))
    assert [json.loads(r[0]) for r in preview(df, Format.TEXT, ColumnMapping(text_col="text")).collect()][0].keys() == {"text"}


def test_eval_samples_keep_line_numbers(spark, tmp_path):
    path = tmp_path / "test.jsonl"
    path.write_text('{"prompt":"p","completion":"c"}\n\n{broken\n{"messages":[{"role":"user","content":"u"},{"role":"assistant","content":"a"}]}\n')
    got = [tuple(r)[:3] for r in read_eval_samples(spark, [str(path)]).orderBy("id").collect()]
    assert got == [(1, "p", "c"), (4, "user: u", "a")]


def test_leaderboard_files(spark, tmp_path):
    path = str(tmp_path / "board")
    append_leaderboard(spark.createDataFrame([("old", 1.5)], "run_name string, macro_f1_pct double"), path)
    append_leaderboard(spark.createDataFrame([("new", 7)], "run_name string, seed int"), path)
    board = read_leaderboard(spark, path)
    assert {r["run_name"]: (r["macro_f1_pct"], r["seed"]) for r in board.collect()} == {"old": (1.5, None), "new": (None, 7)}
    export_leaderboard(board, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2


def test_paths_and_kinds(spark, tmp_path):
    assert path_list(["a", "b\nc"]) == ["a", "b", "c"] and path_list(" x , y ") == ["x", "y"] and path_list("") == []
    assert split_table("f.db::t") == ("f.db", "t") and split_table("f.db") == ("f.db", None)
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "p"))
    real = next((tmp_path / "p").glob("part-*"))
    bare = tmp_path / "bare"
    bare.write_bytes(real.read_bytes())
    assert file_kind(str(bare)) == "parquet" and load(spark, str(bare)).df.count() == 3
    db = tmp_path / "unnamed"
    database(db, {"t": 2})
    assert file_kind(str(db)) == "sqlite"
    (tmp_path / "w.safetensors").write_bytes(b"x")
    (tmp_path / "w.duckdb").write_bytes(b"x")
    for name in ("w.safetensors", "w.duckdb"):
        with pytest.raises(ValueError):
            file_kind(str(tmp_path / name))


def written_parts(spark, tmp_path, monkeypatch, query, suffix):
    """How many files a query writes for a table of 20 pieces."""
    from tuneprep.queries import sources

    docs = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(i, f"text {i}", "en", f"s{i % 3}", 6) for i in range(400)]
    spark.createDataFrame(rows, docs).repartition(20).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(sources, "_folder", lambda spark, name: str(tmp_path / "out" / name))
    monkeypatch.setattr(sources, "widen", lambda df: df)
    settings = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for name in settings:
        spark.conf.set(name, "100000")
    try:
        df = getattr(sources, query)(spark, str(tmp_path))
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert df.count() == 400
    return len(list((tmp_path / "out").rglob(f"part-*{suffix}")))


def test_shards_grow_with_the_table(spark, tmp_path, monkeypatch):
    assert written_parts(spark, tmp_path, monkeypatch, "sharded_parquet", ".parquet") >= 20


def test_test_sets_are_sorted_in_pieces_of_the_table(spark, tmp_path, monkeypatch):
    assert written_parts(spark, tmp_path, monkeypatch, "eval_samples_file", ".txt") >= 20


def test_each_archive_is_a_task_of_its_own(spark, tmp_path):
    paths = [archive(tmp_path / f"{i:02}.tar.gz", [(f"{i}.txt", f"t{i}")], "w:gz") for i in range(24)]
    for rows in (tar.index_archives(spark, paths), tar._read_streams(spark, paths, False)):
        # Dealt by a hash or from several partitions, some tasks had several archives.
        assert sorted(len({r["archive"] for r in part}) for part in rows.rdd.glom().collect()) == [1] * 24
    assert {r["__key__"]: r["text"] for r in tar.read_tar(spark, paths).collect()} == {str(i): f"t{i}" for i in range(24)}


def test_archives_of_a_folder_share_a_reader(spark, tmp_path, monkeypatch):
    from tuneprep.sources import load as loading

    for i in range(5):
        archive(tmp_path / f"{i}.tar", [(f"{i}.txt", f"t{i}"), (f"{i}.cls" if i else f"{i}.about.txt", "c")])
    calls = []
    monkeypatch.setattr(loading, "read_tar", lambda spark, paths: calls.append(len(paths)) or tar.read_tar(spark, paths))
    got = load(spark, str(tmp_path)).df
    assert calls == [5]
    assert {(r["__key__"], r["text"], r["cls"]) for r in got.collect()} == {(str(i), f"t{i}" if i else "c", "c" if i else None) for i in range(5)}
