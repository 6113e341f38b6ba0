"""Tar archives of samples or of data files.

An index of members comes first: their names, places and sizes, read from the headers alone
where the archive is not compressed. Of such archives each task then reads a range of members,
each member once; compressed archives are one task each, streamed. Nothing is unpacked to
disk. An archive with table files (.jsonl, .csv, .tsv, .tab), none of them empty and not all
without a record, is a set of tables; any other archive is a set of samples, one member per field.
"""

from __future__ import annotations

import codecs
import csv
import io
import json
import posixpath
import tarfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneprep.operators.splitting import SPLIT
from tuneprep.session import scratch_dir
from tuneprep.sources.encoding import EIGHT_BIT, decode_bytes, one_task_each
from tuneprep.sources.files import filesystem, utf_of
from tuneprep.sources.jsonl import read_jsonl

# Member names that mean something.
TABLE_SUFFIXES = (".jsonl", ".csv", ".tsv", ".tab")
SPLIT_WORDS = ("train", "valid", "validation", "val", "test", "dev")
SPLIT_FOLDERS = {
    "train": "train",
    "training": "train",
    "valid": "valid",
    "validation": "valid",
    "val": "valid",
    "dev": "valid",
    "test": "test",
    "testing": "test",
    "eval": "test",
    "evaluation": "test",
}
FIELD_NAMES = (
    "prompt", "completion", "response", "instruction", "input", "output", "chosen", "rejected", "label",
    "query", "answer", "system", "text", "context",
)
TEXT_SUFFIXES = ("txt", "text")

#: Bytes of members that one task reads of an archive that is not compressed.
RANGE_BYTES = 64 << 20
#: Members of one sample from which on its fields are reduced before they meet.
HOT_MEMBERS = 10_000
ROWS_PER_BATCH = 2_000
BYTES_PER_BATCH = 8 << 20
COLUMNS = ["archive", "split", "key", "field", "ord", "value"]
SCHEMA = "archive string, split string, key string, field string, ord long, value string"
#: A member; or, without a name, its archive: whether it can be read by ranges, and holds tables.
INDEX = ["archive", "plain", "tables", "ord", "name", "split", "key", "start", "size"]
INDEX_SCHEMA = "archive string, plain boolean, tables boolean, ord long, name string, split string, key string, start long, size long"


def _data_members(archive: tarfile.TarFile) -> Iterator[tarfile.TarInfo]:
    for member in archive:
        archive.members.clear()  # the archive would keep all it has seen
        if member.isfile() and not posixpath.basename(member.name).startswith((".", "__")):
            yield member


def _open(path: str) -> tuple[tarfile.TarFile, bool]:
    """An archive, and whether its members can be read by their places."""
    fs, inner = filesystem(path)
    try:
        return tarfile.open(fileobj=fs.open_input_file(inner), mode="r:"), True
    except tarfile.ReadError:
        return tarfile.open(fileobj=fs.open_input_stream(inner, compression=None), mode="r|*"), False


def _table_split(name: str) -> str:
    stem = posixpath.splitext(posixpath.basename(name))[0].lower()
    return next((w for w in SPLIT_WORDS if w in stem), "default")


class _Section(io.RawIOBase):
    """``size`` bytes of a file from ``start`` on; without ``start``, from where it stands."""

    def __init__(self, file, start: int | None, size: int):
        self.file, self.left = file, size
        if start is not None:
            file.seek(start)

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.file.read(min(len(buffer), self.left))
        self.left -= len(data)
        buffer[: len(data)] = data
        return len(data)


def _table_rows(name: str, section: _Section) -> Iterator[dict]:
    raw = io.BufferedReader(section)
    # Its head shows a UTF form; what is in no UTF form is taken for the usual 8-bit one.
    head = raw.peek(io.DEFAULT_BUFFER_SIZE)
    encoding = utf_of(head) or ("utf-8" if _starts_utf8(head) else EIGHT_BIT[0])
    text = io.TextIOWrapper(raw, encoding=encoding, errors="replace", newline="")
    if name.lower().endswith(".jsonl"):
        for line in text:
            try:
                row = json.loads(line)
            except ValueError:
                continue
            if isinstance(row, dict):
                yield row
    else:
        yield from csv.DictReader(text, delimiter="," if name.lower().endswith(".csv") else "\t")


def _starts_utf8(head: bytes) -> bool:
    try:
        codecs.getincrementaldecoder("utf-8")().decode(head)
    except UnicodeDecodeError:
        return False
    return True


def _sample_position(name: str) -> tuple[str, str, str, str]:
    """(split, key, field, suffix) of a sample member."""
    *folders, base = name.split("/")
    split = next((SPLIT_FOLDERS[f.lower()] for f in folders if f.lower() in SPLIT_FOLDERS), "default")
    key, *dots = base.split(".")
    suffix = dots[-1].lower() if dots else ""
    named = len(dots) > 1 and dots[0].lower() in FIELD_NAMES
    plain = not dots or suffix in TEXT_SUFFIXES
    return split, key, dots[0].lower() if named else "text" if plain else suffix, suffix


def _sample_fields(field: str, suffix: str, content: bytes) -> Iterator[tuple[str, str]]:
    """Field -> value as JSON. The members of a JSON object become fields themselves."""
    text = decode_bytes(content)
    if suffix != "json":
        yield field, json.dumps(text.strip(), ensure_ascii=False)
        return
    try:
        data = json.loads(text)
    except ValueError:
        data = text
    items = data.items() if isinstance(data, dict) else [("json", data)]
    for name, value in items:
        yield name, json.dumps(value, ensure_ascii=False)


def archive_index(path: str) -> Iterator[tuple]:
    """Rows of INDEX: the members, then the archive."""
    archive, plain = _open(path)
    sizes, found = [], False
    with archive:
        for ord, member in enumerate(_data_members(archive), 1):
            plain = plain and not member.issparse()
            split, key, _, _ = _sample_position(member.name)
            yield path, None, None, ord, member.name, split, key, member.offset_data, member.size
            if member.name.lower().endswith(TABLE_SUFFIXES):
                sizes.append(member.size > 0)
                if member.size and not found:
                    content = _Section(archive.extractfile(member), None, member.size)
                    found = next(_table_rows(member.name, content), None) is not None
    yield path, plain, bool(sizes) and all(sizes) and found, 0, None, None, None, None, None


def _member_rows(path: str, tables: bool, ord: int, name: str, section: _Section) -> Iterator[tuple]:
    """Rows of SCHEMA. Table rows have no key; their value is the whole record."""
    if tables:
        if name.lower().endswith(TABLE_SUFFIXES):
            split = _table_split(name)
            for row in _table_rows(name, section):
                yield path, split, None, None, ord, json.dumps(row, ensure_ascii=False)
        return
    split, key, field, suffix = _sample_position(name)
    yield path, split, key, "__key__", 0, json.dumps(key, ensure_ascii=False)
    for found, value in _sample_fields(field, suffix, section.read()):
        yield path, split, key, found, ord, value


def _archive_rows(path: str, tables: bool) -> Iterator[tuple]:
    """Rows of a whole archive, streamed."""
    archive, _ = _open(path)
    with archive:
        for ord, member in enumerate(_data_members(archive), 1):
            yield from _member_rows(path, tables, ord, member.name, _Section(archive.extractfile(member), None, member.size))


def _framed(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1]) if isinstance(row[-1], str) else 0
        if len(held) >= ROWS_PER_BATCH or size >= BYTES_PER_BATCH:
            yield pd.DataFrame(held, columns=columns)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


def index_archives(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The index of archives, one task for each."""

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                for frame in _framed(archive_index(path), INDEX):
                    yield frame.astype({"plain": "boolean", "tables": "boolean", "start": "Int64", "size": "Int64"})

    return one_task_each(spark, paths).mapInPandas(index, INDEX_SCHEMA)


def _read_ranges(members: DataFrame) -> DataFrame:
    """Rows of members of archives that are not compressed, by ranges of ``RANGE_BYTES``."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            path, file = None, None
            for batch in batches:
                for row in batch.itertuples(index=False):
                    if row.archive != path:
                        if file:
                            file.close()
                        fs, inner = filesystem(row.archive)
                        path, file = row.archive, fs.open_input_file(inner)
                    yield from _member_rows(path, row.tables, row.ord, row.name, _Section(file, row.start, row.size))

        yield from _framed(rows(), COLUMNS)

    total = members.agg(F.sum("size"), F.count_distinct("archive")).first()
    tasks = max((total[0] or 0) // RANGE_BYTES + 1, min(total[1], int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 1)
    ranges = members.repartition(tasks, "archive", F.floor(F.col("start") / RANGE_BYTES)).sortWithinPartitions("archive", "start")
    return ranges.select("archive", "tables", "ord", "name", "start", "size").mapInPandas(read, SCHEMA)


def _read_streams(spark: SparkSession, paths: list[str], tables: bool) -> DataFrame:
    """Rows of other archives, one task for each."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                yield from _framed(_archive_rows(path, tables), COLUMNS)

    return one_task_each(spark, paths).mapInPandas(read, SCHEMA)


def group_samples(rows: DataFrame, early: bool = False) -> DataFrame:
    """(_split, value): one JSON record per (archive, split, key).

    A field that occurs twice keeps its last value. Content is exchanged once; with ``early``
    the copies of a field are reduced by an exchange of their own first, for keys that have many.
    """
    scope = ["archive", "split", "key"]
    dealt = rows if early else rows.repartition(*scope)
    last = dealt.groupBy(*scope, "field").agg(F.max_by("value", "ord").alias("value"))
    grouped = last.groupBy(*scope).agg(F.sort_array(F.collect_list(F.struct("field", "value"))).alias("fields"))
    quoted = lambda c: F.to_json(c.cast("variant"))
    pairs = F.transform("fields", lambda f: F.concat(quoted(f["field"]), F.lit(":"), f["value"]))
    record = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    return grouped.select(F.col("split").alias(SPLIT), record.alias("value"))


def archive_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(_split, value): the records of archives as JSON. Only the index is written."""
    folder = scratch_dir(spark, "tar-index")
    index_archives(spark, paths).write.parquet(folder)
    index = spark.read.parquet(folder)
    archives = index.where("name IS NULL").select("archive", "plain", "tables")
    members = index.where("name IS NOT NULL").drop("plain", "tables").join(archives.where("plain"), "archive")
    kinds: dict[tuple[bool, bool], list[str]] = {}
    for r in archives.orderBy("archive").collect():  # a row for each path
        kinds.setdefault((r["plain"], r["tables"]), []).append(r["archive"])
    parts = []
    if (True, True) in kinds:
        parts.append(_read_ranges(members.where("tables")).select(F.col("split").alias(SPLIT), "value"))
    if (False, True) in kinds:
        parts.append(_read_streams(spark, kinds[False, True], True).select(F.col("split").alias(SPLIT), "value"))
    samples = []
    if (True, False) in kinds:
        samples.append(_read_ranges(members.where("NOT tables")))
    if (False, False) in kinds:
        samples.append(_read_streams(spark, kinds[False, False], False))
    if samples:
        rows = samples[0] if len(samples) == 1 else samples[0].unionAll(samples[1])
        scope = ["archive", "split", "key"]
        hot = index.where("name IS NOT NULL").groupBy(*scope).count().where(F.col("count") > HOT_MEMBERS).select(*scope)
        parts.append(group_samples(rows, early=not hot.isEmpty()))
    return reduce(DataFrame.unionAll, parts)


def read_tar(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The records of archives, with ``_split``.

    Records are written once, to the shared scratch folder, because their columns are known
    only after reading them.
    """
    records = scratch_dir(spark, "records")
    archive_records(spark, paths).write.partitionBy(SPLIT).text(records)
    df = read_jsonl(spark, [records], keep=[SPLIT])
    if not df.columns or df.columns == [SPLIT]:
        raise ValueError(f"no records in {', '.join(paths)}")
    return df
