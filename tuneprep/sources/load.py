"""Datasets from files and folders in any supported format."""

from __future__ import annotations

import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneprep.operators.splitting import SPLIT, SPLIT_NAMES, normalize_split
from tuneprep.session import scratch_dir
from tuneprep.sources.arrow_ipc import read_arrow
from tuneprep.sources.encoding import not_utf8, utf8_copies
from tuneprep.sources.files import (
    PARQUET_FOLDERS,
    SPLIT_FILES,
    SPLIT_SUFFIXES,
    exists,
    file_kind,
    filesystem,
    head,
    is_dir,
    is_json_array,
    known_file,
    listing,
    named_parquet,
    names,
    path_list,
    split_table,
)
from tuneprep.sources.jsonl import read_json_array, read_jsonl
from tuneprep.sources.sqlite import read_sqlite
from tuneprep.sources.tar import read_tar
from tuneprep.sources.text import read_text_files

DEFAULT = "default"
#: Files whose first bytes are looked at together.
HEADS_AT_ONCE = 32


class SchemaMismatch(ValueError):
    """Sources that cannot be merged because their columns differ."""


@dataclass
class Dataset:
    """A lazy dataset: rows with ``_split``, where they came from, class names of columns."""

    df: DataFrame
    source: str
    features: dict[str, list[str]] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != SPLIT]


def has_quoted_newlines(spark: SparkSession, paths: Sequence[str]) -> bool:
    """Whether some line has an odd number of quotes, as it must where a quoted value holds a newline."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(list(paths)).where(quotes % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, paths: Sequence[str], separator: str = ",", multiline: bool | None = None) -> DataFrame:
    """Delimited text with a header, every column a string.

    ``multiline`` allows newlines in quotes, for which a file must be one task. None: as the
    files need it, which one parallel pass over their lines decides.
    """
    if multiline is None:
        multiline = has_quoted_newlines(spark, paths)
    return spark.read.csv(list(paths), header=True, sep=separator, inferSchema=False, multiLine=multiline, escape='"')


def read_parquet_folder(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet files of a folder, or of its ``data`` folder, or of its subfolders."""
    files, folders = listing(path)
    if not any(named_parquet(f) for f in files):
        data = [d for d in folders if d.endswith("/data")]
        path = data[0] if data else path
    return spark.read.parquet(path, pathGlobFilter="*.{parquet,pq,parq,parquet.*}", recursiveFileLookup=True)


def holds_parquet(path: str) -> bool:
    files, folders = listing(path)
    for folder in [d for d in folders if d.rsplit("/", 1)[-1] in PARQUET_FOLDERS]:
        files = files + listing(folder)[0]
    return any(named_parquet(f) for f in files)


def _kind(path: str) -> tuple[str, list[str]]:
    """The kind of a file, or of a folder that Spark wrote under a file's name, and its parts."""
    parts = (listing(path)[0] or [path]) if is_dir(path) else [path]
    kind = file_kind(path, parts[0])
    return ("array" if kind == "json" and is_json_array(parts[0]) else kind), parts


def _utf8(spark: SparkSession, paths: list[str], parts: list[str], encoding: str) -> list[str]:
    """What to read instead of ``paths``, whose files are ``parts``: those that are not UTF-8 are copied to scratch."""
    other = not_utf8(spark, parts) if encoding == "auto" else set(parts) if encoding == "detect" else set()
    if not other:
        return paths
    copies = scratch_dir(spark, "utf8")
    utf8_copies(spark, sorted(other), copies).write.format("noop").mode("overwrite").save()
    return [p for p in parts if p not in other] + [copies]


def read_files(spark: SparkSession, kind: str, paths: Sequence[str], multiline: bool | None = None) -> DataFrame:
    """Text files of one kind by one reader."""
    if kind in ("csv", "tsv"):
        return read_csv(spark, paths, "," if kind == "csv" else "\t", multiline)
    return read_text_files(spark, paths) if kind == "text" else read_jsonl(spark, paths)


def load_file(spark: SparkSession, path: str, encoding: str = "auto", multiline: bool | None = None) -> DataFrame:
    """One file (or ``file.db::table``) as rows, with ``_split`` where the file has splits.

    ``encoding`` is ``utf-8``, ``detect``, or ``auto``: detect where a file is not UTF-8 from
    its first byte to its last, which one parallel pass finds out. UTF-8 files are read in
    parallel pieces; others are copied to UTF-8 in the shared scratch folder first.
    ``multiline`` is that of ``read_csv``.
    """
    file, table = split_table(path)
    kind, parts = ("sqlite", [file]) if table else _kind(file)
    if kind == "parquet":
        return spark.read.parquet(file)
    if kind == "arrow":
        return read_arrow(spark, [file])
    if kind == "sqlite":
        return read_sqlite(spark, file, table)
    if kind == "tar":
        return read_tar(spark, [file])
    if kind == "array":
        return read_json_array(spark, parts)
    return read_files(spark, kind, _utf8(spark, [file], parts, encoding), multiline)


def load_files(spark: SparkSession, paths: Sequence[str], encoding: str = "auto", multiline: bool | None = None) -> DataFrame:
    """Many files as the rows of one table. Files of a kind, for CSV those of one header, share a reader."""
    groups: dict[tuple[str, bytes], list[str]] = {}
    single: list[str] = []
    with ThreadPoolExecutor(HEADS_AT_ONCE) as pool:
        for path, (kind, parts) in zip(paths, pool.map(_kind, paths), strict=True):
            if kind in ("csv", "tsv", "text", "json") and parts == [path]:
                groups.setdefault((kind, head(path).split(b"\n")[0] if kind in ("csv", "tsv") else b""), []).append(path)
            elif kind in ("array", "arrow", "parquet", "tar") and parts == [path]:
                groups.setdefault((kind, b""), []).append(path)
            else:
                single.append(path)
    frames = []
    for (kind, _), own in groups.items():
        if kind == "array":
            frames.append(read_json_array(spark, own))
        elif kind == "arrow":
            frames.append(read_arrow(spark, own))
        elif kind == "tar":
            frames.append(read_tar(spark, own).drop(SPLIT))
        elif kind == "parquet":
            frames.extend(spark.read.parquet(p) for p in own)
        else:
            frames.append(read_files(spark, kind, _utf8(spark, own, own, encoding), multiline))
    frames += [load_file(spark, p, encoding, multiline).drop(SPLIT) for p in single]
    return union_all(frames)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    df = frames[0]
    for other in frames[1:]:
        df = df.unionByName(other, allowMissingColumns=True)
    return df


def _with_split(df: DataFrame, split: str) -> DataFrame:
    return df.withColumn(SPLIT, F.lit(split))


def _inner_split(rows: DataFrame, split: str, file: str) -> DataFrame:
    """Of an archive or database named for a split and with splits of its own: the rows of that split.

    A file whose rows are all of one split, or of none, is that split whatever it is called.
    """
    own = normalize_split(F.col(SPLIT))
    wanted = SPLIT_NAMES.get(split, split)
    inner = sorted(r[0] for r in rows.select(own).distinct().toLocalIterator())
    if len(inner) <= 1:
        return rows.drop(SPLIT)
    for name in (wanted, DEFAULT):
        if name in inner:
            return rows.where(own == name).drop(SPLIT)
    raise ValueError(f"'{file}' stands for the split '{split}' but has the splits {', '.join(inner)}; say which one with '::'")


def _split_files(files: Sequence[str]) -> dict[str, str]:
    """Split -> file; for each split the first suffix of SPLIT_SUFFIXES that exists."""
    names = {f.rsplit("/", 1)[-1]: f for f in files}
    found = {}
    for split in SPLIT_FILES:
        name = next((split + s for s in SPLIT_SUFFIXES if split + s in names), None)
        if name:
            found[split] = names[name]
    return found


def _json_file(path: str) -> dict:
    fs, inner = filesystem(path)
    with fs.open_input_file(inner) as f:
        return json.loads(f.read())


def class_names(folder: str) -> dict[str, list[str]]:
    """Class names of label columns, from the folder's ``dataset_info.json``."""
    info = f"{folder}/dataset_info.json"
    features = _json_file(info).get("features") or {} if exists(info) else {}
    return {c: list(f["names"]) for c, f in features.items() if isinstance(f, dict) and f.get("names")}


def _saved_splits(spark: SparkSession, folder: str) -> Dataset | None:
    """A saved dataset dictionary: one folder of Arrow shards per split."""
    index = f"{folder}/dataset_dict.json"
    if not exists(index):
        return None
    frames, features = [], {}
    for split in _json_file(index).get("splits", []):
        shards = [f for f in listing(f"{folder}/{split}")[0] if f.endswith(".arrow")]
        if shards:
            frames.append(_with_split(read_arrow(spark, shards), split))
            features = features or class_names(f"{folder}/{split}")
    return Dataset(union_all(frames), folder, features) if frames else None


def with_class_names(df: DataFrame, features: dict[str, list[str]]) -> DataFrame:
    for column, names in features.items():
        if column in df.columns:
            df = df.withMetadata(column, {"names": names})
    return df


def load_folder(spark: SparkSession, folder: str, encoding: str = "auto", multiline: bool | None = None) -> Dataset:
    saved = _saved_splits(spark, folder)
    if saved:
        return Dataset(with_class_names(saved.df, saved.features), folder, saved.features)
    if any(name.startswith(f"{SPLIT}=") for name in names(folder)):  # what write_records wrote
        return Dataset(read_jsonl(spark, [folder], keep=[SPLIT]), folder)
    files, folders = listing(folder)
    splits = _split_files(files + folders)
    if splits:
        frames = []
        for split, file in splits.items():
            rows = load_file(spark, file, encoding, multiline)
            if SPLIT in rows.columns:
                rows = _inner_split(rows, split, file)
            frames.append(_with_split(rows, split))
        return Dataset(union_all(frames), folder)
    if holds_parquet(folder):
        return Dataset(_with_split(read_parquet_folder(spark, folder), DEFAULT), folder)
    known = [f for f in files if known_file(f)]
    if not known:
        raise ValueError(f"no dataset files in '{folder}'")
    features = class_names(folder)
    rows = load_files(spark, known, encoding, multiline)
    return Dataset(with_class_names(_with_split(rows, DEFAULT), features), folder, features)


def load_one(spark: SparkSession, path: str, encoding: str = "auto", multiline: bool | None = None) -> Dataset:
    file, _ = split_table(path)
    if not exists(file):
        raise FileNotFoundError(f"there is no file or folder '{file}'")
    if is_dir(file):
        return load_folder(spark, file.rstrip("/"), encoding, multiline)
    df = load_file(spark, path, encoding, multiline)
    return Dataset(df if SPLIT in df.columns else _with_split(df, DEFAULT), path)


def column_differences(base: Sequence[str], other: Sequence[str]) -> tuple[list[str], list[str]]:
    """(missing in other, extra in other)."""
    return sorted(set(base) - set(other)), sorted(set(other) - set(base))


def merge(datasets: Sequence[Dataset]) -> Dataset:
    """All rows of several datasets with equal columns; splits are given up."""
    base = datasets[0]
    for other in datasets[1:]:
        missing, extra = column_differences(base.columns, other.columns)
        parts = [f"Missing in '{other.source}': {missing}"] if missing else []
        parts += [f"Extra in '{other.source}': {extra}"] if extra else []
        if parts:
            raise SchemaMismatch(
                f"'{base.source}' has columns {base.columns}, '{other.source}' has {other.columns}. " + "; ".join(parts)
            )
    rows = union_all([d.df.drop(SPLIT) for d in datasets])
    source = f"Merged ({len(datasets)} files: {', '.join(d.source.rsplit('/', 1)[-1] for d in datasets)})"
    return Dataset(_with_split(rows, DEFAULT), source, base.features)


def load(spark: SparkSession, paths, encoding: str = "auto", multiline: bool | None = None) -> Dataset:
    """A file, a folder, ``db::table``, or several of them merged.

    ``paths`` may also be a callable that takes the session and returns a DataFrame or a Dataset.
    """
    if callable(paths):
        made = paths(spark)
        if isinstance(made, Dataset):
            return made
        return Dataset(made if SPLIT in made.columns else _with_split(made, DEFAULT), getattr(paths, "__name__", "callable"))
    names = path_list(paths)
    if not names:
        raise ValueError("give at least one path")
    datasets = [load_one(spark, name, encoding, multiline) for name in names]
    return datasets[0] if len(datasets) == 1 else merge(datasets)
