"""What a path holds: path lists, file kinds, encodings of a file's head.

Runs on the driver and reads names and a few header bytes only.
"""

from __future__ import annotations

import os
from collections.abc import Iterable

import pyarrow.fs as pafs

# Suffixes, magic numbers and names by which data is recognised.
PARQUET_SUFFIXES = (".parquet", ".pq", ".parq")
SUFFIX_KINDS = {
    ".arrow": "arrow",
    ".jsonl": "json",
    ".json": "json",
    ".csv": "csv",
    ".tsv": "tsv",
    ".tab": "tsv",
    ".txt": "text",
    ".text": "text",
    ".sqlite": "sqlite",
    ".db": "sqlite",
    ".sqlite3": "sqlite",
    ".tar": "tar",
    ".tar.gz": "tar",
    ".tgz": "tar",
    ".tar.bz2": "tar",
    ".tar.xz": "tar",
}
MAGIC_KINDS = {b"PAR1": "parquet", b"ARROW1": "arrow", b"SQLite format 3\x00": "sqlite"}
UNREADABLE = {".duckdb": "DuckDB", ".ddb": "DuckDB", ".lance": "Lance"}
WEIGHTS = (".safetensors", ".bin", ".pt")
SPLIT_FILES = ("train", "valid", "validation", "val", "test", "dev")
SPLIT_SUFFIXES = (
    ".jsonl", ".parquet", ".pq", ".parq", ".arrow", ".json", ".csv", ".tsv", ".tab", ".txt", ".text",
    ".sqlite", ".db", ".sqlite3", ".tar", ".tar.gz", ".tgz",
)
PARQUET_FOLDERS = ("data", "train", "test", "valid", "validation", "dev")
UTF_MARKS = {
    b"\xef\xbb\xbf": "utf-8-sig",
    b"\xff\xfe\x00\x00": "utf-32",
    b"\x00\x00\xfe\xff": "utf-32",
    b"\xff\xfe": "utf-16",
    b"\xfe\xff": "utf-16",
}
HEAD_BYTES = 8192
NUL_SHARE = 0.15


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system and the path in it, for plain paths and for URIs."""
    if "://" in uri or uri.startswith("file:"):
        if uri.startswith("file:/") and not uri.startswith("file://"):
            uri = "file://" + uri[len("file:"):]
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), os.path.abspath(os.path.expanduser(uri))


def path_list(paths: str | os.PathLike | Iterable) -> list[str]:
    """A list of paths from a list, a newline-separated or a comma-separated text."""
    if isinstance(paths, os.PathLike):
        return [os.fspath(paths)]
    if not isinstance(paths, str):
        return [p for item in paths for p in path_list(item)]
    lines = [p.strip() for p in paths.splitlines() if p.strip()]
    if len(lines) == 1 and "," in lines[0] and not exists(lines[0]):
        return [p.strip() for p in lines[0].split(",") if p.strip()]
    return lines


def split_table(path: str) -> tuple[str, str | None]:
    """``file.db::table`` -> (file, table)."""
    file, mark, table = path.partition("::")
    return (file.strip(), table.strip() or None) if mark else (path, None)


def file_type(path: str) -> pafs.FileType:
    fs, inner = filesystem(path)
    return fs.get_file_info(inner).type


def exists(path: str) -> bool:
    return file_type(path) != pafs.FileType.NotFound


def is_dir(path: str) -> bool:
    return file_type(path) == pafs.FileType.Directory


def listing(path: str) -> tuple[list[str], list[str]]:
    """(files, folders) directly in a folder, sorted by name, hidden ones left out."""
    fs, inner = filesystem(path)
    base = path.rstrip("/")
    found = [i for i in fs.get_file_info(pafs.FileSelector(inner)) if not i.base_name.startswith((".", "_"))]
    found.sort(key=lambda i: i.base_name)
    files = [f"{base}/{i.base_name}" for i in found if i.type == pafs.FileType.File]
    folders = [f"{base}/{i.base_name}" for i in found if i.type == pafs.FileType.Directory]
    return files, folders


def names(path: str) -> list[str]:
    """All names directly in a folder, hidden ones too."""
    fs, inner = filesystem(path)
    return sorted(i.base_name for i in fs.get_file_info(pafs.FileSelector(inner)))


def head(path: str, size: int = HEAD_BYTES) -> bytes:
    fs, inner = filesystem(path)
    with fs.open_input_file(inner) as f:
        return f.read(size)


def _suffix(name: str, suffixes: Iterable[str]) -> str | None:
    low = name.lower()
    return max((s for s in suffixes if low.endswith(s)), key=len, default=None)


def named_parquet(path: str) -> bool:
    name = os.path.basename(path).lower()
    return name.endswith(PARQUET_SUFFIXES) or ".parquet." in name


def file_kind(path: str, first: str | None = None) -> str:
    """parquet, arrow, json, csv, tsv, text, sqlite or tar; by name, then by content.

    ``first`` is a file to look into when ``path`` is a folder named like a file.
    """
    name = os.path.basename(path)
    if named_parquet(path):
        return "parquet"
    if name.lower().endswith(WEIGHTS):
        raise ValueError(f"'{name}' holds model weights, not a dataset")
    other = _suffix(name, UNREADABLE)
    if other:
        raise ValueError(f"{UNREADABLE[other]} files are not read; export '{name}' to Parquet")
    start = head(first or path, 16)
    by_magic = next((kind for magic, kind in MAGIC_KINDS.items() if start.startswith(magic)), None)
    if by_magic in ("parquet", "arrow"):
        return by_magic
    by_name = _suffix(name, SUFFIX_KINDS)
    return SUFFIX_KINDS[by_name] if by_name else by_magic or "json"


def known_file(path: str) -> bool:
    return named_parquet(path) or _suffix(os.path.basename(path), SUFFIX_KINDS) is not None


def utf_of(sample: bytes) -> str | None:
    """The UTF form a file's head shows: by its mark, or UTF-16/32 by its NUL bytes."""
    for mark, name in UTF_MARKS.items():
        if sample.startswith(mark):
            return name
    if sample and sample.count(0) / len(sample) >= NUL_SHARE:
        even, odd = sample[0::2].count(0), sample[1::2].count(0)
        order = ["utf-16-le", "utf-16-be"] if odd >= even else ["utf-16-be", "utf-16-le"]
        for name in [*order, "utf-32-le", "utf-32-be"]:
            whole = sample[: len(sample) - len(sample) % 4]
            try:
                if "\x00" not in whole.decode(name):
                    return name
            except UnicodeDecodeError:
                continue
    return None


def is_json_array(path: str) -> bool:
    sample = head(path)
    text = sample.decode(utf_of(sample) or "utf-8", errors="replace")
    return text.lstrip(chr(0xFEFF) + " \t\r\n").startswith("[")
