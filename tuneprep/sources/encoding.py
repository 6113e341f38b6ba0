"""Ingest of text files in unknown encodings.

Files are spread over the tasks. Each task streams a file twice: once to find the
encoding, once to decode it, so memory does not depend on the size of a file.
"""

from __future__ import annotations

import codecs
import io
import posixpath
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneprep.sources.files import HEAD_BYTES, filesystem, head, utf_of

# What is tried when a file is not UTF, in this order.
EIGHT_BIT = ("cp1252", "latin-1", "iso-8859-15", "mac_roman")
CONTROL_LOOKAHEAD = 4096
COMPRESSED = (".gz", ".bz2", ".zst", ".xz", ".lz4", ".snappy", ".deflate")

CHUNK = 1 << 20
LINES_PER_BATCH = 20_000
SCHEMA = "path string, encoding string, line_no long, line string"


def _decodes(path: str, encoding: str) -> bool:
    fs, inner = filesystem(path)
    decoder = codecs.getincrementaldecoder(encoding)()
    with fs.open_input_stream(inner) as f:
        try:
            while chunk := f.read(CHUNK):
                decoder.decode(chunk)
            decoder.decode(b"", final=True)
        except UnicodeDecodeError:
            return False
    return True


def detect_encoding(path: str) -> str:
    """The encoding of a file; ``utf-8`` with replacement is the last resort."""
    sample = head(path)
    utf = utf_of(sample)
    if utf and _decodes(path, utf):
        return utf
    if _decodes(path, "utf-8"):
        return "utf-8"
    for name in EIGHT_BIT:
        if name == "latin-1" and any(0x80 <= b <= 0x9F for b in sample[:CONTROL_LOOKAHEAD]):
            continue
        if _decodes(path, name):
            return name
    return "utf-8"


def decode_bytes(data: bytes) -> str:
    """Text by the rules of ``detect_encoding``, for content that is in memory."""
    names = [utf_of(data[:HEAD_BYTES]), "utf-8", *EIGHT_BIT]
    for name in names:
        if name is None or (name == "latin-1" and any(0x80 <= b <= 0x9F for b in data[:CONTROL_LOOKAHEAD])):
            continue
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


def open_text(path: str, encoding: str | None = None, newline: str | None = None) -> io.TextIOWrapper:
    fs, inner = filesystem(path)
    raw = io.BufferedReader(fs.open_input_stream(inner), CHUNK)
    return io.TextIOWrapper(raw, encoding=encoding or detect_encoding(path), errors="replace", newline=newline)


def decoded_lines(path: str) -> Iterator[tuple[str, int, str]]:
    encoding = detect_encoding(path)
    with open_text(path, encoding) as text:
        for number, line in enumerate(text, 1):
            yield encoding, number, line.rstrip("\n")


def not_utf8(spark: SparkSession, paths: list[str]) -> set[str]:
    """The files of which some line is no UTF-8, or whose head shows UTF-16 or UTF-32.

    Lines are checked in parallel pieces, as they are in the file. Compressed files are taken
    for UTF-8.
    """
    plain = [p for p in paths if not p.lower().endswith(COMPRESSED)]
    with ThreadPoolExecutor(32) as pool:
        marked = {p for p, utf in zip(plain, pool.map(lambda p: utf_of(head(p)), plain), strict=True) if utf not in (None, "utf-8-sig")}
    rest = {posixpath.abspath(filesystem(p)[1]): p for p in plain if p not in marked}
    if not rest:
        return marked
    lines = spark.read.text(list(rest.values())).select(F.col("_metadata.file_path").alias("path"), "value")
    bad = lines.where(~F.is_valid_utf8("value")).select("path").distinct().toLocalIterator()
    return marked | {rest[posixpath.abspath(filesystem(r["path"])[1])] for r in bad}


def one_task_each(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path): a task for each file. Sliced, not dealt by an exchange, which gives some tasks several files and others none."""
    return spark.createDataFrame(spark.sparkContext.parallelize([(p,) for p in paths], max(1, len(paths))), "path string")


def utf8_copies(spark: SparkSession, paths: list[str], folder: str) -> DataFrame:
    """(path, copy): every file as UTF-8 in ``folder``, one task per file.

    The copies keep the file's line structure, so all readers work on them, in parallel
    where they can split a file. A copy gets its name when it is complete.
    """

    def transcode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        target, inner = filesystem(folder)
        for batch in batches:
            copies = []
            for path in batch["path"]:
                name = f"{zlib.crc32(path.encode()):08x}-{posixpath.basename(path)}"
                unfinished = f"{inner}/.{name}.{TaskContext.get().taskAttemptId()}"
                target.create_dir(inner, recursive=True)
                with open_text(path, newline="") as text, target.open_output_stream(unfinished) as out:
                    while part := text.read(CHUNK):
                        out.write(part.encode("utf-8", errors="replace"))
                target.move(unfinished, f"{inner}/{name}")
                copies.append(f"{folder}/{name}")
            yield pd.DataFrame({"path": batch["path"], "copy": copies})

    return one_task_each(spark, paths).mapInPandas(transcode, "path string, copy string")


def read_any_encoding(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, encoding, line_no, line) of text files in whatever encoding they have."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "encoding", "line_no", "line"]
        for batch in batches:
            for path in batch["path"]:
                rows = []
                for encoding, number, line in decoded_lines(path):
                    rows.append((path, encoding, number, line))
                    if len(rows) >= LINES_PER_BATCH:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    return one_task_each(spark, paths).mapInPandas(decode, SCHEMA)
