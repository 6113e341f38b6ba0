"""Files of every readable kind, written from the tables by Spark tasks.

Each task writes the rows of its own partition, so writing grows with the table as
reading does. A file appears under its final name only when it is complete, and a task
that runs again replaces it.
"""

from __future__ import annotations

import io
import json
import os
import sqlite3
import tarfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tuneprep.session import local_path
from tuneprep.sources.files import filesystem

Batches = Iterator[pd.DataFrame]


def write_files(df: DataFrame, folder: str, suffix: str, write: Callable[[str, Batches], None]) -> str:
    """Run ``write(path, batches)`` in every task; returns the folder."""

    def one_file(batches: Batches) -> Batches:
        first = next((b for b in batches if len(b)), None)
        if first is None:
            return

        def rest() -> Batches:
            yield first
            yield from batches

        fs, inner = filesystem(folder)
        fs.create_dir(inner, recursive=True)
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}{suffix}"
        unfinished = f"{inner}/.{name}.{context.taskAttemptId()}"
        with_scheme = unfinished if isinstance(fs, pafs.LocalFileSystem) else f"{folder}/{os.path.basename(unfinished)}"
        write(with_scheme, rest())
        fs.move(unfinished, f"{inner}/{name}")
        yield pd.DataFrame({"file": [name]})

    df.mapInPandas(one_file, "file string").write.format("noop").mode("overwrite").save()
    return folder


def _plain(value):
    return value.item() if hasattr(value, "item") else value


def arrow_file(path: str, batches: Batches) -> None:
    fs, inner = filesystem(path)
    writer = None
    with fs.open_output_stream(inner) as out:
        for batch in batches:
            table = pa.RecordBatch.from_pandas(batch, preserve_index=False)
            writer = writer or ipc.new_file(out, table.schema)
            writer.write_batch(table)
        writer.close()


def arrow_stream(path: str, batches: Batches) -> None:
    """The stream format, with the columns in the opposite order."""
    fs, inner = filesystem(path)
    writer = None
    with fs.open_output_stream(inner) as out:
        for batch in batches:
            table = pa.RecordBatch.from_pandas(batch[list(batch.columns)[::-1]], preserve_index=False)
            writer = writer or ipc.new_stream(out, table.schema)
            writer.write_batch(table)
        writer.close()


def json_array(path: str, batches: Batches) -> None:
    """A pretty-printed array, with elements that are no objects in between."""
    fs, inner = filesystem(path)
    with fs.open_output_stream(inner) as out:
        out.write(b"[\n")
        for batch in batches:
            for row in batch.to_dict("records"):
                row = {k: _plain(v) for k, v in row.items()}
                out.write(json.dumps(row, indent=1, ensure_ascii=False).encode() + b',\n[1, {"a": 2}],\n')
        out.write(b'"end"\n]\n')


def sqlite_tables(path: str, batches: Batches) -> None:
    """One table per value of the column ``_table``; INTEGER and TEXT columns."""
    with sqlite3.connect(local_path(path)) as db:
        for batch in batches:
            columns = [c for c in batch.columns if c != "_table"]
            kinds = {c: "INTEGER" if pd.api.types.is_integer_dtype(batch[c]) else "TEXT" for c in columns}
            defined = ", ".join(f'"{c}" {k}' for c, k in kinds.items())
            for name in ("train", "valid", "test") if batch["_table"].iloc[0] != "rows" else ("rows",):
                db.execute(f'CREATE TABLE IF NOT EXISTS "{name}" ({defined})')
            for name, part in batch.groupby("_table"):
                marks = ", ".join("?" * len(columns))
                rows = part[columns].astype(object).values.tolist()
                db.executemany(f'INSERT INTO "{name}" VALUES ({marks})', rows)
    db.close()


def _add(archive: tarfile.TarFile, name: str, content: bytes) -> None:
    member = tarfile.TarInfo(name)
    member.size = len(content)
    archive.addfile(member, io.BytesIO(content))


def sample_archive(path: str, batches: Batches) -> None:
    """A compressed archive of samples: JSON fields, a text and a named field each."""
    fs, inner = filesystem(path)
    with fs.open_output_stream(inner) as out, tarfile.open(fileobj=out, mode="w|gz", compresslevel=1) as archive:
        for batch in batches:
            for row in batch.to_dict("records"):
                key = f"{row['split']}/{row['doc_id']}"
                fields = {"lang": row["lang"], "size": int(row["n_chars"]), "about": {"source": row["source"]}}
                _add(archive, f"{key}.json", json.dumps(fields).encode())
                _add(archive, f"{key}.completion.txt", row["source"].encode())
                _add(archive, f"{key}.txt", b"replaced by the next member")
                _add(archive, f"{key}.txt", row["text"].encode())
                _add(archive, f"{row['split']}/.hidden.txt", b"ignored")


def text_archive(encoding: str) -> Callable[[str, Batches], None]:
    """An archive, not compressed, with a text file for each row."""

    def write(path: str, batches: Batches) -> None:
        fs, inner = filesystem(path)
        with fs.open_output_stream(inner) as out, tarfile.open(fileobj=out, mode="w|") as archive:
            for batch in batches:
                for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                    _add(archive, f"{doc_id}.txt", text.encode(encoding))

    return write


def table_archive(path: str, batches: Batches) -> None:
    """An archive with a JSONL table of its rows, and a file that does not count."""
    lines = io.BytesIO()
    for batch in batches:
        for row in batch.to_dict("records"):
            row = {k: _plain(v) for k, v in row.items()}
            lines.write(json.dumps(row, ensure_ascii=False).encode() + b"\n{broken\n")
    fs, inner = filesystem(path)
    with fs.open_output_stream(inner) as out, tarfile.open(fileobj=out, mode="w|") as archive:
        _add(archive, "README.md", b"not data")
        _add(archive, "data/my-train-set.jsonl", lines.getvalue())


def encoded_lines(encoding: str) -> Callable[[str, Batches], None]:
    def write(path: str, batches: Batches) -> None:
        fs, inner = filesystem(path)
        with fs.open_output_stream(inner) as out:
            mark = b"\xff\xfe" if encoding == "utf-16" else b"\xef\xbb\xbf" if encoding == "utf-8-sig" else b""
            out.write(mark)
            plain = {"utf-16": "utf-16-le", "utf-8-sig": "utf-8"}.get(encoding, encoding)
            for batch in batches:
                out.write("".join(line + "\n" for line in batch["line"]).encode(plain))

    return write
