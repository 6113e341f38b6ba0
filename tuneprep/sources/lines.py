"""Numbered lines of text files, as a Spark data source.

Files are cut into ranges of ``RANGE_BYTES`` here, not by Spark's planning, whatever the session's
settings are: a range is one input partition, and so are many small files together. One pass
counts the lines that begin in the ranges on which a later number depends; every range then knows
the number of its first line, so a second pass numbers lines where they are read. Nothing is
joined and no line moves.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tuneprep.session import scratch_dir
from tuneprep.sources.files import filesystem

#: Bytes of a file that are one task (more than a byte-order mark has).
RANGE_BYTES = 64 << 20
#: Tasks that read small files open this many at most.
FILES_PER_TASK = 256
#: Bytes read at once.
CHUNK_BYTES = 4 << 20
_STREAMED = (".gz", ".bz2", ".zst")
_UNKNOWN = (".snappy", ".lz4", ".deflate", ".xz")
_MARK = b"\xef\xbb\xbf"


@dataclass
class LineRange:
    """The lines of ``file`` that begin in [start, stop); a compressed file is one range."""

    part: int
    file: str
    size: int
    start: int
    stop: int
    first: int = 1


@dataclass
class LineRanges(InputPartition):
    """What one task reads."""

    ranges: list[LineRange]


def _files(path: str) -> Iterator[tuple[str, int]]:
    """Files at or under a path with their sizes, from one listing; names that begin with a dot or underscore are left out."""
    fs, inner = filesystem(path)
    info = fs.get_file_info(inner)
    if info.is_file:
        yield path, info.size
        return
    if info.type != pafs.FileType.Directory:
        raise FileNotFoundError(path)
    base, cut = path.rstrip("/"), len(inner.rstrip("/"))
    for found in fs.get_file_info(pafs.FileSelector(inner, recursive=True)):
        name = found.path[cut:]
        if found.is_file and not any(part.startswith((".", "_")) for part in name.split("/")):
            yield base + name, found.size


def _ranges(paths: Sequence[str]) -> list[LineRange]:
    found: list[LineRange] = []
    for file, size in sorted({f for path in paths for f in _files(path)}):
        if file.lower().endswith(_UNKNOWN):
            raise ValueError(f"lines of '{file}' cannot be numbered: its compression is not known here")
        step = max(1, size) if file.lower().endswith(_STREAMED) else RANGE_BYTES
        found += [LineRange(0, file, size, at, min(at + step, size)) for at in range(0, size, step)]
    for k, r in enumerate(found):
        r.part = k
    return found


def _packed(ranges: Sequence[LineRange]) -> list[list[LineRange]]:
    """Neighbouring ranges as tasks of ``RANGE_BYTES`` and ``FILES_PER_TASK`` at most."""
    tasks: list[list[LineRange]] = []
    room = 0
    for r in ranges:
        bytes_ = r.stop - r.start
        # A compressed file is read on its own.
        alone = r.file.lower().endswith(_STREAMED)
        if not tasks or alone or bytes_ > room or len(tasks[-1]) >= FILES_PER_TASK:
            tasks.append([])
            room = RANGE_BYTES
        tasks[-1].append(r)
        room = 0 if alone else room - bytes_
    return tasks


class _Pieces:
    """Bytes read in pieces, given out again as blocks of whole lines joined by a newline.

    A line ends at CR, LF or both.
    """

    def __init__(self) -> None:
        self.rest = b""

    def add(self, piece: bytes) -> bytes | None:
        held = self.rest + piece
        # A CR at the end may be half of a line end.
        tail = held[-1:] if held.endswith(b"\r") else b""
        held = held[: len(held) - len(tail)].replace(b"\r\n", b"\n").replace(b"\r", b"\n")
        cut = held.rfind(b"\n")
        self.rest = held[cut + 1 :] + tail
        return held[:cut] if cut >= 0 else None

    def end(self) -> bytes | None:
        """The last line, if it has begun."""
        rest, self.rest = self.rest, b""
        return rest.removesuffix(b"\r") if rest else None


def _first_line(f: pa.NativeFile, start: int, stop: int) -> int:
    """Where the first line begins that begins at ``start`` or later; ``stop`` if there is none before."""
    before = f.read_at(2, start - 1)
    if before[:1] == b"\n":
        return start
    if before[:1] == b"\r":
        return start + (before[1:] == b"\n")
    at = start
    while at < stop:
        piece = f.read_at(min(CHUNK_BYTES, stop - at), at)
        ends = [k for k in (piece.find(b"\n"), piece.find(b"\r")) if k >= 0]
        if ends:
            end = at + min(ends)
            return end + (2 if f.read_at(2, end) == b"\r\n" else 1)
        at += len(piece)
    return stop


def _blocks(r: LineRange) -> Iterator[bytes]:
    fs, inner = filesystem(r.file)
    if fs.get_file_info(inner).size != r.size:
        raise RuntimeError(f"'{r.file}' changed between counting its lines and reading them")
    pieces = _Pieces()
    if r.file.lower().endswith(_STREAMED):
        with fs.open_input_stream(inner) as stream:
            first = True
            while piece := stream.read(CHUNK_BYTES):
                block = pieces.add(piece.removeprefix(_MARK) if first else piece)
                first = False
                if block is not None:
                    yield block
        if (block := pieces.end()) is not None:
            yield block
        return
    with fs.open_input_file(inner) as f:
        at = _first_line(f, r.start, r.stop) if r.start else len(_MARK) * (f.read_at(3, 0) == _MARK)
        if at >= r.stop:
            return
        while at < r.stop:
            piece = f.read_at(min(CHUNK_BYTES, r.stop - at), at)
            at += len(piece)
            if (block := pieces.add(piece)) is not None:
                yield block
        # The last line may end in a later range; a CR has ended it in any case.
        while pieces.rest and not pieces.rest.endswith(b"\r") and at < r.size:
            piece = f.read_at(min(CHUNK_BYTES, r.size - at), at)
            at += len(piece)
            ends = [k for k in (piece.find(b"\n"), piece.find(b"\r")) if k >= 0]
            pieces.rest += piece[: min(ends)] if ends else piece
            if ends:
                break
        if (block := pieces.end()) is not None:
            yield block


def _lines(block: bytes) -> pa.Array:
    try:
        text = pa.array([block], pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        text = pa.array([block.decode("utf-8", "replace")], pa.string())
    return pc.split_pattern(text, "\n").values


class _LineReader(DataSourceReader):
    def __init__(self, plan: str, count: bool):
        self.plan, self.count = plan, count

    def partitions(self) -> list[InputPartition]:
        fs, inner = filesystem(self.plan)
        with fs.open_input_stream(inner) as f:
            return [LineRanges([LineRange(**r) for r in task]) for task in json.loads(f.read())]

    def read(self, partition: LineRanges | None) -> Iterator[pa.RecordBatch]:
        for r in partition.ranges if partition else ():  # None is what Spark asks for if there is no range
            yield from self._count(r) if self.count else self._numbered(r)

    @staticmethod
    def _count(r: LineRange) -> Iterator[pa.RecordBatch]:
        n = sum(block.count(b"\n") + 1 for block in _blocks(r))
        yield pa.RecordBatch.from_arrays([pa.array([r.part]), pa.array([n])], names=["part", "lines"])

    @staticmethod
    def _numbered(r: LineRange) -> Iterator[pa.RecordBatch]:
        first = r.first
        for block in _blocks(r):
            lines = _lines(block)
            numbers = pa.array(range(first, first + len(lines)), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.repeat(r.file, len(lines)), numbers, lines], names=["file", "line_no", "line"])
            first += len(lines)


class NumberedLines(DataSource):
    """Options: ``plan`` (a file with the ranges), ``count`` (true: lines of each range)."""

    @classmethod
    def name(cls) -> str:
        return "numbered_lines"

    def schema(self) -> str:
        return "part long, lines long" if self._count() else "file string, line_no long, line string"

    def _count(self) -> bool:
        return self.options.get("count") == "true"

    def reader(self, schema) -> _LineReader:
        return _LineReader(self.options["plan"], self._count())


def _load(spark: SparkSession, ranges: list[LineRange], count: bool) -> DataFrame:
    folder = scratch_dir(spark, "line-ranges")
    fs, inner = filesystem(folder)
    fs.create_dir(inner, recursive=True)
    with fs.open_output_stream(f"{inner}/plan.json") as f:
        f.write(json.dumps([[asdict(r) for r in task] for task in _packed(ranges)]).encode())
    return spark.read.format("numbered_lines").option("plan", f"{folder}/plan.json").option("count", str(count).lower()).load()


def numbered_lines(spark: SparkSession, paths: Sequence[str], across: bool = False) -> DataFrame:
    """(``file``, ``line_no``, ``line``) of text files, counted from 1 over every line of a file.

    Folders are read with all that is in them, names that begin with a dot or underscore left
    out. With ``across`` the count goes on from file to file in the order of their paths. Lines
    end at CR, LF or both. Bytes that are not UTF-8 become U+FFFD; a byte-order mark is no text.
    gzip, bzip2 and zstandard files are one task each; other small files share tasks. A file that has changed its size when it
    is read is an error. No file, or only empty ones, give no rows.
    """
    spark.dataSource.register(NumberedLines)
    ranges = _ranges(paths)
    # Only what another number is counted on from. One number for each such range comes to the driver.
    needed = [r for r, after in zip(ranges, ranges[1:], strict=False) if across or r.file == after.file]
    counts = {row["part"]: row["lines"] for row in _load(spark, needed, count=True).collect()} if needed else {}
    number, file = 1, None
    for r in ranges:
        if r.file != file and not across:
            number = 1
        r.first, number, file = number, number + counts.get(r.part, 0), r.file
    return _load(spark, ranges, count=False)
