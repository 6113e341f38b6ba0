"""SQLite tables as a Spark data source, and the choice of tables in a database.

The database file must lie on a path that every executor mounts: SQLite opens files, not
object stores. It is opened read-only.
"""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator, Sequence
from contextlib import closing
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DataType, DoubleType, LongType, StringType, StructField, StructType

from tuneprep.operators.splitting import SPLIT
from tuneprep.session import local_path

# Tables taken for splits, and tables taken for the data.
SPLIT_TABLES = {
    "train": ("train", "training"),
    "valid": ("valid", "validation", "val", "dev"),
    "test": ("test", "testing", "eval", "evaluation"),
}
MAIN_TABLES = ("data", "dataset", "records", "items", "samples", "main")

ROWS_PER_TASK = 500_000
ROWS_PER_BATCH = 20_000


def connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(local_path(path))}?mode=ro", uri=True)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _type_of(declared: str) -> DataType:
    """Spark type by the affinity of the declared type."""
    kind = declared.upper()
    if "INT" in kind:
        return LongType()
    if any(k in kind for k in ("CHAR", "CLOB", "TEXT")):
        return StringType()
    if "BLOB" in kind:
        return BinaryType()
    if any(k in kind for k in ("REAL", "FLOA", "DOUB", "NUM", "DEC")):
        return DoubleType()
    return StringType()


class _RowIds(InputPartition):
    def __init__(self, path: str, low: int | None = None, high: int | None = None):
        self.path, self.low, self.high = path, low, high


class SqliteReader(DataSourceReader):
    def __init__(self, paths: Sequence[str], table: str, schema: StructType, tasks: int | None):
        self.paths, self.table, self.schema, self.tasks = list(paths), table, schema, tasks

    def partitions(self) -> list[InputPartition]:
        return [piece for path in self.paths for piece in self._pieces(path)]

    def _pieces(self, path: str) -> list[InputPartition]:
        with closing(connect(path)) as db:
            table = quoted(self.table)
            try:
                (rows,) = db.execute(f"SELECT count(rowid) FROM {table}").fetchone()
            except sqlite3.OperationalError:  # WITHOUT ROWID, or a view
                return [_RowIds(path)]
            step = -(-rows // self.tasks) if self.tasks else ROWS_PER_TASK
            # From row to row, not from number to number: rowids may be far apart.
            starts: list[int | None] = [None]
            jump = f"SELECT rowid FROM {table} WHERE rowid >= ? ORDER BY rowid LIMIT 1 OFFSET {max(1, step)}"
            while found := db.execute(jump, (-(1 << 63) if starts[-1] is None else starts[-1],)).fetchone():
                starts.append(found[0])
        return [_RowIds(path, low, high) for low, high in zip(starts, [*starts[1:], None], strict=True)]

    def read(self, partition: _RowIds) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(self.schema)
        columns = [
            f"CAST({quoted(f.name)} AS TEXT)" if isinstance(f.dataType, StringType) else quoted(f.name)
            for f in self.schema
        ]
        query = f"SELECT {', '.join(columns)} FROM {quoted(self.table)}"
        limits = [f"rowid >= {partition.low}"] * (partition.low is not None) + [f"rowid < {partition.high}"] * (partition.high is not None)
        if limits:
            query += f" WHERE {' AND '.join(limits)}"
        with closing(connect(partition.path)) as db:
            cursor = db.execute(query)
            while rows := cursor.fetchmany(ROWS_PER_BATCH):
                arrays = [pa.array(values, type=f.type) for values, f in zip(zip(*rows), target)]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)


class SqliteSource(DataSource):
    """Options: ``paths`` (JSON list), ``table``, ``columns`` (JSON list), ``tasks`` per file."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> StructType:
        with closing(connect(json.loads(self.options["paths"])[0])) as db:
            info = db.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
        wanted = json.loads(self.options.get("columns", "null"))
        return StructType(
            [StructField(name, _type_of(kind)) for _, name, kind, *_ in info if wanted is None or name in wanted]
        )

    def reader(self, schema: StructType) -> SqliteReader:
        tasks = self.options.get("tasks")
        return SqliteReader(json.loads(self.options["paths"]), self.options["table"], schema, int(tasks) if tasks else None)


def read_sqlite_table(
    spark: SparkSession,
    paths: str | Sequence[str],
    table: str,
    columns: Sequence[str] | None = None,
    schema: StructType | str | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """One table of one database, or of several with the same columns.

    Pass ``schema`` where cells do not hold what the column declares.
    """
    spark.dataSource.register(SqliteSource)
    files = [paths] if isinstance(paths, str) else list(paths)
    reader = spark.read.format("sqlite_table").option("paths", json.dumps(files)).option("table", table)
    if columns is not None:
        reader = reader.option("columns", json.dumps(list(columns)))
    if tasks:
        reader = reader.option("tasks", str(tasks))
    return (reader.schema(schema) if schema is not None else reader).load()


def choose_tables(path: str, table: str | None = None) -> dict[str, list[str]]:
    """Split -> tables. A single table that is not a split has the split ``default``."""
    with closing(connect(path)) as db:
        names = [
            r[0]
            for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%'")
        ]
        columns = {n: [r[1] for r in db.execute(f"PRAGMA table_info({quoted(n)})")] for n in names}
    if not names:
        raise ValueError(f"no tables in '{path}'")
    if table is not None:
        if table not in names:
            raise ValueError(f"no table '{table}' in '{path}'; it has {', '.join(names)}")
        return {"default": [table]}
    splits: dict[str, list[str]] = {}
    for name in names:
        for split, known in SPLIT_TABLES.items():
            if name.lower() in known:
                splits.setdefault(split, []).append(name)
    if splits:
        return splits
    main = [n for n in names if n.lower() in MAIN_TABLES]
    same_columns = all(columns[n] == columns[names[0]] for n in names)
    if len(names) > 1 and not main and same_columns:
        return {n: [n] for n in names}
    return {"default": [(main or names)[0]]}


def read_sqlite(spark: SparkSession, paths: str | Sequence[str], table: str | None = None) -> DataFrame:
    """The tables of a database that make up a dataset, with ``_split``.

    Several databases are shards of one dataset; the first one decides on the tables.
    """
    first = paths if isinstance(paths, str) else paths[0]
    frames = [
        read_sqlite_table(spark, paths, name).withColumn(SPLIT, F.lit(split))
        for split, tables in choose_tables(first, table).items()
        for name in tables
    ]
    df = frames[0]
    for other in frames[1:]:
        df = df.unionByName(other, allowMissingColumns=True)
    return df
