"""Arrow IPC files (file and stream format) as a Spark data source."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.ipc as ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tuneprep.sources.files import filesystem

# A file larger than this is read by several tasks, a range of record batches each.
BYTES_PER_TASK = 256 << 20


def _plain(kind: pa.DataType) -> pa.DataType:
    """The type without dictionary encoding and without 64-bit offsets."""
    if pa.types.is_dictionary(kind):
        return _plain(kind.value_type)
    if pa.types.is_large_string(kind):
        return pa.string()
    if pa.types.is_large_binary(kind):
        return pa.binary()
    if pa.types.is_list(kind) or pa.types.is_large_list(kind) or pa.types.is_fixed_size_list(kind):
        return pa.list_(_plain(kind.value_type))
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, _plain(f.type), True) for f in kind])
    return kind


def _conform(values: pa.Array, kind: pa.DataType) -> pa.Array:
    """Cast by name: Spark matches nested fields of Arrow batches by position."""
    if values.type == kind:
        return values
    if pa.types.is_dictionary(values.type):
        return _conform(values.dictionary_decode(), kind)
    if pa.types.is_struct(kind):
        at = {f.name: i for i, f in enumerate(values.type)}
        fields = [
            _conform(values.field(at[f.name]), f.type) if f.name in at else pa.nulls(len(values), f.type) for f in kind
        ]
        return pa.StructArray.from_arrays(fields, fields=list(kind), mask=values.is_null())
    if pa.types.is_list(kind):
        items = values.cast(pa.list_(values.type.value_type))
        inner = _conform(items.values, kind.value_type)
        return pa.ListArray.from_arrays(items.offsets, inner, type=kind, mask=items.is_null() if items.null_count else None)
    return values.cast(kind)


def _open(path: str):
    """A reader with ``schema``, and whether batches can be picked by number."""
    fs, inner = filesystem(path)
    try:
        return ipc.open_file(fs.open_input_file(inner)), True
    except pa.ArrowInvalid:
        return ipc.open_stream(fs.open_input_stream(inner)), False


class _Range(InputPartition):
    def __init__(self, path: str, first: int = 0, last: int | None = None):
        self.path, self.first, self.last = path, first, last


class ArrowIpcReader(DataSourceReader):
    def __init__(self, paths: Sequence[str], schema: StructType):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.paths = list(paths)
        self.target = to_arrow_schema(schema)

    def partitions(self) -> list[InputPartition]:
        found: list[InputPartition] = []
        for path in self.paths:
            fs, inner = filesystem(path)
            pieces = fs.get_file_info(inner).size // BYTES_PER_TASK + 1
            reader, seekable = _open(path) if pieces > 1 else (None, False)
            if not seekable:
                found.append(_Range(path))
                continue
            step = max(1, -(-reader.num_record_batches // pieces))
            found += [_Range(path, i, i + step) for i in range(0, reader.num_record_batches, step)]
        return found

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        reader, seekable = _open(partition.path)
        if seekable:
            last = reader.num_record_batches if partition.last is None else partition.last
            batches = (reader.get_batch(i) for i in range(partition.first, min(last, reader.num_record_batches)))
        else:
            batches = iter(reader)
        for batch in batches:
            have = set(batch.schema.names)
            columns = [
                _conform(batch.column(f.name), f.type) if f.name in have else pa.nulls(batch.num_rows, f.type)
                for f in self.target
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=self.target)


class ArrowIpcSource(DataSource):
    """Options: ``paths`` (JSON list), ``columns`` (JSON list, optional)."""

    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def _paths(self) -> list[str]:
        return json.loads(self.options["paths"])

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        reader, _ = _open(self._paths()[0])
        wanted = json.loads(self.options.get("columns", "null"))
        fields = [pa.field(f.name, _plain(f.type), True) for f in reader.schema]
        if wanted is not None:
            by_name = {f.name: f for f in fields}
            fields = [by_name[c] for c in wanted]
        return from_arrow_schema(pa.schema(fields))

    def reader(self, schema: StructType) -> ArrowIpcReader:
        return ArrowIpcReader(self._paths(), schema)


def read_arrow(spark: SparkSession, paths: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    spark.dataSource.register(ArrowIpcSource)
    reader = spark.read.format("arrow_ipc").option("paths", json.dumps(list(paths)))
    if columns is not None:
        reader = reader.option("columns", json.dumps(list(columns)))
    return reader.load()
