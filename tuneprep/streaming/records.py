"""Formatting records as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tuneprep.operators.formatting import format_records, record_json
from tuneprep.plans.mapping import ColumnMapping, Format

ROWS = "rows"


def record_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int | None = None) -> DataFrame:
    """JSON lines of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def write_formatted(
    stream: DataFrame, fmt: Format, mapping: ColumnMapping, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Formatted records as JSON lines in ``path``, exactly once.

    Every batch counts its records under the observed metric ``rows``; ``progress.count_records`` adds them up.
    """
    records = format_records(stream, fmt, mapping).select(record_json(fmt).alias("value"))
    counted = records.observe(ROWS, F.count(F.lit(1)).alias("records"))
    writer = counted.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
