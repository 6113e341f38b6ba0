"""JSON records: one per line, or one array per file."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tuneprep.functions.text import strip
from tuneprep.session import scratch_dir
from tuneprep.sources.encoding import LINES_PER_BATCH, open_text

CORRUPT = "_corrupt_record"
BYTE_ORDER_MARK = chr(0xFEFF)
STRICT = {"allowSingleQuotes": "false", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}


def looks_like_object(value: Column | str) -> Column:
    text = strip(value)
    return F.startswith(text, F.lit("{")) & F.endswith(text, F.lit("}"))


def infer_schema(spark: SparkSession, paths: Sequence[str]) -> StructType:
    """The columns of the lines that look like objects; what other lines hold adds none."""
    lines = spark.read.option("recursiveFileLookup", "true").text(list(paths)).select("value").where(looks_like_object("value"))
    # Only the JVM's reader takes a dataset of strings.
    strings = getattr(lines._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    schema = DataFrame(spark.read.options(**STRICT)._jreader.json(strings), spark).schema
    return StructType([f for f in schema if f.name != CORRUPT])


def parse_objects(
    lines: DataFrame, schema: StructType, keep: Sequence[str] = (), lenient: bool = False
) -> DataFrame:
    """Rows of the lines that hold a JSON object; blank, broken and other lines are dropped.

    A line is broken when the parser reports it so. With a given schema a single field of
    another type is reported too; ``lenient`` keeps such a row, with NULL in the field.
    """
    wanted = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    record = F.from_json("value", wanted, STRICT)

    def whole(r: Column) -> Column:
        sound = r[CORRUPT].isNull()
        return sound | F.get_json_object("value", "$").isNotNull() if lenient else sound

    # Kept or dropped in a generator: a filter would be pushed down and parse the line twice.
    records = F.explode(F.filter(F.array(record), whole)).alias("r")
    parsed = lines.where(looks_like_object("value")).select(*keep, records)
    return parsed.select(*[f"r.`{name}`" for name in schema.names if name not in keep], *keep)


def read_jsonl(
    spark: SparkSession, paths: Sequence[str], schema: StructType | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """JSON lines. Give ``schema`` to save the pass that infers it.

    ``keep`` names partition columns of the folder that stay in the result.
    """
    given = schema is not None
    if not given:
        schema = infer_schema(spark, paths)
    if not schema.names:
        raise ValueError(f"no JSON records in {', '.join(paths)}")
    return parse_objects(spark.read.text(list(paths)), schema, keep, lenient=given)


def array_elements(read: Callable[[int], str], chunk: int = 1 << 20) -> Iterator[str]:
    """The elements of one JSON array as JSON texts, from a stream, one at a time."""
    decoder = json.JSONDecoder()
    text, at, more, opened = "", 0, chunk, False
    while True:
        part = read(more)
        text, at = text[at:] + part, 0
        if not opened:
            start = text.lstrip(BYTE_ORDER_MARK + " \t\r\n")
            if not start and part:
                continue
            if not start.startswith("["):
                raise ValueError("not a JSON array")
            text, opened = start[1:], True
        while True:
            skipped = re.compile(r"[\s,]*").match(text, at).end()
            if text.startswith("]", skipped):
                return
            try:
                value, end = decoder.raw_decode(text, skipped)
            except ValueError:
                if not part:
                    raise ValueError("the JSON array is broken or not closed") from None
                break
            if end == len(text) and part:  # a number may go on in the next piece
                break
            yield json.dumps(value, ensure_ascii=False)
            at, more = end, chunk
        if at == 0:
            more *= 2  # an element longer than what is in memory


def read_json_array(spark: SparkSession, paths: Sequence[str], schema: StructType | None = None) -> DataFrame:
    """Files that hold one JSON array each; elements that are no objects are dropped.

    An array cannot be split, so a file is one task, which streams it. The elements go to
    the shared scratch folder as lines, from where they are read in parallel.
    """

    def elements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                rows: list[str] = []
                with open_text(path) as text:
                    for element in array_elements(text.read):
                        if element.startswith("{"):
                            rows.append(element)
                        if len(rows) >= LINES_PER_BATCH:
                            yield pd.DataFrame({"value": rows})
                            rows = []
                yield pd.DataFrame({"value": rows})

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths))
    lines = scratch_dir(spark, "json-array")
    files.mapInPandas(elements, "value string").write.text(lines)
    return read_jsonl(spark, [lines], schema)


def json_lines_column(df: DataFrame) -> Column:
    """All columns of ``df`` as one JSON line."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).cast(StringType())
