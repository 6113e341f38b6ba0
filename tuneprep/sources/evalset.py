"""Test records for an evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneprep.operators.formatting import eval_samples
from tuneprep.sources.jsonl import infer_schema, parse_objects
from tuneprep.sources.lines import numbered_lines


def read_eval_samples(spark: SparkSession, paths: Sequence[str], limit: int | None = None) -> DataFrame:
    """(id, prompt, golden, messages) of a JSONL test set.

    The id is the line number, counted on from file to file in the order of their paths;
    blank or broken lines count. ``limit`` keeps the first samples by their id.
    """
    lines = numbered_lines(spark, paths, across=True).select(F.col("line_no").alias("__id"), F.col("line").alias("value"))
    records = parse_objects(lines, infer_schema(spark, paths), keep=["__id"])
    prompt, golden, messages = eval_samples(records)
    samples = records.select(
        F.col("__id").alias("id"), prompt.alias("prompt"), golden.alias("golden"), messages.alias("messages")
    )
    return samples if limit is None else samples.orderBy("id").limit(limit)
