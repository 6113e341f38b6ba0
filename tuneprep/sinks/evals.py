"""Evaluation results: leaderboard table, summaries, predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneprep.operators.board import LEADERBOARD, on_board
from tuneprep.sinks.publish import Store, published

#: Marks a folder of artifacts.
ARTIFACTS = "_artifacts"


def append_leaderboard(rows: DataFrame, path: str) -> None:
    on_board(rows).write.mode("append").parquet(path)


def read_leaderboard(spark: SparkSession, path: str) -> DataFrame:
    """All rows on today's columns, whatever columns they were written with."""
    stored = spark.read.option("mergeSchema", True).parquet(path)
    return on_board(stored)


def export_leaderboard(board: DataFrame, path: str) -> None:
    """CSV with a header; what is missing is an empty cell."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in LEADERBOARD]
    board.select(*texts).write.mode("overwrite").csv(path, header=True, emptyValue="", escape='"')


def put_run_artifacts(summaries: DataFrame, scored: DataFrame, folder: str) -> None:
    """``summary`` and ``predictions`` as JSON lines, one folder per run, in a folder yet to be published."""
    summaries.write.partitionBy("run_id").json(f"{folder}/summary", ignoreNullFields=False)
    scored.write.partitionBy("run_id").json(f"{folder}/predictions", ignoreNullFields=False)
    Store(summaries.sparkSession, folder).make(f"{folder}/{ARTIFACTS}")


def write_run_artifacts(summaries: DataFrame, scored: DataFrame, path: str) -> None:
    """``summary`` and ``predictions`` in ``path``.

    They replace those of an earlier evaluation when both are complete; a folder that holds
    anything else is refused.
    """
    with published(summaries.sparkSession, path, ARTIFACTS) as folder:
        put_run_artifacts(summaries, scored, folder)
