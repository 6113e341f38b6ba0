"""From answers to scores, for all runs at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tuneprep.operators.board import leaderboard_rows
from tuneprep.operators.scoring import (
    class_summary,
    confusion_cells,
    confusion_matrix,
    eval_summary,
    migration_matrix,
    pair_answers,
    per_class,
    score_answers,
)
from tuneprep.sinks.evals import ARTIFACTS, append_leaderboard, put_run_artifacts
from tuneprep.sinks.publish import published


@dataclass(frozen=True)
class Evaluation:
    """The tables of an evaluation, all keyed by ``run_id`` and all lazy."""

    scored: DataFrame
    summary: DataFrame
    migration: DataFrame
    confusion: DataFrame
    classes: DataFrame
    class_summary: DataFrame


def evaluate(pairs: DataFrame) -> Evaluation:
    """Score pairs (run_id, id, golden, baseline_output, model_output)."""
    scored = score_answers(pairs)
    cells = confusion_cells(pairs)
    classes = per_class(cells)
    return Evaluation(
        scored=scored,
        summary=eval_summary(scored),
        migration=migration_matrix(scored),
        confusion=confusion_matrix(cells),
        classes=classes,
        class_summary=class_summary(classes),
    )


def evaluate_runs(
    samples: DataFrame,
    baseline: DataFrame,
    tuned: DataFrame,
    runs: DataFrame,
    artifacts: str,
    board: str,
) -> Evaluation:
    """Join answers to samples, score, write artifacts and append to the leaderboard.

    The scored rows are written first and everything else is computed from the written
    table, so answers are scored once and a lost executor costs only its own part. ``artifacts``
    takes its new content when that is complete.
    """
    spark = samples.sparkSession
    pairs = pair_answers(samples, baseline, tuned)
    with published(spark, artifacts, ARTIFACTS) as folder:
        score_answers(pairs).write.parquet(f"{folder}/scored")
        scored = spark.read.parquet(f"{folder}/scored")
        put_run_artifacts(eval_summary(scored), scored, folder)
    scored = spark.read.parquet(f"{artifacts}/scored")
    cells = confusion_cells(scored)
    classes = per_class(cells)
    result = Evaluation(
        scored, eval_summary(scored), migration_matrix(scored), confusion_matrix(cells), classes, class_summary(classes)
    )
    append_leaderboard(leaderboard_rows(result.summary, runs, result.class_summary), board)
    return result
