"""The leaderboard: run settings with their results, ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The columns of the leaderboard, in order.
LEADERBOARD = {
    "run_name": "string",
    "model": "string",
    "fine_tune_type": "string",
    "iters": "bigint",
    "batch_size": "bigint",
    "learning_rate": "double",
    "lora_rank": "bigint",
    "lora_alpha": "double",
    "exact_match_pct": "double",
    "substring_match_pct": "double",
    "avg_word_f1": "double",
    "avg_word_prec": "double",
    "avg_word_recall": "double",
    "categorical_accuracy_pct": "double",
    "macro_f1_pct": "double",
    "majority_baseline_pct": "double",
    "accuracy_over_baseline_pp": "double",
    "seed": "bigint",
    "num_layers": "bigint",
    "fixed_count": "bigint",
    "regressed_count": "bigint",
    "total_samples": "bigint",
    "tokens_per_sec": "double",
    "timestamp": "timestamp",
    "adapter_path": "string",
}


def on_board(rows: DataFrame) -> DataFrame:
    """``rows`` with exactly the leaderboard's columns; what is missing is NULL."""
    have = set(rows.columns)
    return rows.select(
        *[(F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in LEADERBOARD.items()]
    )


def leaderboard_rows(summaries: DataFrame, runs: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Run settings (one row per ``run_id``) with their summary and class metrics."""
    df = runs.join(summaries, "run_id")
    if classes is not None:
        df = df.join(
            classes.select(
                "run_id",
                F.col("accuracy").alias("categorical_accuracy_pct"),
                F.col("macro_f1").alias("macro_f1_pct"),
                F.col("majority_baseline").alias("majority_baseline_pct"),
                F.col("accuracy_over_baseline").alias("accuracy_over_baseline_pp"),
            ),
            "run_id",
            "left",
        )
    if "timestamp" not in df.columns:
        df = df.withColumn("timestamp", F.current_timestamp())
    return on_board(df)


def ranked(board: DataFrame, metric: str, name: str = "run_name") -> DataFrame:
    """Runs with their rank by a metric, best first. Equal values share a rank.

    The rank is 1 + the number of runs with a better value. It is counted over the
    distinct values, so the rows themselves never meet in one window.
    """
    values = board.where(F.col(metric).isNotNull()).groupBy(metric).agg(F.count(F.lit(1)).alias("__n"))
    better = Window.orderBy(F.col(metric).desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranks = values.select(metric, (F.coalesce(F.sum("__n").over(better), F.lit(0)) + 1).alias("rank"))
    return board.join(ranks, metric).orderBy("rank", name)
