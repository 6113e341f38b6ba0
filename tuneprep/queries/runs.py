"""Driver queries: training logs, loss curves, checkpoints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneprep.operators.checkpoints import (
    ALL,
    BEST_TRAIN,
    BEST_VAL,
    FINAL,
    PRE_OVERFIT,
    best_train_checkpoint,
    best_val_checkpoint,
    final_checkpoint,
    loss_series,
    matched_val_losses,
    parse_log_lines,
    pre_overfit_checkpoint,
    resolve_checkpoints,
    train_loss_as_of,
)
from tuneprep.queries.fixtures import checkpoints, log_lines, loss_curves
from tuneprep.queries.sql import CURVES, KNEES, LOG_LINES


def log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_log_lines(log_lines(spark, sf_dir)).drop("line")


def loss_series_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loss_series(log_lines(spark, sf_dir))


def matched_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched_val_losses(checkpoints(spark, sf_dir), loss_curves(spark, sf_dir))


def best_val(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_val_checkpoint(checkpoints(spark, sf_dir), loss_curves(spark, sf_dir))


def train_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_loss_as_of(checkpoints(spark, sf_dir), loss_curves(spark, sf_dir))


def best_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_train_checkpoint(checkpoints(spark, sf_dir), loss_curves(spark, sf_dir))


def pre_overfit_knee(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pre_overfit_checkpoint(checkpoints(spark, sf_dir), loss_curves(spark, sf_dir))


def pre_overfit_knee_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same choice by the plan for runs with too many steps for one task."""
    return pre_overfit_checkpoint(checkpoints(spark, sf_dir), loss_curves(spark, sf_dir), hot_rows=10)


def train_asof_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_loss_as_of(checkpoints(spark, sf_dir), loss_curves(spark, sf_dir), hot_rows=10)


def last_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return final_checkpoint(checkpoints(spark, sf_dir))


def checkpoint_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved, losses = checkpoints(spark, sf_dir), loss_curves(spark, sf_dir)
    chosen = [
        resolve_checkpoints(saved, losses, s).withColumn("strategy", F.lit(s))
        for s in (FINAL, BEST_VAL, PRE_OVERFIT, BEST_TRAIN, ALL)
    ]
    return reduce(DataFrame.unionByName, chosen)


QUERIES = {
    "log_parse": log_parse,
    "loss_series": loss_series_query,
    "matched_steps": matched_steps,
    "best_val_checkpoint": best_val,
    "train_loss_asof": train_asof,
    "train_loss_asof_hot": train_asof_hot,
    "best_train_asof": best_train,
    "pre_overfit_knee": pre_overfit_knee,
    "pre_overfit_knee_hot": pre_overfit_knee_hot,
    "final_checkpoint": last_checkpoint,
    "checkpoint_strategy": checkpoint_strategy,
}

_NULL = "NULL::DOUBLE"
_FINALS = "finals AS (SELECT run_id, max(step) AS step, arg_max(path, step) AS path FROM ckpts GROUP BY run_id)"


def _chosen(strategy: str, source: str, label: str, missing: str) -> str:
    text = f"printf('{label}', b.step, b.loss)"
    return f"""SELECT f.run_id, coalesce(b.step, f.step) AS step, coalesce(c.path, f.path) AS path,
        CASE WHEN b.step IS NULL THEN '{missing}' ELSE {text} END AS label, '{strategy}' AS strategy
        FROM finals f LEFT JOIN {source} b ON b.run_id = f.run_id LEFT JOIN ckpts c ON c.run_id = b.run_id AND c.step = b.step"""


_NO_VAL = "Final trained adapter (fallback: no val loss in log)"
_NO_TRAIN = "Final trained adapter (fallback: no train loss in log)"

SQL = {
    "log_parse": f"""WITH {LOG_LINES} SELECT run_id, line_no, step,
        CASE WHEN event_type = 'click' THEN v END AS train_loss, CASE WHEN event_type = 'view' THEN v END AS val_loss,
        CASE WHEN event_type = 'click' THEN 1e-5::DOUBLE END AS learning_rate,
        CASE event_type WHEN 'click' THEN 1.15::DOUBLE WHEN 'error' THEN 0.5::DOUBLE END AS it_per_sec,
        CASE WHEN event_type = 'view' THEN 2.0::DOUBLE END AS val_it_per_sec,
        CASE WHEN event_type = 'click' THEN 1200.0::DOUBLE END AS tokens_per_sec
        FROM log_lines WHERE event_type IN ('view', 'click', 'error')""",
    "loss_series": f"""WITH {LOG_LINES} SELECT run_id, step, CASE WHEN event_type = 'click' THEN 'train' ELSE 'val' END AS metric,
        arg_max(v, line_no) AS value FROM log_lines WHERE event_type IN ('view', 'click', 'purchase') GROUP BY ALL""",
    "matched_steps": f"WITH {CURVES} SELECT * FROM matched",
    "best_val_checkpoint": f"WITH {CURVES} SELECT * FROM best_val",
    "train_loss_asof": f"WITH {CURVES} SELECT * FROM as_of",
    "train_loss_asof_hot": f"WITH {CURVES} SELECT * FROM as_of",
    "best_train_asof": f"WITH {CURVES} SELECT * FROM best_train",
    "pre_overfit_knee": f"WITH {KNEES} SELECT * FROM knees",
    "pre_overfit_knee_hot": f"WITH {KNEES} SELECT * FROM knees",
    "final_checkpoint": f"WITH {CURVES}, {_FINALS} SELECT * FROM finals",
    "checkpoint_strategy": f"""WITH {KNEES}, {_FINALS}
        SELECT run_id, step, path, 'Final trained adapter' AS label, 'final' AS strategy FROM finals
        UNION ALL {_chosen('best_val_loss', 'best_val', 'Adapter with minimal validation loss (step %d, val loss %.4f)', _NO_VAL)}
        UNION ALL {_chosen('pre_overfit', 'knees', 'Pre-overfit knee adapter (step %d, val loss %.4f)', _NO_VAL)}
        UNION ALL {_chosen('best_train_loss', 'best_train', 'Adapter with minimal training loss (step %d, train loss %.4f)', _NO_TRAIN)}
        UNION ALL SELECT c.run_id, c.step, path, 'Adapter step ' || c.step || CASE WHEN v.val_loss IS NOT NULL AND t.train_loss IS NOT NULL
                THEN printf(' (val loss %.4f, train loss %.4f)', v.val_loss, t.train_loss)
                WHEN v.val_loss IS NOT NULL THEN printf(' (val loss %.4f)', v.val_loss)
                WHEN t.train_loss IS NOT NULL THEN printf(' (train loss %.4f)', t.train_loss) ELSE '' END, 'all'
            FROM ckpts c LEFT JOIN vals v USING (run_id, step) LEFT JOIN trains t USING (run_id, step)""",
}
