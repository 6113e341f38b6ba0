"""Loss series out of training logs, and the choice of a checkpoint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneprep.functions.logs import line_metrics, log_step, loose_losses
from tuneprep.functions.text import round_half_even
from tuneprep.operators.ordered import HOT_ROWS, OrderedRuns

# Tolerances of the pre-overfit rule, strategy names and labels.
REBOUND_TOLERANCE = 0.05
KNEE_DROP = 0.02
KNEE_ABSOLUTE = 0.005
SMALLEST_MINIMUM = 1e-8
FINAL, BEST_VAL, PRE_OVERFIT, BEST_TRAIN, ALL = "final", "best_val_loss", "pre_overfit", "best_train_loss", "all"
STRATEGY_ALIASES = {
    "last": FINAL,
    "min_val_loss": BEST_VAL,
    "pre_overfit_knee": PRE_OVERFIT,
    "knee": PRE_OVERFIT,
    "min_train_loss": BEST_TRAIN,
    "every": ALL,
}
LABEL_FINAL = "Final trained adapter"
LABEL_NO_VAL = "Final trained adapter (fallback: no val loss in log)"
LABEL_NO_TRAIN = "Final trained adapter (fallback: no train loss in log)"
LABEL_VAL = "Adapter with minimal validation loss (step %d, val loss %.4f)"
LABEL_KNEE = "Pre-overfit knee adapter (step %d, val loss %.4f)"
LABEL_TRAIN = "Adapter with minimal training loss (step %d, train loss %.4f)"


def parse_log_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Progress lines with their step and metrics; other lines are dropped.

    The parsed line is kept or dropped inside a generator: a filter on the metrics would be
    pushed down and make Spark parse every line twice.
    """
    metrics = line_metrics(line)
    parsed = F.struct(log_step(line).alias("step"), *[c.alias(n) for n, c in metrics.items()])
    progress = F.filter(
        F.array(parsed), lambda p: p["step"].isNotNull() & F.coalesce(*[p[n] for n in metrics]).isNotNull()
    )
    return lines.select("*", F.inline(progress))


def loss_series(lines: DataFrame, line: str = "line", order: str = "line_no", run: str = "run_id") -> DataFrame:
    """(run, step, metric, value), one value per step: the last line wins."""
    step = log_step(line)
    losses = F.filter(
        F.array(
            *[F.struct(step.alias("step"), F.lit(n).alias("metric"), c.alias("value")) for n, c in loose_losses(line).items()]
        ),
        lambda m: m["step"].isNotNull() & m["value"].isNotNull(),
    )
    found = lines.select(run, order, F.inline(losses))
    return found.groupBy(run, "step", "metric").agg(F.max_by("value", order).alias("value"))


def curve(losses: DataFrame, metric: str, name: str, run: str = "run_id") -> DataFrame:
    return losses.where(F.col("metric") == metric).select(run, "step", F.col("value").alias(name))


def matched_val_losses(checkpoints: DataFrame, losses: DataFrame, run: str = "run_id") -> DataFrame:
    """Checkpoints that have a validation loss at their own step."""
    return checkpoints.select(run, "step").join(curve(losses, "val", "val_loss", run), [run, "step"])


def train_loss_as_of(
    checkpoints: DataFrame, losses: DataFrame, run: str = "run_id", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """(run, step, train_loss): the train loss at the checkpoint or the last one before it.

    One union and one running value instead of a range join: every row is read once.
    """
    train = curve(losses, "train", "train_loss", run).withColumn("__at", F.lit(0))
    saved = checkpoints.select(run, "step", F.lit(None).cast("double").alias("train_loss"), F.lit(1).alias("__at"))
    both = OrderedRuns(train.unionByName(saved), run, "step", tie=["__at"], hot_rows=hot_rows)
    found = both.last_known("__loss", "train_loss").result().where(F.col("__at") == 1)
    return found.where(F.col("__loss").isNotNull()).select(run, "step", F.col("__loss").alias("train_loss"))


def _lowest(df: DataFrame, loss: str, run: str) -> DataFrame:
    best = F.min(F.struct(F.col(loss).alias("loss"), F.col("step").alias("step")))
    return df.groupBy(run).agg(best.alias("b")).select(run, "b.step", "b.loss")


def best_val_checkpoint(checkpoints: DataFrame, losses: DataFrame, run: str = "run_id") -> DataFrame:
    return _lowest(matched_val_losses(checkpoints, losses, run), "val_loss", run)


def best_train_checkpoint(
    checkpoints: DataFrame, losses: DataFrame, run: str = "run_id", hot_rows: int = HOT_ROWS
) -> DataFrame:
    return _lowest(train_loss_as_of(checkpoints, losses, run, hot_rows), "train_loss", run)


def pre_overfit_checkpoint(
    checkpoints: DataFrame, losses: DataFrame, run: str = "run_id", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The checkpoint where the validation loss has finished dropping.

    The curve is read up to the first step that lies more than 5 % above the minimum so
    far or rises for the second time in a row. Among the steps up to the minimum of that
    part, the earliest one within max(0.005, 2 % of the drop) of the minimum is chosen.
    """
    points = matched_val_losses(checkpoints, losses, run)
    runs = OrderedRuns(points, run, "step", hot_rows=hot_rows)
    runs.min_before("low", "val_loss").previous("prev", "val_loss")
    v, low = F.col("val_loss"), F.col("low")
    rise = F.coalesce((v >= low) & (v > F.col("prev")), F.lit(False))
    runs.with_columns({"rise": rise}).previous("prev_rise", "rise")
    rebound = (v >= low) & ((v - low) / F.greatest(low, F.lit(SMALLEST_MINIMUM)) > REBOUND_TOLERANCE)
    stop = F.coalesce(rebound, F.lit(False)) | (F.col("rise") & F.coalesce(F.col("prev_rise"), F.lit(False)))
    runs.with_columns({"stop": stop})

    runs.of_key({"stop_step": F.min(F.when(F.col("stop"), F.col("step"))), "first_loss": F.min_by("val_loss", "step")})
    read = F.col("stop_step").isNull() | (F.col("step") < F.col("stop_step"))
    runs.of_key({"lowest": F.min(F.when(read, F.struct(F.col("val_loss").alias("loss"), F.col("step").alias("step"))))})
    drop = F.greatest(F.lit(0.0), F.col("first_loss") - F.col("lowest.loss"))
    threshold = F.col("lowest.loss") + F.greatest(F.lit(KNEE_ABSOLUTE), F.lit(KNEE_DROP) * drop)
    knee = (F.col("step") <= F.col("lowest.step")) & (v <= threshold)
    picked = F.min(F.when(knee, F.struct(F.col("step").alias("step"), v.alias("loss"))))
    return runs.df.groupBy(run).agg(picked.alias("k")).select(run, "k.step", "k.loss")


def final_checkpoint(checkpoints: DataFrame, run: str = "run_id") -> DataFrame:
    return checkpoints.groupBy(run).agg(F.max("step").alias("step"), F.max_by("path", "step").alias("path"))


def _four_digits(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, round_half_even(column, 4))


def resolve_checkpoints(
    checkpoints: DataFrame, losses: DataFrame, strategy: str = FINAL, run: str = "run_id", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """(run, step, path, label) of the checkpoints to evaluate.

    A run without the losses a strategy needs falls back to its final checkpoint.
    """
    strategy = STRATEGY_ALIASES.get(strategy, strategy)
    if strategy == ALL:
        rounded = {
            "val": _four_digits(curve(losses, "val", "val_loss", run), "val_loss"),
            "train": _four_digits(curve(losses, "train", "train_loss", run), "train_loss"),
        }
        df = checkpoints.select(run, "step", "path")
        for series in rounded.values():
            df = df.join(series, [run, "step"], "left")
        known = F.concat_ws(
            ", ",
            F.when(F.col("val_loss").isNotNull(), F.format_string("val loss %.4f", "val_loss")),
            F.when(F.col("train_loss").isNotNull(), F.format_string("train loss %.4f", "train_loss")),
        )
        label = F.concat(
            F.format_string("Adapter step %d", "step"), F.when(known != "", F.concat(F.lit(" ("), known, F.lit(")"))).otherwise("")
        )
        return df.select(run, "step", "path", label.alias("label"))

    final = final_checkpoint(checkpoints, run)
    if strategy == BEST_VAL:
        chosen, label, missing = best_val_checkpoint(checkpoints, losses, run), LABEL_VAL, LABEL_NO_VAL
    elif strategy == PRE_OVERFIT:
        chosen, label, missing = pre_overfit_checkpoint(checkpoints, losses, run, hot_rows), LABEL_KNEE, LABEL_NO_VAL
    elif strategy == BEST_TRAIN:
        chosen, label, missing = best_train_checkpoint(checkpoints, losses, run, hot_rows), LABEL_TRAIN, LABEL_NO_TRAIN
    else:
        return final.select(run, "step", "path", F.lit(LABEL_FINAL).alias("label"))

    chosen = _four_digits(chosen, "loss").join(checkpoints.select(run, "step", "path"), [run, "step"])
    chosen = chosen.select(
        run, F.struct("step", "path", F.format_string(label, "step", "loss").alias("label")).alias("chosen")
    )
    fallback = F.struct("step", "path", F.lit(missing).alias("label"))
    both = final.join(chosen, run, "left").select(run, F.coalesce("chosen", fallback).alias("c"))
    return both.select(run, "c.step", "c.path", "c.label")
