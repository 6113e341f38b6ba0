"""How often a run sees its data: implied epochs over grids of settings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def implied_epochs(iters: Column, batch_size: Column, records: Column, accumulation: Column | None = None) -> Column:
    """iters * batch * accumulation / records; NULL when something is unknown."""
    steps = F.greatest(F.lit(1), accumulation if accumulation is not None else F.lit(1))
    known = (records > 0) & (iters > 0) & (batch_size > 0)
    return F.when(known, (iters * (batch_size * steps)) / records.cast("double"))


def expand_grid(df: DataFrame, settings: Mapping[str, Sequence]) -> DataFrame:
    """One row per row of ``df`` and combination of settings.

    The lists are literals, so the product is made inside each task, without a join.
    """
    for name, values in settings.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def sweep_runs(counts: DataFrame, settings: Mapping[str, Sequence]) -> DataFrame:
    """Every run of a sweep over datasets (``dataset, records``) with its implied epochs."""
    runs = expand_grid(counts, settings)
    accumulation = F.col("grad_accumulation_steps") if "grad_accumulation_steps" in settings else None
    epochs = implied_epochs(F.col("iters"), F.col("batch_size"), F.col("records"), accumulation)
    return runs.withColumn("implied_epochs", epochs)


def sweep_coverage(runs: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_runs"), F.min("implied_epochs").alias("min_implied_epochs")
    )


def run_epochs(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """Runs with the implied epochs on their dataset; NULL for an unknown dataset."""
    joined = runs.join(counts, "dataset", "left")
    accumulation = F.col("grad_accumulation_steps") if "grad_accumulation_steps" in runs.columns else None
    epochs = implied_epochs(F.col("iters"), F.col("batch_size"), F.coalesce("records", F.lit(0)), accumulation)
    return joined.withColumn("implied_epochs", epochs)


def record_counts(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Non-blank lines per group."""
    from tuneprep.functions.text import strip

    return lines.where(strip("value") != "").groupBy(*by).agg(F.count(F.lit(1)).alias("records"))
