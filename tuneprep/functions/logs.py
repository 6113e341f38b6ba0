"""Training-log lines to metric columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tuneprep.functions.text import col_of

# The spellings trainers print. The first group is the number.
STEP = r"Iter\s+(\d+):"
LINE_METRICS = {
    "train_loss": r"Train loss\s+([0-9.]+)",
    "val_loss": r"Val loss\s+([0-9.]+)",
    "learning_rate": r"Learning Rate\s+([0-9.eE+-]+)",
    "it_per_sec": r"(?<!Val\s)It/sec\s+([0-9.]+)",
    "val_it_per_sec": r"Val It/sec\s+([0-9.]+)",
    "tokens_per_sec": r"Tokens/sec\s+([0-9.]+)",
}
LOOSE_LOSSES = {
    "val": r"(?i)Val loss\s*[=:]?\s*([0-9.]+)",
    "train": r"(?i)Train loss\s*[=:]?\s*([0-9.]+)",
}
MILESTONE = "val loss"


def _number(line: Column, pattern: str, kind: str = "double") -> Column:
    """The first number the pattern finds. No match is NULL before the cast: casting the
    empty text that ``regexp_extract`` gives costs an exception per row."""
    return F.get(F.regexp_extract_all(line, F.lit(pattern), F.lit(1)), 0).try_cast(kind)


def log_step(line: Column | str) -> Column:
    return _number(col_of(line), STEP, "bigint")


def line_metrics(line: Column | str) -> dict[str, Column]:
    """Name -> column for every metric of a progress line (NULL where absent)."""
    line = col_of(line)
    return {name: _number(line, pattern) for name, pattern in LINE_METRICS.items()}


def loose_losses(line: Column | str) -> dict[str, Column]:
    """Losses in any letter case, with an optional ``=`` or ``:``."""
    line = col_of(line)
    return {name: _number(line, pattern) for name, pattern in LOOSE_LOSSES.items()}


def is_milestone(line: Column | str) -> Column:
    return F.contains(F.lower(col_of(line)), F.lit(MILESTONE))
