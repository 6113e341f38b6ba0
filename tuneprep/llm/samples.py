"""Bounded samples of labelled rows, drawn by a hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SCALE = 1 << 40


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo ``modulus``; a null id counts as an empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus).cast("int")


def stratified(rows: DataFrame, label: str, quota: int, *by: str) -> DataFrame:
    """About ``quota`` rows for each value of ``label``, or all where there are fewer.

    Rows are chosen by a hash of ``by``, so the sample is the same in every run. Counting the
    labels is one job, whose result has one row for each label.
    """
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.pmod(F.xxhash64(*by), F.lit(_SCALE))
    chosen = F.lit(False)
    for value, n in counts.items():
        chosen = chosen | ((F.col(label) == F.lit(value)) & (place < int(_SCALE * min(1.0, quota / n))))
    return rows.where(chosen)
