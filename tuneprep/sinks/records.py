"""Training records to JSON lines, with a manifest."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tuneprep.operators.formatting import gold_columns, record_json
from tuneprep.operators.splitting import SPLIT
from tuneprep.plans.mapping import Format
from tuneprep.sinks.publish import Store

MANIFEST = "_manifest"
GOLD = "_test_gold"


def write_records(records: DataFrame, fmt: Format, path: str, order: Column | str | None = None, splits: Sequence[str] = ()) -> dict[str, int]:
    """One folder ``_split=<name>`` of JSON lines per split; empty splits have none.

    ``order`` puts the rows of a split in that order over its files, which costs one range
    exchange. Without it nothing is moved. Returns how many records of each of ``splits`` the
    tasks that wrote them have counted; a record of another split is an error.
    """
    if order is None:
        lines = records.select(SPLIT, record_json(fmt).alias("value"))
    else:
        sort_key = F.col(order) if isinstance(order, str) else order
        lines = records.select(SPLIT, sort_key.alias("__order"), record_json(fmt).alias("value"))
        lines = lines.repartitionByRange(SPLIT, "__order").sortWithinPartitions(SPLIT, "__order").drop("__order")
    seen = Observation()
    each = [F.count_if(F.col(SPLIT).eqNullSafe(name)).alias(f"n{i}") for i, name in enumerate(splits)]
    lines.observe(seen, F.count(F.lit(1)).alias("all"), *each).write.mode("error").partitionBy(SPLIT).text(path)
    counts = {name: seen.get[f"n{i}"] for i, name in enumerate(splits)}
    if sum(counts.values()) != seen.get["all"]:
        raise ValueError(f"{seen.get['all'] - sum(counts.values())} records are in none of the splits {list(splits)}")
    return counts


def write_gold(records: DataFrame, fmt: Format, path: str) -> None:
    """The test split as (prompt, expected) JSON lines, next to the records."""
    test = records.where(F.col(SPLIT) == "test")
    fields = [c.alias(n) for n, c in gold_columns(fmt).items()]
    line = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    test.select(line.alias("value")).write.text(f"{path}/{GOLD}")


def manifest(
    spark: SparkSession,
    path: str,
    fmt: Format,
    counts: Mapping[str, int],
    source: str = "",
    seed: int | None = None,
    written: str | None = None,
) -> dict:
    """What was written: per split path, records and bytes. ``counts`` has one entry per split.

    ``written`` is the folder the records are in as yet, if they will be moved to ``path``.
    """
    store = Store(spark, written or path)
    files = {}
    for name, n in counts.items():
        if n:
            number, size = store.size(f"{written or path}/{SPLIT}={name}")
            files[name] = {"path": f"{path}/{SPLIT}={name}", "files": number, "records": n, "size_bytes": size}
    return {
        "status": "success",
        "format": Format(fmt).value,
        "source_path": source,
        "output_dir": path,
        "files": files,
        "splits": dict(counts),
        "total_records": sum(counts.values()),
        "seed_used": seed,
    }


def write_manifest(spark: SparkSession, data: dict, path: str) -> None:
    """The manifest as one small JSON file in a folder that readers of ``path`` skip."""
    line = json.dumps(data, ensure_ascii=False)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{path}/{MANIFEST}")


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/{MANIFEST}").first()["value"])
