"""The last row of every key of a stream, as a table of deltas and snapshots.

``delta/batch=<n>`` has the rows that batch n changed, ``snapshot/upto=<n>`` the last row of every
key after batch n. A reader takes the newest complete snapshot and the deltas after it. Every
``every`` batches a new snapshot is made; what is older than the snapshot before it goes, so that
a reader that has just looked at the folders still finds its files.
"""

from __future__ import annotations

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tuneprep.sources.files import exists, filesystem, listing

#: Batches between two snapshots.
EVERY = 20
#: What Spark leaves in a folder that is written to its end.
_DONE = "_SUCCESS"


def _numbered(path: str, name: str) -> list[int]:
    """The numbers of the complete folders ``<path>/<name>=<number>``, rising."""
    if not exists(path):
        return []
    fs, _ = filesystem(path)
    found = []
    for folder in listing(path)[1]:
        _, inner = filesystem(f"{folder}/{_DONE}")
        if fs.get_file_info(inner).type == pafs.FileType.File:
            found.append(int(folder.rsplit(f"{name}=", 1)[1]))
    return sorted(found)


def _drop(path: str) -> None:
    fs, inner = filesystem(path)
    fs.delete_dir(inner)


def _rows(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of the newest snapshot and of the deltas after it, with their ``batch``."""
    upto = max(_numbered(f"{path}/snapshot", "upto"), default=-1)
    parts = [spark.read.parquet(f"{path}/snapshot/upto={upto}")] if upto >= 0 else []
    parts += [spark.read.parquet(*[f"{path}/delta/batch={n}" for n in later])] if (later := [n for n in _numbered(f"{path}/delta", "batch") if n > upto]) else []
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]) if parts else None


def _last(rows: DataFrame, keys: list[str]) -> DataFrame:
    values = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("last")).select(*keys, "last.*")


def save_batch(batch: DataFrame, batch_id: int, path: str, keys: list[str], every: int = EVERY) -> None:
    """Put the rows of a batch into the table. A batch that is saved again replaces its rows."""
    spark = batch.sparkSession
    snapshots = _numbered(f"{path}/snapshot", "upto")
    if snapshots and snapshots[-1] >= batch_id:
        return  # a restart repeats a batch that a snapshot has already
    batch.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{path}/delta/batch={batch_id}")
    if batch_id - (snapshots[-1] if snapshots else -1) < every:
        return
    _last(_rows(spark, path), keys).write.mode("overwrite").parquet(f"{path}/snapshot/upto={batch_id}")
    for n in snapshots[:-1]:
        _drop(f"{path}/snapshot/upto={n}")
    for n in _numbered(f"{path}/delta", "batch") if snapshots else []:
        if n <= snapshots[-1]:
            _drop(f"{path}/delta/batch={n}")


def keep_latest(
    state: DataFrame, path: str, checkpoint: str, available_now: bool = True, key: str | list[str] = "run_id", every: int = EVERY
) -> StreamingQuery:
    """Write changed rows of ``state`` to the table in ``path``; the table stays right when a job is restarted."""
    keys = [key] if isinstance(key, str) else list(key)
    writer = state.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(lambda batch, batch_id: save_batch(batch, batch_id, path, keys, every))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest(spark: SparkSession, path: str, key: str | list[str] = "run_id") -> DataFrame:
    """The last row written for every key. It is an error if nothing was written yet."""
    rows = _rows(spark, path)
    if rows is None:
        raise ValueError(f"no batch has been written to '{path}'")
    return _last(rows, [key] if isinstance(key, str) else list(key)).drop("batch")
