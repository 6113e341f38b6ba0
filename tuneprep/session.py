"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings a job of this library wants. The cluster's own values win when the
# session already exists; nothing here depends on the number of executors.
CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # HotSpot never compiles a method beyond 8000 bytes. Past that, code per operator,
    # which comes in small methods, is several times faster than one large method.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tuneprep") -> SparkSession:
    """A local session, for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in CONF.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TUNEPREP_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()
_scratch: dict[str, list[str]] = {}


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="tuneprep-"), "tuneprep.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder named by ``spark.checkpoint.dir``.

    The setting is read from the session. Where the session names none, a local one (tests)
    gets a temporary folder, which later calls share; on a cluster no folder of this machine
    would do, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of '{master}' share")
        base = tempfile.mkdtemp(prefix="tuneprep-")
        spark.sparkContext.setCheckpointDir(base)
    folder = f"{base.rstrip('/')}/tuneprep/{name}-{uuid.uuid4().hex[:12]}"
    _scratch.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return folder


def clear_scratch(spark: SparkSession) -> int:
    """Remove the scratch folders made by this process for this application; returns how many there were.

    DataFrames of this library read from them, so call it when their results are written.
    """
    folders = _scratch.pop(spark.sparkContext.applicationId, [])
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    return sum(bool(path(f).getFileSystem(conf).delete(path(f), True)) for f in folders)


def local_path(uri: str) -> str:
    """The mounted path of a ``file:`` URI; other schemes are returned unchanged."""
    if uri.startswith("file://"):
        return uri[len("file://"):]
    if uri.startswith("file:"):
        return uri[len("file:"):]
    return uri


def widen(df: DataFrame) -> DataFrame:
    """``df`` over at least as many tasks as there are cores.

    For work that costs much more per row than moving the row, on inputs of few splits. A
    large input has more splits than cores and is not moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
