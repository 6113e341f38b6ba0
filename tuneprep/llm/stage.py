"""Intermediate tables of this package, written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tuneprep.session import scratch_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared scratch folder.

    The table cuts the lineage: what is computed from it later does not depend on executors
    that ran before.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def spread(spark: SparkSession) -> int:
    """Tasks for work that is heavy for each row: the shuffle partitions, at least two for each core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
