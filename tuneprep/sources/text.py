"""Delimited and plain text files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneprep.functions.text import strip, tokens

# How prompt/completion files are recognised.
DELIMITERS = ("@", "\t", "::", "||", "|")
VALID_SHARE = 0.80
LABEL_CHARS = 80
LABEL_WORDS = 6


def read_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, line) of text files."""
    return spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def _after(line: Column, delimiter: str) -> Column:
    return F.substring_index(line, delimiter, -1)


def _before(line: Column, delimiter: str) -> Column:
    rest = F.length(_after(line, delimiter)) + len(delimiter)
    return F.substr(line, F.lit(1), F.length(line) - rest)


def _valid(line: Column, delimiter: str) -> Column:
    label = strip(_after(line, delimiter))
    ok = F.contains(line, F.lit(delimiter)) & (strip(_before(line, delimiter)) != "") & (label != "")
    if delimiter == "@":
        ok = ok & (F.length(label) < LABEL_CHARS) & (F.size(tokens(label)) <= LABEL_WORDS)
    return ok


def detect_delimiters(lines: DataFrame) -> DataFrame:
    """(file, delimiter) for every file of which most lines have one; others are absent.

    All lines count. Spark sums them up per task, so a row for each file and task is moved.
    """
    line = F.col("line")
    address = F.contains(line, F.lit("@")) & F.contains(_after(line, "@"), F.lit(".")) & ~F.contains(line, F.lit(" "))
    shares = [F.avg(_valid(line, d).cast("int")).alias(f"s{i}") for i, d in enumerate(DELIMITERS)]
    seen = lines.groupBy("file").agg(F.max(address).alias("addresses"), *shares)
    choice = F.coalesce(
        *[
            F.when((F.col(f"s{i}") >= VALID_SHARE) & (~F.col("addresses") if d == "@" else F.lit(True)), F.lit(d))
            for i, d in enumerate(DELIMITERS)
        ]
    )
    return seen.select("file", choice.alias("delimiter")).where(F.col("delimiter").isNotNull())


def split_delimited(lines: DataFrame, delimiters: DataFrame) -> DataFrame:
    """(file, prompt, completion, text), cut at the last delimiter of the line.

    A line without its file's delimiter is all prompt, with an empty completion.
    """
    joined = lines.join(delimiters, "file")
    line, d = F.col("line"), F.col("delimiter")
    cut = lambda part: F.coalesce(*[F.when(d == x, strip(part(line, x))) for x in DELIMITERS])
    has = F.contains(line, d)
    return joined.select(
        "file",
        F.when(has, cut(_before)).otherwise(line).alias("prompt"),
        F.when(has, cut(_after)).otherwise("").alias("completion"),
        line.alias("text"),
    )


def stripped_lines(lines: DataFrame) -> DataFrame:
    return lines.withColumn("line", strip("line")).where(F.col("line") != "")


def read_text_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Non-blank stripped lines: (prompt, completion, text) where a file is delimited.

    Only the list of delimiters, one row per file, is looked at before the plan is made:
    files that are all plain give the single column ``text``.
    """
    lines = stripped_lines(read_lines(spark, paths))
    delimiters = detect_delimiters(lines)
    if delimiters.isEmpty():
        return lines.select(F.col("line").alias("text"))
    plain = lines.join(delimiters, "file", "left_anti").select(F.col("line").alias("text"))
    pairs = split_delimited(lines, delimiters).drop("file")
    return pairs.unionByName(plain, allowMissingColumns=True)
