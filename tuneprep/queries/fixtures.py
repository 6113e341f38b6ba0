"""Inputs of the driver queries, derived from the supplied tables.

Each rule exists twice, as Spark columns and as SQL (see ``sql.py``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneprep.functions.text import normal_words, single_spaces
from tuneprep.session import widen

NEXT_LANG = {"de": "en", "en": "es", "es": "fr", "fr": "de"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _answer(form: Column) -> Column:
    """Five forms of an answer to ``golden``, over the whole text."""
    half = F.floor(F.size("__words") / 2).cast("int")
    return (
        F.when(form == 0, F.col("golden"))
        .when(form == 1, F.concat(F.lit("The "), F.col("golden"), F.lit(".")))
        .when(form == 2, F.concat(F.lit("answer is "), F.col("golden")))
        .when(form == 3, F.array_join(F.slice("__words", F.lit(1), half), " "))
        .otherwise(F.array_join(F.slice("__words", half + 1, F.size("__words") - half), " "))
    )


def eval_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, id, golden, baseline_output, model_output): a pair of answers per document.

    The gold answer is the document's text with single spaces. The run is its source.
    """
    docs = widen(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    df = docs.select("doc_id", "source", single_spaces("text").alias("golden"))
    df = df.withColumn("__words", normal_words("golden"))
    return df.select(
        F.col("source").alias("run_id"),
        F.col("doc_id").alias("id"),
        "golden",
        _answer(F.floor(F.col("doc_id") / 5) % 5).alias("baseline_output"),
        _answer(F.col("doc_id") % 5).alias("model_output"),
    )


def class_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, id, golden, model_output): the language of a document and a guess at it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    following = F.create_map(*[F.lit(x) for pair in NEXT_LANG.items() for x in pair])
    guess = (
        F.when(F.col("doc_id") % 8 == 7, "unknown")
        .when(F.col("doc_id") % 4 == 3, F.try_element_at(following, F.col("lang")))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("Lang: "), F.col("lang"), F.lit("!")))
        .otherwise(F.col("lang"))
    )
    return docs.select(
        F.col("source").alias("run_id"), F.col("doc_id").alias("id"), F.col("lang").alias("golden"), guess.alias("model_output")
    )


def loss_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, step, metric, value): views are validation losses, clicks are train losses.

    A user is a run and the event number is the step, so no ordering job is needed here.
    """
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click"))
    return events.select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("step"),
        F.when(F.col("event_type") == "view", "val").otherwise("train").alias("metric"),
        "value",
    )


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, step, path): saved with every validation loss and at every purchase."""
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "purchase"))
    return events.select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("step"),
        F.concat(F.lit("adapters/"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("path"),
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, line_no, line): every event as a line of its user's training log.

    Ten events share a step, so some steps of a run are reported twice.
    """
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    step = F.concat(F.lit("Iter "), F.floor(F.col("event_id") / 10).cast("string"), F.lit(": "))
    number = F.format_string("%.2f", "value")
    line = (
        F.when(F.col("event_type") == "view", F.concat(step, F.lit("Val loss "), number, F.lit(", Val It/sec 2.0")))
        .when(
            F.col("event_type") == "click",
            F.concat(step, F.lit("Train loss "), number, F.lit(", Learning Rate 1.000e-05, It/sec 1.150, Tokens/sec 1200.0")),
        )
        .when(F.col("event_type") == "purchase", F.concat(step, F.lit("VAL LOSS = "), number))
        .when(F.col("event_type") == "error", F.concat(step, F.lit("Train loss 1.2.3, It/sec 0.5")))
        .otherwise(F.concat(F.lit("  Loading weights "), F.col("event_id").cast("string")))
    )
    return events.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("line_no"), line.alias("line"))


def run_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per document source, with settings that follow from the source's name."""
    sources = table(spark, sf_dir, "documents").select("source").distinct()
    number = F.regexp_extract("source", r"(\d+)", 1).cast("bigint")
    return sources.select(
        F.col("source").alias("run_id"),
        F.col("source").alias("run_name"),
        F.lit("base-1b").alias("model"),
        F.lit("lora").alias("fine_tune_type"),
        (number * 100 + 100).alias("iters"),
        F.lit(4).alias("batch_size"),
        F.lit(0.0002).alias("learning_rate"),
        F.lit(8).alias("lora_rank"),
        F.lit(16.0).alias("lora_alpha"),
        number.alias("seed"),
        F.lit(16).alias("num_layers"),
        F.concat(F.lit("adapters/"), F.col("source")).alias("adapter_path"),
    )
