"""Batch generation with a user function, and the table of baseline answers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneprep.functions.answers import clean_answer, word_count_tokens
from tuneprep.functions.text import round_half_even

Generate = Callable[[list[str]], list[str]]


def generate_answers(
    prompts: DataFrame,
    make_generate: Callable[[], Generate],
    keys: Sequence[str] = ("id",),
    prompt: str = "prompt",
    batch_size: int = 64,
    tasks: int | None = None,
) -> DataFrame:
    """(keys, output, n_tokens, seconds) for every prompt.

    ``make_generate`` runs once per task and gives the function that answers a list of
    prompts. A failure fails the job, and so does a wrong number of answers: there are no
    placeholder answers. Prompts are dealt to ``tasks`` tasks, by default twice as many as
    there are cores and at least the shuffle partitions: an answer costs far more than moving
    its prompt.
    """
    keys = list(keys)
    schema = prompts.select(*keys).schema.add("output", "string").add("seconds", "double")

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = make_generate()
        for batch in batches:
            for start in range(0, len(batch), batch_size):
                part = batch.iloc[start : start + batch_size]
                began = time.perf_counter()
                outputs = generate(part[prompt].tolist())
                if len(outputs) != len(part):
                    raise ValueError(f"{len(part)} prompts, but {len(outputs)} answers")
                share = (time.perf_counter() - began) / len(part)
                yield part[keys].assign(output=outputs, seconds=share)

    spark = prompts.sparkSession
    tasks = tasks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    raw = prompts.select(*keys, prompt).repartition(tasks).mapInPandas(answer, schema)
    cleaned = raw.withColumn("output", clean_answer("output"))
    return cleaned.withColumn("n_tokens", word_count_tokens("output")).select(*keys, "output", "n_tokens", "seconds")


def generation_speed(answers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Tokens, seconds of work and tokens per second."""
    df = answers.groupBy(*by).agg(F.sum("n_tokens").alias("n_tokens"), F.sum("seconds").alias("seconds"))
    df = df.withColumn("__t", F.col("n_tokens") / F.greatest(F.col("seconds"), F.lit(0.001)))
    return df.withColumn("tokens_per_sec", round_half_even("__t", 1)).drop("__t")


def prompt_key(prompt: str = "prompt"):
    return F.sha2(F.col(prompt), 256)


def missing_prompts(samples: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """(prompt_key, prompt) without an answer of ``model`` in the cache, each once."""
    known = cache.where(F.col("model") == model).select("prompt_key").distinct()
    asked = samples.select(prompt_key().alias("prompt_key"), "prompt")
    wanted = asked.groupBy("prompt_key").agg(F.any_value("prompt").alias("prompt"))
    return wanted.join(known, "prompt_key", "left_anti")


def baseline_answers(
    spark: SparkSession, samples: DataFrame, model: str, cache_path: str, make_generate: Callable[[], Generate]
) -> DataFrame:
    """Samples (id, prompt) with the baseline's ``output``, out of a table that grows.

    Only prompts not answered before are generated, and they are appended to the table.
    """
    schema = "model string, prompt_key string, output string"
    try:
        cache = spark.read.schema(schema).parquet(cache_path)
    except Exception as e:
        if getattr(e, "getCondition", lambda: None)() != "PATH_NOT_FOUND":
            raise
        cache = spark.createDataFrame([], schema)
    fresh = generate_answers(missing_prompts(samples, cache, model), make_generate, keys=["prompt_key"])
    fresh.select(F.lit(model).alias("model"), "prompt_key", "output").write.mode("append").parquet(cache_path)
    stored = spark.read.schema(schema).parquet(cache_path).where(F.col("model") == model)
    answers = stored.groupBy("prompt_key").agg(F.min("output").alias("output"))
    return samples.withColumn("prompt_key", prompt_key()).join(answers, "prompt_key", "left").drop("prompt_key")
