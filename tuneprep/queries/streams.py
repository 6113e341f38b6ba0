"""Driver queries: streams over files written from the tables, and batch generation.

The streams run with ``availableNow``: they take everything that is there, in several
batches, and stop. A query returns the table the stream has left behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneprep.operators.generate import generate_answers, generation_speed
from tuneprep.operators.scoring import score_answers
from tuneprep.plans.mapping import ColumnMapping, Format
from tuneprep.queries.fixtures import eval_pairs, log_lines, table
from tuneprep.queries.sql import LOG_LINES, SCORED, STOPS, strip, tokens
from tuneprep.session import scratch_dir
from tuneprep.streaming.logs import (
    append_to,
    log_stream,
    metric_stream,
    milestone_stream,
    overfit_alerts,
    rocksdb_state,
    running_accuracy,
    running_best,
)
from tuneprep.streaming.progress import count_records
from tuneprep.streaming.records import record_stream, write_formatted
from tuneprep.streaming.table import keep_latest, latest

FILES_PER_BATCH = 8


def _run(query) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def stream_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arriving as JSON lines, formatted and written as they come."""
    base = scratch_dir(spark, "stream")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs.repartition(16).write.json(f"{base}/in")
    stream = record_stream(spark, f"{base}/in", docs.schema, FILES_PER_BATCH)
    mapping = ColumnMapping(prompt_template="{doc_id}", completion_col="text")
    counts = count_records(spark, f"{base}/counts")
    query = write_formatted(stream, Format.PROMPT_COMPLETION, mapping, f"{base}/out", f"{base}/checkpoint")
    _run(query)
    counted = counts.total(query)
    spark.streams.removeListener(counts)
    written = spark.read.schema("prompt string, completion string").json(f"{base}/out")
    return written.withColumn("counted", F.lit(counted).cast("long"))


def _log_files(spark: SparkSession, sf_dir: str, base: str) -> str:
    """Log lines in files; the name of a file starts with what it holds the log of.

    One file holds the lines of many users, with the user in front of the line.
    """
    lines = log_lines(spark, sf_dir)
    text = F.concat(F.col("run_id").cast("string"), F.lit("|"), "line")
    lines.repartitionByRange(16, "line_no").sortWithinPartitions("line_no").select(text.alias("value")).write.text(base)
    return base


def _tagged(stream: DataFrame) -> DataFrame:
    run = F.substring_index("line", "|", 1)
    return stream.select(run.alias("run_id"), F.expr("substring(line, length(substring_index(line, '|', 1)) + 2)").alias("line"))


def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_dir(spark, "metrics")
    stream = _tagged(log_stream(spark, _log_files(spark, sf_dir, f"{base}/in"), FILES_PER_BATCH))
    _run(append_to(metric_stream(stream).select("run_id", "step", "train_loss", "val_loss"), f"{base}/out", f"{base}/checkpoint"))
    return spark.read.parquet(f"{base}/out")


def stream_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_dir(spark, "milestones")
    stream = _tagged(log_stream(spark, _log_files(spark, sf_dir, f"{base}/in"), FILES_PER_BATCH))
    _run(append_to(milestone_stream(stream), f"{base}/out", f"{base}/checkpoint"))
    return spark.read.parquet(f"{base}/out")


def stream_log_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_dir(spark, "best")
    stream = _tagged(log_stream(spark, _log_files(spark, sf_dir, f"{base}/in"), FILES_PER_BATCH))
    _run(keep_latest(running_best(stream), f"{base}/out", f"{base}/checkpoint"))
    return latest(spark, f"{base}/out")


def stream_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running accuracy over scored answers that arrive in files."""
    base = scratch_dir(spark, "accuracy")
    score_answers(eval_pairs(spark, sf_dir), words=False).select("run_id", "model_correct").write.parquet(f"{base}/in")
    stream = spark.readStream.schema("run_id string, model_correct boolean").option("maxFilesPerTrigger", 4).parquet(f"{base}/in")
    _run(keep_latest(running_accuracy(stream), f"{base}/out", f"{base}/checkpoint"))
    return latest(spark, f"{base}/out")


def stream_overfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each run starts to overfit, found while its losses arrive in eight batches.

    Every third point comes up to 40 events late, and every fifth first with a loss that a later
    line corrects.
    """
    base = scratch_dir(spark, "overfit")
    views = table(spark, sf_dir, "events").where(F.col("event_type") == "view")
    points = views.select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("step"), F.col("value").alias("val_loss"))
    late = F.when(F.col("step") % 3 == 0, F.pmod(F.xxhash64("step"), F.lit(40))).otherwise(0)
    right = points.select("*", F.lit(1).alias("seq"), (F.col("step") + late).alias("at"))
    wrong = points.where(F.col("step") % 5 == 0).select("run_id", "step", (F.col("val_loss") * 3).alias("val_loss"), F.lit(0).alias("seq"), F.col("step").alias("at"))
    ends = points.agg(F.min("step"), F.max("step")).first()
    batch = F.least(F.lit(7), F.floor((F.col("at") - (ends[0] or 0)) * 8 / ((ends[1] or 0) - (ends[0] or 0) + 1)))
    arriving = right.union(wrong).withColumn("batch", batch.cast("int")).drop("at")
    # The stream takes the oldest files first.
    for n in range(8):
        arriving.where(F.col("batch") == n).drop("batch").repartition(FILES_PER_BATCH).write.mode("append").parquet(f"{base}/in")
    schema = "run_id string, step long, val_loss double, seq int"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(f"{base}/in")
    with rocksdb_state(spark):
        query = keep_latest(overfit_alerts(stream), f"{base}/out", f"{base}/checkpoint")
    _run(query)
    return latest(spark, f"{base}/out").where("stop_step IS NOT NULL").select("run_id", "stop_step", "val_loss")


def batch_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a deterministic model, cleaned and counted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prompt"))

    def make_generate():
        return lambda prompts: [f"assistant: {p}</s>" for p in prompts]

    return generate_answers(docs, make_generate, keys=["doc_id"]).select("doc_id", "output", "n_tokens")


def speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens per second by language, at half a second an answer."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").alias("prompt"))
    answers = generate_answers(docs, lambda: lambda prompts: [f"assistant: {p}</s>" for p in prompts], keys=["lang"])
    return generation_speed(answers.withColumn("seconds", F.lit(0.5)), ["lang"])


QUERIES = {
    "generation_speed": speed,
    "stream_format": stream_format,
    "stream_metrics": stream_metrics,
    "stream_milestones": stream_milestones,
    "stream_log_best": stream_log_best,
    "stream_accuracy": stream_accuracy,
    "stream_overfit": stream_overfit,
    "batch_generate": batch_generate,
}

SQL = {
    "generation_speed": f"""WITH a AS (SELECT lang, greatest(1, floor(len({tokens('text')}) * 1.3::DOUBLE))::BIGINT AS n FROM documents)
        SELECT lang, sum(n)::BIGINT AS n_tokens, count(*) * 0.5::DOUBLE AS seconds, round_even(sum(n) / (count(*) * 0.5::DOUBLE), 1) AS tokens_per_sec
        FROM a GROUP BY lang""",
    "stream_format": f"SELECT doc_id::VARCHAR AS prompt, {strip('text')} AS completion, (SELECT count(*) FROM documents) AS counted FROM documents",
    "stream_metrics": f"""WITH {LOG_LINES} SELECT run_id::VARCHAR AS run_id, step, CASE WHEN event_type = 'click' THEN v END AS train_loss,
        CASE WHEN event_type = 'view' THEN v END AS val_loss FROM log_lines WHERE event_type IN ('view', 'click', 'error')""",
    "stream_milestones": f"""WITH {LOG_LINES} SELECT run_id::VARCHAR AS run_id, 'Iter ' || step || ': ' || CASE event_type
            WHEN 'view' THEN 'Val loss ' || printf('%.2f', v) || ', Val It/sec 2.0' ELSE 'VAL LOSS = ' || printf('%.2f', v) END AS milestone
        FROM log_lines WHERE event_type IN ('view', 'purchase')""",
    "stream_log_best": f"""WITH {LOG_LINES} SELECT run_id::VARCHAR AS run_id, min(v) FILTER (event_type IN ('view', 'purchase')) AS best_val_loss,
        arg_min(step, (v, step)) FILTER (event_type IN ('view', 'purchase')) AS best_step, count(*) FILTER (event_type IN ('view', 'purchase')) AS n_val
        FROM log_lines WHERE event_type <> 'signup' GROUP BY run_id""",
    "stream_accuracy": f"WITH {SCORED} SELECT run_id, count(*) AS samples, count(*) FILTER (model_correct) AS correct FROM scored GROUP BY run_id",
    "stream_overfit": f"""WITH {STOPS} SELECT run_id::VARCHAR AS run_id, stop_step, m.val_loss FROM stops s JOIN matched m USING (run_id)
        WHERE m.step = s.stop_step""",
    "batch_generate": f"""SELECT doc_id, rtrim({strip('text')}) AS output, greatest(1, floor(len({tokens('text')}) * 1.3::DOUBLE))::BIGINT AS n_tokens
        FROM documents""",
}
