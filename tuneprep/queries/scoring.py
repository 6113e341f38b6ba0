"""Driver queries: scores of answers, classes, leaderboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneprep.functions.text import exact_match, normalize_answer, substring_match
from tuneprep.operators.board import leaderboard_rows, ranked
from tuneprep.operators.generate import missing_prompts
from tuneprep.operators.scoring import (
    by_status,
    class_lists,
    class_summary,
    compare_runs,
    confusion_cells,
    confusion_matrix,
    eval_summary,
    migration_matrix,
    pair_answers,
    per_class,
    score_answers,
)
from tuneprep.queries.fixtures import class_pairs, eval_pairs, run_settings, table
from tuneprep.queries.sql import CELLS, CLASS_PAIRS, CLASS_SUMMARY, PAIRS, PER_CLASS, SCORED, SUMMARY, WORDS, normalize, percent, strip
from tuneprep.session import scratch_dir
from tuneprep.sinks.evals import append_leaderboard, read_leaderboard

WORD_METRICS = ["word_precision", "word_recall", "word_f1"]


def exact_match_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = normalize_answer
    return eval_pairs(spark, sf_dir).select(
        "id",
        exact_match("model_output", "golden").alias("strict"),
        (norm("model_output") == norm("golden")).alias("normalised"),
    )


def substring_match_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eval_pairs(spark, sf_dir).select(
        "id",
        substring_match("model_output", "golden").alias("model"),
        substring_match("baseline_output", "golden").alias("baseline"),
    )


def word_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_answers(eval_pairs(spark, sf_dir)).select("id", *WORD_METRICS)


def transition_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples and the answers of both models as three tables, joined and classified.

    Every 50th model answer is missing: it counts as wrong.
    """
    pairs = eval_pairs(spark, sf_dir)
    samples = pairs.select("run_id", "id", "golden")
    baseline = pairs.select("run_id", "id", F.col("baseline_output").alias("output"))
    tuned = pairs.where(F.col("id") % 50 != 0).select("run_id", "id", F.col("model_output").alias("output"))
    scored = score_answers(pair_answers(samples, baseline, tuned), words=False)
    return scored.select("run_id", "id", "status", "model_correct", F.col("model_output").isNull().alias("missing"))


def migration_matrix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return migration_matrix(score_answers(eval_pairs(spark, sf_dir), words=False))


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eval_summary(score_answers(eval_pairs(spark, sf_dir)))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusion_cells(class_pairs(spark, sf_dir))


def confusion_matrix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusion_matrix(_cells(spark, sf_dir))


def class_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of every run whose gold answers are labels; free text has none."""
    labels = class_pairs(spark, sf_dir).withColumn("run_id", F.concat(F.lit("lang/"), "run_id"))
    texts = eval_pairs(spark, sf_dir).withColumn("run_id", F.concat(F.lit("text/"), "run_id")).select(labels.columns)
    both = labels.unionByName(texts)
    runs = both.select("run_id").distinct().join(class_lists(both), "run_id", "left")
    return runs.select("run_id", F.coalesce(F.size("classes"), F.lit(0)).alias("n_classes"))


def per_class_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_class(_cells(spark, sf_dir))


def class_summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_summary(per_class(_cells(spark, sf_dir)))


def _board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard_rows(_summary(spark, sf_dir), run_settings(spark, sf_dir), class_summary_query(spark, sf_dir))


def leaderboard_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results put on the leaderboard and ranked by word F1."""
    columns = ["rank", "run_name", "iters", "learning_rate", "exact_match_pct", "substring_match_pct", "avg_word_f1"]
    columns += ["categorical_accuracy_pct", "macro_f1_pct", "fixed_count", "regressed_count", "total_samples", "tokens_per_sec"]
    stored = scratch_dir(spark, "board")
    append_leaderboard(_board(spark, sf_dir), stored)
    return ranked(read_leaderboard(spark, stored), "avg_word_f1").select(*columns)


def run_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two prediction sets over the same samples, compared sample by sample."""
    pairs = eval_pairs(spark, sf_dir)
    sets = F.array(
        F.struct(F.lit("a").alias("run_id"), F.col("baseline_output").alias("output")),
        F.struct(F.lit("b").alias("run_id"), F.col("model_output").alias("output")),
    )
    long = pairs.select("id", "golden", "baseline_output", F.explode(sets).alias("s"))
    runs = long.select("s.run_id", "id", "golden", "baseline_output", F.col("s.output").alias("model_output"))
    return compare_runs(score_answers(runs, words=False), "a", "b")


def status_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter the stored results of an evaluation; the filter reaches the scan."""
    stored = scratch_dir(spark, "scored")
    score_answers(eval_pairs(spark, sf_dir), words=False).write.parquet(stored)
    return by_status(spark.read.parquet(stored), "FIXED").select("id", "run_id", "status", "golden", "model_output")


def baseline_cache_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts (document texts) that the labelled documents do not answer yet, each once."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id")
    cache = docs.join(labels, "doc_id", "left_semi").select(F.lit("base").alias("model"), F.sha2("text", 256).alias("prompt_key"))
    return missing_prompts(docs.select(F.col("text").alias("prompt")), cache, "base")


QUERIES = {
    "exact_match": exact_match_query,
    "substring_match": substring_match_query,
    "word_f1": word_f1,
    "transition_status": transition_status,
    "migration_matrix": migration_matrix_query,
    "eval_summary": _summary,
    "confusion_matrix": confusion_matrix_query,
    "class_gate": class_gate,
    "per_class_f1": per_class_f1,
    "class_summary": class_summary_query,
    "leaderboard_rank": leaderboard_rank,
    "run_compare": run_compare,
    "status_filter": status_filter,
    "baseline_cache_missing": baseline_cache_missing,
}

_STATUSES = ("preserved", "fixed", "regressed", "persistent_fail")

SQL = {
    "exact_match": f"WITH {PAIRS} SELECT id, model_output = golden AS strict, {normalize('model_output')} = {normalize('golden')} AS normalised FROM pairs",
    "substring_match": f"""WITH {SCORED} SELECT id, substring_match AS model, golden <> '' AND baseline_output <> ''
        AND ((ng <> '' AND contains(nb, ng)) OR contains(lower({strip('baseline_output')}), lower({strip('golden')}))) AS baseline FROM scored""",
    "word_f1": f"WITH {WORDS} SELECT id, word_precision, word_recall, word_f1 FROM measured",
    "transition_status": f"""WITH {SCORED} SELECT run_id, id, CASE WHEN id % 50 <> 0 THEN status WHEN baseline_correct THEN 'REGRESSED'
        ELSE 'PERSISTENT_FAIL' END AS status, model_correct AND id % 50 <> 0 AS model_correct, id % 50 = 0 AS missing FROM scored""",
    "migration_matrix": f"""WITH {SCORED}, counted AS (SELECT run_id, count(*) AS total,
            {', '.join(f"count(*) FILTER (status = '{s.upper()}') AS {s}" for s in _STATUSES)} FROM scored GROUP BY run_id)
        SELECT run_id, total, {', '.join(_STATUSES)}, fixed - regressed AS net_gain,
            {', '.join(f"{percent(s, 'total')} AS {s}_pct" for s in _STATUSES)}, {percent('(fixed - regressed)', 'total')} AS net_gain_pct FROM counted""",
    "eval_summary": f"WITH {SUMMARY} SELECT * FROM summary",
    "confusion_matrix": f"""WITH {CELLS}, grid AS (SELECT run_id, actual, unnest(list_append(list_transform(classes, lambda c: {{'p': c, 'o': false}}),
            {{'p': 'other', 'o': true}})) AS x FROM (SELECT run_id, classes, unnest(classes) AS actual FROM class_lists))
        SELECT g.run_id, g.actual, x.p AS predicted, x.o AS is_other, coalesce(n, 0) AS n FROM grid g LEFT JOIN cells c
            ON c.run_id = g.run_id AND c.actual = g.actual AND ((x.o AND c.predicted IS NULL) OR (NOT x.o AND c.predicted = x.p))""",
    "class_gate": f"""WITH {PAIRS}, {CLASS_PAIRS}, golds_n AS (SELECT 'text/' || run_id AS run_id, {normalize('golden')} AS actual FROM pairs
            UNION ALL SELECT 'lang/' || run_id, golden FROM class_pairs)
        SELECT run_id, CASE WHEN count(DISTINCT actual) BETWEEN 2 AND 15 THEN count(DISTINCT actual) ELSE 0 END::INT AS n_classes
        FROM golds_n GROUP BY run_id""",
    "per_class_f1": f"WITH {PER_CLASS} SELECT * FROM per_class",
    "class_summary": f"WITH {CLASS_SUMMARY} SELECT * FROM class_summary",
    "leaderboard_rank": f"""WITH {SUMMARY}, {CLASS_SUMMARY}, board AS (SELECT s.run_id AS run_name,
            regexp_extract(s.run_id, '(\\d+)', 1)::BIGINT * 100 + 100 AS iters, 0.0002::DOUBLE AS learning_rate, exact_match_pct,
            substring_match_pct, avg_word_f1, accuracy AS categorical_accuracy_pct, macro_f1 AS macro_f1_pct, fixed_count,
            regressed_count, s.total_samples, NULL::DOUBLE AS tokens_per_sec FROM summary s LEFT JOIN class_summary c USING (run_id))
        SELECT rank() OVER (ORDER BY avg_word_f1 DESC) AS rank, * FROM board""",
    "run_compare": f"""WITH {SCORED} SELECT id, baseline_correct AS left_correct, model_correct AS right_correct, status FROM scored""",
    "status_filter": f"WITH {SCORED} SELECT id, run_id, status, golden, model_output FROM scored WHERE status = 'FIXED' ORDER BY id LIMIT 100",
    "baseline_cache_missing": """SELECT DISTINCT sha256(text) AS prompt_key, text AS prompt FROM documents WHERE text NOT IN
        (SELECT text FROM documents JOIN labels USING (doc_id))""",
}
