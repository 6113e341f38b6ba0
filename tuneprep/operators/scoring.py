"""Scoring of answers against gold answers, for any number of runs in one job.

Sums of ratios are kept as integers (ten-thousandths, hundredths), so a result does not
depend on the order in which partitions are added up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneprep.functions.text import (
    exact_match,
    normal_words,
    normalize_answer,
    round_half_even,
    shared_words,
    substring_match,
    with_percentages,
)
from tuneprep.session import scratch_dir

STATUSES = ("PRESERVED", "FIXED", "REGRESSED", "PERSISTENT_FAIL")
MAX_CLASSES = 15
OTHER = "other"


def pair_answers(
    samples: DataFrame, baseline: DataFrame, tuned: DataFrame, on: Sequence[str] = ("run_id", "id")
) -> DataFrame:
    """Samples with both answers, joined on the sample's key.

    A sample without an answer stays, with NULL in place of the answer: it counts as wrong
    and stays in the denominator.
    """
    on = list(on)
    base = baseline.select(*on, F.col("output").alias("baseline_output"))
    model = tuned.select(*on, F.col("output").alias("model_output"))
    return samples.join(base, on, "left").join(model, on, "left")


def transition(baseline_correct: Column, model_correct: Column) -> Column:
    return (
        F.when(baseline_correct & model_correct, "PRESERVED")
        .when(model_correct, "FIXED")
        .when(baseline_correct, "REGRESSED")
        .otherwise("PERSISTENT_FAIL")
    )


def word_metrics(df: DataFrame, norm_prediction: str, norm_gold: str) -> DataFrame:
    """Add word precision, recall and F1 (multiset overlap), rounded to 4 digits."""
    df = df.withColumns({"__p": normal_words(norm_prediction), "__g": normal_words(norm_gold)})
    df = df.withColumns(
        {"__np": F.size("__p"), "__ng": F.size("__g"), "__same": shared_words("__p", "__g")}
    ).drop("__p", "__g")
    both_empty = (F.col("__np") == 0) & (F.col("__ng") == 0)

    def ratio(size: str) -> Column:
        return F.when(both_empty, 1.0).when(F.col("__same") > 0, F.col("__same") / F.col(size)).otherwise(0.0)

    df = df.withColumns({"__prec": ratio("__np"), "__rec": ratio("__ng")})
    total = F.col("__prec") + F.col("__rec")
    df = df.withColumn("__f1", F.when(total > 0, F.lit(2.0) * F.col("__prec") * F.col("__rec") / total).otherwise(0.0))
    return df.withColumns(
        {
            "word_precision": round_half_even("__prec", 4),
            "word_recall": round_half_even("__rec", 4),
            "word_f1": round_half_even("__f1", 4),
        }
    ).drop("__np", "__ng", "__same", "__prec", "__rec", "__f1")


def score_answers(pairs: DataFrame, words: bool = True) -> DataFrame:
    """Per-sample results of ``golden``, ``baseline_output`` and ``model_output``."""
    df = pairs.withColumns(
        {
            "__gold": normalize_answer("golden"),
            "__model": normalize_answer("model_output"),
            "__base": normalize_answer("baseline_output"),
        }
    )
    df = df.withColumns(
        {
            "exact_match_strict": exact_match("model_output", "golden"),
            "exact_match_norm": F.col("model_output").isNotNull() & (F.col("__model") == F.col("__gold")),
            "substring_match": substring_match("model_output", "golden", "__model", "__gold"),
            "baseline_correct": substring_match("baseline_output", "golden", "__base", "__gold")
            | (F.col("baseline_output").isNotNull() & (F.col("__base") == F.col("__gold"))),
        }
    )
    df = df.withColumn("model_correct", F.col("substring_match") | F.col("exact_match_norm"))
    df = df.withColumn("status", transition(F.col("baseline_correct"), F.col("model_correct")))
    if words:
        df = word_metrics(df, "__model", "__gold")
    return df.drop("__gold", "__model", "__base")


def _count(flag: Column | str) -> Column:
    flag = F.col(flag) if isinstance(flag, str) else flag
    return F.count_if(F.coalesce(flag, F.lit(False)))


def eval_summary(scored: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Totals, percentages and mean word metrics; one row per run."""

    def units(name: str) -> Column:
        return F.sum(F.round(F.col(name) * F.lit(10000.0)).cast("long"))

    df = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_samples"),
        _count("exact_match_strict").alias("strict_count"),
        _count("exact_match_norm").alias("exact_count"),
        _count("substring_match").alias("substring_count"),
        units("word_f1").alias("__f1"),
        units("word_precision").alias("__prec"),
        units("word_recall").alias("__rec"),
        _count(F.col("status") == "FIXED").alias("fixed_count"),
        _count(F.col("status") == "REGRESSED").alias("regressed_count"),
        _count(F.col("model_output").isNull()).alias("missing_count"),
    )
    df = with_percentages(
        df,
        "total_samples",
        exact_match_pct="exact_count",
        exact_match_strict_pct="strict_count",
        substring_match_pct="substring_count",
    )
    means = {"avg_word_f1": "__f1", "avg_word_prec": "__prec", "avg_word_recall": "__rec"}
    for name, total in means.items():
        df = df.withColumn(total, F.col(total) / F.lit(10000.0) / F.col("total_samples"))
        df = df.withColumn(name, round_half_even(total, 4)).drop(total)
    return df


def migration_matrix(scored: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Transition counts and percentages with the net gain; one row per run."""
    names = {s: s.lower() for s in STATUSES}
    df = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), *[_count(F.col("status") == s).alias(n) for s, n in names.items()]
    )
    df = df.withColumn("net_gain", F.col("fixed") - F.col("regressed"))
    return with_percentages(df, "total", **{f"{n}_pct": n for n in [*names.values(), "net_gain"]})


def hash128(value: Column) -> Column:
    """16 bytes that stand for a text where texts are only counted."""
    return F.unhex(F.md5(value))


def class_lists(pairs: DataFrame, by: str = "run_id", gold: str = "golden", max_classes: int = MAX_CLASSES) -> DataFrame:
    """The gold classes of every run that has 2..max_classes of them.

    Distinct gold answers are counted by their hashes, so free text is not moved. The texts
    are then read for the runs that have few; there are at most max_classes of a run. Both
    results are written, so that Spark knows how small they are.
    """
    actual = normalize_answer(gold).alias("actual")
    hashes = pairs.select(by, actual).select(by, hash128(F.col("actual")).alias("hash")).distinct()
    few = hashes.groupBy(by).agg(F.count(F.lit(1)).alias("k")).where(F.col("k").between(2, max_classes)).select(by)
    few = _written(few, "class-runs")
    found = pairs.select(by, actual).join(few, by, "left_semi").distinct()
    return _written(found.groupBy(by).agg(F.sort_array(F.collect_list("actual")).alias("classes")), "classes")


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def confusion_cells(
    pairs: DataFrame,
    by: str = "run_id",
    gold: str = "golden",
    prediction: str = "model_output",
    key: str = "id",
    max_classes: int = MAX_CLASSES,
) -> DataFrame:
    """Counts per (actual, predicted); ``predicted`` is NULL when no single class is named.

    A prediction is its class when it equals one, or the only class it contains. Answers are
    mapped to classes where they are read: a task passes on at most one row for each pair of
    classes of a run, and no answer.
    """
    classes = class_lists(pairs, by, gold, max_classes)
    norm = pairs.join(classes, by).select(
        by, F.col(key).alias("__id"), normalize_answer(gold).alias("actual"), normalize_answer(prediction).alias("answer"), "classes"
    )
    answer = F.col("answer")
    named = F.filter("classes", lambda c: (c != "") & F.contains(answer, c))
    predicted = F.when(F.array_contains("classes", answer), answer).when(F.size(named) == 1, named[0])
    cells = norm.select(by, "__id", "actual", predicted.alias("predicted")).groupBy(by, "actual", "predicted")
    counted = cells.agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("first_id"))
    return _written(counted.join(classes, by), "cells")


def confusion_matrix(cells: DataFrame, by: str = "run_id") -> DataFrame:
    """The full matrix with zero cells and the ``other`` column, as a long table."""
    seen = cells.select(
        by, "actual", F.col("predicted").isNull().alias("is_other"), F.coalesce("predicted", F.lit(OTHER)).alias("predicted"), "n"
    )
    rows = cells.groupBy(by).agg(F.first("classes").alias("classes"))
    columns = F.concat(
        F.transform("classes", lambda c: F.struct(c.alias("predicted"), F.lit(False).alias("is_other"))),
        F.array(F.struct(F.lit(OTHER).alias("predicted"), F.lit(True).alias("is_other"))),
    )
    grid = rows.select(by, "classes", F.explode("classes").alias("actual"))
    grid = grid.select(by, "actual", F.explode(columns).alias("c")).select(by, "actual", "c.predicted", "c.is_other")
    empty = grid.withColumn("n", F.lit(0).cast("long"))
    return empty.unionByName(seen).groupBy(by, "actual", "predicted", "is_other").agg(F.sum("n").alias("n"))


def per_class(cells: DataFrame, by: str = "run_id") -> DataFrame:
    """Support, precision, recall and F1 (percent, 2 digits) of every gold class."""
    n = F.col("n")
    hit = F.coalesce(F.col("actual") == F.col("predicted"), F.lit(False))
    as_actual = F.struct(
        F.col("actual").alias("class"),
        n.alias("support"),
        F.lit(0).cast("long").alias("answered"),
        F.when(hit, n).otherwise(0).alias("tp"),
        F.when(F.col("predicted").isNull(), n).otherwise(0).alias("unclassified"),
        F.col("first_id").alias("first_id"),
    )
    zero = F.lit(0).cast("long")
    as_predicted = F.struct(
        F.col("predicted").alias("class"),
        zero.alias("support"),
        n.alias("answered"),
        zero.alias("tp"),
        zero.alias("unclassified"),
        F.lit(None).cast("long").alias("first_id"),
    )
    parts = cells.select(by, F.explode(F.array(as_actual, as_predicted)).alias("p")).select(by, "p.*")
    df = (
        parts.where(F.col("class").isNotNull())
        .groupBy(by, "class")
        .agg(*[F.sum(c).alias(c) for c in ("support", "answered", "tp", "unclassified")], F.min("first_id").alias("first_id"))
    )
    df = df.withColumns(
        {
            "__p": F.when(F.col("answered") > 0, F.col("tp") / F.col("answered")).otherwise(0.0),
            "__r": F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0),
        }
    )
    total = F.col("__p") + F.col("__r")
    df = df.withColumn("__f", F.when(total > 0, F.lit(2.0) * F.col("__p") * F.col("__r") / total).otherwise(0.0))
    hundred = {c: F.col(c) * F.lit(100.0) for c in ("__p", "__r", "__f")}
    df = df.withColumns(hundred)
    return df.withColumns(
        {"precision": round_half_even("__p", 2), "recall": round_half_even("__r", 2), "f1": round_half_even("__f", 2)}
    ).drop("__p", "__r", "__f")


def class_summary(classes: DataFrame, by: str = "run_id") -> DataFrame:
    """Accuracy, macro F1 and the majority baseline; one row per run.

    ``classes`` is the result of ``per_class``. The majority label is the most frequent
    gold class; among equals the one whose first sample has the lowest id.
    """
    df = classes.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_classes"),
        F.sum("support").alias("total_samples"),
        F.sum("tp").alias("__correct"),
        F.sum("unclassified").alias("unclassified"),
        F.sum(F.round(F.col("f1") * F.lit(100.0)).cast("long")).alias("__f1"),
        F.max_by("class", F.struct(F.col("support"), -F.col("first_id"))).alias("majority_label"),
        F.max("support").alias("__majority"),
    )
    df = with_percentages(df, "total_samples", 2, accuracy="__correct", majority_baseline="__majority")
    df = df.withColumns(
        {
            "__macro": F.col("__f1") / F.lit(100.0) / F.col("n_classes"),
            "__over": F.col("accuracy") - F.col("majority_baseline"),
        }
    )
    return df.withColumns(
        {"macro_f1": round_half_even("__macro", 2), "accuracy_over_baseline": round_half_even("__over", 2)}
    ).drop("__correct", "__f1", "__majority", "__macro", "__over")


def compare_runs(scored: DataFrame, left: str, right: str, on: Sequence[str] = ("id",)) -> DataFrame:
    """Transition of every sample from one run to another."""
    on = list(on)
    a = scored.where(F.col("run_id") == left).select(*on, F.col("model_correct").alias("left_correct"))
    b = scored.where(F.col("run_id") == right).select(*on, F.col("model_correct").alias("right_correct"))
    return a.join(b, on).withColumn("status", transition(F.col("left_correct"), F.col("right_correct")))


def by_status(scored: DataFrame, status: str, limit: int = 100) -> DataFrame:
    """The first predictions with a status, in order of id."""
    return scored.where(F.col("status") == status).orderBy("id").limit(limit)
