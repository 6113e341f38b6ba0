import pytest
from pyspark.sql import functions as F

from tuneprep.operators.board import LEADERBOARD, leaderboard_rows, ranked
from tuneprep.operators.checks import discrete_labels, key_sets, label_values, reasoning_summary, training_compat
from tuneprep.operators.coverage import implied_epochs, sweep_coverage, sweep_runs
from tuneprep.operators.generate import baseline_answers, generate_answers, generation_speed
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
from tuneprep.plans.evaluate import evaluate


def pairs(spark, rows):
    return spark.createDataFrame([("r", i, *r) for i, r in enumerate(rows)], "run_id string, id long, golden string, baseline_output string, model_output string")


@pytest.fixture(scope="module")
def seven(spark):
    rows = [("x", "x", "x"), ("x", "x", "it is X."), ("x", "q", "x"), ("x", "q", "x"), ("x", "", "x"), ("x", "x", "q"), ("x", "q", "q")]
    return score_answers(pairs(spark, rows))


def test_transitions(seven):
    row = migration_matrix(seven).first()
    assert (row["preserved"], row["fixed"], row["regressed"], row["persistent_fail"]) == (2, 3, 1, 1)
    assert (row["net_gain"], row["net_gain_pct"], row["fixed_pct"]) == (2, 28.6, 42.9)


def test_summary(seven):
    row = eval_summary(seven).first()
    assert (row["total_samples"], row["strict_count"], row["exact_count"], row["substring_count"]) == (7, 4, 4, 5)
    assert row["substring_match_pct"] == 71.4
    assert row["avg_word_f1"] == round((1 + 0.5 + 1 + 1 + 1 + 0 + 0) / 7, 4)


def test_missing_answers_count_as_wrong(spark):
    samples = spark.createDataFrame([("r", 1, ""), ("r", 2, "a")], "run_id string, id long, golden string")
    one = spark.createDataFrame([("r", 2, "a")], "run_id string, id long, output string")
    rows = score_answers(pair_answers(samples, one, one.where("id > 2"))).orderBy("id").collect()
    assert [r["status"] for r in rows] == ["PERSISTENT_FAIL", "REGRESSED"]
    summary = eval_summary(score_answers(pair_answers(samples, one, one))).first()
    assert (summary["total_samples"], summary["missing_count"]) == (2, 1)


def test_confusion(spark):
    rows = [("positive", "", "positive"), ("negative", "", "negative"), ("neutral", "", "The answer: neutral!"), ("positive", "", "positive, not negative"), ("neutral", "", "Neutral")]
    cells = confusion_cells(pairs(spark, rows))
    matrix = {(r["actual"], r["predicted"], r["is_other"]): r["n"] for r in confusion_matrix(cells).collect()}
    assert len(matrix) == 12 and sum(matrix.values()) == 5
    assert matrix[("positive", "other", True)] == 1
    classes = {r["class"]: (r["support"], r["precision"], r["recall"], r["f1"]) for r in per_class(cells).collect()}
    assert classes["positive"] == (2, 100.0, 50.0, 66.67)
    total = class_summary(per_class(cells)).first()
    assert (total["accuracy"], total["unclassified"], total["macro_f1"]) == (80.0, 1, 88.89)
    # positive and neutral are equally frequent: the one seen first is the majority
    assert (total["majority_label"], total["majority_baseline"], total["accuracy_over_baseline"]) == ("positive", 40.0, 40.0)


def test_free_text_answers_to_class_questions_are_not_moved(spark, tmp_path):
    rows = [("yes" if k % 2 else "no", "", f"free answer {k} that says " + ("yes" if k % 3 else "nothing")) for k in range(200)]
    cells = confusion_cells(pairs(spark, rows))
    assert cells.count() <= 4 and sum(r["n"] for r in cells.collect()) == 200
    from tuneprep.operators import scoring

    plans, written = [], scoring._written
    scoring._written = lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or written(df, name)
    try:
        confusion_cells(pairs(spark, rows))
    finally:
        scoring._written = written
    by_name = dict(plans)
    moved = [line for line in by_name["cells"].splitlines() if "Exchange" in line]
    assert moved and not any("answer" in line or "model_output" in line for line in moved)


def test_class_named_other_and_inside_words(spark):
    rows = [("other", "", "other"), ("a b", "", "x a bc"), ("a b", "", "zzz")]
    cells = confusion_cells(pairs(spark, rows))
    matrix = {(r["actual"], r["predicted"], r["is_other"]): r["n"] for r in confusion_matrix(cells).collect()}
    assert matrix[("other", "other", False)] == 1 and matrix[("other", "other", True)] == 0
    assert class_summary(per_class(cells)).first()["unclassified"] >= 1


@pytest.mark.parametrize("classes, open_", [(1, True), (2, False), (15, False), (16, True), (400, True)])
def test_class_gate(spark, classes, open_):
    df = spark.range(800).select(F.lit("r").alias("run_id"), "id", F.concat(F.lit("c"), F.col("id") % classes).alias("golden"), F.lit("x").alias("model_output"))
    assert class_lists(df).isEmpty() is open_


def test_compare_and_filter(spark):
    rows = [("a", 1, True), ("a", 2, False), ("b", 1, False), ("b", 2, True)]
    scored = spark.createDataFrame(rows, "run_id string, id long, model_correct boolean")
    got = {r["id"]: r["status"] for r in compare_runs(scored, "a", "b").collect()}
    assert got == {1: "REGRESSED", 2: "FIXED"}
    many = spark.range(300).select("id", F.lit("FIXED").alias("status"))
    assert [r["id"] for r in by_status(many, "FIXED").collect()] == list(range(100))


def test_evaluate_is_all_keyed_by_run(spark):
    both = pairs(spark, [("x", "x", "x"), ("y", "x", "y")]).unionByName(pairs(spark, [("x", "x", "q")]).withColumn("run_id", F.lit("s")))
    result = evaluate(both)
    assert {r["run_id"]: r["total_samples"] for r in result.summary.collect()} == {"r": 2, "s": 1}
    assert [r["run_id"] for r in result.class_summary.collect()] == ["r"]


def test_board(spark):
    runs = spark.createDataFrame([("r1", "one"), ("r2", "two"), ("r3", "three")], "run_id string, run_name string")
    summaries = spark.createDataFrame([("r1", 0.5), ("r2", 0.9), ("r3", 0.5)], "run_id string, avg_word_f1 double")
    board = leaderboard_rows(summaries, runs)
    assert board.columns == list(LEADERBOARD) and len(LEADERBOARD) == 25
    assert [(r["rank"], r["run_name"]) for r in ranked(board, "avg_word_f1").collect()] == [(1, "two"), (2, "one"), (2, "three")]


def test_labels(spark):
    df = spark.createDataFrame(
        [(1, 1.0, " 0", "x", True), (0, 2.0, "10", "y", False), (1, None, "-2", "x ", None), (1, 2.0, "007", "3", True)],
        "i int, d double, s string, m string, b boolean",
    )
    got = {r["column"]: (r["values"], r["is_integer"]) for r in label_values(df, df.columns).collect()}
    assert got == {
        "i": (["0", "1"], True),
        "d": (["1", "2"], True),
        "s": (["-2", "0", "7", "10"], True),
        "m": (["3", "x", "y"], False),
        "b": (["0", "1"], True),
    }
    named = df.withMetadata("i", {"names": ["no", "yes"]})
    assert discrete_labels(named, "i").suggested_map == {"0": "no", "1": "yes"}
    assert discrete_labels(spark.range(50), "id") is None and discrete_labels(df, "nope") is None


def test_traces(spark):
    df = spark.sql("""SELECT 'a' AS _split, array(named_struct('role','user','content','<think>','reasoning','')) AS messages
        UNION ALL SELECT 'a', array(named_struct('role','assistant','content','x <channel|>','reasoning',''))
        UNION ALL SELECT 'b', array(named_struct('role','user','content','x','reasoning','because'))""")
    assert {r[0]: (r["rows"], r["with_trace"]) for r in reasoning_summary(df).collect()} == {"a": (2, 1), "b": (1, 1)}
    plain = spark.sql("SELECT 'a' AS _split, 'x' AS prompt, '<think>' AS completion")
    assert reasoning_summary(plain).first()["has_trace"]


def test_key_sets(spark):
    lines = ['{"a":1,"b":2}', '{"b":1,"a":{"c":1}}', '{"a":1', "[1]", ""]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert [(r["keys"], r["rows"]) for r in key_sets(df).collect()] == [(["a", "b"], 2)]
    commas = spark.createDataFrame([('{"a,b":1}',), ('{"a":1,"b":2}',)], "value string")
    assert not training_compat(key_sets(commas), multimodal=False).first()["consistent"]
    chat = spark.createDataFrame([('{"question":1,"answer":2}',)], "value string")
    assert training_compat(key_sets(chat)).first()["compatible"]
    assert not training_compat(key_sets(df)).first()["compatible"]
    assert training_compat(key_sets(df), multimodal=False).first()["compatible"]


def test_epochs(spark):
    counts = spark.createDataFrame([("d", 2400), ("empty", 0)], "dataset string, records long")
    runs = sweep_runs(counts, {"iters": [600, 1200], "batch_size": [4, 8], "grad_accumulation_steps": [1, 2]})
    got = {r["dataset"]: (r["total_runs"], r["min_implied_epochs"]) for r in sweep_coverage(runs).collect()}
    assert got == {"d": (8, 1.0), "empty": (8, None)}
    assert "Join" not in runs._jdf.queryExecution().executedPlan().toString()
    one = spark.sql("SELECT 10 AS i, 4 AS b, 0 AS a, 20 AS n")
    assert one.select(implied_epochs(F.col("i"), F.col("b"), F.col("n"), F.col("a"))).first()[0] == 2.0


def test_generate(spark):
    prompts = spark.range(200, numPartitions=3).select("id", F.concat(F.lit("p"), "id").alias("prompt"))
    out = generate_answers(prompts, lambda: lambda ps: [f"model: {p} b c</s>" for p in ps], batch_size=7)
    row = out.where("id = 5").first()
    assert (row["output"], row["n_tokens"]) == ("p5 b c", 3)
    speed = generation_speed(out).first()
    assert speed["n_tokens"] == 600 and speed["tokens_per_sec"] > 0
    with pytest.raises(Exception, match="answers"):
        generate_answers(prompts, lambda: lambda ps: ps[:-1]).collect()
    with pytest.raises(Exception, match="no model"):
        generate_answers(prompts, lambda: (_ for _ in ()).throw(RuntimeError("no model"))).collect()


def test_baseline_cache(spark, tmp_path):
    samples = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, prompt string")
    cache = str(tmp_path / "cache")
    first = baseline_answers(spark, samples.where("prompt = 'a'"), "m", cache, lambda: lambda ps: ["one"] * len(ps))
    assert first.count() == 2
    second = baseline_answers(spark, samples, "m", cache, lambda: lambda ps: ["two"] * len(ps))
    assert {r["id"]: r["output"] for r in second.collect()} == {1: "one", 2: "one", 3: "two"}
    other = baseline_answers(spark, samples, "n", cache, lambda: lambda ps: ["three"] * len(ps))
    assert {r["output"] for r in other.collect()} == {"three"}
    assert spark.read.parquet(cache).count() == 4


def test_many_spellings_of_few_labels(spark):
    df = spark.range(2000).select(F.concat(F.repeat(F.lit(" "), (F.col("id") % 700).cast("int")), (F.col("id") % 3).cast("string")).alias("s"))
    assert discrete_labels(df, "s").values == ["0", "1", "2"]
