"""Text columns against plain Python forms of the same rules."""

import random
import re
import string
from collections import Counter

import pytest

from tuneprep.functions import text as T
from tuneprep.functions.answers import clean_answer
from tuneprep.functions.chat import MESSAGES, flatten_messages, merge_system, parse_chat_prompt
from tuneprep.operators.scoring import word_metrics

PIECES = ["a", "an", "the", "The", "banana", "ther", "a-b", "it's", ".", " ", "\t", "\n", "\xa0", " ", "\x1c", "ça", "é", "the_", "A,", "“a”", "1", "à"]


def column(spark, values, name="x"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")


def results(df, expr):
    return [r["r"] for r in df.select("i", expr.alias("r")).orderBy("i").collect()]


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def py_normalize(text):
    text = "".join(c for c in text.lower() if c not in string.punctuation)
    return " ".join(re.sub(r"\b(a|an|the)\b", " ", text).split())


def test_normalize_known(spark):
    assert results(column(spark, ["  The Blue, Sky!  ", None, ""]), T.normalize_answer("x")) == ["blue sky", "", ""]


def test_normalize_and_tokens_random(spark):
    texts = random_texts(400, 1)
    df = column(spark, texts)
    assert results(df, T.normalize_answer("x")) == [py_normalize(t) for t in texts]
    assert results(df, T.tokens("x")) == [t.split() for t in texts]
    assert results(df, T.strip("x")) == [t.strip() for t in texts]


def test_round_half_even_is_python_round(spark):
    rng = random.Random(2)
    values = [rng.randint(0, 400) / rng.randint(1, 400) for _ in range(3000)] + [k / 160 for k in range(161)] + [2.675, 0.03125, -1.25, -0.00015]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    for digits in (1, 2, 4):
        assert results(df, T.round_half_even("x", digits)) == [round(v, digits) for v in values]


def py_words(p, g):
    p, g = py_normalize(p).split(), py_normalize(g).split()
    if not p or not g:
        same = float(not p and not g)
        return same, same, same
    n = sum((Counter(p) & Counter(g)).values())
    if not n:
        return 0.0, 0.0, 0.0
    prec, rec = n / len(p), n / len(g)
    return round(prec, 4), round(rec, 4), round(2 * prec * rec / (prec + rec), 4)


def test_word_metrics(spark):
    pairs = list(zip(random_texts(300, 3), random_texts(300, 4)))
    pairs += [("The colors are blue and gold", "blue and gold"), ("", ""), ("x", ""), ("b b b a c", "b b d")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, p string, g string")
    df = df.select("i", T.normalize_answer("p").alias("p"), T.normalize_answer("g").alias("g"))
    rows = word_metrics(df, "p", "g").orderBy("i").collect()
    got = [(r["word_precision"], r["word_recall"], r["word_f1"]) for r in rows]
    assert got == [py_words(*p) for p in pairs]
    assert got[300] == (0.6, 1.0, 0.75)


def test_substring_match(spark):
    cases = [("It is Blue.", "blue", True), ("", "x", False), ("x", "", False), ("the", "The", True), ("say --", "--", True), ("abc", "d", False)]
    df = spark.createDataFrame([(i, p, g) for i, (p, g, _) in enumerate(cases)], "i int, p string, g string")
    assert results(df, T.substring_match("p", "g")) == [c[2] for c in cases]


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("<think>\nhm\n</think>\n\nParis", "Paris"),
        ("<think>open only", "<think>open only"),
        ("a<think>1</think>b<think>2</think>c", "abc"),
        ("<|channel>thought x<channel|> yes <turn|>", "yes"),
        ("Assistant: model: hi <|im_end|>", "hi"),
        ("model: assistant: hi", "assistant: hi"),
        ("x</s><end_of_turn>", "x"),
        ("x<end_of_turn></s>", "x<end_of_turn>"),
        ("GenerationResult(text='four', token=5)", "four"),
        ("GenerationResult(token=5)", "GenerationResult(token=5)"),
        ("   plain\n ", "plain"),
        ("", ""),
    ],
)
def test_clean_answer(spark, raw, clean):
    assert results(column(spark, [raw]), clean_answer("x")) == [clean]


def py_parse(prompt):
    turns = []
    for line in prompt.strip().split("\n"):
        found = re.match(r"\s*(system|user|assistant):(.*)", line.strip(), re.S)
        if found:
            turns.append([found.group(1), [found.group(2).strip()]])
        elif turns:
            turns[-1][1].append(line)
    messages = [(role, "\n".join(lines).strip()) for role, lines in turns]
    return messages if any(role != "assistant" for role, _ in messages) else None


def test_parse_chat_prompt(spark):
    rng = random.Random(5)
    pieces = ["user:", "system: be kind ", " assistant: x", "plain", "", "  ", "User: no", "user : no", "\tuser:tab\r", "assistant:", "see user: y"]
    prompts = ["\n".join(rng.choice(pieces) for _ in range(rng.randint(0, 7))) for _ in range(400)]
    got = results(column(spark, prompts), parse_chat_prompt("x"))
    assert [g and [(m["role"], m["content"]) for m in g] for g in got] == [py_parse(p) for p in prompts]


def py_merge(messages):
    done, pending = [], ""
    for role, content in messages:
        if role == "system":
            pending = f"{pending}\n\n{content}".strip() if pending else content
        elif role == "user" and pending:
            done.append((role, f"{pending}\n\n{content}"))
            pending = ""
        else:
            done.append((role, content))
    return done or ([("user", pending)] if pending else [])


def test_merge_and_flatten(spark):
    rng = random.Random(6)
    conversations = [
        [(rng.choice(["system", "user", "assistant"]), rng.choice(["a", "b c", ""])) for _ in range(rng.randint(0, 6))] for _ in range(300)
    ]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(conversations)], f"i int, m {MESSAGES}")
    merged = results(df, merge_system("m"))
    assert [[(m["role"], m["content"]) for m in c] for c in merged] == [py_merge(c) for c in conversations]
    assert results(df, flatten_messages("m")) == ["\n".join(f"{r}: {c}" for r, c in conv) for conv in conversations]


def test_answers_stay_in_the_jvm(spark):
    from tuneprep.operators.scoring import score_answers

    df = spark.createDataFrame([("g", "b", "m")], "golden string, baseline_output string, model_output string")
    plan = score_answers(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


def test_shared_words_are_counted_with_their_copies(spark):
    from collections import Counter

    from tuneprep.functions.text import shared_words

    rng = random.Random(7)
    some = lambda: [rng.choice(["a", "b", "é", "😀", "a b", "", None]) for _ in range(rng.randint(0, 12))]
    rows = [(some(), some()) for _ in range(300)] + [(None, ["a"]), (["a"], None), ([], []), ([None], [None]), (["a", None], ["a", None])]
    df = spark.createDataFrame(rows, "l array<string>, r array<string>").select(shared_words("l", "r").alias("n"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
    counts = [[None if side is None else Counter(w for w in side if w is not None) for side in row] for row in rows]
    assert [r["n"] for r in df.collect()] == [None if a is None or b is None else sum((a & b).values()) for a, b in counts]
