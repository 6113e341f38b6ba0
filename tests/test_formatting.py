import json

import pytest
from pyspark.sql import functions as F

from tuneprep.operators.formatting import (
    assemble_conversations,
    eval_samples,
    format_records,
    gold_columns,
    record_json,
)
from tuneprep.plans.convert import plan_mapping
from tuneprep.plans.mapping import (
    ColumnMapping,
    Format,
    MappingError,
    column_list,
    detect_format,
    detect_mapping,
    parse_label_map,
    validate_mapping,
)


def records(df, fmt, mapping):
    return [json.loads(r["j"]) for r in format_records(df, fmt, mapping).select(record_json(fmt).alias("j")).collect()]


@pytest.fixture(scope="module")
def qa(spark):
    rows = [(1, " Q1 ", "ctx", "0", True), (2, "Q2", "  ", "1 ", False), (3, None, None, "2", None)]
    return spark.createDataFrame(rows, "id long, instruction string, input string, output string, flag boolean").coalesce(1)


def test_text(qa):
    assert records(qa, Format.TEXT, ColumnMapping(text_col="instruction + input")) == [{"text": "Q1\n\nctx"}, {"text": "Q2"}, {"text": ""}]
    sys = ColumnMapping(text_col="instruction", default_system_prompt=" S ")
    assert records(qa, Format.TEXT, sys) == [{"text": "S\n\nQ1"}, {"text": "S\n\nQ2"}, {"text": "S"}]


def test_template_values(qa):
    got = records(qa, Format.TEXT, ColumnMapping(text_template="<{id}>{instruction}|{flag}"))
    assert [r["text"] for r in got] == ["<1> Q1 |True", "<2>Q2|False", "<3>|"]


def test_prompt_completion_and_labels(qa):
    mapping = ColumnMapping(prompt_col="instruction, input", completion_col="output", label_map={"0": "neg", "1": "pos"})
    got = records(qa, Format.PROMPT_COMPLETION, mapping)
    assert got == [
        {"prompt": "Q1\n\nctx", "completion": "neg"},
        {"prompt": "Q2", "completion": "pos"},
        {"prompt": "", "completion": "2"},
    ]


def test_chat_columns(qa):
    mapping = ColumnMapping(system_col="input", user_col="instruction", assistant_col="output", default_system_prompt="S")
    got = records(qa, Format.CHAT, mapping)
    assert [[m["role"] for m in r["messages"]] for r in got] == [["system", "user", "assistant"]] * 3
    assert [r["messages"][0]["content"] for r in got] == ["ctx", "S", "S"]


def test_chat_messages(spark):
    rows = [([("Human ", "hi"), ("gpt", "0"), ("tool", "t")],), ([("system", " "), ("user", "u")],), (None,)]
    df = spark.createDataFrame(rows, "conversations array<struct<`from`:string,value:string>>").coalesce(1)
    mapping = detect_mapping(Format.CHAT, df.columns)
    got = records(df, Format.CHAT, mapping)
    assert got[0]["messages"] == [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "0"}, {"role": "tool", "content": "t"}]
    mapping = ColumnMapping(messages_col="conversations", role_key="from", content_key="value", label_map={"0": "no"}, default_system_prompt="S")
    got = records(df, Format.CHAT, mapping)
    assert [m["content"] for m in got[0]["messages"]] == ["S", "hi", "no", "t"]
    assert [m["content"] for m in got[1]["messages"]] == ["S", " ", "u"]
    assert got[2]["messages"] == [{"role": "system", "content": "S"}]


def test_chat_maps_and_pairs(spark):
    df = spark.sql("SELECT array(map('role','bot','content','x'), map('content','y')) AS messages")
    assert records(df, Format.CHAT, ColumnMapping(messages_col="messages"))[0]["messages"] == [
        {"role": "assistant", "content": "x"},
        {"role": "user", "content": "y"},
    ]
    df = spark.sql("SELECT array(array('human','x'), array('only')) AS messages")
    assert records(df, Format.CHAT, ColumnMapping(messages_col="messages"))[0]["messages"] == [{"role": "user", "content": "x"}]


def test_dpo_nested(spark):
    df = spark.sql(
        "SELECT array(named_struct('role','user','content','q')) AS prompt, named_struct('a', 1) AS chosen, ' no ' AS rejected"
    )
    got = records(df, Format.DPO, ColumnMapping(prompt_col="prompt", chosen_col="chosen", rejected_col="rejected", default_system_prompt="S"))
    assert got == [{"prompt": [{"role": "system", "content": "S"}, {"role": "user", "content": "q"}], "chosen": {"a": 1}, "rejected": "no"}]


def test_gold(spark):
    df = spark.sql("SELECT array(named_struct('role','user','content','q'), named_struct('role','assistant','content','a')) AS messages")
    row = df.select(*[c.alias(n) for n, c in gold_columns(Format.CHAT).items()]).first()
    assert [m["content"] for m in row["prompt"]] == ["q"] and row["expected"] == "a"


def test_eval_samples(spark):
    lines = [
        '{"prompt":"p","completion":"c","text":"t"}',
        '{"messages":[{"role":"user","content":"u"},{"role":"assistant","content":"a"}]}',
        '{"messages":[{"role":"user","content":"u"}]}',
        '{"text":"0123456789"}',
        '{"prompt":"p","chosen":"x"}',
        '{"other":1}',
    ]
    schema = "prompt string, completion string, text string, chosen string, messages array<struct<role:string,content:string>>"
    df = spark.createDataFrame([(x,) for x in lines], "v string").coalesce(1).select(F.from_json("v", schema).alias("r")).select("r.*")
    p, g, m = eval_samples(df)
    got = [(r[0], r[1], r[2] and len(r[2])) for r in df.select(p, g, m).collect()]
    assert got == [("p", "c", None), ("user: u", "a", 1), ("user: u", "", 1), ("0123456", "789", None), ("p", "x", None), ("", "", None)]


def test_assemble(spark):
    df = spark.createDataFrame([(1, 2, "assistant", "b"), (1, 1, "user", "a")], "conv_id long, turn long, role string, text string")
    assert [m["content"] for m in assemble_conversations(df).first()["messages"]] == ["a", "b"]


def test_label_map_specs():
    assert parse_label_map({0: " a "}) == {"0": "a"}
    assert parse_label_map('{"0": "neg", "1": 2}') == {"0": "neg", "1": "2"}
    assert parse_label_map("0:neg, 1=pos,,x") == {"0": "neg", "1": "pos"}
    assert parse_label_map("") is None and parse_label_map(None) is None and parse_label_map(5) is None


def test_column_lists():
    assert column_list("a + b") == ["a", "b"] and column_list("a, b,") == ["a", "b"]
    assert column_list("a, b", ["a, b"]) == ["a, b"] and column_list(" ") == []


@pytest.mark.parametrize(
    "columns, fmt, fields",
    [
        (["id", "conversations"], Format.CHAT, {"messages_col": "conversations", "role_key": "from", "content_key": "value"}),
        (["user", "assistant", "system"], Format.CHAT, {"user_col": "user", "assistant_col": "assistant", "system_col": "system"}),
        (["prompt", "chosen", "rejected"], Format.DPO, {"dpo_prompt_col": "prompt", "chosen_col": "chosen", "rejected_col": "rejected"}),
        (["anything"], Format.TEXT, {"text_col": "anything"}),
        (["text", "label"], Format.PROMPT_COMPLETION, {"prompt_col": "text", "completion_col": "label"}),
        (["text", "meta"], Format.TEXT, {"text_col": "text"}),
        (["Question", "Ground-Truth", "id"], Format.PROMPT_COMPLETION, {"prompt_col": "Question", "completion_col": "Ground-Truth"}),
        (["foo", "bar"], Format.PROMPT_COMPLETION, {"prompt_col": "foo", "completion_col": "bar"}),
        (["bar", "output"], Format.PROMPT_COMPLETION, {"prompt_col": "bar", "completion_col": "output"}),
        (["question", "gloss", "id"], Format.PROMPT_COMPLETION, {"prompt_col": "question", "completion_col": "gloss"}),
        (["question", "gloss", "notes"], Format.PROMPT_COMPLETION, {"prompt_col": "question", "completion_col": None}),
        ([], Format.PROMPT_COMPLETION, {}),
    ],
)
def test_detection(columns, fmt, fields):
    found, mapping = detect_format(columns)
    assert found is fmt
    assert {k: getattr(mapping, k) for k in fields} == fields


def test_validation_lists_everything():
    mapping = ColumnMapping(prompt_col="a + z", completion_col="y")
    assert len(validate_mapping(Format.PROMPT_COMPLETION, mapping, ["a"])) == 2
    assert validate_mapping(Format.TEXT, ColumnMapping(text_template="{a} {q}"), ["a"]) == ["The template uses columns that the dataset does not have: q."]
    assert validate_mapping(Format.CHAT, ColumnMapping(user_col="a"), ["a"]) == ["No column is given for the assistant."]
    assert validate_mapping(Format.CHAT, ColumnMapping(user_col="a", assistant_col="a", system_col="s"), ["a"]) == ["The dataset has no column 's' for the system."]
    assert validate_mapping(Format.CHAT, ColumnMapping(messages_col="m + n"), ["m + n"]) == [] != validate_mapping(Format.CHAT, ColumnMapping(messages_col="m"), ["a"])
    assert validate_mapping(Format.PROMPT_COMPLETION, ColumnMapping(prompt_template="no columns", completion_col="a"), ["a"]) == []
    assert validate_mapping(Format.DPO, ColumnMapping(), ["a"]) == [f"No column is given for the {x}." for x in ("prompt", "chosen", "rejected")]


def test_plan_mapping_overrides():
    fmt, mapping = plan_mapping(["prompt", "question", "chosen", "rejected"], "dpo", prompt_col="question", label_map="0:a")
    assert fmt is Format.DPO and mapping.preference_prompt == "question" and mapping.label_map == {"0": "a"}
    with pytest.raises(MappingError):
        plan_mapping(["a"], "chat")
