"""Rows to training records, as column expressions compiled once from a mapping.

No operator here shuffles: a format is one projection, so it runs in the scan stage, and
column pruning reads only the mapped columns.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tuneprep.functions.chat import MESSAGES, message
from tuneprep.functions.text import strip
from tuneprep.plans.mapping import ColumnMapping, Format, check_mapping, column_list

_BRACED = re.compile(r"\{([a-zA-Z0-9_]+)\}")


def text_of(df: DataFrame, name: str) -> Column:
    """A column as text: nested values as JSON, booleans as True/False."""
    kind = df.schema[name].dataType
    col = F.col(f"`{name}`")
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(col, {"ignoreNullFields": "false"})
    if isinstance(kind, T.BooleanType):
        return F.when(col, "True").when(~col, "False")
    return col.cast("string")


def joined_columns(df: DataFrame, spec: str | None, separator: str = "\n\n") -> Column:
    """Stripped, non-empty values of one or several columns, joined."""
    parts = [F.nullif(strip(text_of(df, n)), F.lit("")) for n in column_list(spec, df.columns) if n in df.columns]
    return F.concat_ws(separator, *parts) if parts else F.lit("")


def fill_template(df: DataFrame, template: str) -> Column:
    """``{name}`` replaced by the column's text; NULL and unknown names give ''."""
    pieces: list[Column] = []
    at = 0
    for found in _BRACED.finditer(template):
        pieces.append(F.lit(template[at : found.start()]))
        if found.group(1) in df.columns:
            pieces.append(F.coalesce(text_of(df, found.group(1)), F.lit("")))
        at = found.end()
    pieces.append(F.lit(template[at:]))
    return F.concat(*pieces)


def map_label(value: Column, labels: Mapping[str, str] | None) -> Column:
    """The mapped label of the stripped value, or the value itself."""
    if not labels:
        return value
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.when(value == "", value).otherwise(F.coalesce(F.try_element_at(table, strip(value)), value))


def map_label_table(df: DataFrame, column: str, labels: DataFrame, key: str = "label", value: str = "name") -> DataFrame:
    """``map_label`` for a map kept as a table. Spark broadcasts it if it is small."""
    found = labels.select(strip(F.col(key).cast("string")).alias("__key"), F.col(value).cast("string").alias("__name"))
    text = F.col(column).cast("string")
    joined = df.withColumn("__key", strip(text)).join(found, "__key", "left")
    return joined.withColumn(column, F.coalesce(F.col("__name"), text)).select(*df.columns)


def normalize_role(role: Column, role_map: Mapping[str, str]) -> Column:
    key = strip(F.lower(role.cast("string")))
    if not role_map:
        return key
    table = F.create_map(*[F.lit(x) for pair in role_map.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), key)


def _item_reader(item: T.DataType, mapping: ColumnMapping):
    """How to read (role, content) from one element of the messages column."""
    if isinstance(item, T.StructType):
        def read(m: Column, key: str, default: str) -> Column:
            if key not in item.names:
                return F.lit(default)
            kind = item[key].dataType
            nested = isinstance(kind, (T.StructType, T.ArrayType, T.MapType))
            value = F.to_json(m[key], {"ignoreNullFields": "false"}) if nested else m[key].cast("string")
            return F.coalesce(value, F.lit(default))

        return lambda m: (read(m, mapping.role_key, "user"), read(m, mapping.content_key, ""))
    if isinstance(item, T.MapType):
        def entry(m: Column, key: str, default: str) -> Column:
            return F.coalesce(F.try_element_at(m, F.lit(key)).cast("string"), F.lit(default))

        return lambda m: (entry(m, mapping.role_key, "user"), entry(m, mapping.content_key, ""))
    if isinstance(item, T.ArrayType):
        return lambda m: (m[0].cast("string"), m[1].cast("string"))
    raise TypeError(f"messages must hold structs, maps or [role, content] pairs, not {item.simpleString()}")


def chat_messages(df: DataFrame, mapping: ColumnMapping) -> Column:
    def labelled(role: Column, content: Column) -> Column:
        return F.when(role == "assistant", map_label(content, mapping.label_map)).otherwise(content)

    if mapping.messages_col and mapping.messages_col in df.columns:
        kind = df.schema[mapping.messages_col].dataType
        if not isinstance(kind, T.ArrayType):
            raise TypeError(f"messages column '{mapping.messages_col}' is not an array")
        read = _item_reader(kind.elementType, mapping)
        items = F.col(f"`{mapping.messages_col}`")
        if isinstance(kind.elementType, T.ArrayType):
            items = F.filter(items, lambda m: F.size(m) >= 2)

        def build(m: Column) -> Column:
            raw_role, content = read(m)
            role = normalize_role(raw_role, mapping.role_map)
            return message(role, labelled(role, content) if mapping.label_map else content)

        messages = F.coalesce(F.transform(items, build), F.array().cast(MESSAGES))
    else:
        turns = []
        if mapping.system_col:
            text = joined_columns(df, mapping.system_col)
            turns.append(F.when(text != "", message(F.lit("system"), text)))
        if mapping.user_col:
            turns.append(message(F.lit("user"), joined_columns(df, mapping.user_col)))
        if mapping.assistant_col:
            text = map_label(joined_columns(df, mapping.assistant_col), mapping.label_map)
            turns.append(message(F.lit("assistant"), text))
        messages = F.filter(F.array(*turns), lambda m: m.isNotNull()) if turns else F.array().cast(MESSAGES)

    system = (mapping.default_system_prompt or "").strip()
    if system:
        present = F.exists(messages, lambda m: (m["role"] == "system") & (strip(m["content"]) != ""))
        first = F.array(message(F.lit("system"), F.lit(system)))
        messages = F.when(present, messages).otherwise(F.concat(first, messages))
    return messages


def _with_system(text: Column, mapping: ColumnMapping) -> Column:
    system = (mapping.default_system_prompt or "").strip()
    if not system:
        return text
    return F.concat_ws("\n\n", F.lit(system), F.nullif(text, F.lit("")))


def _preference_side(df: DataFrame, spec: str | None, mapping: ColumnMapping, prompt: bool) -> Column:
    kind = df.schema[spec].dataType if spec in df.columns else None
    system = (mapping.default_system_prompt or "").strip()
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        value = F.col(f"`{spec}`")
        item = kind.elementType if isinstance(kind, T.ArrayType) else None
        if prompt and system and isinstance(item, T.StructType) and {"role", "content"} <= set(item.names):
            given = {"role": F.lit("system"), "content": F.lit(system)}
            first = F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in item.fields])
            present = F.exists(value, lambda m: m["role"] == "system")
            value = F.when(F.coalesce(present, F.lit(False)), value).otherwise(F.concat(F.array(first), value))
        return value
    text = joined_columns(df, spec)
    return _with_system(text, mapping) if prompt else map_label(text, mapping.label_map)


def record_columns(df: DataFrame, fmt: Format, mapping: ColumnMapping) -> dict[str, Column]:
    """Output field -> expression for ``fmt``. Raises MappingError if it cannot be built."""
    fmt = Format(fmt)
    check_mapping(fmt, mapping, df.columns)
    if fmt is Format.TEXT:
        text = fill_template(df, mapping.text_template) if mapping.text_template else joined_columns(df, mapping.text_col)
        return {"text": _with_system(text, mapping)}
    if fmt is Format.CHAT:
        return {"messages": chat_messages(df, mapping)}
    if fmt is Format.PROMPT_COMPLETION:
        prompt = (
            fill_template(df, mapping.prompt_template) if mapping.prompt_template else joined_columns(df, mapping.prompt_col)
        )
        completion = map_label(joined_columns(df, mapping.completion_col), mapping.label_map)
        return {"prompt": _with_system(prompt, mapping), "completion": completion}
    return {
        "prompt": _preference_side(df, mapping.preference_prompt, mapping, prompt=True),
        "chosen": _preference_side(df, mapping.chosen_col, mapping, prompt=False),
        "rejected": _preference_side(df, mapping.rejected_col, mapping, prompt=False),
    }


def format_records(df: DataFrame, fmt: Format, mapping: ColumnMapping, keep: Sequence[str] = ()) -> DataFrame:
    """``df`` as records of ``fmt``; ``keep`` columns are passed through in front.

    Works on streaming frames too: every operator is row-wise.
    """
    columns = record_columns(df, fmt, mapping)
    return df.select(*[F.col(f"`{k}`") for k in keep], *[c.alias(n) for n, c in columns.items()])


def record_json(fmt: Format) -> Column:
    """One JSON line per formatted record."""
    names = {
        Format.TEXT: ["text"],
        Format.CHAT: ["messages"],
        Format.PROMPT_COMPLETION: ["prompt", "completion"],
        Format.DPO: ["prompt", "chosen", "rejected"],
    }[Format(fmt)]
    return F.to_json(F.struct(*names), {"ignoreNullFields": "false"})


def gold_columns(fmt: Format) -> dict[str, Column]:
    """What an evaluation needs from a formatted record: the question and its answer."""
    fmt = Format(fmt)
    if fmt is Format.CHAT:
        messages = F.col("messages")
        return {
            "prompt": F.slice(messages, 1, F.greatest(F.size(messages) - 1, F.lit(0))),
            "expected": F.coalesce(F.try_element_at(messages, F.lit(-1))["content"], F.lit("")),
        }
    if fmt is Format.PROMPT_COMPLETION:
        return {"prompt": F.col("prompt"), "expected": F.col("completion")}
    if fmt is Format.DPO:
        return {"prompt": F.col("prompt"), "expected": F.col("chosen")}
    return {"text": F.col("text")}


def assemble_conversations(
    turns: DataFrame, conversation: str = "conv_id", order: str = "turn", role: str = "role", content: str = "text"
) -> DataFrame:
    """One row per conversation from one row per turn, messages in turn order.

    A conversation is one output record, so its turns do meet in one row.
    """
    item = F.struct(F.col(order).alias("o"), F.col(role).alias("role"), F.col(content).alias("content"))
    grouped = turns.groupBy(conversation).agg(F.sort_array(F.collect_list(item)).alias("__turns"))
    return grouped.select(
        conversation, F.transform("__turns", lambda t: message(t["role"], t["content"])).alias("messages")
    )


def eval_samples(df: DataFrame) -> tuple[Column, Column, Column]:
    """(prompt, golden, messages) of test records, by the shape of each record.

    Fields a table does not have count as missing. The order of the rules is prompt with
    completion, messages, text (first 70 % of the characters are the prompt), chosen.
    """
    have = set(df.columns)
    text = lambda n: text_of(df, n) if n in have else F.lit(None).cast("string")
    no_messages = F.lit(None).cast(MESSAGES)
    if "messages" in have:
        as_messages = F.transform(
            "messages",
            lambda m: message(F.coalesce(m["role"], F.lit("user")), F.coalesce(m["content"], F.lit(""))),
        )
    else:
        as_messages = no_messages
    last = F.try_element_at(as_messages, F.lit(-1))
    answered = F.coalesce(last["role"] == "assistant", F.lit(False))
    asked = F.when(answered, F.slice(as_messages, 1, F.greatest(F.size(as_messages) - 1, F.lit(0)))).otherwise(as_messages)
    flat = F.array_join(F.transform(asked, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")

    pair = text("prompt").isNotNull() & text("completion").isNotNull()
    chat = F.coalesce(F.size(as_messages) > 0, F.lit(False))
    plain = text("text").isNotNull()
    chosen = text("chosen").isNotNull()
    cut = F.floor(F.length(text("text")) * F.lit(0.7)).cast("int")

    prompt = (
        F.when(pair, text("prompt"))
        .when(chat, flat)
        .when(plain, F.substr(text("text"), F.lit(1), cut))
        .when(chosen, F.coalesce(text("prompt"), F.lit("")))
        .otherwise("")
    )
    golden = (
        F.when(pair, text("completion"))
        .when(chat, F.when(answered, last["content"]).otherwise(""))
        .when(plain, F.substr(text("text"), cut + 1))
        .when(chosen, text("chosen"))
        .otherwise("")
    )
    messages = F.when(~pair & chat & (F.size(asked) > 0), asked)
    return prompt, golden, messages
