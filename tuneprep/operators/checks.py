"""Checks of a dataset: label columns, key sets of rows, reasoning traces."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tuneprep.functions.text import strip
from tuneprep.operators.formatting import text_of
from tuneprep.operators.scoring import hash128

# Limits of a label column, and the marks of a reasoning trace.
MAX_LABELS = 12
TRACE_MARKS = ("<think>", "</think>", "<|channel>thought", "<channel|>")
TRACE_FIELDS = ("reasoning_content", "reasoning")
TARGET_COLUMNS = ("completion", "chosen", "text")


LABEL_TYPE = "struct<column:string,value:string,is_integer:boolean,number:decimal(38,0)>"


def _label(df: DataFrame, name: str) -> Column:
    """(value, is_integer): integers, booleans, whole floats and digit strings are integers."""
    kind = df.schema[name].dataType
    col = F.col(f"`{name}`")
    if isinstance(kind, T.BooleanType):
        whole = col.cast("int").cast("decimal(38,0)")
        text = whole.cast("string")
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        whole = F.when(col == F.floor(col), col.try_cast("decimal(38,0)"))
        text = col.cast("string")
    elif isinstance(kind, (T.IntegralType, T.DecimalType)):
        whole = F.when(col == col.cast("decimal(38,0)"), col.cast("decimal(38,0)"))
        text = col.cast("string")
    else:
        text = strip(text_of(df, name))
        whole = F.when(F.regexp_like(text, F.lit(r"\A-*[0-9]+\z")), text.try_cast("decimal(38,0)"))
    return F.struct(
        F.lit(name).alias("column"),
        F.coalesce(whole.cast("string"), text).alias("value"),
        whole.isNotNull().alias("is_integer"),
        whole.alias("number"),
    )


def label_values(df: DataFrame, columns: Sequence[str], max_labels: int = MAX_LABELS) -> DataFrame:
    """(column, values, is_integer) of the columns with 2..max_labels different values.

    All rows count. Different values are counted by their hashes, so that free text is not
    shuffled; then the values of the columns with few of them are read.
    """
    hashes = [F.struct(F.lit(k).alias("k"), hash128(_label(df, c)["value"]).alias("h")) for k, c in enumerate(columns)]
    hashed = df.select(F.explode(F.array(*hashes)).alias("x")).select("x.*").where("h is not null").distinct()
    counts = {r["k"]: r["count"] for r in hashed.groupBy("k").count().collect()}
    few = [c for k, c in enumerate(columns) if counts.get(k, 0) <= max_labels]
    labels = F.array(*[F.when(F.col(f"`{c}`").isNotNull(), _label(df, c)) for c in few] or [F.lit(None).cast(LABEL_TYPE)])
    found = df.select(F.explode(labels).alias("l")).where(F.col("l").isNotNull()).select("l.*").distinct()
    order = [F.col("number").asc_nulls_last(), F.col("value")]
    rank = F.row_number().over(Window.partitionBy("column").orderBy(*order))
    few = found.withColumn("rank", rank).where(F.col("rank") <= max_labels + 1)
    lists = few.groupBy("column").agg(
        F.sort_array(F.collect_list(F.struct("rank", "value"))).alias("v"), F.bool_and("is_integer").alias("is_integer")
    )
    lists = lists.where(F.size("v").between(2, max_labels))
    return lists.select("column", F.transform("v", lambda x: x["value"]).alias("values"), "is_integer")


@dataclass(frozen=True)
class DiscreteLabels:
    values: list[str]
    is_integer: bool
    class_names: list[str] | None = None

    @property
    def suggested_map(self) -> dict[str, str] | None:
        return dict(zip(self.values, self.class_names)) if self.class_names else None


def discrete_labels(df: DataFrame, column: str, max_labels: int = MAX_LABELS) -> DiscreteLabels | None:
    """The labels of a column, or None. Class names in the column's metadata come first."""
    if column not in df.columns:
        return None
    names = df.schema[column].metadata.get("names")
    if names:
        return DiscreteLabels([str(i) for i in range(len(names))], True, [str(n) for n in names])
    row = label_values(df, [column], max_labels).first()
    return DiscreteLabels(row["values"], row["is_integer"]) if row else None


def _marked(text: Column) -> Column:
    hits = [F.contains(text, F.lit(mark)) for mark in TRACE_MARKS]
    return F.coalesce(hits[0] | hits[1] | hits[2] | hits[3], F.lit(False))


def has_reasoning_trace(df: DataFrame) -> Column:
    """Whether a training record has a reasoning trace in what the model should answer."""
    if "messages" in df.columns:
        item = df.schema["messages"].dataType.elementType

        def in_message(m: Column) -> Column:
            hit = (m["role"] == "assistant") & _marked(m["content"])
            for name in TRACE_FIELDS:
                if name in item.names:
                    hit = hit | F.coalesce(m[name].cast("string") != "", F.lit(False))
            return hit

        return F.coalesce(F.exists("messages", in_message), F.lit(False))
    targets = [_marked(text_of(df, c)) for c in TARGET_COLUMNS if c in df.columns]
    return F.greatest(F.lit(False), F.lit(False), *targets)


def reasoning_summary(df: DataFrame, by: Sequence[str] = ("_split",)) -> DataFrame:
    """Rows and rows with a reasoning trace per group."""
    flagged = df.select(*by, has_reasoning_trace(df).alias("trace"))
    return flagged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("trace").alias("with_trace"), F.bool_or("trace").alias("has_trace")
    )


def key_sets(lines: DataFrame, value: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """Counts of the sorted key sets, as arrays, of JSON objects; other lines are dropped."""
    keys = F.array_sort(F.array_distinct(F.json_object_keys(value)))
    # Kept or dropped in a generator, so that a line is parsed once; see parse_log_lines.
    objects = lines.select(*by, F.explode(F.array_compact(F.array(keys))).alias("keys"))
    return objects.groupBy(*by, "keys").agg(F.count(F.lit(1)).alias("rows"))


def training_compat(sets: DataFrame, by: Sequence[str] = (), multimodal: bool = True) -> DataFrame:
    """Per group: number of key sets, whether they agree, whether training can use them.

    Rows must all have the same keys. The multimodal engine also needs messages or
    conversations, or question with answer.
    """
    has = lambda k: F.array_contains("keys", k)
    chat = has("messages") | has("conversations") | (has("question") & has("answer"))
    found = sets.groupBy(*by).agg(F.count(F.lit(1)).alias("key_sets"), F.bool_and(chat).alias("chat"))
    agree = F.col("key_sets") == 1
    usable = agree & F.col("chat") if multimodal else agree
    return found.select(*by, "key_sets", agree.alias("consistent"), usable.alias("compatible"))
