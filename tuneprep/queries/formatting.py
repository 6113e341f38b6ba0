"""Driver queries: records, splits, conversations, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneprep.functions.answers import clean_answer
from tuneprep.functions.chat import flatten_messages, merge_system, parse_chat_prompt
from tuneprep.functions.text import normalize_answer
from tuneprep.operators.checks import key_sets, label_values, reasoning_summary, training_compat
from tuneprep.operators.coverage import record_counts, run_epochs, sweep_coverage, sweep_runs
from tuneprep.operators.formatting import (
    assemble_conversations,
    eval_samples,
    format_records,
    gold_columns,
    map_label_table,
    record_json,
)
from tuneprep.operators.splitting import (
    SPLIT,
    SplitConfig,
    exact_split,
    normalize_split,
    shuffle_hash,
    split_counts,
    split_samples,
)
from tuneprep.plans.convert import inspect, preview
from tuneprep.plans.mapping import ColumnMapping, Format, detect_format, detect_mapping
from tuneprep.queries.fixtures import table
from tuneprep.queries.sql import BLANK_CHARS, normalize, quote, strip
from tuneprep.session import widen
from tuneprep.sources.load import Dataset, merge

SYSTEM = "You are a careful assistant."
CONFIG = SplitConfig(80.0, 10.0, 10.0, seed=42)
STATUS_NAMES = {"O": "open", "F": "filled", "P": "pending"}
LANG_NAMES = {"de": "German", "en": "English", "fr": "French"}
LANG_SPLITS = {"de": "Validation", "en": "TRAIN", "es": "dev", "fr": "Testing"}
GRID = {"iters": [600, 1000], "batch_size": [2, 4], "grad_accumulation_steps": [1, 2]}


def _literal_map(values: dict[str, str]):
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _sql_case(column: str, values: dict[str, str], default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in values.items()) + f" ELSE {default} END"


def fmt_text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = ColumnMapping(text_col="text", default_system_prompt=SYSTEM)
    return format_records(table(spark, sf_dir, "documents"), Format.TEXT, mapping, keep=["doc_id"])


def fmt_text_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = ColumnMapping(text_template="### {lang} ({source}, {n_chars})\n{text}\n")
    return format_records(table(spark, sf_dir, "documents"), Format.TEXT, mapping, keep=["doc_id"])


def fmt_prompt_completion_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    mapping = ColumnMapping(
        prompt_col="c_name + c_mktsegment + o_orderpriority", completion_col="o_orderstatus", label_map=STATUS_NAMES
    )
    return format_records(joined, Format.PROMPT_COMPLETION, mapping, keep=["o_orderkey"])


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble_conversations(table(spark, sf_dir, "conversations"))


def fmt_chat_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    renamed = turns.withColumn("role", F.when(F.col("role") == "assistant", " GPT").otherwise(F.initcap("role")))
    mapping = ColumnMapping(messages_col="messages", default_system_prompt=SYSTEM)
    records = format_records(assemble_conversations(renamed), Format.CHAT, mapping, keep=["conv_id"])
    return records.select("conv_id", F.to_json("messages").alias("messages"))


def fmt_chat_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("hint", F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(" "))
    mapping = ColumnMapping(
        system_col="hint", user_col="text", assistant_col="lang", default_system_prompt=SYSTEM, label_map=LANG_NAMES
    )
    records = format_records(docs, Format.CHAT, mapping, keep=["doc_id"])
    return records.select("doc_id", F.to_json("messages").alias("messages"))


def fmt_dpo_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    following = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next_text"))
    pairs = docs.join(labels, "doc_id").join(following, "doc_id")
    good = F.col("quality") == 1
    pairs = pairs.withColumns(
        {
            "better": F.when(good, F.col("text")).otherwise(F.col("next_text")),
            "worse": F.when(good, F.col("next_text")).otherwise(F.col("text")),
        }
    )
    mapping = ColumnMapping(
        dpo_prompt_col="lang, source", chosen_col="better", rejected_col="worse", default_system_prompt=SYSTEM
    )
    return format_records(pairs, Format.DPO, mapping, keep=["doc_id"])


def fmt_dpo_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt that is a message list stays one, and gets the system turn it lacks."""
    conversations = _conversations(spark, sf_dir)
    parts = conversations.select(
        "conv_id",
        F.slice("messages", 1, F.greatest(F.size("messages") - 1, F.lit(0))).alias("history"),
        F.element_at("messages", -1)["content"].alias("last"),
        F.element_at("messages", 1)["content"].alias("first"),
    )
    mapping = ColumnMapping(
        dpo_prompt_col="history", chosen_col="last", rejected_col="first", default_system_prompt=SYSTEM
    )
    records = format_records(parts, Format.DPO, mapping, keep=["conv_id"])
    return records.withColumn("prompt", F.to_json("prompt"))


def label_map_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same labels by a map in the mapping and by a join with a table of names."""
    labels = table(spark, sf_dir, "labels")
    names = labels.select(F.col("toxic").alias("label")).distinct()
    names = names.withColumn("name", F.when(F.col("label") == 1, "toxic").otherwise("clean"))
    mapped = map_label_table(labels, "toxic", names)
    mapping = ColumnMapping(prompt_col="toxic", completion_col="quality", label_map={"0": "bad", "1": "good"})
    return format_records(mapped, Format.PROMPT_COMPLETION, mapping, keep=["doc_id"])


def _split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_split(table(spark, sf_dir, "documents"), CONFIG, key="doc_id")


def split_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split_documents(spark, sf_dir).select("doc_id", F.col(SPLIT).alias("split"))


def split_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_counts(_split_documents(spark, sf_dir)).select(F.col(SPLIT).alias("split"), "records")


def split_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split by row content where most rows are copies of a few: counts stay exact."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus")
    return split_counts(exact_split(rows, SplitConfig(85.0, 15.0, 0.0, seed=7))).select(
        F.col(SPLIT).alias("split"), "records"
    )


def split_samples_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = shuffle_hash(F.col("doc_id").cast("string"), CONFIG.seed)
    return split_samples(_split_documents(spark, sf_dir), order).select(
        F.col(SPLIT).alias("split"), F.col("_rank").alias("rank"), "doc_id", "text"
    )


def split_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    given = F.coalesce(F.try_element_at(_literal_map(LANG_SPLITS), F.col("lang")), F.col("lang"))
    return docs.select("doc_id", normalize_split(given).alias("split"))


def _samples(df: DataFrame, key: str) -> DataFrame:
    prompt, golden, messages = eval_samples(df)
    return df.select(key, prompt.alias("prompt"), golden.alias("golden"), F.to_json(messages).alias("messages"))


def eval_samples_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(_conversations(spark, sf_dir), "conv_id")


def eval_samples_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").drop("messages")


def eval_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first samples by id, as an evaluation with a sample limit takes them."""
    return eval_samples_text(spark, sf_dir).orderBy("doc_id").limit(50)


def norm_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = widen(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    bench = table(spark, sf_dir, "benchmark").select((-F.col("item_id") - 1).alias("id"), "text")
    return docs.unionByName(bench).select("id", normalize_answer("text").alias("answer"))


def discrete_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = label_values(table(spark, sf_dir, "labels"), ["doc_id", "quality", "toxic"])
    docs = label_values(table(spark, sf_dir, "documents"), ["lang", "source", "text"])
    return labels.unionByName(docs).select("column", F.array_join("values", ",").alias("labels"), "is_integer")


def gold_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = format_records(_conversations(spark, sf_dir), Format.CHAT, ColumnMapping(messages_col="messages"), keep=["conv_id"])
    gold = gold_columns(Format.CHAT)
    return records.select("conv_id", F.to_json(gold["prompt"]).alias("prompt"), gold["expected"].alias("expected"))


def _event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines of differing keys; errors are cut off, signups are arrays."""
    events = table(spark, sf_dir, "events")
    line = (
        F.when(F.col("event_type") == "error", F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string")))
        .when(F.col("event_type") == "signup", F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit("]")))
        .when(F.col("event_type") == "click", F.to_json(F.struct("value", "event_id", "user_id")))
        .when(F.col("event_type") == "view", F.to_json(F.struct("user_id", "value", "event_id")))
        .otherwise(F.to_json(F.struct("event_id", "value")))
    )
    return events.select("event_type", line.alias("value"))


def schema_keysets(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.array_join("keys", ",")
    props = key_sets(table(spark, sf_dir, "events").select(F.col("props").alias("value"))).withColumn("keys", shown)
    lines = key_sets(_event_lines(spark, sf_dir)).withColumn("keys", shown)
    return props.withColumn("origin", F.lit("props")).unionByName(lines.withColumn("origin", F.lit("lines")))


def training_compat_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = _conversations(spark, sf_dir).select(F.lit("chat").alias("dataset"), F.to_json(F.struct("messages")).alias("value"))
    orders = table(spark, sf_dir, "orders").select(
        F.lit("orders").alias("dataset"),
        F.to_json(F.struct(F.col("o_orderkey").alias("prompt"), F.col("o_orderstatus").alias("completion"))).alias("value"),
    )
    lines = _event_lines(spark, sf_dir).select(F.lit("events").alias("dataset"), "value")
    sets = key_sets(chats.unionByName(orders).unionByName(lines), by=["dataset"])
    return training_compat(sets, by=["dataset"])


def reasoning_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    thought = F.when(F.col("source") == "src3", F.concat(F.lit("<think>"), F.col("text"), F.lit("</think>"))).otherwise(F.col("text"))
    turns = F.array(
        F.struct(F.lit("user").alias("role"), F.lit("<think> about it").alias("content")),
        F.struct(F.lit("assistant").alias("role"), thought.alias("content")),
    )
    return reasoning_summary(docs.select("lang", turns.alias("messages")), by=["lang"])


def clean_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    form = F.col("doc_id") % 6
    raw = (
        F.when(form == 0, F.concat(F.lit("<think>first\nthoughts</think>\n"), text))
        .when(form == 1, F.concat(F.lit("Assistant: "), text, F.lit(" <|im_end|>\n")))
        .when(form == 2, F.concat(F.lit("<|channel>thought a\nb<channel|>"), text, F.lit("<turn|>")))
        .when(form == 3, F.concat(F.lit("<start_of_turn>model\n"), text, F.lit("<end_of_turn></s>")))
        .when(form == 4, F.concat(text, F.lit("</s><|eot_id|>")))
        .otherwise(text)
    )
    return widen(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", clean_answer(raw).alias("answer"))


def repr_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.concat(
        F.lit("GenerationResult(text='"), F.regexp_replace("text", "['\"\\n\\r]", " "), F.lit("', token=7, logprobs=array([0.1]))")
    )
    docs = widen(table(spark, sf_dir, "documents").select("doc_id", "text"))
    raw = F.when(F.col("doc_id") % 2 == 0, shown).otherwise(F.concat(F.lit("GenerationResult: "), F.col("text")))
    return docs.select("doc_id", clean_answer(raw).alias("answer"))


def parse_chat_prompt_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _conversations(spark, sf_dir)
    parsed = conversations.select("conv_id", parse_chat_prompt(flatten_messages("messages")).alias("m"))
    return parsed.select("conv_id", F.posexplode("m").alias("turn", "m")).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "m.role", "m.content"
    )


def conversation_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations(spark, sf_dir).select("conv_id", flatten_messages("messages").alias("prompt"))


def merge_system_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = _conversations(spark, sf_dir).select("conv_id", merge_system("messages").alias("m"))
    return merged.select("conv_id", F.to_json("m").alias("messages"))


def chat_from_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages kept as [role, content] pairs."""
    pairs = _conversations(spark, sf_dir).select(
        "conv_id", F.transform("messages", lambda m: F.array(m["role"], m["content"])).alias("dialog")
    )
    mapping = detect_mapping(Format.CHAT, pairs.columns)
    records = format_records(pairs, Format.CHAT, mapping, keep=["conv_id"])
    return records.select("conv_id", F.to_json("messages").alias("messages"))


def implied_epochs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counts = docs.groupBy(F.col("source").alias("dataset")).agg(F.count(F.lit(1)).alias("records"))
    return sweep_runs(counts, GRID)


def sweep_coverage_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep_coverage(implied_epochs_query(spark, sf_dir))


def run_epochs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs on the data of their customer's segment; one segment is unknown."""
    customer = table(spark, sf_dir, "customer")
    counts = customer.where(F.col("c_mktsegment") != "MACHINERY").groupBy(F.col("c_mktsegment").alias("dataset")).agg(
        F.count(F.lit(1)).alias("records")
    )
    runs = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("run"),
        F.col("c_mktsegment").alias("dataset"),
        (F.col("o_orderkey") % 1000).alias("iters"),
        F.lit(4).alias("batch_size"),
    )
    return run_epochs(runs, counts).select("run", "dataset", "implied_epochs")


def record_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank lines of all documents per language."""
    lines = table(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", "\n")).alias("value"))
    return record_counts(lines, by=["lang"])


def merge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    parts = [Dataset(docs.where(F.col("lang") == x), x) for x in ("de", "en", "es", "fr")]
    parts.append(Dataset(docs.where(~F.col("lang").isin("de", "en", "es", "fr")), "other"))
    return merge(parts).df.drop(SPLIT)


def inspect_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per split with the columns and the formats that they fit."""
    report = inspect(Dataset(_split_documents(spark, sf_dir), "documents"))
    columns = ",".join(report["columns"])
    fits = ",".join(name for name, found in report["suggested_mappings"].items() if found["is_valid"])
    suggested, _ = detect_format(report["columns"])
    rows = [(name, n, columns, fits, suggested.value) for name, n in report["split_counts"].items()]
    return spark.createDataFrame(rows, "split string, records long, columns string, fits string, suggested string")


def preview_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preview(table(spark, sf_dir, "documents"), Format.TEXT, ColumnMapping(text_col="text"), order="doc_id")


def fmt_auto_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format and mapping found from the column names alone."""
    qa = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.concat_ws("-", "source", "lang").alias("Question"), F.col("text").alias("Ground-Truth")
    )
    fmt, mapping = detect_format(qa.columns)
    records = format_records(qa, fmt, mapping, keep=["id"])
    return records.select("id", record_json(fmt).alias("record"))


QUERIES = {
    "fmt_text_documents": fmt_text_documents,
    "fmt_text_template": fmt_text_template,
    "fmt_prompt_completion_concat": fmt_prompt_completion_concat,
    "fmt_chat_conversations": fmt_chat_conversations,
    "fmt_chat_columns": fmt_chat_columns,
    "fmt_dpo_pairs": fmt_dpo_pairs,
    "fmt_dpo_nested": fmt_dpo_nested,
    "fmt_auto_detected": fmt_auto_detected,
    "label_map_quality": label_map_quality,
    "split_counts": split_counts_query,
    "split_exact": split_exact,
    "split_content": split_content,
    "split_samples": split_samples_query,
    "split_normalise": split_normalise,
    "eval_samples_chat": eval_samples_chat,
    "eval_samples_text": eval_samples_text,
    "eval_limit": eval_limit,
    "norm_answer": norm_answer,
    "discrete_labels": discrete_labels,
    "gold_export": gold_export,
    "schema_keysets": schema_keysets,
    "training_compat": training_compat_query,
    "reasoning_scan": reasoning_scan,
    "clean_answers": clean_answers,
    "repr_answers": repr_answers,
    "parse_chat_prompt": parse_chat_prompt_query,
    "conversation_flatten": conversation_flatten,
    "merge_system": merge_system_query,
    "chat_from_pairs": chat_from_pairs,
    "implied_epochs": implied_epochs_query,
    "sweep_coverage": sweep_coverage_query,
    "run_epochs": run_epochs_query,
    "record_counts": record_counts_query,
    "merge_sources": merge_sources,
    "inspect_dataset": inspect_dataset,
    "preview": preview_query,
}

_SYS = quote(SYSTEM)
_NL = "chr(10)"
_PARA = f"{_NL} || {_NL}"
_MSG = "{'role': role, 'content': text}"
_CONV = f"SELECT conv_id, list({_MSG} ORDER BY turn) AS messages FROM conversations GROUP BY conv_id"
_SYS_MSG = f"{{'role': 'system', 'content': {_SYS}}}"
_HAS_SYS = f"len(list_filter(messages, lambda m: m.role = 'system' AND {strip('m.content')} <> '')) > 0"
_FLAT = "array_to_string(list_transform({0}, lambda m: m.role || ': ' || m.content), chr(10))"
_SPLIT_DOCS = """ranked AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || doc_id)) AS pos, count(*) OVER () AS total FROM documents),
    split_docs AS (SELECT * EXCLUDE (pos, total), pos, CASE WHEN pos <= round_even(total * 0.8, 0) THEN 'train'
        WHEN pos <= round_even(total * 0.8, 0) + round_even(total * 0.1, 0) THEN 'valid' ELSE 'test' END AS split FROM ranked)"""

_EPOCHS = """counts AS (SELECT source AS dataset, count(*) AS records FROM documents GROUP BY source),
    runs AS (SELECT dataset, records, iters::INT AS iters, batch_size::INT AS batch_size, acc::INT AS grad_accumulation_steps,
        (iters * batch_size * acc)::DOUBLE / records AS implied_epochs
        FROM counts, (VALUES (600), (1000)) i(iters), (VALUES (2), (4)) b(batch_size), (VALUES (1), (2)) g(acc))"""

SQL = {
    "preview": f"SELECT to_json({{text: {strip('text')}}})::VARCHAR AS record FROM documents ORDER BY doc_id LIMIT 3",
    "fmt_text_documents": f"SELECT doc_id, {_SYS} || CASE WHEN {strip('text')} = '' THEN '' ELSE {_PARA} || {strip('text')} END AS text FROM documents",
    "fmt_text_template": f"SELECT doc_id, '### ' || lang || ' (' || source || ', ' || n_chars || ')' || {_NL} || text || {_NL} AS text FROM documents",
    "fmt_prompt_completion_concat": f"""SELECT o_orderkey, {strip('c_name')} || {_PARA} || {strip('c_mktsegment')} || {_PARA} || {strip('o_orderpriority')} AS prompt,
        {_sql_case('o_orderstatus', STATUS_NAMES, 'o_orderstatus')} AS completion FROM orders JOIN customer ON o_custkey = c_custkey""",
    "fmt_chat_conversations": f"""WITH c AS ({_CONV}) SELECT conv_id, to_json(CASE WHEN {_HAS_SYS} THEN messages
        ELSE list_concat([{_SYS_MSG}], messages) END)::VARCHAR AS messages FROM c""",
    "fmt_chat_columns": f"""SELECT doc_id, to_json([{{'role': 'system', 'content': CASE WHEN doc_id % 3 = 0 THEN source ELSE {_SYS} END}},
        {{'role': 'user', 'content': {strip('text')}}},
        {{'role': 'assistant', 'content': {_sql_case('lang', LANG_NAMES, 'lang')}}}])::VARCHAR AS messages FROM documents""",
    "fmt_dpo_pairs": f"""SELECT d.doc_id, {_SYS} || {_PARA} || d.lang || {_PARA} || d.source AS prompt,
        {strip('CASE quality WHEN 1 THEN d.text ELSE n.text END')} AS chosen,
        {strip('CASE quality WHEN 1 THEN n.text ELSE d.text END')} AS rejected
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id JOIN documents n ON n.doc_id = d.doc_id + 1""",
    "fmt_dpo_nested": f"""WITH c AS ({_CONV}) SELECT conv_id,
        to_json(CASE WHEN len(list_filter(messages[:-2], lambda m: m.role = 'system')) > 0 THEN messages[:-2]
            ELSE list_concat([{_SYS_MSG}], messages[:-2]) END)::VARCHAR AS prompt,
        {strip('messages[-1].content')} AS chosen, {strip('messages[1].content')} AS rejected FROM c""",
    "fmt_auto_detected": f"SELECT doc_id AS id, to_json({{'prompt': source || '-' || lang, 'completion': {strip('text')}}})::VARCHAR AS record FROM documents",
    "label_map_quality": """SELECT doc_id, CASE toxic WHEN 1 THEN 'toxic' ELSE 'clean' END AS prompt,
        CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS completion FROM labels""",
    "split_counts": f"WITH {_SPLIT_DOCS} SELECT split, count(*) AS records FROM split_docs GROUP BY split",
    "split_exact": f"WITH {_SPLIT_DOCS} SELECT doc_id, split FROM split_docs",
    "split_content": """WITH t AS (SELECT count(*) AS total FROM lineitem)
        SELECT 'train' AS split, round_even(total * 0.85, 0)::BIGINT AS records FROM t
        UNION ALL SELECT 'valid', total - round_even(total * 0.85, 0)::BIGINT FROM t""",
    "split_samples": f"""WITH {_SPLIT_DOCS} SELECT split, row_number() OVER (PARTITION BY split ORDER BY pos)::INT AS rank, doc_id, text
        FROM split_docs QUALIFY rank <= 3""",
    "split_normalise": f"SELECT doc_id, {_sql_case('lang', {'de': 'valid', 'en': 'train', 'es': 'valid', 'fr': 'test'}, 'lang')} AS split FROM documents",
    "eval_samples_chat": f"""WITH c AS ({_CONV}), a AS (SELECT *, messages[-1].role = 'assistant' AS answered FROM c),
        q AS (SELECT *, CASE WHEN answered THEN messages[:-2] ELSE messages END AS asked FROM a)
        SELECT conv_id, {_FLAT.format('asked')} AS prompt, CASE WHEN answered THEN messages[-1].content ELSE '' END AS golden,
        CASE WHEN len(asked) > 0 THEN to_json(asked)::VARCHAR END AS messages FROM q""",
    "eval_samples_text": """SELECT doc_id, substr(text, 1, floor(length(text) * 0.7::DOUBLE)::INT) AS prompt,
        substr(text, floor(length(text) * 0.7::DOUBLE)::INT + 1) AS golden FROM documents""",
    "eval_limit": """SELECT doc_id, substr(text, 1, floor(length(text) * 0.7::DOUBLE)::INT) AS prompt,
        substr(text, floor(length(text) * 0.7::DOUBLE)::INT + 1) AS golden FROM documents ORDER BY doc_id LIMIT 50""",
    "norm_answer": f"""SELECT doc_id AS id, {normalize('text')} AS answer FROM documents
        UNION ALL SELECT -item_id - 1, {normalize('text')} FROM benchmark""",
    "discrete_labels": """WITH v AS (SELECT 'doc_id' AS col, doc_id::VARCHAR AS value, true AS is_integer FROM labels
        UNION ALL SELECT 'quality', quality::VARCHAR, true FROM labels UNION ALL SELECT 'toxic', toxic::VARCHAR, true FROM labels
        UNION ALL SELECT 'lang', lang, false FROM documents UNION ALL SELECT 'source', source, false FROM documents
        UNION ALL SELECT 'text', text, false FROM documents)
        SELECT col AS "column", array_to_string(list_sort(list(DISTINCT value)), ',') AS labels, bool_and(is_integer) AS is_integer
        FROM v GROUP BY col HAVING count(DISTINCT value) BETWEEN 2 AND 12""",
    "gold_export": f"WITH c AS ({_CONV}) SELECT conv_id, to_json(messages[:-2])::VARCHAR AS prompt, messages[-1].content AS expected FROM c",
    "schema_keysets": """SELECT 'k' AS keys, count(*) AS rows, 'props' AS origin FROM events
        UNION ALL SELECT CASE WHEN event_type = 'purchase' THEN 'event_id,value' ELSE 'event_id,user_id,value' END AS keys, count(*), 'lines'
        FROM events WHERE event_type NOT IN ('error', 'signup') GROUP BY 1""",
    "training_compat": """SELECT 'chat' AS dataset, 1::BIGINT AS key_sets, true AS consistent, true AS compatible FROM conversations GROUP BY 1
        UNION ALL SELECT 'orders', 1, true, false FROM orders GROUP BY 1
        UNION ALL SELECT 'events', count(DISTINCT CASE WHEN event_type = 'purchase' THEN 1 ELSE 2 END), false, false
        FROM events WHERE event_type NOT IN ('error', 'signup') GROUP BY 1""",
    "reasoning_scan": """WITH f AS (SELECT lang, source = 'src3' OR contains(text, '<think>') OR contains(text, '</think>')
            OR contains(text, '<|channel>thought') OR contains(text, '<channel|>') AS trace FROM documents)
        SELECT lang, count(*) AS rows, count(*) FILTER (trace) AS with_trace, bool_or(trace) AS has_trace FROM f GROUP BY lang""",
    # A stop token that was tried before the one behind it stays: each is tried once, in order.
    "clean_answers": f"""SELECT doc_id, CASE WHEN doc_id % 6 = 3 THEN ltrim(text, {BLANK_CHARS}) || '<end_of_turn>'
        ELSE {strip('text')} END AS answer FROM documents""",
    "repr_answers": f"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {strip("regexp_replace(text, '[''\"\\n\\r]', ' ', 'g')")}
        ELSE 'GenerationResult: ' || rtrim(text, {BLANK_CHARS}) END AS answer FROM documents""",
    "parse_chat_prompt": f"SELECT conv_id, turn, role, {strip('text')} AS content FROM conversations",
    "conversation_flatten": f"WITH c AS ({_CONV}) SELECT conv_id, {_FLAT.format('messages')} AS prompt FROM c",
    "merge_system": f"""WITH pending AS (SELECT *, sum(CASE role WHEN 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS users FROM conversations),
        sys AS (SELECT conv_id, coalesce(users, 0) AS users, string_agg(text, {_PARA} ORDER BY turn) AS sys FROM pending WHERE role = 'system' GROUP BY 1, 2),
        merged AS (SELECT p.conv_id, turn, role, CASE WHEN role = 'user' AND sys IS NOT NULL THEN sys || {_PARA} || text ELSE text END AS text
            FROM pending p LEFT JOIN sys s ON p.conv_id = s.conv_id AND coalesce(p.users, 0) = s.users WHERE role <> 'system')
        SELECT conv_id, to_json(list({_MSG} ORDER BY turn))::VARCHAR AS messages FROM merged GROUP BY conv_id""",
    "chat_from_pairs": f"WITH c AS ({_CONV}) SELECT conv_id, to_json(messages)::VARCHAR AS messages FROM c",
    "implied_epochs": f"WITH {_EPOCHS} SELECT * FROM runs",
    "sweep_coverage": f"WITH {_EPOCHS} SELECT dataset, count(*) AS total_runs, min(implied_epochs) AS min_implied_epochs FROM runs GROUP BY dataset",
    "run_epochs": """SELECT o_orderkey AS run, c.c_mktsegment AS dataset,
        CASE WHEN o_orderkey % 1000 > 0 THEN (o_orderkey % 1000 * 4)::DOUBLE / records END AS implied_epochs
        FROM orders JOIN customer c ON o_custkey = c_custkey LEFT JOIN (SELECT c_mktsegment, count(*) AS records FROM customer
            WHERE c_mktsegment <> 'MACHINERY' GROUP BY 1) n ON n.c_mktsegment = c.c_mktsegment""",
    "record_counts": f"""SELECT lang, count(*) AS records FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents)
        WHERE {strip('line')} <> '' GROUP BY lang""",
    "merge_sources": "SELECT doc_id, lang, text FROM documents",
    "inspect_dataset": f"""WITH {_SPLIT_DOCS} SELECT split, count(*) AS records, 'doc_id,text,lang,source,n_chars' AS columns,
        'text' AS fits, 'text' AS suggested FROM split_docs GROUP BY split""",
}

