"""Message arrays: flatten, parse back, fold the system text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tuneprep.functions.text import BLANK, BLANK_IN_LINE, col_of, strip

MESSAGE = "struct<role:string,content:string>"
MESSAGES = f"array<{MESSAGE}>"

_MARKER = r"(?:system|user|assistant):"


def message(role: Column, content: Column) -> Column:
    return F.struct(role.alias("role"), content.alias("content"))


def flatten_messages(messages: Column | str) -> Column:
    """``role: content`` lines."""
    line = lambda m: F.concat(F.coalesce(m["role"], F.lit("user")), F.lit(": "), F.coalesce(m["content"], F.lit("")))
    return F.array_join(F.transform(col_of(messages), line), "\n")


def parse_chat_prompt(prompt: Column | str) -> Column:
    """Messages of a flattened prompt; NULL when it opens no user or system turn.

    The text is cut in front of every line that starts with a role marker, so each piece
    is one turn and the cost is linear in the text.
    """
    pieces = F.split(strip(prompt), rf"\n(?={BLANK_IN_LINE}*{_MARKER})")
    starts = rf"\A{BLANK}*(system|user|assistant):"

    def turn(piece: Column) -> Column:
        body = F.regexp_replace(piece, starts, "")
        body = F.regexp_replace(body, rf"\A([^\n]*?){BLANK_IN_LINE}+(?=\n|\z)", "$1")
        return message(F.regexp_extract(piece, starts, 1), strip(body))

    turns = F.filter(F.transform(pieces, turn), lambda m: m["role"] != "")
    usable = F.exists(turns, lambda m: m["role"].isin("user", "system"))
    return F.when(usable, turns)


def merge_system(messages: Column | str) -> Column:
    """Fold system texts into the next user turn.

    Pending system texts are joined by a blank line. When nothing but system texts exists
    they become one user turn.
    """
    messages = col_of(messages)

    def step(acc: Column, m: Column) -> Column:
        role = F.coalesce(m["role"], F.lit("user"))
        content = F.coalesce(m["content"], F.lit(""))
        pending = acc["pending"]
        joined = F.when(pending == "", content).otherwise(strip(F.concat(pending, F.lit("\n\n"), content)))
        keep = lambda c: F.concat(acc["done"], F.array(message(role, c)))
        takes = (role == "user") & (pending != "")
        return (
            F.when(role == "system", F.struct(joined.alias("pending"), acc["done"].alias("done")))
            .when(
                takes,
                F.struct(F.lit("").alias("pending"), keep(F.concat(pending, F.lit("\n\n"), content)).alias("done")),
            )
            .otherwise(F.struct(pending.alias("pending"), keep(content).alias("done")))
        )

    start = F.struct(F.lit("").alias("pending"), F.array().cast(MESSAGES).alias("done"))

    def finish(acc: Column) -> Column:
        only_system = (F.size(acc["done"]) == 0) & (acc["pending"] != "")
        return F.when(only_system, F.array(message(F.lit("user"), acc["pending"]))).otherwise(acc["done"])

    return F.aggregate(messages, start, step, finish)
