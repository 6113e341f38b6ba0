"""Cleaning of generated answers."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tuneprep.functions.text import col_of, strip, tokens

# What generation leaves around an answer. The order is the order in which
# the pieces are removed.
THOUGHT_BLOCKS = (("<think>", "</think>"), ("<|channel>thought", "<channel|>"))
LEADING_TAGS = ("<start_of_turn>model", "<|turn>model", "assistant:", "model:")
STOP_TOKENS = ("<end_of_turn>", "<turn|>", "<|eot_id|>", "<|im_end|>", "</s>", "<eos>", "<|endoftext|>")
RESULT_REPR = "GenerationResult("
RESULT_TEXT = r"""(?d)text=['"](.*?)['"]"""


def unwrap_result(c: Column | str) -> Column:
    """The ``text='...'`` part of a leaked result object, else the stripped text."""
    text = strip(c)
    leaked = F.startswith(text, F.lit(RESULT_REPR)) & F.regexp_like(text, F.lit(RESULT_TEXT))
    return F.when(leaked, F.regexp_extract(text, RESULT_TEXT, 1)).otherwise(text)


def _each(text: Column, pieces: Sequence[str], step: Callable[[Column, Column], Column]) -> Column:
    """Apply ``step(text, piece)`` for every piece in turn."""
    return F.aggregate(F.array(*[F.lit(p) for p in pieces]), text, step)


def clean_answer(c: Column | str) -> Column:
    """Drop closed thought blocks, leading role tags and trailing stop tokens.

    Every tag and token is tried once, in order. Only the ends of the text are looked at
    for them, so the cost does not grow with their number times the text.
    """
    text = unwrap_result(c)
    for opening, closing in THOUGHT_BLOCKS:
        text = F.regexp_replace(strip(text), rf"(?s)\Q{opening}\E.*?\Q{closing}\E", "")

    def drop_tag(acc: Column, tag: Column) -> Column:
        size = F.length(tag)
        return F.when(F.lower(F.substr(acc, F.lit(1), size)) == tag, strip(F.substr(acc, size + 1))).otherwise(acc)

    def drop_token(acc: Column, token: Column) -> Column:
        rest = F.substr(acc, F.lit(1), F.length(acc) - F.length(token))
        return F.when(F.endswith(acc, token), strip(rest)).otherwise(acc)

    text = _each(strip(text), LEADING_TAGS, drop_tag)
    return _each(text, STOP_TOKENS, drop_token)


def word_count_tokens(c: Column | str) -> Column:
    """Token estimate for an answer without token counts: max(1, int(words * 1.3))."""
    return F.greatest(F.lit(1), F.floor(F.size(tokens(col_of(c))) * F.lit(1.3))).cast("long")


def template_variables(template: str) -> list[str]:
    """The ``{name}`` references of a template, in order."""
    return re.findall(r"\{([a-zA-Z0-9_]+)\}", template)
