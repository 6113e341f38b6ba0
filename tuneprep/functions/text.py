"""Text columns: stripping, answer normalisation, answer comparison.

Everything is a built-in expression, so scoring stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters str.strip() and str.split() treat as blank, the ASCII
# punctuation, and the articles dropped from answers.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = ("a", "an", "the")

# The same blanks as a regular-expression class, with and without the newline.
BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"
BLANK_IN_LINE = r"[\t\x0b\f\r\x1c-\x1f\x85\p{Z}]"

# A word is letters, digits and underscore. Spelled out, because what Java means by
# \b differs between releases. What comes before an article is looked at last.
_WORD = r"[\p{L}\p{N}_]"
_ARTICLE = rf"(?:{'|'.join(ARTICLES)})(?!{_WORD})(?<!{_WORD}(?:{'|'.join(ARTICLES)}))"

_VELTKAMP = float(2**27 + 1)


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove Unicode blanks at both ends (``trim`` alone removes only U+0020)."""
    return F.btrim(col_of(c), F.lit(BLANKS))


def _words(spaced: Column) -> Column:
    """Words of a text in which single spaces are the only blanks."""
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def single_spaces(c: Column | str) -> Column:
    """The text with every run of blanks as one space, and none at the ends."""
    return F.btrim(F.regexp_replace(F.translate(col_of(c), BLANKS, " " * len(BLANKS)), " {2,}", " "))


def tokens(c: Column | str) -> Column:
    """Split on blanks; an empty text has no tokens."""
    return _words(single_spaces(c))


def normalize_answer(c: Column | str) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces. NULL gives ''.

    Blanks become spaces and punctuation goes in one translation, so that the patterns
    left are simple ones: wide character classes cost more than all the rest.
    """
    text = F.translate(F.lower(col_of(c)), BLANKS + PUNCTUATION, " " * len(BLANKS))
    text = F.btrim(F.regexp_replace(F.regexp_replace(text, _ARTICLE, " "), " {2,}", " "))
    return F.coalesce(text, F.lit(""))


def normal_words(c: Column | str) -> Column:
    """The words of a normalised answer."""
    return _words(col_of(c))


def exact_match(prediction: Column | str, gold: Column | str) -> Column:
    return F.coalesce(col_of(prediction) == col_of(gold), F.lit(False))


def substring_match(
    prediction: Column | str,
    gold: Column | str,
    norm_prediction: Column | str | None = None,
    norm_gold: Column | str | None = None,
) -> Column:
    """Whether the gold answer occurs in the prediction, normalised or case-folded.

    Pass the normalised columns when they exist already.
    """
    p, g = col_of(prediction), col_of(gold)
    np_ = col_of(norm_prediction) if norm_prediction is not None else normalize_answer(p)
    ng = col_of(norm_gold) if norm_gold is not None else normalize_answer(g)
    hit = ((ng != "") & F.contains(np_, ng)) | F.contains(F.lower(strip(p)), F.lower(strip(g)))
    return F.coalesce((p != "") & (g != "") & hit, F.lit(False))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often it is used, in lambdas too."""
    return F.transform(F.array(value), body)[0]


def word_counts(words: Column) -> Column:
    """Word -> number of its copies. The words are sorted; a word's copies are those from where it
    starts up to where the next one does."""

    def counted(ordered: Column) -> Column:
        def starts(i: Column) -> Column:
            word = F.get(ordered, i)
            return word.isNotNull() & ((i == 0) | ~word.eqNullSafe(F.get(ordered, i - 1)))

        # The last number is one too many: it is no place of a word.
        places = F.filter(F.sequence(F.lit(0), F.size(ordered)), starts)
        return _let(
            places,
            lambda p: F.map_from_arrays(
                F.transform(p, lambda i: F.get(ordered, i)),
                F.transform(p, lambda i, k: F.coalesce(F.get(p, k + 1), F.size(ordered)) - i),
            ),
        )

    return _let(F.sort_array(words), counted)


def shared_words(left: Column | str, right: Column | str) -> Column:
    """Size of the multiset intersection of two word arrays; a null array gives null.

    Copies are counted on each side and the counts met by a hash of their words, so answers of
    tens of thousands of words stay cheap. Equal sides are not counted at all. Null words match
    nothing.
    """
    left, right = col_of(left), col_of(right)
    least = F.map_zip_with(word_counts(left), word_counts(right), lambda _, a, b: F.least(F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0))))
    shared = F.aggregate(F.map_values(least), F.lit(0), lambda acc, n: acc + n)
    return F.when(left == right, F.size(F.array_compact(left))).otherwise(shared)


def round_half_even(x: Column | str, digits: int) -> Column:
    """Round a double by its exact binary value, ties to even.

    ``round`` and ``bround`` look at the decimal spelling, which moves some values by one
    unit. Here the product x * 10^digits is split into two exact halves instead. Give a
    plain column: the argument is used several times.
    """
    x = col_of(x)
    scale = float(10**digits)
    t = x * F.lit(_VELTKAMP)
    high = t - (t - x)
    low = x - high
    whole = F.floor(x * F.lit(scale))
    over_half = ((high * F.lit(scale) - whole) - F.lit(0.5)) + low * F.lit(scale)
    up = (over_half > 0) | ((over_half == 0) & (F.pmod(whole, F.lit(2)) == 1))
    return (whole + F.when(up, 1).otherwise(0)) / F.lit(scale)


def with_percentages(df, total: str, digits: int = 1, **columns: str):
    """Add ``name = round(100 * column / total, digits)`` for every keyword."""
    raw = {f"__{name}": F.col(c) / F.greatest(F.col(total), F.lit(1)) * F.lit(100.0) for name, c in columns.items()}
    df = df.withColumns(raw)
    return df.withColumns({name: round_half_even(f"__{name}", digits) for name in columns}).drop(*raw)
