"""Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that separates tokens: space, tab, LF, CR, FF.
WHITESPACE = r" \t\n\r\f"
#: A token is what a run of non-space holds from its first to its last letter a-z.
TOKEN = rf"[a-z](?:[^{WHITESPACE}]*[a-z])?"


def tokens(text: Column | str) -> Column:
    """Lower-cased tokens of a text, in order: runs between white space, stripped at both ends of what is not a-z,
    empty ones dropped. One regular expression call, so it stays inside generated code. Null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def head_terms(tokens_: Column | str, cap: int | None) -> Column:
    """Distinct tokens among the first `cap` of a line (all, if None), in order of first appearance."""
    col = F.col(tokens_) if isinstance(tokens_, str) else tokens_
    return F.array_distinct(F.slice(col, 1, cap) if cap else col)


def adjacent_pairs(tokens_: Column | str) -> Column:
    """Adjacent token pairs as an array of struct(left, right); empty for fewer than two tokens."""
    col = F.col(tokens_) if isinstance(tokens_, str) else tokens_
    n = F.greatest(F.size(col) - 1, F.lit(0))
    return F.arrays_zip(F.slice(col, F.lit(1), n).alias("left"), F.slice(col, F.lit(2), n).alias("right"))


def truncated(text: Column | str, width: int = 80) -> Column:
    """A text cut to `width` characters plus `...` where it is longer; null stays null."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(F.col(text) if isinstance(text, str) else text)
