"""Text columns: whitespace, truncation, concatenation, tokens."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from negmine.constants import ELLIPSIS, STOP_WORDS, WORD_PATTERN

# Unicode whitespace; Spark's trim() removes the plain blank only.
_WS = r"[\s\x0b\p{Z}\x1c-\x1f\x85]"


def strip_ws(text: Column) -> Column:
    """Remove Unicode whitespace at both ends."""
    return F.regexp_replace(F.regexp_replace(text, rf"^{_WS}+", ""), rf"{_WS}+\z", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"[^\s\x0b\p{Z}\x1c-\x1f\x85]")


def or_null(text: Column) -> Column:
    """An empty string counts as missing."""
    return F.nullif(text, F.lit(""))


def first_truthy(*columns: Column) -> Column:
    """The first column that is neither NULL nor empty."""
    return F.coalesce(*[or_null(c) for c in columns])


def concat_fields(*columns: Column) -> Column:
    """Non-empty values in order, one blank between them."""
    return F.concat_ws(" ", *[or_null(c.cast("string")) for c in columns])


def truncate_text(text: Column, max_chars: int) -> Column:
    """Cut after ``max_chars`` code points and mark the cut."""
    return F.when(
        F.length(text) > max_chars,
        F.concat(F.substring(text, 1, max_chars), F.lit(ELLIPSIS)),
    ).otherwise(text)


def words(text: Column) -> Column:
    """Lower-cased words of two or more characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))


def tokens(text: Column, stop_words: list[str] | None = None) -> Column:
    """Words without stop words; repeats and order are kept."""
    stop = STOP_WORDS if stop_words is None else stop_words
    found = words(F.coalesce(text, F.lit("")))
    return F.filter(found, lambda t: ~t.isin(stop)) if stop else found
