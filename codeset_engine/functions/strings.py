"""String helpers with Python's notion of whitespace."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters Python treats as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a regex class body; \x{..} is understood by Java and by RE2.
WHITESPACE_CLASS = (
    r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def strip(text: Column) -> Column:
    """Trim whitespace at both ends (``trim`` alone removes spaces only)."""
    return F.trim(text, F.lit(WHITESPACE))


def split_once(text: Column) -> Column:
    """Array of at most two parts, split at the first whitespace run."""
    return F.split(text, f"[{WHITESPACE_CLASS}]+", 2)


def token_count(text: Column) -> Column:
    """Number of whitespace-separated tokens."""
    return F.regexp_count(text, F.lit(f"[^{WHITESPACE_CLASS}]+"))


def occurrences(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a non-empty ``needle``."""
    removed = F.length(text) - F.length(F.replace(text, needle, F.lit("")))
    return (removed / F.length(needle)).cast("long")


def keyword_score(text: Column, query: Column) -> Column:
    """Keyword density of one row for its own query: the score that keyword search ranks by.

    Zero without a match; null when the query is empty or the text has no tokens.
    """
    hits = occurrences(F.lower(text), F.lower(query))
    return F.when(query != "", F.try_divide(hits, token_count(text)))


def drop_invalid_utf8(text: Column) -> Column:
    """Text without the bytes that do not decode as UTF-8."""
    repaired = F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit(""))
    return F.when(F.is_valid_utf8(text), text).otherwise(repaired)
