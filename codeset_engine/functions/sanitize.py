"""Input sanitisers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .strings import strip

# Limits and the characters that are replaced or kept.
MAX_FILENAME, STEM_KEPT = 255, 250
MAX_TEXT = 10000
UNSAFE_FILENAME_CHARS = r'[<>:"/\\|?*]'
NON_CODE_CHARS = r"[^A-Z0-9.\-]"


def sanitize_code(code: Column) -> Column:
    return F.regexp_replace(F.upper(strip(code)), NON_CODE_CHARS, "")


def sanitize_filename(name: Column) -> Column:
    """Last path part with unsafe characters replaced, shortened but keeping its extension."""
    parts = F.filter(F.split(name, "/"), lambda part: ~part.isin("", "."))
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    safe = F.regexp_replace(last, UNSAFE_FILENAME_CHARS, "_")
    dot = F.length(safe) - F.length(F.substring_index(safe, ".", -1))
    stem = F.when(dot > 0, F.substring(safe, F.lit(1), dot - 1)).otherwise(safe)
    extension = F.when(dot > 0, F.substring_index(safe, ".", -1)).otherwise(F.lit(""))
    shortened = F.concat(F.substring(stem, 1, STEM_KEPT),
                         F.when(extension != "", F.concat(F.lit("."), extension))
                         .otherwise(F.lit("")))
    return F.when(F.length(safe) > MAX_FILENAME, shortened).otherwise(safe)


def sanitize_text(text: Column, max_length: int = MAX_TEXT) -> Column:
    """No NUL, no outer whitespace, at most ``max_length`` code points."""
    return F.substring(strip(F.replace(text, F.lit("\0"), F.lit(""))), 1, max_length)
