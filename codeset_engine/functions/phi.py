"""Detection and redaction of personal health information."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

# The patterns, in the order in which redaction applies them. The "|" in the
# e-mail class is literal. (?U) gives \d, \s and \b their Unicode meaning on every JDK.
PATTERNS = {
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "phone": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "mrn": r"\bMRN[:\s]*\d+\b",
    "dob": r"\b\d{1,2}/\d{1,2}/\d{4}\b",
    "zip": r"\b\d{5}(-\d{4})?\b",
}
# The shorter list offered by configuration.
CONFIGURED_PATTERNS = {
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "phone": r"\b\d{10}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
}
KEPT_BY_REDACTION = ("zip",)


# What every match of a pattern contains. Texts without it skip the pattern, of which the word
# boundaries with their Unicode meaning cost most.
NEEDED_TEXT = {PATTERNS["ssn"]: "-", PATTERNS["email"]: "@", PATTERNS["dob"]: "/"}
NEEDED_MATCH = {PATTERNS["phone"]: r"\p{Nd}{3}", PATTERNS["zip"]: r"\p{Nd}{5}", PATTERNS["mrn"]: r"(?i)MRN",
                CONFIGURED_PATTERNS["phone"]: r"\p{Nd}{10}"}


def java_pattern(kind: str, pattern: str, mrn_ignore_case: bool) -> str:
    flags = "(?Ui)" if kind == "mrn" and mrn_ignore_case else "(?U)"
    return flags + pattern


def _worthwhile(text: Column, pattern: str) -> Column | None:
    if pattern in NEEDED_TEXT:
        return F.contains(text, F.lit(NEEDED_TEXT[pattern]))
    return text.rlike(NEEDED_MATCH[pattern]) if pattern in NEEDED_MATCH else None


def detect_phi(text: Column, patterns: Mapping[str, str] = PATTERNS,
               mrn_ignore_case: bool = True, zip_suffix_only: bool = False) -> Column:
    """``map<type, matches>`` without empty types.

    ``zip_suffix_only`` returns the optional ``-dddd`` part instead of the ZIP itself, for
    callers that depend on that older behaviour.
    """
    entries: list[Column] = []
    for kind, pattern in patterns.items():
        group = 1 if kind == "zip" and zip_suffix_only else 0
        found = F.regexp_extract_all(text, F.lit(java_pattern(kind, pattern, mrn_ignore_case)),
                                     F.lit(group))
        possible = _worthwhile(text, pattern)
        if possible is not None:
            found = F.when(possible, found).otherwise(F.array().cast("array<string>"))
        entries += [F.lit(kind), found]
    return F.map_filter(F.create_map(*entries), lambda _, found: F.size(found) > 0)


def contains_phi(text: Column, patterns: Mapping[str, str] = PATTERNS,
                 mrn_ignore_case: bool = True) -> Column:
    """Whether any pattern matches; stops at the first that does."""
    result = F.lit(False)
    for kind, pattern in patterns.items():
        matches = text.rlike(java_pattern(kind, pattern, mrn_ignore_case))
        possible = _worthwhile(text, pattern)
        result = result | (matches if possible is None else possible & matches)
    return result


def redact_phi(text: Column, patterns: Mapping[str, str] = PATTERNS,
               mrn_ignore_case: bool = True) -> Column:
    """Replace matches by ``[REDACTED-TYPE]``, pattern after pattern; ZIP codes stay.

    A replacement adds no "@", "/", digit or "MRN", and the SSN rule comes first, so the tests can
    look at the original text.
    """
    redacted = text
    for kind, pattern in patterns.items():
        if kind not in KEPT_BY_REDACTION:
            replaced = F.regexp_replace(redacted, java_pattern(kind, pattern, mrn_ignore_case),
                                        f"[REDACTED-{kind.upper()}]")
            possible = _worthwhile(text, pattern)
            redacted = (replaced if possible is None
                        else F.when(possible, replaced).otherwise(redacted))
    return redacted


def redact_log_line(line: Column) -> Column:
    """Redaction of log records, where the MRN label is matched case-sensitively."""
    return redact_phi(line, mrn_ignore_case=False)
