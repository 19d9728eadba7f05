"""The pure expressions as temporary SQL functions of a session.

After :func:`register`, ``SELECT redact_phi(text), is_icd10cm(code) FROM ...`` works in Spark
SQL. The functions are SQL expressions that Catalyst inlines; nothing runs in Python.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import phi, sanitize, validate
from .strings import WHITESPACE, WHITESPACE_CLASS


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _strip(argument: str) -> str:
    return f"trim(BOTH {quoted(WHITESPACE)} FROM {argument})"


def _is_code(pattern: str, value: str) -> str:
    return f"coalesce({value} RLIKE {quoted(pattern)}, false)"


def _possible(pattern: str) -> str:
    """Whether ``text`` has what every match of the pattern contains."""
    if pattern in phi.NEEDED_TEXT:
        return f"contains(text, {quoted(phi.NEEDED_TEXT[pattern])})"
    return f"text RLIKE {quoted(phi.NEEDED_MATCH[pattern])}"


def _redacted() -> str:
    """Steps as nested one-element arrays, so that each is written, and computed, once."""
    steps = "array(text)"
    for kind, pattern in phi.PATTERNS.items():
        if kind not in phi.KEPT_BY_REDACTION:
            java = quoted(phi.java_pattern(kind, pattern, True))
            steps = (f"transform({steps}, t -> IF({_possible(pattern)}, "
                     f"regexp_replace(t, {java}, '[REDACTED-{kind.upper()}]'), t))")
    return f"{steps}[0]"


def _any_phi() -> str:
    return " OR ".join(
        f"({_possible(pattern)} AND text RLIKE {quoted(phi.java_pattern(kind, pattern, True))})"
        for kind, pattern in phi.PATTERNS.items())


def definitions() -> dict[str, tuple[str, str, str]]:
    """name -> (arguments, result type, expression)."""
    upper = f"upper({_strip('code')})"
    return {
        "is_icd10cm": ("code STRING", "BOOLEAN", _is_code(validate.ICD10CM_PATTERN, upper)),
        "is_icd10pcs": ("code STRING", "BOOLEAN", _is_code(validate.ICD10PCS_PATTERN, upper)),
        "is_cpt": ("code STRING", "BOOLEAN",
                   f"{_is_code(validate.CPT_PATTERN, _strip('code'))}"
                   f" AND {_strip('code')} >= '{validate.CPT_MIN:05d}'"),
        "is_hcpcs": ("code STRING", "BOOLEAN", _is_code(validate.HCPCS_PATTERN, upper)),
        "is_email": ("address STRING", "BOOLEAN", _is_code(validate.EMAIL_PATTERN, "address")),
        "sanitize_code": ("code STRING", "STRING",
                          f"regexp_replace({upper}, {quoted(sanitize.NON_CODE_CHARS)}, '')"),
        "redact_phi": ("text STRING", "STRING", _redacted()),
        "contains_phi": ("text STRING", "BOOLEAN", _any_phi()),
        "chunk_id": ("text STRING", "STRING", "substring(md5(encode(text, 'UTF-8')), 1, 16)"),
        "keyword_score": (
            "text STRING, query STRING", "DOUBLE",
            "try_divide(try_divide(length(lower(text)) - length(replace(lower(text), lower(query), '')), length(query)),"
            f" regexp_count(text, {quoted(f'[^{WHITESPACE_CLASS}]+')}))"),
    }


def register(spark: SparkSession) -> list[str]:
    """Create (or replace) the functions in the session; returns their names."""
    for name, (arguments, result, expression) in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) "
                  f"RETURNS {result} RETURN {expression}")
    return list(definitions())
