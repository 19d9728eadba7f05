"""Text forms of audit and performance records."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas

# Thresholds and defaults.
SLOW_SECONDS = 1.0
HIGH_CONFIDENCE, MIN_CONFIDENCE = 0.85, 0.6
RETENTION_DAYS = 2555
DEFAULT_USER = "system"
UNKNOWN = "unknown"


def _hex4(code: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(code), 4, "0")))


def ascii_json(text: Column) -> Column:
    """JSON text with characters beyond ASCII as ``\\uXXXX``, those above U+FFFF as two."""
    def escaped(char: Column) -> Column:
        code = F.ascii(char)
        beyond = code - 0x10000
        pair = F.concat(_hex4(F.shiftright(beyond, 10) + 0xD800), _hex4(beyond.bitwiseAND(F.lit(0x3FF)) + 0xDC00))
        return F.when(code <= 127, char).when(code > 0xFFFF, pair).otherwise(_hex4(code))
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.split(text, ""), escaped), "")).otherwise(text)


def _scalar(value: Column) -> Column:
    """JSON text of one value: the only element of a JSON array."""
    array = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.when(value.isNull(), F.lit("null")).otherwise(
        ascii_json(F.substring(array, F.lit(2), F.length(array) - 2)))


def json_object(values: Mapping[str, Column]) -> Column:
    """JSON object text with ``", "`` and ``": "`` between its parts; all of it is ASCII."""
    pairs = [F.concat(F.lit(f"{json.dumps(name)}: "), _scalar(value)) for name, value in values.items()]
    return F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}"))


def structured_line(message: Column, values: Mapping[str, Column]) -> Column:
    return F.concat(message, F.lit(" | Data: "), json_object(values))


def audit_message(action: Column, resource: Column, user: Column,
                  details: Column | None = None) -> Column:
    """``Action: a | Resource: r | User: u[ | Details: json]``."""
    base = F.concat(F.lit("Action: "), action, F.lit(" | Resource: "), resource,
                    F.lit(" | User: "), user)
    if details is None:
        return base
    return F.concat(base, F.when(details.isNull() | (details == ""), F.lit(""))
                    .otherwise(F.concat(F.lit(" | Details: "), details)))


def audit_parts(message: Column) -> Column:
    """``struct<action, resource, user, details>`` read back from an audit message."""
    pattern = r"(?s)^Action: (.*?) \| Resource: (.*?) \| User: (.*?)(?: \| Details: (.*))?$"
    names = ("action", "resource", "user", "details")
    parts = [F.nullif(F.regexp_extract(message, pattern, i + 1), F.lit("")).alias(name)
             for i, name in enumerate(names)]
    return F.struct(*parts)


def duration_level(duration: Column, threshold: float = SLOW_SECONDS) -> Column:
    return F.when(duration > threshold, F.lit("WARNING")).otherwise(F.lit("INFO"))


def duration_message(name: Column, duration: Column, threshold: float = SLOW_SECONDS) -> Column:
    seconds = F.format_string("%.2f", duration)
    return (F.when(duration > threshold,
                   F.concat(name, F.lit(" took "), seconds, F.lit(f"s (threshold: {threshold}s)")))
            .otherwise(F.concat(name, F.lit(" completed in "), seconds, F.lit("s"))))


def confidence_band(score: Column) -> Column:
    """``high`` above 0.85, ``review`` below 0.6, else ``medium``; bounds belong to medium."""
    return (F.when(score > HIGH_CONFIDENCE, F.lit("high"))
            .when(score < MIN_CONFIDENCE, F.lit("review"))
            .when(score.isNotNull(), F.lit("medium")))


def within_retention(timestamp: Column, as_of: Column, days: int = RETENTION_DAYS) -> Column:
    return timestamp >= as_of - F.make_dt_interval(F.lit(days))


def with_audit(df: DataFrame, action: str, resource: Column, user: Column | None = None,
               timestamp: Column | None = None, module: str = "", function: str = "",
               details: Column | None = None) -> DataFrame:
    """Audit event rows for an operation applied to each row of ``df``.

    ``resource`` and ``user`` extract the affected object and the actor; the operation's own
    name and ``system`` stand in for them.
    """
    who = F.coalesce(user.cast("string") if user is not None else F.lit(None), F.lit(DEFAULT_USER))
    what = F.coalesce(resource.cast("string"), F.lit(function or UNKNOWN))
    values = {
        "timestamp": F.current_timestamp() if timestamp is None else timestamp,
        "level": F.lit("INFO"), "module": F.lit(module), "function": F.lit(function),
        "line": F.lit(0), "message": audit_message(F.lit(action), what, who, details),
        "user": who, "action": F.lit(action), "resource": what,
    }
    return df.select(*[values[f.name].cast(f.dataType).alias(f.name)
                       for f in schemas.AUDIT_EVENT])
