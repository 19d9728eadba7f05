"""Parsing of JSON that a model may have wrapped in a Markdown fence."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from .strings import strip

# A fence may be tagged as JSON; what follows it runs to the next fence. Without
# a closing fence everything but the last character is taken.
JSON_FENCE, FENCE = "```json", "```"
JSON_FENCED = r"(?s)```json(.*?)(?:```|.\z)"
FENCED = r"(?s)```(.*?)(?:```|.\z)"


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fenced_json(content: Column) -> Column:
    """Body of the json-tagged fence, else of the first fence, else null."""
    return (F.when(F.contains(content, F.lit(JSON_FENCE)),
                   strip(F.regexp_extract(content, JSON_FENCED, 1)))
            .when(F.contains(content, F.lit(FENCE)), strip(F.regexp_extract(content, FENCED, 1))))


def _if_json(text: Column) -> Column:
    """The text when it is valid JSON. The first character tells most prose apart cheaply."""
    return F.when(text.rlike(r'^\s*[\[{"\-0-9tfn]') & F.try_parse_json(text).isNotNull(), text)


def _if_filled_object(text: Column) -> Column:
    """The text when it is a JSON object with at least one key."""
    return F.when(text.rlike(r"^\s*\{") & (F.size(F.json_object_keys(text)) > 0), text)


def _body(content: Column, accept) -> Column:
    return _once(content, lambda c: F.coalesce(accept(c), _once(fenced_json(c), accept)))


def json_body(content: Column) -> Column:
    """The JSON text of a response: as it stands when valid, else from its fence, else null."""
    return _body(content, _if_json)


def object_body(content: Column) -> Column:
    """As :func:`json_body`, but only objects that hold something."""
    return _body(content, _if_filled_object)


def parse_response(content: Column, schema: T.StructType) -> Column:
    """Typed value of a response, null when there is no valid JSON in it."""
    return F.from_json(json_body(content), schema)
