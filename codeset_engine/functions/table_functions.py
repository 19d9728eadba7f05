"""Table functions for SQL: chunks of texts and the entities in responses.

After :func:`register`, ``SELECT ... FROM docs d, LATERAL separator_chunks(d.text, 1000, 200) c``,
``SELECT * FROM chunk_table(TABLE(docs), 'text')`` and ``... LATERAL response_entities(r.content)``
work in Spark SQL. Their rows are those of the DataFrame operators.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .. import schemas
from ..operators.chunk import CHUNK_OVERLAP, CHUNK_SIZE, check_sizes, split_spans
from .responses import FENCE, FENCED, JSON_FENCE, JSON_FENCED
from .sql import quoted
from .strings import WHITESPACE

CHUNK_FIELDS = [StructField("chunk_index", IntegerType()), StructField("total_chunks", IntegerType()),
                StructField("start_index", IntegerType()), StructField("chunk", StringType())]


def _chunks(text: str | None, size: int, overlap: int) -> Iterator[tuple]:
    spans = split_spans(text or "", size, overlap)
    for i, (start, end) in enumerate(spans):
        yield i, len(spans), start, text[start:end]


def _checked(size: AnalyzeArgument | None, overlap: AnalyzeArgument | None) -> None:
    check_sizes(size.value if size else CHUNK_SIZE, overlap.value if overlap else CHUNK_OVERLAP)


class SeparatorChunks:
    """``separator_chunks(text[, size, overlap])``: the chunks of one text, for ``LATERAL``."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument | None = None,
                overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        _checked(size, overlap)
        return AnalyzeResult(StructType(CHUNK_FIELDS))

    def eval(self, text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Iterator[tuple]:
        yield from _chunks(text, size, overlap)


class ChunkTable:
    """``chunk_table(TABLE(t), 'column'[, size, overlap])``: all other columns of ``t`` and the chunks."""

    @staticmethod
    def analyze(table: AnalyzeArgument, column: AnalyzeArgument, size: AnalyzeArgument | None = None,
                overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not table.isTable or column.value not in table.dataType.names:
            raise ValueError(f"chunk_table needs a table with the column {column.value!r}")
        _checked(size, overlap)
        others = [field for field in table.dataType if field.name != column.value]
        return AnalyzeResult(StructType(others + CHUNK_FIELDS))

    def eval(self, row: Row, column: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Iterator[tuple]:
        others = [row[name] for name in row.__fields__ if name != column]
        for chunk in _chunks(row[column], size, overlap):
            yield *others, *chunk


def _object_body(content: str) -> str:
    """``responses.object_body`` as SQL; arrays of one element hold what is used more than once."""
    filled = r"IF({0} RLIKE '^\\s*\\{{' AND size(json_object_keys({0})) > 0, {0}, NULL)"
    white = quoted(WHITESPACE)
    fenced = " ".join(
        f"WHEN contains(c, {quoted(mark)}) THEN trim(BOTH {white} FROM regexp_extract(c, {quoted(pattern)}, 1))"
        for mark, pattern in ((JSON_FENCE, JSON_FENCED), (FENCE, FENCED)))
    return (f"get(transform(array({content}), c -> coalesce({filled.format('c')}, "
            f"get(transform(array(CASE {fenced} END), f -> {filled.format('f')}), 0))), 0)")


def _response_entities() -> str:
    schema = StructType([*schemas.DIAGNOSES_RESPONSE, *schemas.PROCEDURES_RESPONSE]).simpleString()
    lists = ", ".join(
        f"transform(coalesce(p.{kind}, array()), (e, i) -> struct('{kind}' AS kind, i AS entity_no, e.{name} AS name, e.context AS context))"
        for kind, name in (("diagnoses", "condition"), ("procedures", "procedure_name")))
    return (f"SELECT kind, entity_no, name, context FROM (SELECT from_json({_object_body('content')}, '{schema}') AS p) "
            f"LATERAL VIEW inline(concat({lists})) found AS kind, entity_no, name, context")


def register(spark: SparkSession) -> list[str]:
    """Create (or replace) the table functions in the session; returns their names."""
    from pyspark.sql.functions import udtf
    spark.udtf.register("separator_chunks", udtf(SeparatorChunks, useArrow=True))
    spark.udtf.register("chunk_table", udtf(ChunkTable, useArrow=True))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION response_entities(content STRING) "
              f"RETURNS TABLE(kind STRING, entity_no INT, name STRING, context STRING) RETURN {_response_entities()}")
    return ["separator_chunks", "chunk_table", "response_entities"]
