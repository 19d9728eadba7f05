"""Readers for raw code files. Line order survives the distributed read."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.strings import drop_invalid_utf8
from ..operators.ranking import top_k

# The order of a line: file, then block of the file, then position inside the block.
LINE_ORDER = ("file", "block_start", "line_id")


Decoder = Callable[[bytes], Iterable[list]]
DECODED_ROWS = 10_000    # of a spreadsheet that a task holds at once


def line_order() -> list:
    return [F.asc(name) for name in LINE_ORDER]


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, block_start, line_id, line) of text files; bytes that are no UTF-8 are dropped.

    Large files are split across tasks; ``line_id`` grows within a split and ``block_start``
    orders the splits of a file.
    """
    return (spark.read.text(list(paths))
            .select(F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("block_start"),
                    F.monotonically_increasing_id().alias("line_id"),
                    drop_invalid_utf8(F.col("value")).alias("line")))


def split_cells(line: Column, sep: str) -> Column:
    """The cells of a CSV line, however many: quoted or plain, unquoted empty cells null.

    Inside quotes, a quote is doubled or follows a backslash. Trailing empty cells are cut.
    """
    mark = {"\t": r"\t", "|": r"\|"}.get(sep, sep)
    quoted = r'"[^"\\]*+(?:(?:""|\\.)[^"\\]*+)*+"'
    found = F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(f"{mark}({quoted}|[^{mark}]*+)"), F.lit(1))

    def value(cell: Column) -> Column:
        inner = F.substring(cell, F.lit(2), F.length(cell) - 2)
        inside = F.replace(F.replace(inner, F.lit('""'), F.lit('"')), F.lit('\\"'), F.lit('"'))
        return F.when(cell.rlike('(?s)^".*"$') & (F.length(cell) > 1), inside).otherwise(F.nullif(cell, F.lit("")))
    cells = F.transform(found, value)
    last = F.array_max(F.transform(cells, lambda cell, i: F.when(cell.isNotNull(), i + 1)))
    return F.slice(cells, F.lit(1), F.coalesce(last, F.lit(0)))


def read_delimited(spark: SparkSession, *paths: str, sep: str = ",") -> DataFrame:
    """(file, block_start, line_id, cells) of CSV or TSV files without assuming a header.

    Lines may have any number of cells; cells are text. Empty lines are left out.
    """
    return read_lines(spark, *paths).where("line <> ''").select(
        "file", "block_start", "line_id", split_cells(F.col("line"), sep).alias("cells"))


def read_decoded(spark: SparkSession, path: str, decoder: Decoder) -> DataFrame:
    """(file, block_start, line_id, row_no, cells) of a spreadsheet, by an injected decoder.

    The decoder takes the bytes of a file and gives its rows as lists of cell texts, at once or one
    by one. A file is decoded by one task, which passes on ``DECODED_ROWS`` at a time.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                decoded, start = iter(decoder(bytes(content))), 0
                while part := list(itertools.islice(decoded, DECODED_ROWS)):
                    numbers = range(start, start + len(part))
                    rows = [[None if cell is None else str(cell) for cell in row] for row in part]
                    yield pd.DataFrame({"file": name, "block_start": 0, "line_id": numbers, "row_no": numbers, "cells": rows})
                    start += len(part)

    return files.mapInPandas(run, "file string, block_start long, line_id long, row_no int, cells array<string>")


def number_rows(rows: DataFrame, first_rows: int) -> DataFrame:
    """Adds 0-based ``row_no`` for the first rows of each file.

    Header detection needs true row numbers only near the top; later rows get the row count
    looked at plus one, so that they come after every possible header. Only the first block
    of a file is numbered, and only its first rows, so the window is small for any file.
    """
    keys = ["file", "block_start", "line_id"]
    top = top_k(rows.filter(F.col("block_start") == 0).select(*keys), ["file"],
                [F.asc("block_start"), F.asc("line_id")], first_rows, rank="row_no")
    return (rows.join(top, keys, "left")
            .withColumn("row_no", F.coalesce(F.col("row_no") - 1, F.lit(first_rows))))
