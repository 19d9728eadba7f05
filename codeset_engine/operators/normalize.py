"""Parsing of raw code lines and tables into code rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.strings import split_once, strip
from ..functions.validate import CPT_MIN, ICD10CM_PATTERN, ICD10PCS_PATTERN
from .ranking import first_per_key, top_k

# Words that mark header cells, and how many rows and cells are looked at.
CODE_HEADER_WORDS = ("code", "cpt", "hcpcs", "procedure code")
DESCRIPTION_HEADER_WORDS = ("description", "descriptor", "long", "short", "procedure")
HEADER_ROWS_TRIED = 20
SAMPLE_CELLS = 10


def derive_category(code: Column) -> Column:
    return F.substring(code, 1, 3)


def is_billable(code: Column) -> Column:
    """Codes with a decimal part are billable."""
    return F.contains(code, F.lit("."))


def insert_dot(code: Column) -> Column:
    """``E119`` to ``E11.9``; codes of up to three characters or with a dot stay."""
    return F.when((F.length(code) > 3) & ~F.contains(code, F.lit(".")),
                  F.concat(F.substring(code, 1, 3), F.lit("."), F.substring(code, 4, 100))
                  ).otherwise(code)


def clean_cpt_code(raw: Column) -> Column:
    """Upper case letters and digits only.

    Header words and the text forms of a missing value need no rule of their own: cleaned,
    none of them has the form of a code.
    """
    return F.regexp_replace(F.upper(raw), "[^0-9A-Z]", "")


def is_cpt_or_hcpcs(code: Column) -> Column:
    """Five digits from the lowest CPT code on, or a letter and four digits (cleaned codes)."""
    return code.rlike("^[0-9A-Z][0-9]{4}$") & (code >= f"{CPT_MIN:05d}")


def classify_cpt_code(code: Column) -> Column:
    """``cpt`` for valid five-digit codes, ``hcpcs`` for letter plus four digits, else null."""
    kind = F.when(code < "A", F.lit("cpt")).otherwise(F.lit("hcpcs"))
    return F.when(is_cpt_or_hcpcs(code), kind)


def _content_lines(lines: DataFrame) -> DataFrame:
    """Stripped lines without blank lines and comments."""
    return (lines.withColumn("line", strip(F.col("line")))
            .filter((F.col("line") != "") & ~F.startswith(F.col("line"), F.lit("#"))))


def _parts(lines: DataFrame, parts: Column, code_position: int) -> DataFrame:
    """Code and description from split parts; lines with fewer parts are no data.

    The generator keeps the split from being repeated in every filter on its result.
    """
    return (lines.withColumn("__parts", F.explode(F.array(parts)))
            .filter(F.size("__parts") >= 2 + code_position)
            .withColumn("code", F.upper(strip(F.get("__parts", F.lit(code_position)))))
            .withColumn("description", strip(F.get("__parts", F.lit(1 + code_position))))
            .drop("__parts", "line"))


def parse_icd10cm_lines(lines: DataFrame, dotless: bool = False,
                        code_position: int = 0) -> DataFrame:
    """Rows of a diagnosis code file. Columns other than ``line`` are carried through.

    TAB-separated lines use the first two fields, others split at the first whitespace run.
    ``dotless`` accepts codes written without the dot; ``code_position`` skips leading fields
    of whitespace-separated order files.
    """
    content = _content_lines(lines)
    line = F.col("line")
    spaced = (split_once(line) if code_position == 0
              else F.split(line, r"\s+", 2 + code_position))
    parts = F.when(F.contains(line, F.lit("\t")) & F.lit(code_position == 0),
                   F.split(line, "\t")).otherwise(spaced)
    rows = _parts(content, parts, code_position)
    if dotless:
        rows = rows.withColumn("code", insert_dot(F.col("code")))
    code = F.col("code")
    return (rows.filter(code.rlike(ICD10CM_PATTERN))
            .withColumn("code_type", F.lit("icd10cm"))
            .withColumn("category", derive_category(code))
            .withColumn("is_billable", is_billable(code)))


def parse_icd10pcs_lines(lines: DataFrame, code_position: int = 0) -> DataFrame:
    """Rows of a procedure code file; section and body system are the first two characters."""
    line = F.col("line")
    parts = (split_once(line) if code_position == 0
             else F.split(line, r"\s+", 2 + code_position))
    code = F.col("code")
    return (_parts(_content_lines(lines), parts, code_position)
            .filter(code.rlike(ICD10PCS_PATTERN))
            .withColumn("code_type", F.lit("icd10pcs"))
            .withColumn("section", F.substring(code, 1, 1))
            .withColumn("body_system", F.substring(code, 2, 1)))


def parse_cpt_rows(rows: DataFrame) -> DataFrame:
    """Rows with ``raw_code`` and ``description`` to CPT/HCPCS code rows."""
    return (rows.withColumn("code", clean_cpt_code(F.col("raw_code")))
            .filter(is_cpt_or_hcpcs(F.col("code")))
            .withColumn("code_type", F.when(F.col("code") < "A", F.lit("cpt"))
                        .otherwise(F.lit("hcpcs")))
            .withColumn("description", strip(F.col("description")))
            .drop("raw_code"))


def cpt_row_counts(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Parsed and skipped rows per file (or other key), without parsing twice."""
    kept = F.coalesce(is_cpt_or_hcpcs(clean_cpt_code(F.col("raw_code"))), F.lit(False))
    return (rows.select(*by, kept.alias("__kept")).groupBy(*by)
            .agg(F.count_if("__kept").alias("parsed"), F.count_if(~F.col("__kept")).alias("skipped")))


def dedupe_codes(codes: DataFrame, order: Sequence[Column],
                 keys: Sequence[str] = ("code",)) -> DataFrame:
    """Keep the first row per code in file order."""
    return first_per_key(codes, list(keys), order)


# --- sheets as rows: file, row_no, cells array<string> ----------------------------------

def _looks_like_code(cell: Column) -> Column:
    return F.coalesce(strip(cell).rlike("^([0-9]{5}|[A-Za-z][0-9]{4})$"), F.lit(False))


def _named(cells: Column) -> Column:
    return F.exists(cells, lambda c: c.isNotNull() & (strip(c) != "")
                    & ~F.contains(F.lower(c), F.lit("unnamed")))


def sheet_headers(rows: DataFrame) -> DataFrame:
    """(file, header_row, code_col, desc_col) of each sheet.

    The header is the first of rows 0-19 that has two columns, a named cell and a code below
    its first one, else row 0. Only the first 21 rows of a file are gathered, whatever its
    size; everything else happens inside that one small array.
    """
    top = (rows.filter(F.col("row_no") <= HEADER_ROWS_TRIED).groupBy("file")
           .agg(F.array_sort(F.collect_list(F.struct("row_no", "cells"))).alias("top")))
    below = F.transform("top", lambda row, i: F.struct(
        row["row_no"].alias("row_no"), row["cells"].alias("cells"),
        F.get(F.get("top", i + 1)["cells"], F.lit(0)).alias("below"),
        F.get("top", i + 1)["row_no"].alias("below_no")))
    headers = F.filter(below, lambda row: (
        (row["row_no"] < HEADER_ROWS_TRIED) & (row["below_no"] == row["row_no"] + 1)
        & (F.size(row["cells"]) >= 2) & _named(row["cells"]) & _looks_like_code(row["below"])))
    header_row = F.coalesce(F.get(headers, F.lit(0))["row_no"], F.lit(0))
    return (top.withColumn("header_row", header_row)
            .withColumn("header", F.get(F.filter(
                "top", lambda row: row["row_no"] == F.col("header_row")), F.lit(0))["cells"])
            .select("file", "header_row", detect_columns(F.col("header")).alias("c"))
            .select("file", "header_row", "c.code_col", "c.desc_col"))


def detect_header_rows(rows: DataFrame) -> DataFrame:
    """(file, header_row) of each sheet."""
    return sheet_headers(rows).select("file", "header_row")


def _first_with(header: Column, words: Sequence[str]) -> Column:
    """0-based position of the first header cell that contains any word, null if none."""
    has_word = F.transform(header, lambda c: F.coalesce(
        F.lower(strip(c)).rlike("|".join(words)), F.lit(False)))
    return F.nullif(F.array_position(has_word, F.lit(True)), F.lit(0)) - 1


def detect_columns(header: Column) -> Column:
    """``struct<code_col, desc_col>``: 0-based positions by header words, else 0 and 1."""
    code = F.coalesce(_first_with(header, CODE_HEADER_WORDS),
                      F.when(F.size(header) >= 1, F.lit(0).cast("long")))
    description = F.coalesce(_first_with(header, DESCRIPTION_HEADER_WORDS),
                             F.when(F.size(header) >= 2, F.lit(1).cast("long")))
    return F.struct(code.cast("int").alias("code_col"), description.cast("int").alias("desc_col"))


def detect_code_column_by_data(rows: DataFrame) -> DataFrame:
    """(file, code_col): first column where most of the first ten values have five characters."""
    cells = (rows.select("file", "row_no", F.posexplode("cells").alias("position", "cell"))
             .filter(F.col("cell").isNotNull()))
    sample = first_rows_per_column(cells)
    share = F.avg((F.length(strip(F.col("cell"))) == 5).cast("int"))
    return (sample.groupBy("file", "position").agg(share.alias("share")).filter("share > 0.5")
            .groupBy("file").agg(F.min("position").alias("code_col")))


def first_rows_per_column(cells: DataFrame, n: int = SAMPLE_CELLS) -> DataFrame:
    return top_k(cells, ["file", "position"], [F.asc("row_no")], n, rank="__n").drop("__n")


def read_sheet_codes(rows: DataFrame, by_data: bool = False,
                     carry: Sequence[str] = ()) -> DataFrame:
    """Header detection, column detection and code parsing for sheets given as rows.

    The header facts are one small row per file and are joined back; ``by_data`` finds the
    code column from the values instead of the header words. ``carry`` names further columns
    to keep, such as the line order.
    """
    data = rows.join(sheet_headers(rows), "file").filter(F.col("row_no") > F.col("header_row"))
    if by_data:
        found = detect_code_column_by_data(data.select("file", "row_no", "cells"))
        data = data.drop("code_col").join(found, "file")
    return parse_cpt_rows(data.select(
        "file", "row_no", *carry, F.get("cells", F.col("code_col")).alias("raw_code"),
        F.get("cells", F.col("desc_col")).alias("description")))
