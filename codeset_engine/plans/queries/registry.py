"""Registration of queries and the domain tables derived from the driver's tables.

The derivations are written in SQL that Spark and DuckDB read alike, so that both sides of a
check start from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ...session import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def read_spread(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """A table for work that costs much CPU per row; only ``columns`` are moved."""
    df = read(spark, sf_dir, table)
    return spread(df.select(*columns) if columns else df)


_CODE = ("chr(CAST(65 + p_partkey % 26 AS INT)) || lpad(CAST(p_partkey % 100 AS STRING), 2, '0')"
         " || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE '.' || CAST(p_size % 5 AS STRING) END")
_PCS = ("lpad(CAST(p_partkey % 700 AS STRING), 4, '0') || chr(CAST(65 + p_partkey % 26 AS INT))"
        " || chr(CAST(65 + p_size % 26 AS INT)) || CASE WHEN p_partkey % 11 = 0 THEN '' ELSE 'Z' END")
_N5 = "lpad(CAST(o_orderkey % 100000 AS STRING), 5, '0')"
_N4 = "lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0')"
_K3, _K2, _K4, _K5 = (f"lpad(CAST(c_custkey % {10 ** n} AS STRING), {n}, '0')" for n in (3, 2, 4, 5))
_FENCE = "'```'"


def _entities(key: str, field: str, count: str) -> str:
    """JSON object text with up to two entities."""
    one = f"""'{{"{field}": "' || event_type || '", "context": "c' || CAST(user_id % 10 AS STRING) || '"}}'"""
    return (f"""'{{"{key}": [' || CASE {count} WHEN 0 THEN '' WHEN 1 THEN {one}"""
            f""" ELSE {one} || ', ' || {one} END || ']}}'""")


_BODY = (f"CASE WHEN event_id % 2 = 0 THEN {_entities('diagnoses', 'condition', '(user_id % 3)')}"
         f" ELSE {_entities('procedures', 'procedure_name', '(user_id % 3)')} END")

# name -> (table, {column: expression})
DERIVED: dict[str, tuple[str, dict[str, str]]] = {
    "code_lines": ("part", {
        "line_no": "p_partkey",
        "line": f"""CASE WHEN p_partkey % 97 = 0 THEN '   '
            WHEN p_partkey % 50 = 0 THEN '# ' || p_name
            WHEN p_partkey % 3 = 0 THEN {_CODE} || chr(9) || p_name || chr(9) || p_type
            WHEN p_partkey % 5 = 0 THEN ' ' || lower({_CODE}) || '  ' || p_name || ' '
            WHEN p_partkey % 41 = 0 THEN {_CODE}
            ELSE {_CODE} || '    ' || p_name END"""}),
    "pcs_lines": ("part", {
        "line_no": "p_partkey",
        "line": f"CASE WHEN p_partkey % 97 = 0 THEN '#' ELSE {_PCS} || ' ' || p_name || ' ' || p_type END"}),
    "cpt_cells": ("orders", {
        "file": "o_orderstatus", "line_no": "o_orderkey",
        "raw_code": f"""CASE o_orderkey % 12 WHEN 0 THEN 'CPT' WHEN 1 THEN 'a' || {_N4}
            WHEN 2 THEN lpad(CAST(o_orderkey % 30 AS STRING), 5, '0') WHEN 3 THEN {_N4} || 'T'
            WHEN 4 THEN 'NaN' WHEN 5 THEN ' ' || {_N5} || '-' WHEN 6 THEN '' WHEN 7 THEN {_N4}
            ELSE {_N5} END""",
        "description": "o_orderpriority"}),
    "typed_codes": ("part", {
        "id": "p_partkey",
        "code_type": """CASE p_partkey % 5 WHEN 0 THEN 'ICD10CM' WHEN 1 THEN 'icd10pcs'
            WHEN 2 THEN 'cpt' WHEN 3 THEN 'hcpcs' ELSE p_type END""",
        "code": f"""CASE p_partkey % 5 WHEN 0 THEN {_CODE} WHEN 1 THEN {_PCS}
            WHEN 2 THEN CASE WHEN p_size < 5 THEN 'X' ELSE '' END || lpad(CAST(p_partkey % 4000 AS STRING), 5, '0')
            WHEN 3 THEN ' ' || lower(substring(p_name, 1, 1)) || lpad(CAST(p_partkey AS STRING), 4, '0')
            ELSE p_name END"""}),
    "year_codes": ("lineitem", {
        "code_type": "l_returnflag", "year": "CAST(year(l_shipdate) AS INT)",
        "code": "lpad(CAST(l_partkey AS STRING), 10, '0')", "description": "l_linestatus",
        "l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "l_shipdate": "l_shipdate"}),
    "sheets": ("part", {
        "file": "'sheet' || lpad(CAST(CAST(floor(p_partkey / 100.0) AS BIGINT) AS STRING), 8, '0')",
        "row_no": "CAST(p_partkey % 100 AS INT)",
        "c0": """CASE WHEN p_partkey % 100 < floor(p_partkey / 100.0) % 9 THEN 'Annual list'
            WHEN p_partkey % 100 = floor(p_partkey / 100.0) % 9
            THEN CASE WHEN floor(p_partkey / 100.0) % 4 = 0 THEN 'Seq' ELSE 'HCPCS' END
            WHEN floor(p_partkey / 100.0) % 5 = 4 THEN 'n/a'
            ELSE lpad(CAST(p_partkey % 100000 AS STRING), 5, '0') END""",
        "c1": """CASE WHEN p_partkey % 100 < floor(p_partkey / 100.0) % 9 THEN NULL
            WHEN p_partkey % 100 = floor(p_partkey / 100.0) % 9 THEN 'Long Descriptor'
            WHEN p_partkey % 13 = 0 THEN NULL ELSE p_name END""",
        "c2": """CASE WHEN p_partkey % 100 < floor(p_partkey / 100.0) % 9 THEN NULL
            WHEN p_partkey % 100 = floor(p_partkey / 100.0) % 9
            THEN CASE WHEN floor(p_partkey / 100.0) % 4 = 0 THEN 'CPT Code' ELSE 'Status' END
            ELSE 'B' || lpad(CAST(p_partkey % 10000 AS STRING), 4, '0') END"""}),
    "phi_texts": ("customer", {
        "id": "c_custkey", "segment": "c_mktsegment",
        "text": f"""'Patient ' || c_name
            || CASE WHEN c_custkey % 2 = 0 THEN ' SSN ' || {_K3} || '-' || {_K2} || '-' || {_K4} ELSE '' END
            || CASE c_custkey % 5 WHEN 0 THEN ' call 555-123-' || {_K4} WHEN 1 THEN ' call 555.123' || {_K4}
               WHEN 2 THEN ' MRN: 555123' || {_K4} ELSE '' END
            || CASE WHEN c_custkey % 3 = 0 THEN ' mail User.' || {_K5} || '@Example.com,' ELSE '' END
            || CASE c_custkey % 4 WHEN 0 THEN ' MRN:' || {_K3} WHEN 1 THEN ' mrn ' || {_K3} ELSE '' END
            || CASE WHEN c_custkey % 7 = 0 THEN ' born 1/' || CAST(c_custkey % 28 + 1 AS STRING) || '/1980' ELSE '' END
            || CASE c_custkey % 6 WHEN 0 THEN ' ZIP ' || {_K5} || '-' || {_K4} WHEN 1 THEN ' ZIP ' || {_K5} ELSE '' END"""}),
    "calls": ("events", {
        "agent": "event_type", "ok": "event_type <> 'signup' AND value >= 2.5",
        "total_tokens": "event_id % 1000", "duration": "value"}),
    "responses": ("events", {
        "doc_id": "CAST(floor(event_id / 2.0) AS BIGINT)",
        "kind": "CASE WHEN event_id % 2 = 0 THEN 'diagnoses' ELSE 'procedures' END",
        "total_tokens": "event_id % 500",
        "content": f"""CASE CAST(floor(event_id / 2.0) AS BIGINT) % 7
            WHEN 1 THEN 'Here it is:' || chr(10) || {_FENCE} || 'json' || chr(10) || {_BODY} || chr(10) || {_FENCE} || ' done'
            WHEN 2 THEN {_FENCE} || chr(10) || {_BODY} || chr(10) || {_FENCE}
            WHEN 3 THEN 'no json ' || event_type
            WHEN 4 THEN '{{}}'
            WHEN 5 THEN {_FENCE} || 'json' || chr(10) || {_BODY} || chr(10)
            ELSE {_BODY} END"""}),
    "suggested": ("events", {
        "session": "event_type", "doc_id": "user_id", "event_id": "event_id",
        "code": "'C' || lpad(CAST(event_id % 500 AS STRING), 3, '0')",
        "kind": "CASE WHEN event_id % 3 = 0 THEN 'procedure' ELSE 'diagnosis' END",
        "is_primary": "event_id % 2 = 0", "confidence": "value / (value + 5.0)",
        "severity": """CASE event_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END""",
        "json": """'{"suggestions": [{"code": "C' || lpad(CAST(event_id % 500 AS STRING), 3, '0')
            || '", "description": "' || event_type || '", "confidence": ' || CAST(value AS STRING)
            || ', "modifiers": ["50", "LT"]}], "notes": "n' || CAST(user_id AS STRING) || '"}'"""}),
}


# Derived tables with long expressions that the operators refer to more than once.
COMPUTED_ONCE = ("code_lines", "pcs_lines", "cpt_cells", "typed_codes", "sheets", "phi_texts",
                 "responses")


def derived(spark: SparkSession, sf_dir: str, name: str, heavy: bool = False) -> DataFrame:
    """A derived table; ``heavy`` for work that costs much CPU per row.

    The generator makes sure that long expressions are computed once per row; filters would
    otherwise be pushed below them with a copy of each. Cheap tables go without, so that their
    scans are pruned.
    """
    table, columns = DERIVED[name]
    rows = (read_spread if heavy else read)(spark, sf_dir, table)
    values = [F.expr(e).alias(c) for c, e in columns.items()]
    if name in COMPUTED_ONCE:
        return rows.select(F.inline(F.array(F.struct(*values))))
    return rows.select(*values)


def ctes(*names: str) -> str:
    """``WITH`` clause that defines derived tables for the check."""
    parts = []
    for name in names:
        table, columns = DERIVED[name]
        parts.append(f"{name} AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items())
                     + f" FROM {table})")
    return "WITH " + ",\n".join(parts)


def int_rank(sql: str, name: str = "rank") -> str:
    """The check with its rank as a 32-bit integer, as Spark numbers rows."""
    return f"SELECT * REPLACE (CAST({name} AS INT) AS {name}) FROM ({sql})"


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"
