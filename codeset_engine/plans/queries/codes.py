"""Code parsing, validation, years and download links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ...functions import validate
from ...functions.strings import WHITESPACE, WHITESPACE_CLASS
from ...operators import normalize, years
from ...sources import documents, links, listing
from .registry import ctes, derived, int_rank, query, read, read_spread

_WS = "||".join(f"chr({ord(c)})" for c in WHITESPACE)
_SP = f"[{WHITESPACE_CLASS}]+"


def _strip(expression: str) -> str:
    return f"trim({expression}, {_WS})"


_CM_RULE = r"'^[A-TV-Z][0-9]{2}(\.[A-Z0-9]{1,4})?$'"
_PCS_RULE = "'^[0-9A-HJ-NP-Z]{7}$'"


@query("normalize_codes", f"""{ctes('code_lines')},
content AS (SELECT line_no, {_strip('line')} AS line FROM code_lines),
parts AS (SELECT line_no,
    CASE WHEN contains(line, chr(9)) THEN string_split(line, chr(9))[1]
         ELSE regexp_extract(line, '(?s)^(.*?){_SP}(.*)$', 1) END AS c,
    CASE WHEN contains(line, chr(9)) THEN string_split(line, chr(9))[2]
         ELSE regexp_extract(line, '(?s)^(.*?){_SP}(.*)$', 2) END AS d
    FROM content WHERE line <> '' AND NOT starts_with(line, '#')
      AND (contains(line, chr(9)) OR regexp_matches(line, '{_SP}'))),
valid AS (SELECT line_no, upper({_strip('c')}) AS code, {_strip('d')} AS description FROM parts
          WHERE regexp_matches(upper({_strip('c')}), {_CM_RULE}))
SELECT line_no, code, description, 'icd10cm' AS code_type, substring(code, 1, 3) AS category,
       contains(code, '.') AS is_billable
FROM valid QUALIFY row_number() OVER (PARTITION BY code ORDER BY line_no) = 1""")
def normalize_codes(spark, sf_dir):
    rows = normalize.parse_icd10cm_lines(derived(spark, sf_dir, "code_lines"))
    return normalize.dedupe_codes(rows, [F.asc("line_no")])


@query("normalize_pcs", f"""{ctes('pcs_lines')},
valid AS (SELECT line_no, upper(regexp_extract(line, '^(\\S+) (.*)$', 1)) AS code,
    {_strip("regexp_extract(line, '^(\\S+) (.*)$', 2)")} AS description FROM pcs_lines WHERE NOT starts_with(line, '#'))
SELECT line_no, code, description, 'icd10pcs' AS code_type, substring(code, 1, 1) AS section,
       substring(code, 2, 1) AS body_system
FROM valid WHERE regexp_matches(code, {_PCS_RULE})
QUALIFY row_number() OVER (PARTITION BY code ORDER BY line_no) = 1""")
def normalize_pcs(spark, sf_dir):
    rows = normalize.parse_icd10pcs_lines(derived(spark, sf_dir, "pcs_lines"))
    return normalize.dedupe_codes(rows, [F.asc("line_no")])


_CPT = f"""{ctes('cpt_cells')},
cleaned AS (SELECT *, regexp_replace(upper(raw_code), '[^0-9A-Z]', '', 'g') AS c,
    lower({_strip('raw_code')}) AS l FROM cpt_cells),
kinds AS (SELECT file, line_no, c AS code, description,
    CASE WHEN l IN ('', 'code', 'cpt', 'hcpcs', 'nan', 'none') OR length(c) <> 5 THEN NULL
         WHEN regexp_matches(c, '^[0-9]+$') THEN CASE WHEN CAST(c AS INT) BETWEEN 10 AND 99999 THEN 'cpt' END
         WHEN regexp_matches(c, '^[A-Z][0-9]+$') THEN 'hcpcs' END AS code_type FROM cleaned)"""


@query("classify_cpt", f"""{_CPT}
SELECT file, line_no, code, description, code_type FROM kinds WHERE code_type IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY code ORDER BY line_no) = 1""")
def classify_cpt(spark, sf_dir):
    return normalize.dedupe_codes(normalize.parse_cpt_rows(derived(spark, sf_dir, "cpt_cells")),
                                  [F.asc("line_no")])


@query("row_counters", f"""{_CPT}
SELECT file, count(*) FILTER (code_type IS NOT NULL) AS parsed,
       count(*) FILTER (code_type IS NULL) AS skipped FROM kinds GROUP BY file""")
def row_counters(spark, sf_dir):
    return normalize.cpt_row_counts(derived(spark, sf_dir, "cpt_cells"), ["file"])


_SHEETS = f"""{ctes('sheets')},
rows_ AS (SELECT file, row_no, [c0, c1, c2] AS cells,
    lead(c0) OVER (PARTITION BY file ORDER BY row_no) AS next_cell FROM sheets),
headers AS (SELECT file, coalesce(min(row_no) FILTER (
    (c0 IS NOT NULL OR c1 IS NOT NULL OR c2 IS NOT NULL) AND row_no < 20
    AND regexp_matches(trim(next_cell), '^([0-9]{{5}}|[A-Za-z][0-9]{{4}})$')), 0) AS header_row
    FROM (SELECT *, cells[1] AS c0, cells[2] AS c1, cells[3] AS c2 FROM rows_) GROUP BY file),
cols AS (SELECT headers.file, header_row, cells,
    coalesce(CASE WHEN regexp_matches(lower(cells[1]), 'code|cpt|hcpcs') THEN 0
                  WHEN regexp_matches(lower(cells[2]), 'code|cpt|hcpcs') THEN 1
                  WHEN regexp_matches(lower(cells[3]), 'code|cpt|hcpcs') THEN 2 END, 0) AS code_col,
    coalesce(CASE WHEN regexp_matches(lower(cells[1]), 'descript|long|short|procedure') THEN 0
                  WHEN regexp_matches(lower(cells[2]), 'descript|long|short|procedure') THEN 1
                  WHEN regexp_matches(lower(cells[3]), 'descript|long|short|procedure') THEN 2 END, 1) AS desc_col
    FROM headers JOIN rows_ ON headers.file = rows_.file AND headers.header_row = rows_.row_no)"""


def _sheets(spark, sf_dir) -> DataFrame:
    return derived(spark, sf_dir, "sheets").select("file", "row_no",
                                                   F.array("c0", "c1", "c2").alias("cells"))


@query("detect_header", f"{_SHEETS} SELECT file, CAST(header_row AS INT) AS header_row FROM headers")
def detect_header(spark, sf_dir):
    return normalize.detect_header_rows(_sheets(spark, sf_dir))


@query("detect_columns", f"""{_SHEETS} SELECT file, CAST(code_col AS INT) AS code_col,
    CAST(desc_col AS INT) AS desc_col FROM cols""")
def detect_columns(spark, sf_dir):
    return normalize.sheet_headers(_sheets(spark, sf_dir)).select("file", "code_col", "desc_col")


@query("detect_code_column", f"""{ctes('sheets')},
cells AS (SELECT file, row_no, unnest([0, 1, 2]) AS position, unnest([c0, c1, c2]) AS cell FROM sheets),
sample AS (SELECT * FROM cells WHERE cell IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY file, position ORDER BY row_no) <= 10),
shares AS (SELECT file, position FROM sample GROUP BY file, position
           HAVING avg((length(trim(cell)) = 5)::INT) > 0.5)
SELECT file, CAST(min(position) AS INT) AS code_col FROM shares GROUP BY file""")
def detect_code_column(spark, sf_dir):
    return normalize.detect_code_column_by_data(_sheets(spark, sf_dir))


@query("read_sheets", f"""{_SHEETS},
data AS (SELECT rows_.file, rows_.row_no, rows_.cells[code_col + 1] AS raw_code,
    rows_.cells[desc_col + 1] AS description FROM rows_ JOIN cols USING (file)
    WHERE rows_.row_no > cols.header_row)
SELECT file, row_no, raw_code AS code, trim(description) AS description,
    CASE WHEN regexp_matches(raw_code, '^[0-9]') THEN 'cpt' ELSE 'hcpcs' END AS code_type
FROM data WHERE (regexp_matches(raw_code, '^[0-9]{{5}}$') AND TRY_CAST(raw_code AS INT) >= 10)
    OR regexp_matches(raw_code, '^[A-Z][0-9]{{4}}$')""")
def read_sheets(spark, sf_dir):
    return normalize.read_sheet_codes(_sheets(spark, sf_dir))


_CM_E = f"""CASE WHEN code = '' THEN 'Code cannot be empty'
    WHEN NOT regexp_matches(u, {_CM_RULE}) THEN 'Invalid ICD-10-CM format: ' || u END"""
_PCS_E = f"""CASE WHEN code = '' THEN 'Code cannot be empty'
    WHEN length(u) <> 7 THEN 'ICD-10-PCS must be exactly 7 characters: ' || u
    WHEN NOT regexp_matches(u, {_PCS_RULE}) THEN 'Invalid ICD-10-PCS format: ' || u END"""
_CPT_E = """CASE WHEN code = '' THEN 'Code cannot be empty'
    WHEN NOT regexp_matches(s, '^[0-9]{5}$') THEN 'Invalid CPT format (must be 5 digits): ' || s
    WHEN TRY_CAST(s AS INT) NOT BETWEEN 10 AND 99999 THEN 'CPT code out of valid range: ' || s END"""
_HCPCS_E = """CASE WHEN code = '' THEN 'Code cannot be empty'
    WHEN NOT regexp_matches(u, '^[A-Z][0-9]{4}$') THEN 'Invalid HCPCS format: ' || u END"""


@query("validate_codes", f"""{ctes('typed_codes')},
clean AS (SELECT *, {_strip('code')} AS s, upper({_strip('code')}) AS u, lower(code_type) AS t FROM typed_codes),
errors AS (SELECT id, code_type, code, CASE t WHEN 'icd10cm' THEN {_CM_E} WHEN 'icd10pcs' THEN {_PCS_E}
    WHEN 'cpt' THEN {_CPT_E} WHEN 'hcpcs' THEN {_HCPCS_E} ELSE 'Unknown code type: ' || code_type END AS error FROM clean)
SELECT id, code_type, code, error IS NULL AS is_valid, error FROM errors""")
def validate_codes(spark, sf_dir):
    checked = validate.validate_code(F.col("code"), F.col("code_type"))
    return derived(spark, sf_dir, "typed_codes").select(
        "id", "code_type", "code", checked.alias("r")).select(
        "id", "code_type", "code", "r.is_valid", "r.error")


@query("validate_files", """WITH files AS (
    SELECT 'p' || page_id AS id, url || '.PDF' AS name, length(html) * 20000 AS n_bytes FROM pages UNION ALL
    SELECT 'd' || doc_id, lang || '/' || source || CASE doc_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.Docx'
        WHEN 2 THEN '.exe' ELSE '' END, CASE WHEN doc_id % 8 = 0 THEN 0 ELSE n_chars END FROM documents),
parts AS (SELECT *, lower(regexp_extract(rtrim(name, '/'), '[^/](\\.[^./]+)$', 1)) AS ext FROM files),
errors AS (SELECT id, name, n_bytes, CASE
    WHEN ext NOT IN ('.csv', '.docx', '.pdf', '.txt', '.xls', '.xlsx')
    THEN 'File type ''' || ext || ''' not allowed. Allowed: .csv, .docx, .pdf, .txt, .xls, .xlsx'
    WHEN n_bytes > 52428800 THEN 'File size ' || printf('%.1f', n_bytes / 1048576.0::DOUBLE) || 'MB exceeds maximum 50MB'
    WHEN n_bytes = 0 THEN 'File is empty (0 bytes)' END AS error FROM parts)
SELECT id, name, CAST(n_bytes AS BIGINT) AS n_bytes, error IS NULL AS is_valid, error FROM errors""")
def validate_files(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").selectExpr(
        "'p' || page_id AS id", "url || '.PDF' AS name",
        "CAST(length(html) * 20000 AS BIGINT) AS n_bytes")
    docs = read(spark, sf_dir, "documents").selectExpr(
        "'d' || doc_id AS id", """lang || '/' || source || CASE doc_id % 4 WHEN 0 THEN '.txt'
            WHEN 1 THEN '.Docx' WHEN 2 THEN '.exe' ELSE '' END AS name""",
        "CASE WHEN doc_id % 8 = 0 THEN 0 ELSE n_chars END AS n_bytes")
    checked = validate.validate_file(F.col("name"), F.col("n_bytes"), F.lit(True), F.lit(True))
    return pages.unionByName(docs).withColumn("r", checked).select(
        "id", "name", "n_bytes", "r.is_valid", "r.error")


@query("validate_scores", """WITH s AS (SELECT event_id, value / 10.0 - 0.2 AS score FROM events)
SELECT event_id, score BETWEEN 0 AND 1 AS is_valid,
    CASE WHEN score NOT BETWEEN 0 AND 1 THEN 'Confidence score must be between 0 and 1, got' END AS problem
FROM s""")
def validate_scores(spark, sf_dir):
    checked = validate.validate_confidence(F.expr("value / 10.0D - 0.2D"))
    return read(spark, sf_dir, "events").select("event_id", checked.alias("r")).select(
        "event_id", "r.is_valid", F.regexp_replace("r.error", ", got .*$", ", got").alias("problem"))


@query("validate_years", """WITH y AS (SELECT o_orderkey, CAST(year(o_orderdate) + o_orderkey % 30 AS INT) AS y FROM orders)
SELECT o_orderkey, y BETWEEN 2015 AND 2026 AS is_valid,
    CASE WHEN y < 2015 THEN 'Year ' || y || ' is too old (minimum 2015)'
         WHEN y > 2026 THEN 'Year ' || y || ' is in the future (maximum 2026)' END AS error FROM y""")
def validate_years(spark, sf_dir):
    checked = validate.validate_year(F.expr("CAST(year(o_orderdate) + o_orderkey % 30 AS INT)"),
                                     F.lit(years.CURRENT_YEAR))
    return read(spark, sf_dir, "orders").select("o_orderkey", checked.alias("r")).select(
        "o_orderkey", "r.is_valid", "r.error")


@query("validate_required_keys", """WITH m AS (SELECT event_id, json_keys(
    CASE WHEN event_id % 3 = 0 THEN replace(props, '"k"', '"j"') ELSE props END) AS ks FROM events),
missing AS (SELECT event_id, list_sort(list_filter(['k', 'event', 'a'], lambda x: NOT list_contains(ks, x))) AS l FROM m)
SELECT event_id, len(l) = 0 AS is_valid,
    CASE WHEN len(l) > 0 THEN 'Missing required keys: ' || array_to_string(l, ', ') END AS error FROM missing""")
def validate_required_keys(spark, sf_dir):
    props = F.from_json(F.expr("CASE WHEN event_id % 3 = 0 THEN replace(props, '\"k\"', '\"j\"') "
                               "ELSE props END"), "map<string,string>")
    checked = validate.validate_required_keys(props, ["k", "event", "a"])
    return read(spark, sf_dir, "events").select("event_id", checked.alias("r")).select(
        "event_id", "r.is_valid", "r.error")


@query("validate_emails", f"""WITH tokens AS (
    SELECT doc_id, unnest(regexp_extract_all(text, '[^{WHITESPACE_CLASS}]+')) AS token FROM documents),
checked AS (SELECT *, regexp_matches(token, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}$') AS is_valid FROM tokens)
SELECT doc_id, token, is_valid, CASE WHEN NOT is_valid THEN 'Invalid email format: ' || token END AS error,
    true AS non_empty FROM checked""")
def validate_emails(spark, sf_dir):
    tokens = read_spread(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.explode(F.split(
        "text", f"[{WHITESPACE_CLASS}]+")).alias("token")).where("token <> ''")
    return tokens.select("doc_id", "token", validate.validate_email(F.col("token")).alias("r"),
                        validate.validate_non_empty(F.col("token"), "Email").alias("n")).select(
        "doc_id", "token", "r.is_valid", "r.error", F.col("n.is_valid").alias("non_empty"))


# --- years -------------------------------------------------------------------------------

_YEAR_CODES = ctes("year_codes")


@query("compare_years", f"""{_YEAR_CODES},
d AS (SELECT DISTINCT code_type, year, code FROM year_codes),
totals AS (SELECT code_type, year, count(*) AS n FROM d GROUP BY ALL),
both_ AS (SELECT a.code_type, a.year, count(*) AS n FROM d a JOIN d b
          ON a.code_type = b.code_type AND a.code = b.code AND b.year = a.year + 1 GROUP BY ALL)
SELECT t1.code_type, t1.year AS year1, t2.year AS year2, t1.n AS year1_total, t2.n AS year2_total,
       t2.n - coalesce(both_.n, 0) AS added_in_year2, t1.n - coalesce(both_.n, 0) AS removed_from_year1,
       coalesce(both_.n, 0) AS common_codes
FROM totals t1 JOIN totals t2 ON t1.code_type = t2.code_type AND t2.year = t1.year + 1
LEFT JOIN both_ ON both_.code_type = t1.code_type AND both_.year = t1.year""")
def compare_years(spark, sf_dir):
    return years.compare_consecutive_years(derived(spark, sf_dir, "year_codes"))


def _two(y1: int, y2: int) -> str:
    return f"""{_YEAR_CODES},
a AS (SELECT DISTINCT code_type, code FROM year_codes WHERE year = {y1}),
b AS (SELECT DISTINCT code_type, code FROM year_codes WHERE year = {y2}),
p AS (SELECT coalesce(a.code_type, b.code_type) AS code_type, coalesce(a.code, b.code) AS code,
             a.code IS NOT NULL AS one, b.code IS NOT NULL AS two
      FROM a FULL JOIN b ON a.code_type = b.code_type AND a.code = b.code)"""


@query("compare_two_years", f"""{_two(1997, 2001)},
c AS (SELECT code_type, 1997 AS year1, 2001 AS year2, count(*) FILTER (one) AS t1, count(*) FILTER (two) AS t2,
    count(*) FILTER (two AND NOT one) AS a_, count(*) FILTER (one AND NOT two) AS r_,
    count(*) FILTER (one AND two) AS c_ FROM p GROUP BY code_type),
s AS (SELECT code_type, CASE WHEN two THEN 'added' ELSE 'removed' END AS change, code FROM p WHERE one <> two
      QUALIFY row_number() OVER (PARTITION BY code_type, change ORDER BY code) <= 100)
SELECT code_type, year1, year2, t1 AS year1_total, t2 AS year2_total, a_ AS added_in_year2,
    r_ AS removed_from_year1, c_ AS common_codes, NULL::VARCHAR AS error,
    coalesce((SELECT string_agg(code, ',' ORDER BY code) FROM s WHERE s.code_type = c.code_type AND change = 'added'), '') AS added_codes,
    coalesce((SELECT string_agg(code, ',' ORDER BY code) FROM s WHERE s.code_type = c.code_type AND change = 'removed'), '') AS removed_codes
FROM c""")
def compare_two_years(spark, sf_dir):
    report = years.comparison_report(derived(spark, sf_dir, "year_codes"), 1997, 2001)
    for name in ("added_codes", "removed_codes"):
        report = report.withColumn(name, F.coalesce(F.array_join(name, ","), F.lit("")))
    return report


@query("compare_years_samples", int_rank(f"""{_two(1995, 2001)}
SELECT code_type, CASE WHEN two THEN 'added' ELSE 'removed' END AS change, code,
    row_number() OVER (PARTITION BY code_type, change ORDER BY code) AS rank
FROM p WHERE one <> two QUALIFY rank <= 100"""))
def compare_years_samples(spark, sf_dir):
    return years.changed_code_samples(derived(spark, sf_dir, "year_codes"), 1995, 2001)


@query("set_operations", f"""{_YEAR_CODES},
a AS (SELECT DISTINCT code FROM year_codes WHERE year = 1995),
b AS (SELECT DISTINCT code FROM year_codes WHERE year = 1996)
SELECT 'added' AS change, code FROM (SELECT code FROM b EXCEPT SELECT code FROM a)
UNION ALL SELECT 'removed', code FROM (SELECT code FROM a EXCEPT SELECT code FROM b)
UNION ALL SELECT 'common', code FROM (SELECT code FROM a INTERSECT SELECT code FROM b)""")
def set_operations(spark, sf_dir):
    codes = derived(spark, sf_dir, "year_codes")
    return years.code_changes(codes.filter("year = 1995"), codes.filter("year = 1996"))


@query("code_history", f"""{_YEAR_CODES}
SELECT code_type, code, year, description, l_orderkey, l_linenumber FROM year_codes
QUALIFY row_number() OVER (PARTITION BY code_type, code, year ORDER BY l_orderkey, l_linenumber) = 1""")
def code_history(spark, sf_dir):
    codes = derived(spark, sf_dir, "year_codes").drop("l_shipdate")
    return years.code_history(codes, [F.asc("l_orderkey"), F.asc("l_linenumber")])


@query("code_history_flags", f"""{_YEAR_CODES},
d AS (SELECT DISTINCT code_type, code, year FROM year_codes)
SELECT code_type, code, year, min(year) OVER (PARTITION BY code_type, code) AS first_year,
    max(year) OVER (PARTITION BY code_type, code) AS last_year,
    coalesce(year - lag(year) OVER (PARTITION BY code_type, code ORDER BY year) - 1, 0) AS gap_before FROM d""")
def code_history_flags(spark, sf_dir):
    return years.history_flags(derived(spark, sf_dir, "year_codes"))


@query("compare_all_years", f"""{_YEAR_CODES},
d AS (SELECT DISTINCT code_type, year, code FROM year_codes),
totals AS (SELECT code_type, year, count(*) AS n FROM d GROUP BY ALL),
both_ AS (SELECT a.code_type, a.year AS y1, b.year AS y2, count(*) AS n FROM d a JOIN d b
          ON a.code_type = b.code_type AND a.code = b.code AND a.year <> b.year GROUP BY ALL)
SELECT t1.code_type, t1.year AS year1, t2.year AS year2, t1.n AS year1_total, t2.n AS year2_total,
       t2.n - coalesce(b.n, 0) AS added_in_year2, t1.n - coalesce(b.n, 0) AS removed_from_year1,
       coalesce(b.n, 0) AS common_codes
FROM totals t1 JOIN totals t2 ON t1.code_type = t2.code_type AND t2.year <> t1.year
LEFT JOIN both_ b ON b.code_type = t1.code_type AND b.y1 = t1.year AND b.y2 = t2.year""")
def compare_all_years(spark, sf_dir):
    """Every year of a type with every other one."""
    return years.compare_all_years(derived(spark, sf_dir, "year_codes"))


_INTERVALS = f"""{_YEAR_CODES},
firsts AS (SELECT code_type, code, year, description FROM year_codes
    QUALIFY row_number() OVER (PARTITION BY code_type, code, year ORDER BY l_orderkey, l_linenumber) = 1),
marked AS (SELECT *, CASE WHEN lag(year) OVER w = year - 1 AND lag(description) OVER w IS NOT DISTINCT FROM description
    THEN 0 ELSE 1 END AS starts FROM firsts WINDOW w AS (PARTITION BY code_type, code ORDER BY year)),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY code_type, code ORDER BY year) AS run FROM marked),
intervals AS (SELECT code_type, code, any_value(description) AS description, min(year) AS valid_from, max(year) AS valid_to
    FROM numbered GROUP BY code_type, code, run)"""


@query("validity_intervals", f"{_INTERVALS} SELECT * FROM intervals")
def validity_intervals(spark, sf_dir):
    return years.validity_intervals(derived(spark, sf_dir, "year_codes"),
                                    [F.asc("l_orderkey"), F.asc("l_linenumber")])


_REQUESTS = """SELECT o_orderkey AS qid, CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS code_type,
    lpad(CAST(CASE WHEN o_orderkey % 4 = 0 THEN 7 ELSE o_custkey END AS STRING), 10, '0') AS code,
    CAST(year(o_orderdate) AS INT) AS as_of FROM orders"""


@query("as_of_lookup", f"""{_INTERVALS}, requests AS ({_REQUESTS}),
last_ AS (SELECT r.*, i.description, i.valid_from, i.valid_to FROM requests r LEFT JOIN intervals i
    ON i.code_type = r.code_type AND i.code = r.code AND i.valid_from <= r.as_of
    QUALIFY row_number() OVER (PARTITION BY qid ORDER BY valid_from DESC NULLS LAST) = 1)
SELECT *, CASE WHEN valid_from IS NULL THEN 'unknown' WHEN as_of <= valid_to THEN 'valid' ELSE 'lapsed' END AS status
FROM last_""")
def as_of_lookup(spark, sf_dir):
    """A lookup for every order; a quarter of them ask for one code."""
    orders = read(spark, sf_dir, "orders")
    requests = orders.selectExpr(
        "o_orderkey AS qid", "CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS code_type",
        "lpad(CAST(CASE WHEN o_orderkey % 4 = 0 THEN 7 ELSE o_custkey END AS STRING), 10, '0') AS code",
        "CAST(year(o_orderdate) AS INT) AS as_of")
    return years.as_of_lookup(validity_intervals(spark, sf_dir), requests)


_GRID = f"""{_YEAR_CODES},
grid AS (SELECT code_type, CAST(year AS INT) AS year FROM (SELECT DISTINCT code_type FROM year_codes)
         CROSS JOIN (SELECT unnest(range(1994, 2003)) AS year)),
n AS (SELECT code_type, year, count(*) AS total_codes FROM year_codes GROUP BY ALL)"""
_YEARS = range(1994, 2003)


@query("availability", f"""{_GRID} SELECT code_type, year, total_codes IS NOT NULL AS exists,
    coalesce(total_codes, 0) AS total_codes FROM grid LEFT JOIN n USING (code_type, year)""")
def availability(spark, sf_dir):
    return years.availability(derived(spark, sf_dir, "year_codes"), _YEARS)


@query("available_years", f"""{_YEAR_CODES} SELECT DISTINCT code_type, year FROM year_codes""")
def available_years(spark, sf_dir):
    return years.available_years(derived(spark, sf_dir, "year_codes")).orderBy(
        "code_type", F.desc("year"))


_FILES = """files AS (SELECT code_type, year, 'f' || l_linenumber AS path, l_orderkey AS length,
    l_shipdate AS modificationTime FROM year_codes)"""
_METADATA = f"""{_GRID}, {_FILES},
facts AS (SELECT code_type, year, sum(length) AS file_size, min(path) AS file_path,
    max(modificationTime) AS last_updated FROM files GROUP BY ALL),
metadata AS (SELECT code_type, year, total_codes IS NOT NULL AS exists, coalesce(total_codes, 0) AS total_codes,
    CAST(coalesce(file_size, 0) AS BIGINT) AS file_size, file_path, last_updated
    FROM grid LEFT JOIN n USING (code_type, year) LEFT JOIN facts USING (code_type, year))"""


def _metadata(spark, sf_dir) -> DataFrame:
    codes = derived(spark, sf_dir, "year_codes")
    files = codes.selectExpr("code_type", "year", "'f' || l_linenumber AS path",
                             "l_orderkey AS length", "l_shipdate AS modificationTime")
    return years.year_metadata(codes, files, _YEARS)


@query("year_metadata", f"""{_METADATA} SELECT *, CASE WHEN exists AND code_type = 'cpt'
    THEN 'code|description|code_type' END AS columns FROM metadata""")
def year_metadata(spark, sf_dir):
    return _metadata(spark, sf_dir).withColumn("columns", F.array_join("columns", "|"))


@query("year_report", f"""{_METADATA}
SELECT upper(code_type) AS code_type, year, '  ' || CASE WHEN exists THEN '✓' ELSE '✗' END || ' ' || year
    || CASE WHEN year = 2001 THEN ' (CURRENT)' ELSE '' END || ': '
    || CASE WHEN exists THEN format('{{:,}}', total_codes) || ' codes | '
            || printf('%.2f', file_size / 1048576.0::DOUBLE) || ' MB' ELSE 'Not available' END AS line
FROM metadata""")
def year_report(spark, sf_dir):
    return years.summary_lines(_metadata(spark, sf_dir), current_year=2001)


# --- links -------------------------------------------------------------------------------

_HREF = links.HREF.replace("'", "''")
_HREFS = f"""derived AS (SELECT CASE WHEN page_id % 2 = 0 THEN regexp_replace(html, 'href="/([^"]*)"', 'href="/files/\\1.zip"', 'g')
    ELSE html END AS html FROM pages),
shown AS (SELECT regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'g') AS html FROM derived),
raws AS (SELECT unnest(regexp_extract_all(html, '{_HREF}', 1)) AS raw FROM shown),
hrefs AS (SELECT replace(trim(regexp_replace(raw, '^["'']|["'']$', '', 'g')), '&amp;', '&') AS href FROM raws)"""


@query("extract_links", f"""WITH {_HREFS}
SELECT DISTINCT CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href
    WHEN starts_with(href, '//') THEN 'https:' || href
    WHEN starts_with(href, '/') THEN 'https://www.cms.gov' || href
    ELSE 'https://www.cms.gov/' || regexp_replace(href, '^(\\.\\.?/)+', '') END AS url FROM hrefs
WHERE ends_with(href, '.zip') AND contains(href, '/files/')""")
def extract_links(spark, sf_dir):
    """The archive links of all pages; half of the pages have their site links made into archives."""
    pages = read(spark, sf_dir, "pages").select(F.when(F.col("page_id") % 2 == 0, F.regexp_replace(
        "html", 'href="/([^"]*)"', 'href="/files/$1.zip"')).otherwise(F.col("html")).alias("html"))
    return links.extract_links(pages)


_LINKS_EXPR = """CASE p_partkey % 6
    WHEN 0 THEN 'https://www.cms.gov/files/zip/' || y || '-code-descriptions-tabular-order.zip'
    WHEN 1 THEN 'https://www.cms.gov/files/zip/' || y || '-Code-Tables-tabular-and-index.zip'
    WHEN 2 THEN 'https://www.cms.gov/files/zip/' || y || '-icd-10-pcs-order-file-' || lower(p_type) || '.zip'
    WHEN 3 THEN 'https://www.cms.gov/files/zip/' || y || '-icd-10-pcs-codes-file.zip'
    ELSE 'https://www.cms.gov/files/zip/' || replace(p_name, ' ', '-') || '.zip' END"""
_TYPES = list(links.FALLBACK_SLUGS) + ["cpt_hcpcs_codes", "other_codes"]
_TYPE_LIST = ", ".join(f"'{name}'" for name in _TYPES)


def _sql_choice(values: dict[str, str]) -> str:
    return "CASE code_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


_SLUG_SQL = _sql_choice({name: f"'{links.FILES_BASE}' || replace('{form}', '{{year}}', CAST(year AS STRING))"
                         for name, form in links.FALLBACK_SLUGS.items()})
_KNOWN_SQL = "CASE year " + " ".join(f"WHEN {y} THEN '{url}'" for (_, y), url in links.PREDEFINED.items()) + " END"
_FORM_SQL = {name: form.replace("([0-9]{4})", "' || CAST(year AS STRING) || '")
             for name, form in links.LINK_FORMS.items()}


@query("resolve_urls", f"""WITH l AS (SELECT DISTINCT {_LINKS_EXPR} AS url FROM (
    SELECT *, CAST(2010 + p_size % 20 AS STRING) AS y FROM part)),
requests AS (SELECT DISTINCT [{_TYPE_LIST}][CAST(o_orderkey % {len(_TYPES)} AS INT) + 1] AS code_type,
    CAST(year(o_orderdate) + 20 AS INT) AS year FROM orders),
found AS (SELECT code_type, year, min(url) AS scraped FROM requests JOIN l
    ON regexp_matches(url, {_sql_choice({k: f"'{v}'" for k, v in _FORM_SQL.items()})}) GROUP BY ALL),
joined AS (SELECT code_type, year, scraped, CASE WHEN code_type = 'cpt_hcpcs_codes' THEN {_KNOWN_SQL} END AS known,
    {_SLUG_SQL} AS slug FROM requests LEFT JOIN found USING (code_type, year))
SELECT code_type, year, coalesce(known, scraped, slug) AS url,
    CASE WHEN known IS NOT NULL THEN 'predefined' WHEN scraped IS NOT NULL THEN 'scraped'
         WHEN slug IS NOT NULL THEN 'fallback' ELSE 'none' END AS origin FROM joined""")
def resolve_urls(spark, sf_dir):
    found = (read(spark, sf_dir, "part").selectExpr("*", "CAST(2010 + p_size % 20 AS STRING) AS y")
             .selectExpr(f"{_LINKS_EXPR} AS url").distinct())
    requests = read(spark, sf_dir, "orders").selectExpr(
        f"array({_TYPE_LIST})[CAST(o_orderkey % {len(_TYPES)} AS INT)] AS code_type",
        "CAST(year(o_orderdate) + 20 AS INT) AS year")
    return links.resolve_download_urls(requests, found)


@query("type_groups", """WITH asked AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'cpt' WHEN '2-HIGH' THEN 'icd10cm'
    WHEN '3-MEDIUM' THEN 'icd10pcs' ELSE lower(o_orderpriority) END AS g, CAST(year(o_orderdate) AS INT) AS year FROM orders),
detailed AS (SELECT DISTINCT year, unnest(CASE g WHEN 'cpt' THEN ['cpt_hcpcs_codes']
    WHEN 'icd10cm' THEN ['icd10cm_code_descriptions', 'icd10cm_code_tables']
    WHEN 'icd10pcs' THEN ['icd10pcs_order', 'icd10pcs_codes'] ELSE [g] END) AS code_type FROM asked),
f AS (SELECT *, CASE WHEN starts_with(code_type, 'cpt') THEN 'cpt' WHEN starts_with(code_type, 'icd10cm') THEN 'icd10cm'
    WHEN starts_with(code_type, 'icd10pcs') THEN 'icd10pcs' ELSE 'other' END AS family FROM detailed)
SELECT code_type, year, family, family || '/' || code_type || '_' || year || '.zip' AS zip_path,
    family || '/' || code_type || '_' || year AS extract_dir FROM f""")
def type_groups(spark, sf_dir):
    asked = read(spark, sf_dir, "orders").selectExpr(
        """CASE o_orderpriority WHEN '1-URGENT' THEN 'cpt' WHEN '2-HIGH' THEN 'icd10cm'
           WHEN '3-MEDIUM' THEN 'icd10pcs' ELSE lower(o_orderpriority) END AS code_type""",
        "CAST(year(o_orderdate) AS INT) AS year").distinct()
    return links.download_paths(links.expand_type_groups(asked, keep=["year"]))


# --- discovery on listing rows ------------------------------------------------------------

_LISTED = {
    "path": """'/raw/' || CASE p_partkey % 3 WHEN 0 THEN 'icd10cm' WHEN 1 THEN 'icd10pcs' ELSE 'cpt' END || '/'
        || CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_size % 2 = 0 THEN 'icd10cm_code_descriptions' ELSE 'icd10cm_code_tables' END
           WHEN 1 THEN CASE WHEN p_size % 3 = 0 THEN 'icd10pcs_order' ELSE 'icd10pcs_codes' END ELSE 'cpt_hcpcs_codes' END
        || '_' || CAST(2000 + p_size AS STRING) || '/' || CASE WHEN p_partkey % 7 = 0 THEN 'deep/' ELSE '' END
        || CASE p_partkey % 5 WHEN 0 THEN 'icd10cm_order_' WHEN 1 THEN 'icd10pcs_codes_' WHEN 2 THEN 'my order ' ELSE 'notes ' END
        || CAST(p_partkey AS STRING) || CASE p_partkey % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.csv' WHEN 2 THEN '.TXT' ELSE '.xlsx' END""",
    "length": "CAST(p_partkey * 31 % 1000 AS BIGINT)",
}
_LISTING_SQL = f"""WITH listed AS (SELECT {", ".join(f"{e} AS {c}" for c, e in _LISTED.items())} FROM part),
parts AS (SELECT *, regexp_extract(path, '^/raw/([a-z0-9]+)/', 1) AS code_type,
    regexp_extract(path, '^/raw/[a-z0-9]+/([a-z0-9_]+)_[0-9]{{4}}/', 1) AS source,
    CAST(regexp_extract(path, '_([0-9]{{4}})/', 1) AS INT) AS year, regexp_extract(path, '([^/]+)$', 1) AS name FROM listed),
dirs AS (SELECT code_type, year, arg_min(source, position) AS source FROM (SELECT *, CASE source
    WHEN 'icd10cm_code_descriptions' THEN 0 WHEN 'icd10pcs_order' THEN 0 WHEN 'cpt_hcpcs_codes' THEN 0 ELSE 1 END AS position
    FROM parts) GROUP BY ALL)"""


def _listing(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "part").select(*[F.expr(e).alias(c) for c, e in _LISTED.items()])


@query("source_dirs", f"{_LISTING_SQL} SELECT code_type, year, source FROM dirs")
def source_dirs(spark, sf_dir):
    return listing.resolve_source_dirs(listing.with_source_parts(_listing(spark, sf_dir)))


@query("code_files", f"""{_LISTING_SQL},
ranked AS (SELECT *, CASE WHEN code_type = 'cpt' THEN CASE WHEN ends_with(name, '.xlsx') THEN 0 WHEN ends_with(name, '.csv') THEN 1
        WHEN ends_with(name, '.txt') THEN 2 END
    WHEN starts_with(name, code_type || '_codes_') AND ends_with(name, '.txt') THEN 0
    WHEN starts_with(name, code_type || '_order_') AND ends_with(name, '.txt') THEN 1
    WHEN regexp_matches(name, 'order.*[.]txt$') THEN 2 WHEN regexp_matches(name, 'codes.*[.]txt$') THEN 3
    WHEN ends_with(name, '.txt') THEN 4 END AS priority FROM parts JOIN dirs USING (code_type, year, source))
SELECT code_type, year, source, path, length FROM ranked WHERE priority IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY code_type, year
    ORDER BY priority, CASE WHEN code_type <> 'cpt' THEN length ELSE 0 END DESC, path) = 1""")
def code_files(spark, sf_dir):
    return listing.code_files(_listing(spark, sf_dir)).select("code_type", "year", "source", "path", "length")


@query("document_listing", f"""{_LISTING_SQL}
SELECT path, lower(regexp_extract(name, '([.][^.]+)$', 1)) AS extension, code_type, year FROM parts
WHERE code_type = 'cpt' AND year = 2024 AND NOT contains(path, '/deep/') AND NOT ends_with(path, '.csv')""")
def document_listing(spark, sf_dir):
    """The documents of one type and year, which is what the operator asks for."""
    return documents.document_listing(_listing(spark, sf_dir), "cpt", 2024).select(
        "path", "extension", "code_type", "year")
