"""PHI, sanitising, chunks, prompts and model responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ... import schemas
from ...functions import phi, prompts, responses, sanitize, sql, table_functions
from ...functions.strings import WHITESPACE, WHITESPACE_CLASS
from ...operators import chunk, extract, reports
from .registry import ORACLES, ctes, derived, query, read, read_spread, sql_text

_WS = "||".join(f"chr({ord(c)})" for c in WHITESPACE)


def _strip(expression: str) -> str:
    return f"trim({expression}, {_WS})"


# --- PHI ---------------------------------------------------------------------------------

def _pattern_sql(kind: str) -> str:
    return sql_text(("(?i)" if kind == "mrn" else "") + phi.PATTERNS[kind])


def _found_sql(source: str) -> str:
    """One row per text and PHI type with the matches joined."""
    kinds = ", ".join(f"'{kind}'" for kind in phi.PATTERNS)
    found = ", ".join(f"regexp_extract_all(text, {_pattern_sql(kind)}, 0)" for kind in phi.PATTERNS)
    return f"""found AS (SELECT * FROM (SELECT {source}, unnest([{kinds}]) AS phi_type,
        unnest([{found}]) AS matches FROM texts) WHERE len(matches) > 0)"""


def _redact_sql(kinds: dict[str, str], text: str = "text") -> str:
    for kind, pattern in kinds.items():
        if kind != "zip":
            text = f"regexp_replace({text}, {sql_text(pattern)}, '[REDACTED-{kind.upper()}]', 'g')"
    return text


_ALL_TEXTS = f"""{ctes('phi_texts')}, texts AS (SELECT 'customer' AS source, id, text FROM phi_texts
    UNION ALL SELECT 'document', doc_id, text FROM documents)"""


def _all_texts(spark, sf_dir) -> DataFrame:
    customers = derived(spark, sf_dir, "phi_texts", heavy=True).select(
        F.lit("customer").alias("source"), "id", "text")
    docs = read_spread(spark, sf_dir, "documents", "doc_id", "text").select(
        F.lit("document").alias("source"), F.col("doc_id").alias("id"), "text")
    return customers.unionByName(docs)


@query("phi_detect", f"""{_ALL_TEXTS}, {_found_sql('source, id')}
SELECT source, id, phi_type, CAST(len(matches) AS INT) AS n_matches, array_to_string(matches, '|') AS matches FROM found""")
def phi_detect(spark, sf_dir):
    found = _all_texts(spark, sf_dir).select("source", "id", F.explode(
        phi.detect_phi(F.col("text"))).alias("phi_type", "m"))
    return found.select("source", "id", "phi_type", F.size("m").alias("n_matches"),
                        F.array_join("m", "|").alias("matches"))


_IGNORE_CASE = {k: ("(?i)" if k == "mrn" else "") + p for k, p in phi.PATTERNS.items()}


@query("phi_redact", f"""{_ALL_TEXTS}
SELECT source, id, {_redact_sql(_IGNORE_CASE)} AS redacted, {_redact_sql(phi.PATTERNS)} AS log_line,
    {' OR '.join(f"regexp_matches(text, {_pattern_sql(k)})" for k in phi.PATTERNS)} AS has_phi FROM texts""")
def phi_redact(spark, sf_dir):
    text = F.col("text")
    return _all_texts(spark, sf_dir).select(
        "source", "id", phi.redact_phi(text).alias("redacted"),
        phi.redact_log_line(text).alias("log_line"), phi.contains_phi(text).alias("has_phi"))


@query("phi_redact_configured", f"""{_ALL_TEXTS}
SELECT source, id, {_redact_sql(phi.CONFIGURED_PATTERNS)} AS redacted FROM texts""")
def phi_redact_configured(spark, sf_dir):
    return _all_texts(spark, sf_dir).select("source", "id", phi.redact_phi(
        F.col("text"), phi.CONFIGURED_PATTERNS).alias("redacted"))


@query("phi_report", f"""{_ALL_TEXTS}, {_found_sql('source')}
SELECT source, phi_type, count(*) AS n_documents, CAST(sum(len(matches)) AS BIGINT) AS n_matches
FROM found GROUP BY ALL""")
def phi_report(spark, sf_dir):
    return reports.phi_report(_all_texts(spark, sf_dir), "text", ["source"])


# --- sanitising ----------------------------------------------------------------------------

_LONG_NAME = "url || '/../' || repeat(replace(url, '/', '|'), 8) || '.Pdf'"


@query("sanitize_filenames", f"""WITH names AS (SELECT 'u' || page_id AS id, url AS name FROM pages UNION ALL
    SELECT 'l' || page_id, {_LONG_NAME} FROM pages UNION ALL SELECT 'p' || p_partkey, '../' || p_name || '<' || p_type FROM part),
last AS (SELECT id, regexp_replace(string_split(rtrim(name, '/'), '/')[-1], '[<>:"/\\\\|?*]', '_', 'g') AS n FROM names),
cut AS (SELECT id, n, CASE WHEN contains(n, '.') THEN regexp_replace(n, '\\.[^.]*$', '') ELSE n END AS stem,
    CASE WHEN contains(n, '.') THEN string_split(n, '.')[-1] ELSE '' END AS ext FROM last)
SELECT id, CASE WHEN length(n) > 255 THEN left(stem, 250) || CASE WHEN ext <> '' THEN '.' || ext ELSE '' END
    ELSE n END AS safe FROM cut""")
def sanitize_filenames(spark, sf_dir):
    pages, part = read(spark, sf_dir, "pages"), read(spark, sf_dir, "part")
    names = (pages.selectExpr("'u' || page_id AS id", "url AS name")
             .unionByName(pages.selectExpr("'l' || page_id AS id", f"{_LONG_NAME} AS name"))
             .unionByName(part.selectExpr("'p' || p_partkey AS id",
                                          "'../' || p_name || '<' || p_type AS name")))
    return names.select("id", sanitize.sanitize_filename(F.col("name")).alias("safe"))


@query("sanitize_codes", f"""SELECT p_partkey, regexp_replace(upper({_strip("' ' || p_name || '-' || p_size || '.x ' || chr(9)")}),
    '[^A-Z0-9.\\-]', '', 'g') AS code FROM part""")
def sanitize_codes(spark, sf_dir):
    raw = F.expr("' ' || p_name || '-' || p_size || '.x ' || chr(9)")
    return read(spark, sf_dir, "part").select("p_partkey", sanitize.sanitize_code(raw).alias("code"))


@query("sanitize_texts", f"""SELECT doc_id, left({_strip("replace(chr(10) || text || '  ', chr(0), '')")}, 10000) AS safe
FROM documents""")
def sanitize_texts(spark, sf_dir):
    raw = F.expr("chr(10) || text || '  '")
    return read(spark, sf_dir, "documents").select("doc_id",
                                                   sanitize.sanitize_text(raw).alias("safe"))


@query("sql_functions", f"""SELECT doc_id, {_redact_sql(phi.PATTERNS)} AS redacted,
    {" OR ".join(f"regexp_matches(text, {_pattern_sql(kind)})" for kind in phi.PATTERNS)} AS has_phi,
    left(md5(text), 16) AS chunk_id,
    round((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3.0::DOUBLE
        / nullif(len(regexp_extract_all(text, '[^{WHITESPACE_CLASS}]+')), 0), 6) AS score FROM documents""")
def sql_functions(spark, sf_dir):
    """The registered SQL functions called from SQL over a table."""
    sql.register(spark)
    return spark.sql("""SELECT doc_id, redact_phi(text) AS redacted, contains_phi(text) AS has_phi,
        chunk_id(text) AS chunk_id, round(keyword_score(text, 'the'), 6) AS score FROM {documents}""",
                     documents=read_spread(spark, sf_dir, "documents", "doc_id", "text"))


# --- chunks --------------------------------------------------------------------------------

_CHUNKS = """chunks AS (SELECT doc_id, lang, source, n_chars, CAST(i AS INT) AS chunk_index, total AS total_chunks,
    CAST(i * 800 AS INT) AS start_index, substring(text, CAST(i * 800 + 1 AS BIGINT), 1000) AS chunk FROM (
    SELECT *, unnest(range(total)) AS i FROM (
    SELECT *, CAST(greatest(1, ceil((length(text) - 200) / 800.0)) AS INT) AS total FROM documents WHERE length(text) > 0)))"""
_ID = "left(md5(chunk), 16)"


@query("chunk_fixed", f"""WITH {_CHUNKS}
SELECT doc_id, chunk_index, total_chunks, start_index, chunk, {_ID} AS chunk_id FROM chunks""")
def chunk_fixed(spark, sf_dir):
    docs = read_spread(spark, sf_dir, "documents", "doc_id", "text")
    return chunk.chunk_fixed(docs).withColumn("chunk_id", chunk.chunk_id(F.col("chunk")))


@query("chunk_metadata", f"""WITH {_CHUNKS}
SELECT source || '_' || lang || '_' || source || '/' || doc_id || '.txt_chunk_' || chunk_index AS id,
    doc_id || '.txt' AS source_file, source || '/' || doc_id || '.txt' AS source_path, 'txt' AS file_type,
    round(n_chars / 1024.0::DOUBLE, 2) AS file_size_kb, source AS code_type, lang AS year, upper(source) AS cms_category,
    chunk_index, total_chunks, {_ID} AS chunk_id, CAST(length(chunk) AS INT) AS chunk_size,
    chunk_index > 0 AS has_previous_chunk, chunk_index < total_chunks - 1 AS has_next_chunk, start_index,
    CAST(NULL AS INT) AS page_number, CAST(NULL AS VARCHAR) AS page_label, CAST(NULL AS INT) AS total_pages,
    CAST(NULL AS VARCHAR) AS element_type, CAST(NULL AS VARCHAR) AS parent_element,
    CAST(NULL AS VARCHAR) AS sheet_name, CAST(NULL AS INT) AS row_number
FROM chunks""")
def chunk_metadata(spark, sf_dir):
    docs = read_spread(spark, sf_dir, "documents").select(
        F.expr("'raw/' || source || '/' || doc_id || '.txt'").alias("path"), "text",
        F.col("n_chars").alias("length"), F.col("source").alias("code_type"),
        F.col("lang").alias("year"))
    return chunk.chunk_metadata(chunk.chunk_fixed(docs), root="raw/").drop("chunk", "path")


@query("chunk_dedupe", f"""WITH {_CHUNKS}
SELECT {_ID} AS chunk_id, doc_id, chunk_index, start_index FROM chunks
QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY doc_id, chunk_index) = 1""")
def chunk_dedupe(spark, sf_dir):
    docs = read_spread(spark, sf_dir, "documents", "doc_id", "text")
    chunks = chunk.chunk_fixed(docs).select("doc_id", "chunk_index", "start_index", "chunk")
    first = chunk.dedupe_chunks(chunks, [F.asc("doc_id"), F.asc("chunk_index")])
    return first.select(chunk.chunk_id(F.col("chunk")).alias("chunk_id"), "doc_id", "chunk_index", "start_index")


@query("chunk_neighbours", """WITH n AS (SELECT conv_id, turn AS chunk_index,
    CAST(count(*) OVER (PARTITION BY conv_id) AS INT) AS total_chunks FROM conversations)
SELECT *, chunk_index > 0 AS has_previous_chunk, chunk_index < total_chunks - 1 AS has_next_chunk FROM n""")
def chunk_neighbours(spark, sf_dir):
    """Turns of a conversation as the chunks of a document that comes without its total."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("chunk_index"))
    return chunk.neighbour_flags(turns, "conv_id")


def _chunk_end(start: str, covered: str) -> str:
    """End of a chunk: after the last preferred separator in what is new, else after 1000 characters."""
    new = f"substring(text, {covered} + 1, {start} + 1000 - {covered})"
    ends = []
    for backwards in ("chr(10) || chr(10)", "chr(10)", "' .'", "' '"):
        found = f"strpos(reverse({new}), {backwards})"   # the separator ends this far before the end
        after = f"{start} + 1000 - {found} + 1"
        ends.append(f"CASE WHEN {found} > 0 AND {after} - length({backwards}) > {start} THEN {after} END")
    return (f"CASE WHEN {start} + 1000 >= length(text) THEN length(text) "
            f"ELSE coalesce({', '.join(ends)}, {start} + 1000) END")


@query("chunk_separator", f"""WITH RECURSIVE steps AS (
    SELECT doc_id, text, 0::BIGINT AS i, 0::BIGINT AS start, CAST({_chunk_end('0', '0')} AS BIGINT) AS stop
    FROM documents WHERE length(text) > 0
    UNION ALL SELECT doc_id, text, i + 1, next, CAST({_chunk_end('next', 'stop')} AS BIGINT) FROM (
        SELECT *, greatest(stop - 200, start + 1) AS next FROM steps WHERE stop < length(text)))
SELECT doc_id, CAST(i AS INT) AS chunk_index, CAST(count(*) OVER (PARTITION BY doc_id) AS INT) AS total_chunks,
    CAST(start AS INT) AS start_index, substring(text, start + 1, stop - start) AS chunk,
    left(md5(substring(text, start + 1, stop - start)), 16) AS chunk_id FROM steps""")
def chunk_separator(spark, sf_dir):
    docs = read_spread(spark, sf_dir, "documents", "doc_id", "text")
    return chunk.chunk_by_separator(docs).withColumn("chunk_id", chunk.chunk_id(F.col("chunk")))


_STEPS = ORACLES["chunk_separator"].split("SELECT doc_id, CAST(i AS INT)")[0]


@query("sql_chunks", f"""{_STEPS}SELECT doc_id, CAST(i AS INT) AS chunk_index,
    CAST(count(*) OVER (PARTITION BY doc_id, how) AS INT) AS total_chunks, CAST(start AS INT) AS start_index,
    substring(text, start + 1, stop - start) AS chunk, how
    FROM steps CROSS JOIN (SELECT unnest(['lateral', 'table']) AS how)""")
def sql_chunks(spark, sf_dir):
    """Separator chunks from SQL, by a lateral call for each row and by a call on the whole table."""
    table_functions.register(spark)
    docs = read_spread(spark, sf_dir, "documents", "doc_id", "text")
    return spark.sql("""SELECT doc_id, c.*, 'lateral' AS how FROM {docs} d, LATERAL separator_chunks(d.text, 1000, 200) c
        UNION ALL SELECT doc_id, chunk_index, total_chunks, start_index, chunk, 'table' AS how
        FROM chunk_table(TABLE(SELECT * FROM {docs}), 'text')""", docs=docs)


# --- prompts and responses -----------------------------------------------------------------

_HEAD2, _TAIL2 = prompts.TEMPLATES["procedure_extraction"].replace("{{", "{").replace("}}", "}").split(
    "{document_text}")
_HEAD, _TAIL = prompts.TEMPLATES["diagnosis_extraction"].replace("{{", "{").replace("}}", "}").split(
    "{document_text}")


@query("render_prompt", f"""SELECT conv_id, turn, {sql_text(_HEAD)} || text || {sql_text(_TAIL)} AS prompt,
    'document_text' AS variables FROM conversations""")
def render_prompt(spark, sf_dir):
    template = prompts.template_named("diagnosis_extraction")
    return read(spark, sf_dir, "conversations").select(
        "conv_id", "turn", prompts.render_named("diagnosis_extraction",
                                                document_text=F.col("text")).alias("prompt"),
        F.array_join(prompts.prompt_variables_column(F.lit(template)), ",").alias("variables"))


@query("build_messages", """WITH m AS (SELECT conv_id, turn,
    [CASE WHEN role = 'assistant' THEN 'system' END, CASE WHEN turn % 2 = 1 THEN 'user' END, 'user'] AS roles,
    [CASE WHEN role = 'assistant' THEN 'You are ' || role END, CASE WHEN turn % 2 = 1 THEN 'Context:' || chr(10) || 'turn ' || turn END, text] AS contents
    FROM conversations),
r AS (SELECT conv_id, turn, unnest(roles) AS role, unnest(contents) AS content, generate_subscripts(roles, 1) AS i FROM m)
SELECT conv_id, turn, role, content, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS INT) AS position
FROM r WHERE role IS NOT NULL""")
def build_messages(spark, sf_dir):
    messages = prompts.build_messages(
        F.col("text"), F.expr("CASE WHEN role = 'assistant' THEN 'You are ' || role END"),
        F.expr("CASE WHEN turn % 2 = 1 THEN 'turn ' || turn END"))
    return (read(spark, sf_dir, "conversations")
            .select("conv_id", "turn", F.posexplode(messages).alias("position", "m"))
            .select("conv_id", "turn", "position", "m.role", "m.content"))


_AFTER = ("CASE WHEN instr(substring(content, instr(content, '{f}') + {n}), '```') > 0 "
          "THEN left(substring(content, instr(content, '{f}') + {n}), instr(substring(content, instr(content, '{f}') + {n}), '```') - 1) "
          "ELSE left(substring(content, instr(content, '{f}') + {n}), length(substring(content, instr(content, '{f}') + {n})) - 1) END")
_FENCED = (f"CASE WHEN contains(content, '```json') THEN {_strip(_AFTER.format(f='```json', n=7))} "
           f"WHEN contains(content, '```') THEN {_strip(_AFTER.format(f='```', n=3))} END")
_PARSED = f"""{ctes('responses')}, fenced AS (SELECT *, {_FENCED} AS inner_ FROM responses),
bodies AS (SELECT *, CASE WHEN json_valid(content) THEN content WHEN json_valid(inner_) THEN inner_ END AS body FROM fenced),
parsed AS (SELECT *, coalesce(len(json_keys(body)) > 0, false) AS success,
    CASE WHEN kind = 'diagnoses' THEN json_array_length(body, '$.diagnoses') ELSE json_array_length(body, '$.procedures') END AS n,
    CASE WHEN kind = 'diagnoses' THEN body->>'$.diagnoses[0].condition' ELSE body->>'$.procedures[0].procedure_name' END AS first_name
    FROM bodies)"""


@query("parse_responses", f"""{_PARSED}
SELECT doc_id, kind, body, success, CAST(CASE WHEN success THEN coalesce(n, 0) ELSE 0 END AS INT) AS n_found,
    CAST(CASE WHEN success THEN total_tokens ELSE 0 END AS BIGINT) AS tokens_used, first_name,
    CASE WHEN NOT success THEN 'Failed to parse JSON response' END AS error FROM parsed""")
def parse_responses(spark, sf_dir):
    rows = derived(spark, sf_dir, "responses", heavy=True)
    parsed = extract.parse_entities(
        rows.withColumn("body", responses.json_body(F.col("content"))))
    first = F.when(F.col("kind") == "diagnoses", F.get("diagnoses", F.lit(0))["condition"]).otherwise(
        F.get("procedures", F.lit(0))["procedure_name"])
    return parsed.select("doc_id", "kind", "body", "success", "n_found", "tokens_used",
                         first.alias("first_name"), "error")


@query("combine_extractions", f"""{_PARSED}
SELECT doc_id, bool_and(success) AS success,
    CAST(sum(CASE WHEN success AND kind = 'diagnoses' THEN coalesce(n, 0) ELSE 0 END) AS INT) AS n_diagnoses,
    CAST(sum(CASE WHEN success AND kind = 'procedures' THEN coalesce(n, 0) ELSE 0 END) AS INT) AS n_procedures,
    CAST(sum(CASE WHEN success THEN coalesce(n, 0) ELSE 0 END) AS INT) AS n_total,
    CAST(sum(CASE WHEN success THEN total_tokens ELSE 0 END) AS BIGINT) AS tokens_used,
    max(CASE WHEN NOT success THEN 'Failed to parse JSON response' END) AS error,
    coalesce(max(CASE WHEN success AND kind = 'diagnoses' THEN array_to_string(body->>'$.diagnoses[*].condition', '|') END), '')
        AS diagnoses,
    coalesce(max(CASE WHEN success AND kind = 'procedures' THEN array_to_string(body->>'$.procedures[*].procedure_name', '|') END), '')
        AS procedures FROM parsed GROUP BY doc_id""")
def combine_extractions(spark, sf_dir):
    combined = extract.combine_extractions(
        extract.parse_entities(derived(spark, sf_dir, "responses", heavy=True)), "doc_id")
    return combined.withColumns({
        "diagnoses": F.array_join("diagnoses.condition", "|"),
        "procedures": F.array_join("procedures.procedure_name", "|")})


@query("sql_entities", f"""{_PARSED}, listed AS (SELECT doc_id, kind, CASE WHEN kind = 'diagnoses'
    THEN body->>'$.diagnoses[*].condition' ELSE body->>'$.procedures[*].procedure_name' END AS names,
    CASE WHEN kind = 'diagnoses' THEN body->>'$.diagnoses[*].context' ELSE body->>'$.procedures[*].context' END AS contexts
    FROM parsed WHERE success)
SELECT doc_id, kind, CAST(generate_subscripts(names, 1) - 1 AS INT) AS entity_no, unnest(names) AS name,
    unnest(contexts) AS context FROM listed""")
def sql_entities(spark, sf_dir):
    """The entities in responses, by a lateral call in SQL."""
    table_functions.register(spark)
    return spark.sql("SELECT doc_id, e.* FROM {responses} r, LATERAL response_entities(r.content) e",
                     responses=derived(spark, sf_dir, "responses", heavy=True))


@query("extraction_routing", """WITH docs AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN '' ELSE text END AS t,
    CASE turn % 3 WHEN 0 THEN 'diagnoses' WHEN 1 THEN 'procedures' ELSE 'all' END AS extract_type FROM conversations),
kinds AS (SELECT conv_id, turn, t, unnest(CASE WHEN t = '' THEN [NULL] WHEN extract_type = 'all'
    THEN ['diagnoses', 'procedures'] ELSE [extract_type] END) AS kind FROM docs)
SELECT conv_id, turn, kind, CASE WHEN kind IS NULL THEN 'No document text provided' END AS error,
    CASE WHEN kind IS NULL THEN -1 ELSE 1 END AS n_messages,
    CASE kind WHEN 'diagnoses' THEN """ + f"'user: ' || {sql_text(_HEAD)} || t || {sql_text(_TAIL)}" + """
        WHEN 'procedures' THEN """ + f"'user: ' || {sql_text(_HEAD2)} || t || {sql_text(_TAIL2)}" + """ END AS messages FROM kinds""")
def extraction_routing(spark, sf_dir):
    docs = read(spark, sf_dir, "conversations").selectExpr(
        "conv_id", "turn", "CASE WHEN role = 'system' THEN '' ELSE text END AS document_text",
        "CASE turn % 3 WHEN 0 THEN 'diagnoses' WHEN 1 THEN 'procedures' ELSE 'all' END AS extract_type")
    asked = extract.extraction_requests(docs)
    return asked.select("conv_id", "turn", "kind", "error",
                        F.coalesce(F.size("messages"), F.lit(-1)).alias("n_messages"),
                        F.array_join(F.transform("messages", lambda m: F.concat(
                            m["role"], F.lit(": "), m["content"])), chr(10)).alias("messages"))


@query("parse_suggestions", f"""{ctes('suggested')}
SELECT event_id, json->>'$.suggestions[0].code' AS code, json->>'$.suggestions[0].description' AS description,
    round(CAST(json->>'$.suggestions[0].confidence' AS DOUBLE), 6) AS confidence, json->>'$.suggestions[0].modifiers[1]' AS modifier,
    json->>'$.notes' AS notes FROM suggested""")
def parse_suggestions(spark, sf_dir):
    parsed = derived(spark, sf_dir, "suggested", heavy=True).select(
        "event_id", responses.parse_response(F.col("json"), schemas.SUGGESTIONS_RESPONSE).alias("r"))
    return (parsed.select("event_id", "r.notes", F.inline_outer("r.suggestions"))
            .select("event_id", "code", "description", F.round("confidence", 6).alias("confidence"),
                    F.get("modifiers", F.lit(1)).alias("modifier"), "notes"))


_FINDING_SQL = """'```json' || chr(10) || '{"is_valid": ' || CASE WHEN value > 5 THEN 'true' ELSE 'false' END
    || ', "validation_score": 0.5, "issues": [{"issue_type": "' || event_type || '", "severity": "critical"}, {"severity": "info"}],
    "alternative_codes": ["A' || user_id || '"]}' || chr(10) || '```'"""
_ENTITY_SQL = """'{"entities": [{"text": "' || event_type || '", "type": "DIAGNOSIS", "start": ' || user_id || ', "end": ' || event_id || '}]}'"""


@query("parse_findings", """SELECT event_id, value > 5 AS is_valid, 0.5::DOUBLE AS validation_score,
    unnest([event_type, NULL]) AS issue_type, unnest(['critical', 'info']) AS severity,
    'A' || user_id AS alternative, event_type AS entity, CAST(user_id AS INT) AS entity_start, CAST(event_id AS INT) AS entity_end
FROM events""")
def parse_findings(spark, sf_dir):
    finding = responses.parse_response(F.expr(_FINDING_SQL), schemas.VALIDATION_RESPONSE)
    entity = responses.parse_response(F.expr(_ENTITY_SQL), schemas.ENTITIES_RESPONSE)
    rows = read_spread(spark, sf_dir, "events").select("event_id", finding.alias("f"), entity.alias("e"))
    return (rows.select("event_id", "f.is_valid", "f.validation_score", "e.entities",
                        F.get("f.alternative_codes", F.lit(0)).alias("alternative"),
                        F.inline_outer("f.issues"))
            .select("event_id", "is_valid", "validation_score", "issue_type", "severity",
                    "alternative", F.get("entities", F.lit(0)).alias("x"))
            .select("event_id", "is_valid", "validation_score", "issue_type", "severity",
                    "alternative", F.col("x.text").alias("entity"),
                    F.col("x.start").alias("entity_start"), F.col("x.end").alias("entity_end")))
