"""Column functions against documented cases and Python."""

import datetime as dt
import json
import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from codeset_engine import schemas
from codeset_engine.functions import audit, phi, prompts, responses, sanitize, strings, validate


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [row["r"] for row in df.select("i", expression(F.col("v")).alias("r")).orderBy("i").collect()]


def valid(spark, values, kind, expression):
    return [row["is_valid"] for row in column(spark, values, kind, expression)]


@pytest.mark.parametrize("rule, cases", [
    (validate.validate_icd10cm, {"E11.9": True, "I10": True, "K64.2": True, "J45.909": True,
                                 "INVALID": False, "12345": False, "E": False, " e11.9 ": True,
                                 "U07.1": False, "": False, "   ": False, "E119": False}),
    (validate.validate_icd10pcs, {"0DBJ8ZZ": True, "0BH17EZ": True, "12345": False,
                                  "0DBIO8Z": False, "ABCDEFG": True, "0dbj8zz": True}),
    (validate.validate_cpt, {"99213": True, "45378": True, "12345": True, "ABC12": False,
                             "123": False, "00009": False, "00010": True, " 99213 ": True}),
    (validate.validate_hcpcs, {"A1234": True, "a1234": True, "12345": False, "AB123": False}),
    (validate.validate_file_extension, {"document.pdf": True, "data.csv": True, "report.xlsx": True,
                                        "note.txt": True, "file.exe": False, "script.sh": False,
                                        ".pdf": False, "a/b.PDF": True, "a.pdf/": True, "": False}),
    (validate.validate_email, {"a.b@x.org": True, "a@b": False, "a b@x.org": False, "": False}),
    (validate.validate_non_empty, {"x": True, " \t ": False, "": False}),
])
def test_text_validators(spark, rule, cases):
    assert valid(spark, list(cases), "string", rule) == list(cases.values())
    assert valid(spark, [None], "string", rule) == [False]


def test_validator_messages(spark):
    def error(rule, value):
        return column(spark, [value], "string", rule)[0]["error"]

    assert error(validate.validate_icd10cm, None) == "Code cannot be empty"
    assert error(validate.validate_icd10cm, " bad ") == "Invalid ICD-10-CM format: BAD"
    assert error(validate.validate_icd10pcs, "123") == "ICD-10-PCS must be exactly 7 characters: 123"
    assert error(validate.validate_icd10pcs, "0DBIO8Z") == "Invalid ICD-10-PCS format: 0DBIO8Z"
    assert error(validate.validate_cpt, "00009") == "CPT code out of valid range: 00009"
    assert error(validate.validate_cpt, "A") == "Invalid CPT format (must be 5 digits): A"
    assert error(lambda c: validate.validate_code(c, F.lit("snomed")), "1") == "Unknown code type: snomed"
    assert error(lambda c: validate.validate_code(c, F.lit("CPT")), "99213") is None


def test_number_validators(spark):
    mib = 1024 * 1024
    assert valid(spark, [1024, mib, 10 * mib, 50 * mib, 51 * mib, 0], "long",
                 validate.validate_file_size) == [True, True, True, True, False, False]
    sizes = column(spark, [51 * mib, 50 * mib + mib // 4], "long", validate.validate_file_size)
    assert [row["error"] for row in sizes] == [
        f"File size {x:.1f}MB exceeds maximum 50MB" for x in (51.0, 50.25)]
    assert valid(spark, [0.0, 0.5, 1.0, 0.92, -0.1, 1.5, None, float("nan")], "double",
                 validate.validate_confidence) == [True, True, True, True, False, False, False, False]
    assert valid(spark, ["0.5", "high"], "string", validate.validate_confidence) == [True, False]
    assert valid(spark, [2023, 2024, 2025, 2014, 2027, 2026], "int",
                 lambda c: validate.validate_year(c, F.lit(2025))) == [True, True, True, False, False, True]


def test_file_and_keys(spark):
    df = spark.createDataFrame(
        [("a.pdf", 10, True, True), ("a.exe", 10, True, True), ("d.pdf", 0, True, True),
         ("gone.pdf", None, False, False), ("dir.pdf", None, True, False)],
        "p string, n long, e boolean, f boolean")
    errors = [r["x"]["error"] for r in df.select(validate.validate_file(
        F.col("p"), F.col("n"), F.col("e"), F.col("f")).alias("x")).collect()]
    assert errors[0] is None and errors[1].startswith("File type '.exe'")
    assert errors[2:] == ["File is empty (0 bytes)", "File does not exist: gone.pdf",
                          "Path is not a file: dir.pdf"]
    keys = spark.createDataFrame([({"a": "1"},), ({"a": "1", "b": "2", "c": "3"},), (None,)],
                                 "m map<string,string>")
    got = [r["x"] for r in keys.select(validate.validate_required_keys(
        F.col("m"), ["c", "b", "a"]).alias("x")).collect()]
    assert got[0]["error"] == "Missing required keys: b, c"
    assert [g["is_valid"] for g in got] == [False, True, False]


def test_sanitizers(spark):
    names = {"../../etc/passwd": "passwd", "file<script>.pdf": "file_script_.pdf",
             "normal_file.csv": "normal_file.csv", "a/b/": "b", "": "", 'a:"b|c?*.txt': "a__b_c__.txt",
             "x" * 300 + ".pdf": "x" * 250 + ".pdf", "y" * 300: "y" * 250}
    assert column(spark, list(names), "string", sanitize.sanitize_filename) == list(names.values())
    assert column(spark, ["  e11.9  ", "a-b c_d!"], "string", sanitize.sanitize_code) == ["E11.9", "A-BCD"]
    assert column(spark, [" a\0b ", "z" * 10001], "string", sanitize.sanitize_text) == ["ab", "z" * 10000]


PHI_TEXT = ("Patient: John. SSN: 123-45-6789 Phone: 555-123-4567 Email: john.doe@email.com "
            "MRN: 123456 DOB: 01/15/1980 Address: 123 Main St, Anytown, CA 90210-1234")


def test_phi(spark):
    found = column(spark, [PHI_TEXT, "nothing here", "MRN: 5551234567"], "string", phi.detect_phi)
    assert found[0] == {"ssn": ["123-45-6789"], "phone": ["555-123-4567"], "email": ["john.doe@email.com"],
                        "mrn": ["MRN: 123456"], "dob": ["01/15/1980"], "zip": ["90210-1234"]}
    assert found[1] == {}
    assert column(spark, [PHI_TEXT], "string",
                  lambda c: phi.detect_phi(c, zip_suffix_only=True))[0]["zip"] == ["-1234"]
    assert column(spark, [PHI_TEXT, "none"], "string", phi.contains_phi) == [True, False]
    redacted = column(spark, [PHI_TEXT, "MRN: 5551234567", "mrn: 1"], "string", phi.redact_phi)
    assert "90210-1234" in redacted[0] and redacted[0].count("[REDACTED-") == 5
    assert redacted[1:] == ["MRN: [REDACTED-PHONE]", "[REDACTED-MRN]"]
    assert column(spark, ["MRN: 987654 mrn: 1"], "string", phi.redact_log_line) == ["[REDACTED-MRN] mrn: 1"]


phi_texts = st.lists(st.one_of(
    st.sampled_from(["123-45-6789", "5551234567", "555.123-4567", "a@b.co", "É1@x.org|", "MRN 12", "mrn:\t7",
                     "1/2/1999", "90210", "é", "٣٤٥-12-6789", "_", "-", "@", "/", "x"]),
    st.text(alphabet="0123456789-/.@ aéM_", max_size=12)), max_size=6).map(" ".join)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(phi_texts, min_size=20, max_size=40))
def test_phi_agrees_with_python(spark, texts):
    def python(text):
        for kind, pattern in phi.PATTERNS.items():
            if kind != "zip":
                text = re.sub(pattern, f"[REDACTED-{kind.upper()}]", text, flags=re.I if kind == "mrn" else 0)
        return text

    redacted = column(spark, texts, "string", phi.redact_phi)
    assert redacted == [python(text) for text in texts]
    assert column(spark, redacted, "string", phi.redact_phi) == redacted
    flags = {"mrn": re.I}
    want = [{k: [m.group(0) for m in re.finditer(p, t, flags.get(k, 0))] for k, p in phi.PATTERNS.items()}
            for t in texts]
    assert column(spark, texts, "string", phi.detect_phi) == [
        {k: v for k, v in w.items() if v} for w in want]


def test_strings(spark):
    samples = ["\x1f a 　b ", "", "one", "  x  y z "]
    assert column(spark, samples, "string", strings.strip) == [s.strip() for s in samples]
    assert column(spark, samples, "string", strings.token_count) == [len(s.split()) for s in samples]
    assert column(spark, ["aaaa", "abab"], "string",
                  lambda c: strings.occurrences(c, F.lit("aa"))) == [2, 0]


def test_templates(spark):
    assert set(prompts.TEMPLATES) == {"diagnosis_extraction", "procedure_extraction", "icd10_suggestion",
                                      "cpt_suggestion", "code_validation", "reranking",
                                      "audit_summary", "medical_ner"}
    assert prompts.prompt_variables(prompts.template_named("icd10_suggestion")) == [
        "medical_entity", "context", "retrieved_codes"]
    with pytest.raises(KeyError):
        prompts.template_named("missing")
    with pytest.raises(KeyError):
        prompts.render_named("reranking", medical_entity=F.lit("x"))
    for name, template in prompts.TEMPLATES.items():
        values = {v: f"<{v} {{braces}}>" for v in prompts.prompt_variables(template)}
        got = column(spark, ["x"], "string", lambda c: prompts.render_prompt(
            template, {k: F.lit(v) for k, v in values.items()}))[0]
        assert got == template.format(**values)


def test_messages(spark):
    df = spark.createDataFrame([("u", "s", "c"), ("u", None, ""), ("u", "", None)], "u string, s string, c string")
    got = [[(m["role"], m["content"]) for m in row["m"]] for row in df.select(prompts.build_messages(
        F.col("u"), F.col("s"), F.col("c")).alias("m")).collect()]
    assert got == [[("system", "s"), ("user", "Context:\nc"), ("user", "u")], [("user", "u")], [("user", "u")]]


def test_response_bodies(spark):
    cases = {'{"a": 1}': '{"a": 1}', "[1]": "[1]", 'x\n```json\n{"a": 2}\n``` y': '{"a": 2}',
             '```\n{"a": 3}\n```': '{"a": 3}', '``` {"b": 0} ``` ```json {"a": 4} ```': '{"a": 4}',
             '```json\n{"a": 5}\n': '{"a": 5}', '```json\n{"a": 6}': None, "prose": None, "": None,
             "```json": None, '```json\n```': None}
    assert column(spark, list(cases), "string", responses.json_body) == list(cases.values())
    parsed = column(spark, ['{"diagnoses": [{"condition": "flu"}]}', "bad"], "string",
                    lambda c: responses.parse_response(c, schemas.DIAGNOSES_RESPONSE))
    assert parsed[0]["diagnoses"][0]["condition"] == "flu" and parsed[1] is None


def test_audit_texts(spark):
    df = spark.createDataFrame([("E11.9", 0.92, None, 'q"é')], "code string, confidence double, note string, t string")
    line = df.select(audit.structured_line(F.lit("Code suggested"), {
        n: F.col(n) for n in df.columns}).alias("x")).first()["x"]
    assert line == 'Code suggested | Data: {"code": "E11.9", "confidence": 0.92, "note": null, "t": "q\\"\\u00e9"}'
    message = audit.audit_message(F.lit("a"), F.lit("r"), F.lit("u"), F.lit('{"k": 1}'))
    row = df.select(message.alias("m"), audit.audit_parts(message).alias("p")).first()
    assert row["m"] == 'Action: a | Resource: r | User: u | Details: {"k": 1}'
    assert tuple(row["p"]) == ("a", "r", "u", '{"k": 1}')
    assert column(spark, [0.85, 0.86, 0.6, 0.59, None], "double", audit.confidence_band) == [
        "medium", "high", "medium", "review", None]
    assert column(spark, [1.0, 1.01], "double", audit.duration_level) == ["INFO", "WARNING"]
    assert column(spark, [0.5, 2.0], "double", lambda c: audit.duration_message(F.lit("f"), c)) == [
        "f completed in 0.50s", "f took 2.00s (threshold: 1.0s)"]
    kept = column(spark, [dt.datetime(2018, 1, 3), dt.datetime(2018, 1, 2)], "timestamp",
                  lambda c: audit.within_retention(c, F.expr("TIMESTAMP '2025-01-01'")))
    assert kept == [True, False]
    events = audit.with_audit(df, "code_suggestion", F.col("code"), timestamp=F.expr("TIMESTAMP '2025-01-01'"))
    assert events.schema.names == schemas.AUDIT_EVENT.names
    assert events.first()["user"] == "system"
    assert all(isinstance(f.dataType, T.DataType) for f in events.schema)


def test_sql_functions_agree_with_columns(spark):
    from codeset_engine.functions import sql
    from codeset_engine.operators.chunk import chunk_id
    assert "redact_phi" in sql.register(spark)
    values = ["E11.9", " i10 ", "0DBJ8ZZ", "99213", "00009", "a1234", "x@y.org", PHI_TEXT, "", "it's \\d", "　I10"]
    spark.createDataFrame([(v,) for v in values], "v string").createOrReplaceTempView("sql_function_values")
    v = F.col("v")
    same = {"is_icd10cm": validate.validate_icd10cm(v)["is_valid"], "is_icd10pcs": validate.validate_icd10pcs(v)["is_valid"],
            "is_cpt": validate.validate_cpt(v)["is_valid"], "is_hcpcs": validate.validate_hcpcs(v)["is_valid"],
            "is_email": validate.validate_email(v)["is_valid"], "sanitize_code": sanitize.sanitize_code(v),
            "redact_phi": phi.redact_phi(v), "contains_phi": phi.contains_phi(v), "chunk_id": chunk_id(v)}
    for name, expression in same.items():
        rows = spark.sql(f"SELECT v, {name}(v) AS got FROM sql_function_values").select("got", expression.alias("want")).collect()
        assert [r["got"] for r in rows] == [r["want"] for r in rows], name
    scores = spark.createDataFrame([("Diabetes and diabetes", "DIABETES"), ("x", "y"), (" ", " "), ("x", "")], "t string, q string")
    assert [r[0] for r in scores.select(strings.keyword_score(F.col("t"), F.col("q"))).collect()] == [
        pytest.approx(2 / 3), 0.0, None, None]
    assert spark.sql("SELECT keyword_score('Diabetes and diabetes', 'DIABETES')").first()[0] == pytest.approx(2 / 3)


@given(st.lists(st.text(st.characters(exclude_categories=["Cs"], min_codepoint=32), max_size=12), min_size=1, max_size=8))
@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_json_details_equal_json_dumps(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", audit.json_object({"ké": F.col("t")}).alias("j")).collect()
    assert {r["i"]: r["j"] for r in got} == {i: json.dumps({"ké": t}) for i, t in enumerate(texts)}


def test_table_functions_equal_the_operators(spark):
    from codeset_engine.functions import table_functions
    from codeset_engine.operators import chunk, extract
    table_functions.register(spark)
    docs = spark.createDataFrame([(1, "one two. three\n\nfour " * 5, "x"), (2, None, "y"), (3, "", "z"), (4, "é" * 45, None)],
                                 "id int, text string, tag string")
    names = ["id", "tag", "chunk_index", "total_chunks", "start_index", "chunk"]
    want = sorted(map(tuple, chunk.chunk_by_separator(docs, "text", 20, 5).select(names).collect()), key=str)
    for sql in ("SELECT id, tag, c.* FROM {docs} d, LATERAL separator_chunks(d.text, 20, 5) c",
                "SELECT * FROM chunk_table(TABLE(SELECT tag, text, id FROM {docs}), 'text', 20, 5)"):
        assert sorted(map(tuple, spark.sql(sql, docs=docs).select(names).collect()), key=str) == want and want
    for sql in ("SELECT * FROM chunk_table(TABLE({docs}), 'body')", "SELECT * FROM separator_chunks('a', 10, 10)"):
        with pytest.raises(Exception):
            spark.sql(sql, docs=docs).collect()
    odd = ['{"diagnoses": [{"condition": "a", "context": "c"}, {}]}', 'x ```json\n{"procedures": [{"procedure_name": "p"}]}\n``` y',
           "nope", None, "{}", "```\n{\"diagnoses\": []}\n```", '[1]', '{"diagnoses": [{"condition": "q"']
    rows = spark.createDataFrame([(i, k, c, 1) for i, c in enumerate(odd) for k in ("diagnoses", "procedures")],
                                 "id int, kind string, content string, total_tokens int")
    parsed = extract.parse_entities(rows).collect()
    found = [(r.id, r.kind, i, e[0]) for r in parsed for i, e in enumerate(r[r.kind])]
    got = spark.sql("SELECT DISTINCT id, e.kind, entity_no, name FROM {rows} r, LATERAL response_entities(r.content) e", rows=rows)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(found, key=str) and len(found) == 3
