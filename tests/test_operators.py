"""Operators against brute force on small inputs, and the shape of their plans."""

import math
import random
import sys

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

from codeset_engine.operators import chunk, embed, extract, normalize, ranking, reports, search, years

cloudpickle.register_pickle_by_value(sys.modules[__name__])   # fakes defined here run in workers


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- ranking -------------------------------------------------------------------------------

def test_first_per_key_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    first = ranking.first_per_key(df, ["k"], [F.asc("id")])
    assert {(r["k"], r["id"]) for r in first.collect()} == {(i, i) for i in range(7)}
    plan = plan_of(first).split("== Initial Plan ==")[0]
    assert plan.count("WindowGroupLimit") == 2
    assert plan.rindex("WindowGroupLimit") > plan.index("Exchange")   # one below the exchange


def test_hot_key_sends_few_rows_to_the_shuffle(spark):
    """A third of all rows share one key; each task passes on one row of it at most."""
    rows = spark.range(0, 90000, numPartitions=6).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), "id")
    first = ranking.first_per_key(rows, ["k"], [F.asc("id")])
    assert first.filter("k = -1").first()["id"] == 0 and first.count() == 60001
    changes = years.code_changes(rows.select(F.col("k").cast("string").alias("code")),
                                 rows.filter("id < 3").select(F.col("k").cast("string").alias("code")))
    counts = {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}
    assert counts == {"removed": 59998, "common": 3}
    plan = plan_of(changes)
    assert plan.count("HashAggregate") >= 2 and "SortAggregate" not in plan


def test_top_k_beyond_the_limit_threshold(spark):
    df = spark.range(9000).select((F.col("id") % 3).alias("k"), F.xxhash64("id").alias("v"), "id")
    k = 1500
    got = {(r["k"], r["rank"], r["id"]) for r in
           ranking.top_k(df, ["k"], [F.desc("v"), F.asc("id")], k).collect()}
    rows = [r.asDict() for r in df.collect()]
    want = set()
    for key in range(3):
        ordered = sorted((r for r in rows if r["k"] == key), key=lambda r: (-r["v"], r["id"]))
        want |= {(key, i + 1, r["id"]) for i, r in enumerate(ordered[:k])}
    assert got == want


def test_context_budget_equals_a_plain_running_sum(spark):
    rng = random.Random(7)
    rows = [(rng.choice("aab"), i, "x" * rng.choice([0, 1, 3, 40, 900])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i int, text string")
    for budget in (0, 5, 1000, 8000):
        got = {(r["k"], r["i"], r["rank"], r["used"]) for r in ranking.context_budget(
            df, ["k"], [F.asc("i")], budget=budget).collect()}
        want = set()
        for key in "ab":
            used = rank = 0
            for k, i, text in rows:
                if k == key and text:
                    used, rank = used + len(text), rank + 1
                    if used > budget:
                        break
                    want.add((k, i, rank, used))
        assert got == want


# --- search --------------------------------------------------------------------------------

def brute_semantic(corpus, requests, k):
    result = []
    for qid, q in requests:
        scored = []
        for key, v in corpus:
            if v is not None and any(v):
                dot = sum(a * b for a, b in zip(q, v))
                scored.append((-round(dot / math.hypot(*q) / math.hypot(*v), 9), key))
        result += [(qid, key, rank + 1) for rank, (_, key) in enumerate(sorted(scored)[:k])]
    return set(result)


@pytest.mark.parametrize("id_type", ["long", "string"])
def test_semantic_topk(spark, monkeypatch, id_type):
    rng = np.random.default_rng(3)
    corpus = [(i if id_type == "long" else f"id{i:03d}", v) for i, v in enumerate(
        [*rng.normal(size=(60, 5)).tolist(), *[[1.0, 0.0, 0.0, 0.0, 0.0]] * 300, [0.0] * 5, None])]
    requests = [(i, v) for i, v in enumerate(rng.normal(size=(9, 5)).tolist())] + [(9, [1.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(corpus, f"key {id_type}, v array<double>").repartition(5)
    req = spark.createDataFrame([*requests, (99, [0.0] * 5)], "qid int, vector array<double>")

    def run(**options):
        hits = search.semantic_topk(df, req, 7, id_col="key", vector_col="v", **options).collect()
        return {(r["qid"], r["key"], r["rank"]) for r in hits}

    assert run() == brute_semantic(corpus, requests, 7)
    monkeypatch.setattr(search, "BROADCAST_BYTES", 0)   # requests that stream past blocks give the same
    assert run() == brute_semantic(corpus, requests, 7)
    odd = F.col("key") > (corpus[30][0])
    assert run(where=odd) == brute_semantic([c for c in corpus if c[0] > corpus[30][0]], requests, 7)


def test_odd_ids_and_vectors_are_no_hits(spark, monkeypatch):
    df = spark.createDataFrame([(1, [1.0, 0.0], "a"), (None, [1.0, 0.0], "a"), (2, [1.0], "b"), (3, [], "c"),
                                (4, None, None), (5, [0.0, 1.0], "a")], "key long, v array<double>, g string")
    req = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0]), (3, None), (4, [])], "qid int, vector array<double>")
    for size in (1 << 20, 0):
        monkeypatch.setattr(search, "BROADCAST_BYTES", size)
        hits = search.semantic_topk(df, req, 5, id_col="key", vector_col="v", per=["g"])
        assert sorted((r["qid"], r["key"], r["g"], r["rank"]) for r in hits.collect()) == [
            (1, 1, "a", 1), (1, 5, "a", 2), (2, 2, "b", 1)]


def test_many_requests_take_one_corpus_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "BROADCAST_BYTES", 1000)
    rng = np.random.default_rng(4)
    vectors = [(i, v) for i, v in enumerate(rng.normal(size=(300, 4)).tolist())]
    spark.createDataFrame(vectors, "key long, v array<double>").write.parquet(str(tmp_path / "corpus"))
    df = spark.read.parquet(str(tmp_path / "corpus"))
    req = spark.createDataFrame(vectors, "qid long, vector array<double>")
    hits = search.semantic_topk(df, req, 3, id_col="key", vector_col="v")
    assert plan_of(hits).count("FileScan parquet") == 1
    assert {(r["qid"], r["key"], r["rank"]) for r in hits.collect()} == brute_semantic(vectors, vectors, 3)


def test_search_rejects_bad_input(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], "a")], "key long, v array<double>, t string")
    req = spark.createDataFrame([(1, [1.0], "")], "qid int, vector array<double>, query string")
    assert search.semantic_topk(df, req, 1, id_col="key", vector_col="v").count() == 0   # no angle
    with pytest.raises(Exception, match="non-empty"):
        search.keyword_topk(df, req, 1, id_col="key", text_col="t").collect()
    with pytest.raises(ValueError, match="sum to 1.0"):
        search.check_weights(0.7, 0.4)
    search.check_weights(0.7, 0.305)


TEXTS = [(1, "Type 2 diabetes mellitus"), (2, "DIABETES diabetes insipidus"), (3, "heart failure"),
         (4, "  diabetesdiabetes "), (5, None), (6, "a diabetes b diabetes"), (7, "aaaa aa")]


def brute_keyword(texts, requests, k):
    result = set()
    for qid, query in requests:
        scored = sorted((-round(t.lower().count(query.lower()) / len(t.split()), 9), key)
                        for key, t in texts if t and query.lower() in t.lower())
        result |= {(qid, key, rank + 1, -s) for rank, (s, key) in enumerate(scored[:k])}
    return result


def test_keyword_topk(spark, monkeypatch):
    requests = [(1, "Diabetes"), (2, "aa"), (3, "nothing"), (4, "e")]
    df = spark.createDataFrame(TEXTS, "key long, t string")
    req = spark.createDataFrame(requests, "qid int, query string")
    for size in (1 << 20, 0):
        monkeypatch.setattr(search, "BROADCAST_BYTES", size)
        got = {(r["qid"], r["key"], r["rank"], r["score"]) for r in search.keyword_topk(
            df, req, 3, id_col="key", text_col="t").collect()}
        assert got == brute_keyword(TEXTS, requests, 3)


def test_hybrid_with_one_weight_equals_the_single_search(spark):
    rng = np.random.default_rng(5)
    texts = [(k, t, v) for (k, t), v in zip(TEXTS, rng.normal(size=(7, 4)).tolist())]
    df = spark.createDataFrame(texts, "key long, t string, v array<double>")
    req = spark.createDataFrame([(1, "diabetes", rng.normal(size=4).tolist())],
                                "qid int, query string, vector array<double>")

    def keys(hits):
        return [r["key"] for r in hits.orderBy("rank").collect()]

    semantic = keys(search.semantic_topk(df, req, 3, id_col="key", vector_col="v"))
    hybrid = search.hybrid_topk(df, df, req, 3, id_col="key", vector_col="v", text_col="t",
                                semantic_weight=1.0, keyword_weight=0.0)
    assert keys(hybrid) == semantic
    only_keyword = search.hybrid_topk(df, df, req, 3, id_col="key", vector_col="v", text_col="t",
                                      semantic_weight=0.0, keyword_weight=1.0)
    assert keys(only_keyword) == keys(search.keyword_topk(df, req, 3, id_col="key", text_col="t"))
    row = hybrid.filter("rank = 1").first()
    assert row["hybrid_score"] == pytest.approx(row["semantic_score"])


def test_lookup(spark):
    codes = spark.createDataFrame([("A", "x"), ("B", None)], "code string, description string")
    asked = spark.createDataFrame([(1, "A"), (2, "C"), (3, "B")], "qid int, code string")
    got = {r["qid"]: (r["description"], r["found"]) for r in
           search.lookup_codes(codes, asked, ["code"]).collect()}
    assert got == {1: ("x", True), 2: (None, False), 3: (None, True)}


# --- codes and years -----------------------------------------------------------------------

def test_icd10cm_lines(spark):
    lines = ["# comment", "", "A00.0\tCholera\textra", "A00.1   Typhoid  fever ", " b20  HIV ",
             "A00.0\tSecond", "INVALID text", "E11", "U07.1 covid", "E119 undotted", "C50.1 x\ty"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")
    rows = normalize.dedupe_codes(normalize.parse_icd10cm_lines(df), [F.asc("line_no")])
    got = {r["code"]: (r["description"], r["category"], r["is_billable"]) for r in rows.collect()}
    assert got == {"A00.0": ("Cholera", "A00", True), "A00.1": ("Typhoid  fever", "A00", True),
                   "B20": ("HIV", "B20", False)}
    dotless = normalize.parse_icd10cm_lines(df, dotless=True)
    assert "E11.9" in {r["code"] for r in dotless.collect()}
    order = spark.createDataFrame([(0, "00001 A000 1 Cholera short")], "line_no int, line string")
    row = normalize.parse_icd10cm_lines(order, dotless=True, code_position=1).first()
    assert row["code"] == "A00.0" and row["description"].startswith("1")


def test_pcs_and_cpt_rows(spark):
    pcs = spark.createDataFrame([(0, "0DBJ8ZZ Excision"), (1, "0DBIO8Z bad"), (2, "short x"),
                                 (3, "0dbj8zz later"), (4, "0BH17EZ")], "line_no int, line string")
    row, = normalize.dedupe_codes(normalize.parse_icd10pcs_lines(pcs), [F.asc("line_no")]).collect()
    assert (row["code"], row["description"], row["section"], row["body_system"]) == (
        "0DBJ8ZZ", "Excision", "0", "D")
    cells = [("99213", "visit"), (" a-1234 ", " drug "), ("0042T", "x"), ("HCPCS", "x"), ("nan", "x"),
             (None, "x"), ("00009", "low"), ("123", "x"), ("B1234", None)]
    df = spark.createDataFrame(cells, "raw_code string, description string")
    got = {(r["code"], r["description"], r["code_type"]) for r in normalize.parse_cpt_rows(df).collect()}
    assert got == {("99213", "visit", "cpt"), ("A1234", "drug", "hcpcs"), ("B1234", None, "hcpcs")}
    counts = normalize.cpt_row_counts(df.withColumn("file", F.lit("f")), ["file"]).first()
    assert (counts["parsed"], counts["skipped"]) == (3, 6)
    kinds = df.select(normalize.classify_cpt_code(normalize.clean_cpt_code(F.col("raw_code"))).alias("k"))
    assert [r["k"] for r in kinds.collect()] == ["cpt", "hcpcs", None, None, None, None, None, None, "hcpcs"]


def test_sheets(spark):
    sheet = [["Title"], ["Annual", None], ["Seq", "Procedure Code", "Long Description"],
             ["10021", "J0120", "injection"], ["10022", "99213", None], ["x", "bad", "y"]]
    plain = [["CPT", "Descr"], ["n/a", "x"], ["99214", "y"]]
    headless = [["Unnamed: 0", "unnamed"], ["99213", "z"], ["99215", "w"]]
    rows = [(f, i, c) for f, s in (("a", sheet), ("b", plain), ("c", headless)) for i, c in enumerate(s)]
    df = spark.createDataFrame(rows, "file string, row_no int, cells array<string>")
    headers = {r["file"]: r["header_row"] for r in normalize.detect_header_rows(df).collect()}
    assert headers == {"a": 2, "b": 1, "c": 1}   # the first row followed by a code
    got = {(r["file"], r["code"], r["description"]) for r in normalize.read_sheet_codes(df).collect()}
    # A header with "procedure code" names both columns.
    assert got == {("a", "J0120", "J0120"), ("a", "99213", "99213"), ("b", "99214", "y"),
                   ("c", "99215", "w")}
    by_data = {r["file"]: r["code_col"] for r in normalize.detect_code_column_by_data(df).collect()}
    assert by_data["c"] == 0
    header = spark.createDataFrame([(["Seq", "Procedure Code", "Note"],), (["a"],), ([],)], "h array<string>")
    assert [tuple(r["c"]) for r in header.select(normalize.detect_columns(F.col("h")).alias("c")).collect()] == [
        (1, 1), (0, None), (None, None)]


YEARS = [("cpt", 2023, "A"), ("cpt", 2023, "B"), ("cpt", 2024, "B"), ("cpt", 2024, "C"), ("cpt", 2024, "C"),
         ("icd10cm", 2023, "X"), ("cpt", 2026, "B")]


def test_years(spark):
    df = spark.createDataFrame(YEARS, "code_type string, year int, code string")
    rows = {r["code_type"]: r.asDict() for r in years.comparison_report(df, 2023, 2024).collect()}
    cpt = rows["cpt"]
    assert (cpt["year1_total"], cpt["year2_total"], cpt["added_in_year2"], cpt["removed_from_year1"],
            cpt["common_codes"], cpt["error"]) == (2, 2, 1, 1, 1, None)
    assert (cpt["added_codes"], cpt["removed_codes"]) == (["C"], ["A"])
    assert rows["icd10cm"]["error"] == "One or both years not available"
    assert rows["icd10cm"]["year1_total"] is None
    back = {r["code_type"]: r for r in years.compare_years(df, 2024, 2023).collect()}["cpt"]
    assert (back["added_in_year2"], back["removed_from_year1"]) == (1, 1)
    pair, = years.compare_consecutive_years(df).collect()
    assert (pair["year1"], pair["year2"], pair["added_in_year2"], pair["common_codes"]) == (2023, 2024, 1, 1)
    flags = {r["year"]: r for r in years.history_flags(df).filter("code = 'B'").collect()}
    assert {y: (r["first_year"], r["last_year"], r["gap_before"]) for y, r in flags.items()} == {
        2023: (2023, 2026, 0), 2024: (2023, 2026, 0), 2026: (2023, 2026, 1)}
    assert years.code_history(df, [F.asc("code")], "B", "cpt").count() == 3
    grid = {(r["code_type"], r["year"]): r["total_codes"] for r in
            years.availability(df, years.ALL_YEARS).collect()}
    assert grid[("cpt", 2024)] == 3 and grid[("icd10cm", 2022)] == 0 and len(grid) == 8


def test_any_year_and_none(spark):
    df = spark.createDataFrame([("t", 1985, "a"), ("t", 1986, "a"), ("t", 2060, "a"), ("t", None, "a"), ("u", None, "b")],
                               "code_type string, year int, code string")
    pair, = years.compare_consecutive_years(df).collect()
    assert (pair["year1"], pair["common_codes"]) == (1985, 1)
    assert sorted((r["year"], r["gap_before"]) for r in years.history_flags(df).collect()) == [
        (1985, 0), (1986, 0), (2060, 73)]
    grid = {(r["code_type"], r["year"]): r["total_codes"] for r in years.availability(df, [1985, 2061]).collect()}
    assert grid == {("t", 1985): 1, ("t", 2061): 0, ("u", 1985): 0, ("u", 2061): 0}


def test_consecutive_years_at_the_edge_of_the_mask(spark):
    df = spark.createDataFrame([("t", 2051, "a"), ("t", 2052, "a"), ("t", 1990, "b"), ("t", 1991, "c")],
                               "code_type string, year int, code string")
    got = {r["year1"]: (r["added_in_year2"], r["removed_from_year1"], r["common_codes"])
           for r in years.compare_consecutive_years(df).collect()}
    assert got == {2051: (0, 0, 1), 1990: (1, 1, 0)}


# --- chunks and embeddings -----------------------------------------------------------------

@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=200), st.integers(1, 30), st.data())
def test_spans_cover_the_text(text, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    spans = chunk.split_spans(text, size, overlap)
    assert bool(spans) == bool(text)
    position = 0
    for i, (start, end) in enumerate(spans):
        assert start <= position < end and end - start <= size and position - start <= overlap
        assert i == 0 or start > spans[i - 1][0]
        position = end
    assert position == len(text)


def test_spans_prefer_separators():
    def cut(text, size=10, overlap=0):
        return [text[a:b] for a, b in chunk.split_spans(text, size, overlap)]

    assert cut("aaaa\n\nbb\nccccccccc") == ["aaaa\n\n", "bb\n", "ccccccccc"]
    assert cut("one two three") == ["one two ", "three"]
    assert cut("x" * 25) == ["x" * 10, "x" * 10, "x" * 5]
    assert cut("ab cd ef gh ij", 6, 3) == ["ab cd ", "cd ef ", "ef gh ", "gh ij"]


@pytest.mark.parametrize("size, overlap", [(10, 3), (7, 6), (5, 0), (1000, 200)])
def test_fixed_chunks(spark, size, overlap):
    texts = ["é" * n + "\n😀" for n in (0, 1, 4, 8, 30, 2500)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {(r["i"], r["chunk_index"]): (r["chunk"], r["total_chunks"], r["start_index"])
           for r in chunk.chunk_fixed(df, size=size, overlap=overlap).collect()}
    step, want = size - overlap, {}
    for i, text in enumerate(texts):
        if text:
            starts = [0]
            while starts[-1] + size < len(text):
                starts.append(starts[-1] + step)
            want |= {(i, n): (text[s:s + size], len(starts), s) for n, s in enumerate(starts)}
    assert got == want
    with pytest.raises(ValueError):
        chunk.chunk_fixed(df, size=5, overlap=5)


def test_chunk_metadata_and_dedupe(spark):
    df = spark.createDataFrame([("/raw/cpt/x_2024/a.pdf", 2048, "cpt", 2024, "same text", "i"),
                                ("/raw/cpt/x_2024/a.xml", 100, "cpt", 2024, "same text", "ii")],
                               "path string, length long, code_type string, year int, text string, page_label string")
    rows = chunk.chunk_metadata(chunk.chunk_fixed(df), root="/raw/").orderBy("path").collect()
    assert [r["id"] for r in rows] == ["cpt_2024_cpt/x_2024/a.pdf_chunk_0", "cpt_2024_cpt/x_2024/a.xml_chunk_0"]
    assert [r["page_label"] for r in rows] == ["i", None]
    assert rows[0]["file_size_kb"] == 2.0 and rows[0]["cms_category"] == "CPT"
    assert rows[0]["chunk_id"] == rows[1]["chunk_id"] and len(rows[0]["chunk_id"]) == 16
    unique = chunk.dedupe_chunks(chunk.chunk_metadata(chunk.chunk_fixed(df)), [F.asc("path")])
    assert [r["file_type"] for r in unique.collect()] == ["pdf"]


def test_every_response_of_a_kind_is_kept(spark):
    rows = spark.createDataFrame(
        [(1, 2, "diagnoses", '{"diagnoses": [{"condition": "b"}]}', 5), (1, 1, "diagnoses", '{"diagnoses": [{"condition": "c"}]}', 6),
         (1, 1, "procedures", '{"procedures": [{"procedure_name": "p"}]}', 7), (2, 1, "procedures", "no json", 8)],
        "doc int, part int, kind string, content string, total_tokens long")
    got = {r["doc"]: r for r in extract.combine_extractions(extract.parse_entities(rows), "doc", "part").collect()}
    assert [d["condition"] for d in got[1]["diagnoses"]] == ["c", "b"] and got[1]["tokens_used"] == 18
    assert (got[1]["n_total"], got[2]["n_total"], got[2]["success"]) == (3, 0, False)


def test_retry():
    calls, pauses = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("not yet")
        return "Success!"

    assert embed.with_retry(flaky, 5, 1.0, 2.0, pauses.append)() == "Success!"
    assert len(calls) == 3 and pauses == [1.0, 2.0]
    with pytest.raises(RuntimeError):
        embed.with_retry(lambda: (_ for _ in ()).throw(RuntimeError("no")), 2, 0, 1, pauses.append)()


def test_embed_batches(spark):
    def embedder(texts):
        if any("bad" in text for text in texts):
            raise ValueError("refused")
        return np.array([[len(text), 1.0] for text in texts])

    df = spark.createDataFrame([(i, "bad" if i == 3 else "x" * i) for i in range(1, 6)], "i int, t string").coalesce(1)
    rows = {r["i"]: (r["embedding"], r["embed_error"]) for r in embed.embed_batches(
        df, embedder, "t", batch_size=2, attempts=2, delay=0.0).collect()}
    assert rows[1] == ([1.0, 1.0], None) and rows[5][0] == [5.0, 1.0]
    assert rows[3] == (None, "ValueError: refused") == rows[4]


def test_entries(spark):
    df = spark.createDataFrame([("J0120", "x", "cpt", "hcpcs", 2024, True), ("99213", None, "cpt", "cpt", 2024, None)],
                               "code string, description string, collection_type string, code_type string, year int, flag boolean")
    one, two = embed.code_entries(df, ["code_type", "flag"]).orderBy(F.desc("code")).collect()
    assert (one["id"], one["document"], one["collection"]) == (
        "cpt_2024_J0120", "J0120: x [cpt]", "medical_codes_cpt_2024")
    assert one["metadata"] == {"code": "J0120", "description": "x", "code_type": "hcpcs", "year": "2024", "flag": "True"}
    assert two["document"] == "99213:  [cpt]" and "flag" not in two["metadata"]


# --- extraction and reports ------------------------------------------------------------------

def fake_model(messages):
    prompt = messages[-1]["content"]
    if "boom" in prompt:
        raise RuntimeError("down")
    kind = "diagnoses" if "diagnosis" in prompt else "procedures"
    name = "condition" if kind == "diagnoses" else "procedure_name"
    body = "sorry" if "unclear" in prompt else '```json\n{"%s": [{"%s": "x"}]}\n```' % (kind, name)
    return {"content": body, "role": "assistant", "finish_reason": "stop", "model": "stub",
            "usage": {"prompt_tokens": 1, "completion_tokens": 2, "total_tokens": 3}}


def test_extraction(spark):
    from codeset_engine.plans import jobs
    docs = spark.createDataFrame([(1, "fever", "all"), (2, "fever", "diagnoses"), (3, "", "all"), (4, "unclear", "procedures"),
                                  (5, "boom", "diagnoses"), (6, None, None), (7, "fever", None)],
                                 "doc_id long, document_text string, extract_type string")
    import codeset_engine.operators.extract as module
    original, module.INITIAL_DELAY = module.INITIAL_DELAY, 0.0
    try:
        rows = {r["doc_id"]: r for r in jobs.extract_entities(docs, fake_model).collect()}
    finally:
        module.INITIAL_DELAY = original
    assert (rows[1]["success"], rows[1]["n_diagnoses"], rows[1]["n_procedures"], rows[1]["tokens_used"]) == (True, 1, 1, 6)
    assert rows[1]["diagnoses"][0]["condition"] == "x" and rows[1]["procedures"][0]["procedure_name"] == "x"
    assert (rows[2]["n_total"], rows[2]["tokens_used"]) == (1, 3) and rows[7]["n_total"] == 2
    assert rows[3]["error"] == rows[6]["error"] == extract.NO_TEXT
    for i in (4, 5):
        assert (rows[i]["success"], rows[i]["n_total"], rows[i]["error"]) == (False, 0, extract.NOT_PARSED)


def test_call_record(spark):
    df = spark.createDataFrame([([("user", "diagnosis")],)], "messages array<struct<role string, content string>>")
    row = extract.call_model(df, fake_model, "messages", delay=0.0).first()
    assert row["ok"] and row["response"]["usage"]["total_tokens"] == 3 and row["response"]["duration"] >= 0


def test_usage_stats_without_success(spark):
    calls = spark.createDataFrame([("a", True, 10, 1.0), ("a", True, 20, 3.0), ("a", False, 5, 9.0), ("b", False, 1, 1.0)],
                                  "agent string, ok boolean, total_tokens long, duration double")
    rows = {r["agent"]: r for r in extract.usage_stats(calls).collect()}
    assert (rows["a"]["total_tokens"], rows["a"]["avg_tokens_per_call"], rows["a"]["avg_time_per_call"]) == (30, 15.0, 2.0)
    assert (rows["b"]["failed_calls"], rows["b"]["avg_time_per_call"], rows["b"]["avg_tokens_per_call"]) == (1, 0.0, 0.0)


def test_rerank(spark):
    candidates = spark.createDataFrame([(1, f"K64.{i}") for i in range(7)], "qid int, code string")
    scores = spark.createDataFrame([(1, f"K64.{i}", [0.5, 0.9, 0.9, 0.1, 0.2, 0.3][i]) for i in range(6)],
                                   "qid int, code string, relevance_score double")
    got = [r["code"] for r in ranking.apply_rerank(candidates, scores, ["qid"]).orderBy("new_rank").collect()]
    assert got == ["K64.1", "K64.2", "K64.0", "K64.5", "K64.4"]


def test_step_summary(spark):
    log = spark.createDataFrame([("embed", True, 5), ("embed", False, None), ("fetch", True, None)],
                                "step string, ok boolean, embedded_count long")
    rows = {r["step"]: tuple(r)[1:] for r in reports.step_summary(log).collect()}
    assert rows == {"embed": (1, 2, 5, False), "fetch": (1, 1, 0, True)}
