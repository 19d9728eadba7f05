"""Files, stored tables, archives, links, jobs and streams in temporary folders."""

import datetime as dt
import io
import json
import sys
import uuid
import zipfile

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from codeset_engine import schemas, session
from codeset_engine.operators import normalize, years
from codeset_engine.plans import jobs
from codeset_engine.sources import code_files, documents, links, listing, tables
from codeset_engine.streaming import logs

cloudpickle.register_pickle_by_value(sys.modules[__name__])   # fakes defined here run in workers


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return path


@pytest.fixture
def raw(tmp_path):
    root = tmp_path / "raw"
    cm = root / "icd10cm"
    write(cm / "icd10cm_code_tables_2024" / "icd10cm_codes_2024.txt", "Z99.9 not chosen\n")
    chosen = cm / "icd10cm_code_descriptions_2024"
    write(chosen / "readme.txt", "x" * 5000)
    write(chosen / "sub" / "icd10cm_codes_2024.txt",
          b"# c\nA00.0\tCholera\textra\nA00.1  Ty\xff\xfephoid\nbad line\nA00.0 again\nE11 Diabetes\n")
    write(chosen / "icd10cm_codes_small.txt", "B20 HIV\n")
    write(root / "icd10pcs" / "icd10pcs_codes_2024" / "icd10pcs_order_2024.txt", "0DBJ8ZZ Excision of appendix\n")
    rows = ["Annual list,,", ",,", "HCPCS Code,Long Description,Other", '99213,"Visit, office",x', "J0120,Injection,",
            "99213,Second,", "zz,skip,"]
    write(root / "cpt" / "cpt_hcpcs_codes_2024" / "list.csv", "\n".join(rows))
    write(root / "cpt" / "cpt_hcpcs_codes_2024" / "notes.txt", "text")
    return root


def test_discovery(spark, raw):
    files = listing.with_source_parts(listing.list_files(spark, str(raw)))
    dirs = {(r["code_type"], r["source"]) for r in listing.resolve_source_dirs(files).collect()}
    assert dirs == {("icd10cm", "icd10cm_code_descriptions"), ("icd10pcs", "icd10pcs_codes"),
                    ("cpt", "cpt_hcpcs_codes")}
    found = {r["code_type"]: r["path"] for r in listing.code_files(listing.list_files(spark, str(raw))).collect()}
    assert found["icd10cm"].endswith("sub/icd10cm_codes_2024.txt")   # best pattern, then largest
    assert found["cpt"].endswith("list.csv") and found["icd10pcs"].endswith("icd10pcs_order_2024.txt")


def test_manifest(spark, raw):
    files = listing.list_files(spark, str(raw))
    base = f"file:{raw}/cpt"
    asked = spark.createDataFrame([(f"{base}/cpt_hcpcs_codes_2024/list.csv",), (base,), (f"{base}/none.csv",)], "path string")
    got = {r["path"]: r["error"] for r in listing.validate_manifest(asked, files).collect()}
    assert list(got[p] for p in (f"{base}/cpt_hcpcs_codes_2024/list.csv", base, f"{base}/none.csv")) == [
        None, f"Path is not a file: {base}", f"File does not exist: {base}/none.csv"]


def test_line_order_across_splits(spark, tmp_path):
    lines = [f"line {i:05d}" for i in range(20000)]
    for name in ("a", "b"):
        write(tmp_path / f"{name}.txt", "\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = code_files.read_lines(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 4
        got = [r["line"] for r in df.orderBy(*code_files.LINE_ORDER).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == lines + lines


def test_normalize_store_load(spark, raw, tmp_path):
    out = str(tmp_path / "codes")
    cm = {r["code"]: r["description"] for r in jobs.normalize_codes(spark, str(raw), "icd10cm", 2024, out).collect()}
    assert cm == {"A00.0": "Cholera", "A00.1": "Typhoid", "E11": "Diabetes"}
    cpt = jobs.normalize_codes(spark, str(raw), "cpt", 2024, out)
    assert {(r["code"], r["description"], r["code_type"]) for r in cpt.collect()} == {
        ("99213", "Visit, office", "cpt"), ("J0120", "Injection", "hcpcs")}
    assert jobs.normalize_codes(spark, str(raw), "icd10pcs", 2024, out).first()["section"] == "0"
    assert jobs.normalize_codes(spark, str(raw), "cpt", 2023, out) is None
    # a second run replaces its own partition and no other
    jobs.normalize_codes(spark, str(raw), "cpt", 2024, out)
    assert tables.load_codes(spark, out).count() == 6
    pruned = tables.load_codes(spark, out, "cpt", 2024)
    assert "PartitionFilters: [isnotnull(collection_type" in pruned._jdf.queryExecution().executedPlan().toString()
    assert tables.load_codes(spark, str(tmp_path / "none")).count() == 0
    tables.write_codes(tables.load_codes(spark, out).limit(0), out)
    assert tables.load_codes(spark, out).count() == 6

    codes = tables.load_codes(spark, out).withColumn("code_type", F.col("collection_type"))
    metadata = years.year_metadata(codes, tables.stored_files(spark, out), [2024, 2023])
    rows = {(r["code_type"], r["year"]): r for r in metadata.collect()}
    assert rows[("icd10cm", 2024)]["total_codes"] == 3 and rows[("icd10cm", 2024)]["file_size"] > 0
    assert rows[("cpt", 2024)]["columns"] == ["code", "description", "code_type"]
    assert rows[("cpt", 2023)]["columns"] is None
    assert rows[("cpt", 2023)]["exists"] is False and rows[("cpt", 2023)]["last_updated"] is None
    lines = {r["line"] for r in years.summary_lines(metadata, 2024).filter("code_type = 'CPT'").collect()}
    assert "  ✗ 2023: Not available" in lines and any(x.startswith("  ✓ 2024 (CURRENT): 2 codes | 0.00 MB") for x in lines)

    csv = str(tmp_path / "csv")
    tables.export_rows(tables.load_codes(spark, out, "cpt", 2024).select(*schemas.CPT.names), csv)
    back = tables.read_codes_csv(spark, csv, "cpt", 2024)
    assert {r["code"] for r in back.collect()} == {"99213", "J0120"} and back.schema.names == schemas.CODES.names
    with pytest.raises(ValueError):
        tables.export_rows(back, csv, "pdf")


def test_spreadsheets_need_a_decoder(spark):
    with pytest.raises(ValueError, match="decoder"):
        jobs.parse_code_file(spark, "x.xlsx", "cpt")


def fake_embedder(texts):
    if any("Injection" in t for t in texts):
        raise ValueError("quota")
    return np.array([[float(len(t)), 1.0] for t in texts])


def test_collections(spark, raw, tmp_path, monkeypatch):
    from codeset_engine.operators import embed
    out, store = str(tmp_path / "codes"), str(tmp_path / "collections")
    for kind in ("icd10cm", "cpt"):
        jobs.normalize_codes(spark, str(raw), kind, 2024, out)
    assert jobs.embed_codes(spark, out, store, "icd10cm", 2024) == {"written": 3, "known": 0, "failed": 0}
    again = jobs.embed_codes(spark, out, store, "icd10cm", 2024)
    assert again["written"] == 0 and tables.read_collections(spark, store).count() == 3
    forced = jobs.embed_codes(spark, out, store, "icd10cm", 2024, force=True, dimension=16)
    assert forced["written"] == 3
    entries = tables.read_collections(spark, store)
    assert entries.count() == 3 and entries.select(F.size("embedding")).distinct().first()[0] == 16

    monkeypatch.setattr(embed.embed_batches, "__defaults__", ("embedding", 1, 1, 0.0))   # one text per call
    partial = jobs.embed_codes(spark, out, store, "cpt", 2024, embedder=fake_embedder)
    assert partial == {"written": 1, "known": 0, "failed": 1}
    assert spark.read.parquet(f"{store}-errors").first()["embed_error"] == "ValueError: quota"
    repaired = jobs.embed_codes(spark, out, store, "cpt", 2024,
                                embedder=lambda texts: np.ones((len(texts), 2)))
    assert repaired["written"] == 1

    entries = tables.read_collections(spark, store)
    counts = {r["collection"]: r["count"] for r in tables.collection_counts(entries).collect()}
    assert counts == {"medical_codes_icd10cm_2024": 3, "medical_codes_cpt_2024": 2}
    asked = spark.createDataFrame([("medical_codes_cpt_2024",), ("x",)], "collection string")
    assert {(r["collection"], r["exists"], r["count"]) for r in tables.collection_exists(entries, asked).collect()} == {
        ("medical_codes_cpt_2024", True, 2), ("x", False, 0)}
    stats = spark.createDataFrame([("cpt", 2024), ("cpt", 2023)], "code_type string, year int")
    assert {(r["year"], r["collection"], r["exists"], r["count"]) for r in tables.collection_stats(entries, stats).collect()} == {
        (2024, "medical_codes_cpt_2024", True, 2), (2023, "medical_codes_cpt_2023", False, 0)}
    assert tables.delete_collection(spark, store, "medical_codes_cpt_2024")
    assert not tables.delete_collection(spark, store, "medical_codes_cpt_2024")
    assert tables.read_collections(spark, store).count() == 3


def test_search_job(spark, raw, tmp_path):
    from codeset_engine.operators import embed
    out, store = str(tmp_path / "codes"), str(tmp_path / "collections")
    jobs.normalize_codes(spark, str(raw), "icd10cm", 2024, out)
    jobs.embed_codes(spark, out, store, "icd10cm", 2024, dimension=64)
    requests = embed.hashing_embed(spark.createDataFrame([(1, "diabetes")], "qid int, query string"),
                                   "query", 64, "vector")
    entries = tables.read_collections(spark, store)
    top = jobs.search_codes(entries, requests, "icd10cm", 2024, k=1).first()
    assert top["code"] == "E11" and top["metadata"]["category"] == "E11" and top["keyword_score"] > 0
    assert jobs.search_codes(entries, requests, "cpt", 2024).count() == 0
    filtered = jobs.search_codes(entries, requests, "icd10cm", 2024, hybrid=False,
                                 where=F.col("metadata")["category"] == "A00")
    assert {r["code"] for r in filtered.collect()} == {"A00.0", "A00.1"}
    everywhere = jobs.search_all_types(entries, requests, 2024, k=2)
    assert [r["collection_type"] for r in everywhere.collect()] == ["icd10cm"] * 2


def test_documents_to_chunks(spark, tmp_path):
    root = tmp_path / "raw"
    folder = root / "cpt" / "cpt_hcpcs_codes_2024"
    write(folder / "a.txt", "word " * 500)
    write(folder / "same.txt", "word " * 500)
    write(folder / "b.xml", "<?xml version='1.0'?><r><!-- c --><a>Hello</a> <b>World</b></r>")
    write(folder / "c.pdf", "page one|page two")
    write(folder / "d.txt", b"\xff\xfe bad")
    write(folder / "e.xsd", "<x/>")
    write(folder / "deep" / "f.txt", "not scanned")
    write(root / "cpt" / "cpt_hcpcs_codes_2023" / "old.txt", "other year")

    def decode(content):
        return [{"text": t, "page_number": i, "total_pages": 2} for i, t in enumerate(content.decode().split("|"))]

    def names(df):
        return {(r["path"].rsplit("/", 1)[1], r["text"] and r["text"][:11], r["load_error"]) for r in df.collect()}

    plain = names(documents.scan_documents(spark, str(root), "cpt", 2024))
    assert ("c.pdf", None, "Unsupported file type: .pdf") in plain and ("d.txt", None, "not UTF-8") in plain
    assert ("b.xml", "Hello World", None) in plain and len(plain) == 5
    docs = documents.scan_documents(spark, str(root), "cpt", 2024, {".pdf": decode})
    assert {("c.pdf", "page one", None), ("c.pdf", "page two", None)} <= names(docs)
    assert len(names(documents.scan_documents(spark, str(root), "cpt", 2024, include_xsd=True))) == 6

    store = str(tmp_path / "docs")
    first = jobs.embed_documents(spark, str(root), store, "cpt", 2024, {".pdf": decode})
    entries = tables.read_collections(spark, store)
    assert first["failed"] == 0 and entries.count() == first["written"] == entries.select("id").distinct().count()
    second = entries.filter("document = 'page two'").first()
    assert second["id"].endswith("c.pdf_chunk_1") and second["metadata"]["page_number"] == "1"
    assert second["metadata"]["total_chunks"] == "2" and second["metadata"]["has_previous_chunk"] == "True"
    copies = entries.groupBy(F.col("metadata")["source_file"].alias("f")).count().collect()
    counts = {r["f"]: r["count"] for r in copies}
    assert counts["same.txt"] == counts["a.txt"] > 1   # every file keeps its chunks
    unique = jobs.chunk_documents(documents.scan_documents(spark, str(root), "cpt", 2024), str(root), dedupe=True)
    assert unique.filter("source_file = 'same.txt'").count() == 0 < unique.filter("source_file = 'a.txt'").count()
    assert jobs.embed_documents(spark, str(root), store, "cpt", 2024, {".pdf": decode})["written"] == 0


def test_jobs_read_no_other_year_or_collection(spark, tmp_path):
    root = tmp_path / "raw"
    write(root / "cpt" / "cpt_hcpcs_codes_2024" / "a.txt", "hello")
    for year in (2023, 2025):
        write(root / "cpt" / f"cpt_hcpcs_codes_{year}" / "b.txt", "other")
    docs = documents.scan_documents(spark, str(root), "cpt", 2024)
    assert [f.rsplit("/", 1)[1] for f in docs.inputFiles()] == ["a.txt"]
    assert documents.scan_documents(spark, str(root), "cpt", 1999).count() == 0
    store = str(tmp_path / "store")
    jobs.embed_documents(spark, str(root), store, "cpt", 2024)
    jobs.embed_documents(spark, str(root), store, "cpt", 2025)
    requests = spark.createDataFrame([(1, "hello", [1.0] * 256)], "qid int, query string, vector array<double>")
    hits = jobs.search_codes(tables.read_collections(spark, store), requests, "cpt", 2024, hybrid=False)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in plan and hits.count() == 1
    assert jobs.search_all_types(tables.read_collections(spark, store), requests, 2025).count() == 1


def test_spreadsheets_through_a_decoder(spark, tmp_path):
    folder = tmp_path / "raw" / "cpt" / "cpt_hcpcs_codes_2024"
    write(folder / "codes.xlsx", "title\nHCPCS|Description\nA1234|from sheet\n99213|visit")
    write(folder / "codes.csv", "HCPCS,Description\nB1234,from csv\n")
    decoders = {".xlsx": lambda content: [line.split("|") for line in content.decode().split("\n")]}
    out = str(tmp_path / "codes")
    plain = jobs.normalize_codes(spark, str(tmp_path / "raw"), "cpt", 2024, out)
    assert [r["code"] for r in plain.collect()] == ["B1234"]
    sheet = jobs.normalize_codes(spark, str(tmp_path / "raw"), "cpt", 2024, out, decoders)
    assert {r["code"]: r["description"] for r in sheet.collect()} == {"A1234": "from sheet", "99213": "visit"}
    write(folder / "codes.csv", "HCPCS,Description\n")
    assert jobs.normalize_codes(spark, str(tmp_path / "raw"), "cpt", 2024, out) is None


def test_fixed_addresses():
    """The fixed values that the SQL checks share with the code, as plain literals."""
    assert links.PREDEFINED[("cpt_hcpcs_codes", 2024)] == (
        "/files/zip/updated-list-codes-effective-january-1-2024-published-march-1-2024-all-codes-effective-january-1-2024-unless-otherwise-indicated-code-list.zip")
    assert links.PREDEFINED[("cpt_hcpcs_codes", 2025)] == "/files/zip/list-codes-effective-january-1-2025-published-november-26-2024.zip"
    assert links.FALLBACK_SLUGS["icd10cm_code_tables"] == "{year}-code-tables-tabular-and-index.zip"
    assert links.LINK_FORMS["icd10pcs_codes"] == r"(?i)/files/zip/([0-9]{4})-icd-10-pcs-codes-file\.zip$"


def test_archives(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        archive.writestr("dir/a.txt", "alpha")
        archive.writestr("b.txt", "beta")
    write(tmp_path / "good.zip", buffer.getvalue())
    write(tmp_path / "bad.zip", b"no archive")
    members = documents.read_archives(spark, str(tmp_path))
    got = {r["member"]: bytes(r["content"]) for r in members.filter("error IS NULL").collect()}
    assert got == {"dir/a.txt": b"alpha", "b.txt": b"beta"}
    status = {r["archive"].rsplit("/", 1)[1]: (r["members"], r["ok"]) for r in documents.expand_status(members).collect()}
    assert status == {"good.zip": (2, True), "bad.zip": (0, False)}


def test_links(spark):
    html = ('<a class="x" href="/files/zip/2025-code-tables-tabular-and-index.zip">a</a> <A HREF=\'files/zip/b.zip\'>b</A>'
            '<a href="https://other.org/files/c.zip">c</a><a href="/files/d.pdf">d</a><a href="//cdn.org/files/e.zip">'
            '<a data-href="/files/no.zip"><area href="/files/no2.zip"><a href="../files/f.zip"><a href=/files/g.zip>'
            '<!-- <a href="/files/no3.zip"> --><script>"<a href=/files/no4.zip>"</script>'
            '<a href="/files/h&#45;&#x69;&amp;.zip"><a href="/other/h.zip"><a href="/files/zip/2025-code-tables-tabular-and-index.zip">again</a>')
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id int, html string")
    urls = [r["url"] for r in links.extract_links(pages).collect()]
    assert urls == sorted(["https://www.cms.gov/files/zip/2025-code-tables-tabular-and-index.zip", "https://other.org/files/c.zip", "https://cdn.org/files/e.zip", "https://www.cms.gov/files/f.zip",
                           "https://www.cms.gov/files/g.zip", "https://www.cms.gov/files/h-i&.zip"])
    asked = spark.createDataFrame([("all", 2025), ("icd10cm_poa", 2025), ("x", 2025)], "code_type string, year int")
    requests = links.expand_type_groups(asked, ["year"])
    assert requests.count() == 7
    resolved = {r["code_type"]: (r["url"], r["origin"]) for r in links.resolve_download_urls(
        requests, links.page_links(pages)).collect()}
    assert resolved["icd10cm_code_tables"] == (
        "https://www.cms.gov/files/zip/2025-code-tables-tabular-and-index.zip", "scraped")
    assert resolved["icd10cm_poa"] == ("https://www.cms.gov/files/zip/2025-poa-exempt-codes.zip", "fallback")
    assert resolved["cpt_hcpcs_codes"][1] == "predefined" and resolved["x"] == (None, "none")
    missing = spark.createDataFrame([("cpt_hcpcs_codes", 2019)], "code_type string, year int")
    assert links.resolve_download_urls(missing, links.page_links(pages)).first()["origin"] == "none"
    paths = links.download_paths(requests).filter("code_type = 'icd10pcs_order'").first()
    assert (paths["family"], paths["zip_path"]) == ("icd10pcs", "icd10pcs/icd10pcs_order_2025.zip")


# --- streams -------------------------------------------------------------------------------

def run(writer):
    query = writer.start()
    query.awaitTermination(120)
    assert query.exception() is None


def test_redaction_stream_equals_batch(spark, tmp_path):
    lines = ["SSN 123-45-6789", "call 555-123-4567", "MRN: 987654 mrn: 1", "plain"]
    for i, line in enumerate(lines):
        write(tmp_path / "in" / f"{i}.log", line)
    stream = logs.redact_stream(spark.readStream.text(str(tmp_path / "in")))
    run(logs.to_files(stream, str(tmp_path / "out"), f"redact-{uuid.uuid4().hex}"))
    batch = logs.redact_stream(spark.read.text(str(tmp_path / "in")))
    got = sorted(r["value"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(r["value"] for r in batch.collect())
    assert "[REDACTED-MRN] mrn: 1" in got


def test_audit_log_round_trip_and_stream(spark, tmp_path):
    path = str(tmp_path / "audit")
    events = spark.createDataFrame([(dt.datetime(2025, 1, 1), "INFO", "m", "f", 3, "msg", "u", "code_validation", None)],
                                   schemas.AUDIT_EVENT)
    logs.append_audit_log(events, path)
    logs.append_audit_log(events, path)
    assert logs.read_audit_log(spark, path).collect() == events.collect() * 2
    line = spark.read.text(path).first()["value"]
    assert set(json.loads(line)) == set(schemas.AUDIT_EVENT.names)
    run(logs.to_files(logs.read_audit_stream(spark, path), str(tmp_path / "out"), f"audit-{uuid.uuid4().hex}"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_duration_windows_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(
        F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("operation"), F.col("value").alias("duration"))
    source = str(tmp_path / "in")
    events.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    run(logs.to_files(logs.duration_windows(stream), str(tmp_path / "out"), f"windows-{uuid.uuid4().hex}"))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = logs.duration_windows(events)
    latest = events.agg(F.max("timestamp")).first()[0] - dt.timedelta(minutes=10)
    closed = want.filter(F.col("window_start") + F.expr("INTERVAL 60 SECONDS") <= F.lit(latest))
    assert got.count() > 0 and got.exceptAll(closed).isEmpty() and closed.exceptAll(got).isEmpty()


def test_chunk_stream_dedupe(spark, tmp_path):
    rows = spark.createDataFrame([("a", dt.datetime(2025, 1, 1)), ("a", dt.datetime(2025, 1, 1)), ("b", dt.datetime(2025, 1, 1))],
                                 "chunk string, timestamp timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    stream = logs.dedupe_chunk_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    run(logs.to_files(stream, str(tmp_path / "out"), f"dedupe-{uuid.uuid4().hex}"))
    assert sorted(r["chunk"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


# --- session -------------------------------------------------------------------------------

def test_cut_lineage_and_small_rows(spark, tmp_path):
    assert session.rows_if_small(spark.range(3), 3) is not None
    assert session.rows_if_small(spark.range(4), 3) is None
    cut = session.cut_lineage(spark.range(5), "x")
    assert cut.count() == 5 and "Scan parquet" in cut._jdf.queryExecution().executedPlan().toString() or cut.inputFiles()
    assert all(session.checkpoint_root(spark) in f for f in cut.inputFiles())
    assert session.spread(spark.range(10, numPartitions=1)).rdd.getNumPartitions() == 8


def test_delimited_lines_of_any_width(spark, tmp_path):
    path = str(write(tmp_path / "w.csv", ",".join(f"c{i}" for i in range(72)) + '\n"a,1","b ""q"" c",,"","d \\"e\\"",,\n\n,x\n'))
    rows = [r["cells"] for r in code_files.read_delimited(spark, path).orderBy("line_id").collect()]
    assert rows == [[f"c{i}" for i in range(72)], ["a,1", 'b "q" c', None, "", 'd "e"'], [None, "x"]]
    tabs = str(write(tmp_path / "w.txt", "a\tb,c\t\td"))
    assert code_files.read_delimited(spark, tabs, sep="\t").first()["cells"] == ["a", "b,c", None, "d"]


def test_number_rows(spark, tmp_path):
    path = str(write(tmp_path / "t.csv", "\n".join(f"{i},x" for i in range(50))))
    rows = code_files.number_rows(code_files.read_delimited(spark, path), 21)
    got = {int(r["cells"][0]): r["row_no"] for r in rows.collect()}
    assert got == {i: min(i, 21) for i in range(50)}
    assert normalize.detect_header_rows(rows).first()["header_row"] == 0
