"""Archives as a data source, stored answers of paid calls, intervals and year patterns."""

import os
import io
import random
import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F, types as T

from codeset_engine.operators import memo, years
from codeset_engine.plans import jobs
from codeset_engine.sources import archives, code_files, spreadsheets, tables

CODES = "code_type string, code string, year int, description string, line int"


# ---------------------------------------------------------------- archives

@pytest.fixture
def zips(tmp_path):
    rng = random.Random(2)
    big = rng.randbytes(300_000) + b"a" * 500_000
    with zipfile.ZipFile(tmp_path / "many.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(50):
            z.writestr(f"folder/file{i}.txt", f"content {i} " * (i + 1))
        z.writestr("empty.txt", "")
        z.mkdir("nothing")
        z.writestr("big.bin", big)
        z.writestr(zipfile.ZipInfo("plain é.bin"), big)          # stored
    (tmp_path / "sub").mkdir()
    with zipfile.ZipFile(tmp_path / "sub" / "B.ZIP", "w", zipfile.ZIP_BZIP2) as z:
        z.writestr("x.txt", "other method" * 10)
    (tmp_path / "broken.zip").write_bytes(b"this is no archive")
    (tmp_path / "note.txt").write_text("not an archive")
    return tmp_path, big


def test_archives_are_read_in_ranges_of_members(spark, zips):
    path, big = zips
    rows = archives.scan_archives(spark, str(path), task_bytes=100, part_bytes=100_000)
    ranges = archives.member_ranges(str(path / "many.zip"), 100)
    assert len(ranges) > 4 and sum(len(r.members) for r in ranges) == 53
    assert rows.rdd.getNumPartitions() == len(ranges) + 2
    got = {}
    for r in rows.collect():
        got.setdefault((os.path.basename(r.archive), r.member), []).append(r)
    for i in range(50):
        assert [bytes(r.content) for r in got["many.zip", f"folder/file{i}.txt"]] == [f"content {i} ".encode() * (i + 1)]
    for name in ("big.bin", "plain é.bin"):
        parts = sorted(got["many.zip", name], key=lambda r: r.part)
        assert [r.part for r in parts] == list(range(len(parts))) and len(parts) == 8
        assert b"".join(bytes(r.content) for r in parts) == big and {r.size for r in parts} == {len(big)}
        assert max(len(r.content) for r in parts) <= 100_000
    assert [bytes(r.content) for r in got["many.zip", "empty.txt"]] == [b""]
    assert ("many.zip", "nothing/") not in got and len(got) == 55
    assert got["broken.zip", None][0].error and got["broken.zip", None][0].content is None
    assert "method 12" in got["B.ZIP", "x.txt"][0].error


def test_a_damaged_member_does_not_stop_the_others(spark, zips):
    path, big = zips
    raw = bytearray((path / "many.zip").read_bytes())
    at = raw.index(b"plain ") + 1000
    raw[at] ^= 0xFF                                  # a byte of the stored content
    (path / "many.zip").write_bytes(raw)
    rows = archives.scan_archives(spark, str(path / "many.zip"), part_bytes=100_000).collect()
    errors = [(r.member, r.error) for r in rows if r.error]
    assert errors == [("plain é.bin", "ValueError: content does not match its checksum")]
    assert sum(r.member == "big.bin" for r in rows) == 8 and len({r.member for r in rows}) == 53


def test_an_empty_folder_has_no_rows(spark, tmp_path):
    rows = archives.scan_archives(spark, str(tmp_path))
    assert rows.columns == ["archive", "member", "part", "size", "content", "error"] and rows.count() == 0


# ---------------------------------------------------------------- paid calls

def model(log, refuses=()):
    """A model that appends every call to a file, which tasks of all workers share in a test."""
    log, refuses = str(log), dict(refuses)

    def call(messages):
        asked = messages[-1]["content"]
        with open(log, "a") as f:
            f.write(asked + "\n")
        if asked in refuses:
            raise SystemExit if refuses[asked] == "dies" else ValueError("refused")
        return {"content": asked.upper(), "model": "m"}
    return call


def calls(log):
    return sorted(log.read_text().split()) if log.exists() else []


def asking(spark, words):
    rows = [(i, None if w is None else [{"role": "user", "content": w}]) for i, w in enumerate(words)]
    return spark.createDataFrame(rows, "id int, messages array<struct<role:string,content:string>>")


def test_each_distinct_input_is_called_once_over_runs(spark, tmp_path):
    store, log = str(tmp_path / "store"), tmp_path / "log"
    bad, better = model(log, {"bad": "raises"}), model(log)
    ask = lambda words, m=bad, **kw: memo.call_model_once(
        asking(spark, words), m, "messages", store, "m", attempts=1, **kw)
    got = {r.id: r for r in ask(["a", "b", "a", None, "bad", "a"]).collect()}
    assert calls(log) == ["a", "b", "bad"]
    assert [got[i].ok for i in range(6)] == [True, True, True, None, False, True]
    assert got[2].response.content == "A" and got[4].call_error == "ValueError: refused" and got[3].response is None
    got = {r.id: r for r in ask(["b", "c", "bad", "a"], better, wave=1).collect()}
    assert calls(log) == ["a", "b", "bad", "bad", "c"]       # only what was new or had failed
    assert [got[i].response.content for i in range(4)] == ["B", "C", "BAD", "A"]
    assert memo.call_model_once(asking(spark, ["a"]), better, "messages", store, "other", attempts=1).first().ok
    assert calls(log).count("a") == 2                        # another model is another call
    assert ask([], better).count() == 0


def test_a_broken_run_repeats_no_finished_wave(spark, tmp_path):
    store, words = str(tmp_path / "store"), [f"w{i}" for i in range(40)]
    dying = model(tmp_path / "first", {"w17": "dies"})
    with pytest.raises(Exception):
        memo.call_model_once(asking(spark, words), dying, "messages", store, "m", wave=5, attempts=1).count()
    stored = {r.answer.content.lower() for r in memo.read_answers(spark, store, _call_type()).collect()}
    again = model(tmp_path / "second")
    got = memo.call_model_once(asking(spark, words), again, "messages", store, "m", wave=5, attempts=1).collect()
    assert len(got) == 40 and all(r.ok for r in got)
    assert sorted(set(words) - stored) == calls(tmp_path / "second")


def test_a_wave_reads_its_own_inputs_only(spark, tmp_path):
    read = []

    def call(part):
        read.append({r[0] for r in part.select(F.input_file_name()).distinct().collect()})
        return part.withColumn("answer", F.upper("asked")).withColumn(
            "call_error", F.when(F.col("asked").endswith("7"), "refused")).withColumn(
            "answer", F.when(F.col("call_error").isNull(), F.col("answer")))
    df, store = spark.createDataFrame([(i, f"w{i}") for i in range(60)], "id int, q string"), str(tmp_path / "store")
    got = {r.id: r for r in memo.answer_once(df, "q", "m", store, T.StringType(), call, wave=9).collect()}
    assert len(read) == 7 and sum(map(len, read)) == len(set().union(*read))
    assert all((r.answer, r.call_error) == ((None, "refused") if i % 10 == 7 else (f"W{i}", None)) for i, r in got.items())
    read.clear()
    again = {r.id: r for r in memo.answer_once(df, "q", "m", store, T.StringType(), call, wave=9).collect()}
    assert len(read) == 1 and again == got     # only what had failed


def _call_type():
    from codeset_engine import schemas
    return schemas.MODEL_CALL


def test_vectors_are_made_once(spark, tmp_path):
    store, log = str(tmp_path / "store"), str(tmp_path / "log")

    def embedder(texts):
        with open(log, "a") as f:
            f.write("".join(t + "\n" for t in texts))
        return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([(1, "one"), (2, "two!"), (3, "one"), (4, None)], "id int, text string")
    for _ in range(2):
        got = {r.id: r for r in memo.embed_once(df, embedder, "text", store, "e").collect()}
    assert [list(got[i].embedding) for i in (1, 2, 3)] == [[3.0, 1.0], [4.0, 1.0], [3.0, 1.0]] and got[4].embedding is None
    assert sorted(open(log).read().split()) == ["one", "two!"]


# ---------------------------------------------------------------- years

def test_all_pairs_of_years_equal_the_single_comparison(spark):
    rng = random.Random(6)
    rows = [(t, f"c{rng.randrange(60)}", y, "d", i) for i, (t, y) in enumerate(
        (rng.choice("AB"), rng.choice([2015, 2019, 2020, 2021, 2090])) for _ in range(600))]
    codes = spark.createDataFrame(rows + [("A", "c1", None, "d", 9)], CODES)
    got = {(r.code_type, r.year1, r.year2): tuple(r)[3:] for r in years.compare_all_years(codes).collect()}
    assert len(got) == 2 * 5 * 4
    held = {}
    for t, c, y, _, _ in rows:
        held.setdefault((t, y), set()).add(c)
    for (t, y1, y2), (n1, n2, added, removed, common) in got.items():
        a, b = held[t, y1], held[t, y2]
        assert (n1, n2, added, removed, common) == (len(a), len(b), len(b - a), len(a - b), len(a & b))
        assert got[t, y2, y1][:2] == (n2, n1) and got[t, y2, y1][4] == common
    assert years.compare_all_years(codes.limit(0)).count() == 0


def test_intervals_break_at_gaps_and_changes(spark):
    rows = [("A", "x", 2001, "one", 1), ("A", "x", 2001, "other", 2), ("A", "x", 2002, "one", 3), ("A", "x", 2003, None, 4),
            ("A", "x", 2004, None, 5), ("A", "x", 2007, None, 6), ("A", "y", 2001, "q", 7), ("A", None, 2001, "n", 8),
            ("A", "y", None, "q", 9)]
    found = years.validity_intervals(spark.createDataFrame(rows, CODES), [F.asc("line")])
    assert sorted(map(tuple, found.collect()), key=str) == sorted([
        ("A", "x", "one", 2001, 2002), ("A", "x", None, 2003, 2004), ("A", "x", None, 2007, 2007),
        ("A", "y", "q", 2001, 2001), ("A", None, "n", 2001, 2001)], key=str)


def test_as_of_lookup_with_a_hot_code(spark):
    spans = [("A", f"c{i}", f"d{i}{y}", y, y + 1) for i in range(20) for y in (2000, 2004, 2010)]
    rng = random.Random(1)
    asked = [(q, "A", "c3" if q % 3 else f"c{rng.randrange(25)}", rng.randrange(1998, 2014)) for q in range(3000)]
    asked += [(9000, "A", None, 2004), (9001, "A", "c3", None), (9002, "B", "c3", 2004), (9002, "B", "c3", 2004)]
    intervals = spark.createDataFrame(spans, "code_type string, code string, description string, valid_from int, valid_to int")
    requests = spark.createDataFrame(asked, "qid int, code_type string, code string, as_of int")
    looked_up = years.as_of_lookup(intervals, requests)
    assert looked_up.columns == ["qid", "code_type", "code", "as_of", "description", "valid_from", "valid_to", "status"]
    got = looked_up.collect()
    assert len(got) == len(asked)
    for r in got:
        begun = [s for s in spans if s[:2] == (r.code_type, r.code) and r.as_of is not None and s[3] <= r.as_of]
        last = max(begun, key=lambda s: s[3], default=None)
        status = "unknown" if last is None else "valid" if r.as_of <= last[4] else "lapsed"
        assert (r.status, r.description, r.valid_from) == (status, last and last[2], last and last[3])
    plan = looked_up._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_answers_keep_their_type(spark, tmp_path):
    none = memo.read_answers(spark, str(tmp_path / "no-store"), T.ArrayType(T.FloatType()))
    assert none.schema["answer"].dataType == T.ArrayType(T.FloatType()) and none.count() == 0


# ---------------------------------------------------------------- spreadsheets

ODD = ["plain", "", "a < b & \"c\"", "line\nbreak\ttab\r\n", "\x00\x1f\x0b bell", "_x0041_ literal", "ﬁ \U0001F600 é", " spaces "]


def test_spreadsheets_round_trip(spark, tmp_path):
    rows = [(i, text, i % 2 == 0, i / 4, None, 10 ** 17 + i) for i, text in enumerate(ODD)]
    df = spark.createDataFrame(rows, "n int, text string, flag boolean, ratio double, nothing string, big long")
    path = str(tmp_path / "book")
    tables.export_rows(df.repartition(3), path, "xlsx")
    read = code_files.read_decoded(spark, f"{path}/*.xlsx", spreadsheets.first_sheet)
    got = {int(r.cells[0]): r.cells for r in read.where("row_no > 0").collect()}
    for i, text, flag, ratio, _, big in rows:
        ratio_text = str(int(ratio)) if ratio == int(ratio) else repr(ratio)
        assert got[i] == [str(i), text, str(flag), ratio_text, None, str(big)]
    assert {tuple(r.cells) for r in read.where("row_no = 0").collect()} == {tuple(df.columns)}
    tables.export_rows(df.limit(1), path, "xlsx")          # replaces what was there
    read = code_files.read_decoded(spark, f"{path}/*.xlsx", spreadsheets.first_sheet)
    assert read.where("row_no > 0").count() == 1
    assert not os.path.exists(f"{path}/_temporary")


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "book")
    good = spark.range(20).selectExpr("id", "'kept' AS text")
    tables.export_rows(good, path, "xlsx")
    before = sorted(os.listdir(path))
    failing = spark.range(0, 20, 1, 4).selectExpr("id", "IF(id = 17, raise_error('stop'), 'new') AS text")
    with pytest.raises(Exception, match="stop"):
        tables.export_rows(failing, path, "xlsx")
    assert sorted(os.listdir(path)) == before


def test_full_sheets_go_on_in_another_workbook(spark, tmp_path, monkeypatch):
    import io
    monkeypatch.setattr(spreadsheets, "MOST_ROWS", 4)
    rows, found, more = iter([(i,) for i in range(8)]), [], True
    while more:
        file = io.BytesIO()
        more = spreadsheets.write_workbook(file, ["n"], rows)
        found.append([r[0] for r in spreadsheets.first_sheet(file.getvalue())])
    assert [r for sheet in found for r in sheet[1:]] == [str(i) for i in range(8)]
    assert all(sheet[0] == "n" and len(sheet) <= 4 for sheet in found)


def workbook(sheet, strings=()):
    """A workbook as other programs write it: shared strings, gaps, formulas, a second sheet."""
    import io
    file, main = io.BytesIO(), spreadsheets.MAIN
    with zipfile.ZipFile(file, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{spreadsheets.OFFICE}"><sheets>'
                   '<sheet name="Codes" sheetId="4" r:id="rId7"/><sheet name="Notes" sheetId="1" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{spreadsheets.PACKAGE}/relationships">'
                   '<Relationship Id="rId2" Target="/xl/worksheets/b.xml"/><Relationship Id="rId7" Target="worksheets/a.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si>{s}</si>" for s in strings) + "</sst>")
        z.writestr("xl/worksheets/a.xml", f'<worksheet xmlns="{main}"><sheetData>{sheet}</sheetData></worksheet>')
        z.writestr("xl/worksheets/b.xml", f'<worksheet xmlns="{main}"><sheetData><row><c t="str"><v>hello</v></c></row></sheetData></worksheet>')
    return file.getvalue()


def test_foreign_workbooks_are_read():
    strings = ["<t>Code</t>", "<r><t>Long </t></r><r><t>text</t></r><rPh><t>no</t></rPh>"]
    content = workbook('<row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c></row>'
                       '<row r="4"><c r="A4"><f>1+1</f><v>99213.0</v></c><c r="B4"><v>1.5E-3</v></c><c r="AB4" t="b"><v>1</v></c>'
                       '<c r="AC4" t="e"><v>#N/A</v></c></row>', strings)
    first, second = spreadsheets.read_sheets(content)
    assert (first.name, second) == ("Codes", ("Notes", [["hello"]]))
    assert first.rows[0] == [] and first.rows[1] == ["Code", None, "Long text"] and first.rows[2] == []
    assert first.rows[3][:2] == ["99213", "0.0015"] and first.rows[3][27:] == ["True", "#N/A"]
    assert spreadsheets.sheet_texts(content)[1] == {"text": "hello", "sheet_name": "Notes"}


def test_a_code_spreadsheet_is_normalised(spark, tmp_path):
    folder = tmp_path / "raw" / "cpt" / "cpt_2025"
    folder.mkdir(parents=True)
    rows = "".join(f'<row r="{n}">' + "".join(f'<c t="str"><v>{v}</v></c>' for v in values) + "</row>" for n, values in enumerate(
        [["Annual list"], ["HCPCS", "Long Descriptor"], ["99213", "visit"], ["A1234", "item"], ["99213", "again"], ["x", "y"]], 1))
    (folder / "codes.xlsx").write_bytes(workbook(rows))
    found = jobs.parse_code_file(spark, str(folder / "codes.xlsx"), "cpt", spreadsheets.DECODERS)
    assert sorted((r.code, r.description, r.code_type) for r in found.collect()) == [
        ("99213", "visit", "cpt"), ("A1234", "item", "hcpcs")]


def test_rows_of_a_large_sheet_are_read_one_by_one(spark, tmp_path):
    book = io.BytesIO()
    spreadsheets.write_workbook(book, ["n", "text"], ([i, f"row number {i} of many"] for i in range(40_000)))
    content = book.getvalue()
    tracemalloc.start()
    numbers = [int(row[0]) for row in spreadsheets.first_sheet_rows(content) if row[0] != "n"]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert numbers == list(range(40_000)) and peak < 6e6
    (tmp_path / "book.xlsx").write_bytes(content)
    read = code_files.read_decoded(spark, f"{tmp_path}/*.xlsx", spreadsheets.first_sheet_rows)
    assert [tuple(r) for r in read.selectExpr("row_no", "line_id", "cells[0]").orderBy("row_no").collect()[1:]] \
        == [(i + 1, i + 1, str(i)) for i in range(40_000)]
