"""Stored search indexes: cells of vectors and postings of trigrams, against the plain search."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from codeset_engine.operators import cells, grams, search

VECTORS = "id long, vector array<double>, label int"


def clusters(n=1500, size=16, groups=12, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, size)) * 4
    return [(i, (centres[i % groups] + rng.normal(size=size)).tolist(), i % groups) for i in range(n)]


def hits(df):
    return sorted((r.qid, r["rank"], r.id, r.similarity) for r in df.collect())


@pytest.fixture(scope="module")
def vectors(spark):
    rows = clusters() + [(5000, [0.0] * 16, 0), (5001, None, 0), (None, [1.0] * 16, 0), (5002, [1.0, 2.0], 0),
                         (5003, [2.0, 4.0], 0)]
    rows += [(6000 + i, rows[5][1], 5) for i in range(300)]    # many equal vectors are one hot cell
    return spark.createDataFrame(rows, VECTORS).cache()


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cells") / "index")
    cells.build_cells(vectors, path, id_col="id", vector_col="vector", keep=["label"], cells=24, fit_rows=900)
    return path


@pytest.fixture(scope="module")
def asks(spark):
    rows = [(i, v) for i, v, _ in clusters(40, seed=9)] + [(100, [0.0] * 16), (101, None), (102, [3.0, 1.0]), (103, []),
                                                          (104, clusters()[5][1])]
    return spark.createDataFrame(rows, "qid long, vector array<double>")


@pytest.mark.parametrize("k, threshold", [(1, None), (7, None), (400, None), (5, 0.9)])
def test_cells_give_the_rows_of_the_exact_search(spark, vectors, index, asks, k, threshold):
    want = search.semantic_topk(vectors, asks, k, id_col="id", vector_col="vector", threshold=threshold)
    assert hits(cells.search_cells(spark, index, asks, k, id_col="id", threshold=threshold)) == hits(want)


def test_every_vector_with_a_direction_is_stored(spark, vectors, index):
    stored = spark.read.parquet(f"{index}/vectors")
    assert stored.count() == vectors.where("id IS NOT NULL AND vector IS NOT NULL AND id <> 5000").count()
    assert stored.where("cell = -1").count() == 2 and "label" in stored.columns
    held = cells.load_cells(spark, index)
    assert held.rows.sum() == stored.count()


def test_bounds_hold_for_every_vector(spark, vectors, index):
    held = cells.load_cells(spark, index)
    stored = spark.read.parquet(f"{index}/vectors").where("cell >= 0").collect()
    asked = np.random.default_rng(4).normal(size=(20, 16))
    asked /= np.linalg.norm(asked, axis=1)[:, None]
    bounds = cells.cell_bounds(held, asked)
    for row in stored:
        vector = np.array(row.vector) / np.linalg.norm(row.vector)
        assert (asked @ vector <= bounds[:, row.cell]).all()


def test_few_files_are_read_for_a_request_near_one_centre(spark, index):
    held = cells.load_cells(spark, index)
    asked = spark.createDataFrame([(1, clusters()[3][1])], "qid long, vector array<double>")
    pairs = cells._pairs(asked, held, 3, 1, None)
    opened = [r.cell for r in pairs.collect()]
    every = spark.read.parquet(f"{index}/vectors").inputFiles()
    read = cells.opened_vectors(spark, index, held, opened).inputFiles()
    assert len(opened) == 1 and 0 < len(read) <= len(every) / 8
    first = search.semantic_topk(spark.read.parquet(f"{index}/vectors").where(F.col("cell").isin(opened)), asked, 3,
                                 id_col="id", vector_col="vector")
    late = cells._pairs(asked.withColumn("kth", F.lit(first.collect()[-1].similarity)), held, 3, 1, "kth")
    assert late.count() <= 3    # of 24 cells, the others cannot hold a better one


def test_approximate_search_has_measured_recall(spark, vectors, index, asks):
    want = {(r[0], r[2]) for r in hits(search.semantic_topk(vectors, asks, 10, id_col="id", vector_col="vector"))}
    got = {(r[0], r[2]) for r in hits(cells.search_cells(spark, index, asks, 10, id_col="id", first=3, approximate=True))}
    assert len(want & got) >= 0.9 * len(want)


def test_vectors_are_added(spark, vectors, asks, tmp_path):
    path, odd = str(tmp_path / "index"), F.col("id") % 2 == 1
    cells.build_cells(vectors.where(odd), path, id_col="id", vector_col="vector", cells=10)
    cells.add_vectors(vectors.where(~odd), path, id_col="id", vector_col="vector")
    want = search.semantic_topk(vectors, asks, 6, id_col="id", vector_col="vector")
    assert hits(cells.search_cells(spark, path, asks, 6, id_col="id")) == hits(want)


def test_tiles_bound_what_a_task_holds(spark, monkeypatch, vectors, asks, tmp_path):
    monkeypatch.setattr(cells, "TILE_ROWS", 100)
    monkeypatch.setattr(cells, "ASK_ROWS", 7)
    path = str(tmp_path / "index")
    cells.build_cells(vectors, path, id_col="id", vector_col="vector", cells=5)
    tiles = spark.read.parquet(f"{path}/vectors").groupBy("cell", "tile").count()
    assert tiles.agg(F.max("count")).first()[0] <= 200 and tiles.count() >= 18
    want = search.semantic_topk(vectors, asks, 4, id_col="id", vector_col="vector")
    assert hits(cells.search_cells(spark, path, asks, 4, id_col="id")) == hits(want)


def test_empty_corpus_and_no_requests(spark, vectors, index, asks, tmp_path):
    path = str(tmp_path / "index")
    cells.build_cells(vectors.limit(0), path, id_col="id", vector_col="vector")
    assert cells.search_cells(spark, path, asks, 3, id_col="id").count() == 0
    assert cells.search_cells(spark, index, asks.limit(0), 3, id_col="id").count() == 0


def test_large_request_sets_use_bounded_blocks(spark, monkeypatch, vectors, asks):
    want = hits(search.semantic_topk(vectors, asks, 5, id_col="id", vector_col="vector"))
    monkeypatch.setattr(search, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(search, "BLOCK_BYTES", 4000)    # about twenty vectors a block
    assert hits(search.semantic_topk(vectors, asks, 5, id_col="id", vector_col="vector")) == want


def test_a_request_goes_once_to_a_block_however_many_cells_it_opens(spark, tmp_path):
    rng, path = np.random.default_rng(8), str(tmp_path / "index")
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(600, 48)))],
                                 "id long, vector array<double>")
    cells.build_cells(rows, path, id_col="id", vector_col="vector")
    held = cells.load_cells(spark, path)
    asked = rows.selectExpr("id AS qid", "vector", "-1.0D AS kth")     # every cell is open
    deal = cells._deal(held, 48, 4)
    sent = cells._asks(asked, held, deal, 3, 2, "kth")
    assert deal.blocks == 4 and sent.count() == 4 * 600
    assert {sum(map(len, r.opened)) for r in sent.groupBy("qid").agg(F.collect_list("cells").alias("opened")).collect()} \
        == {(held.rows > 0).sum()}
    want = search.semantic_topk(rows, asked, 3, id_col="id", vector_col="vector")
    assert hits(cells.search_cells(spark, path, asked, 3, id_col="id")) == hits(want)


def test_scores_of_a_block_are_held_in_parts():
    rng = np.random.default_rng(5)
    vectors = pa.array(list(rng.normal(size=(6000, 8))), pa.list_(pa.float64()))
    numbers, zeros, none = pa.array(range(6000)), pa.array([0] * 6000, pa.int32()), pa.nulls(6000, pa.int64())
    names = ["block", "asks", "c0", "c1", "qid", "value"]
    stream = [pa.RecordBatch.from_arrays([zeros, pa.array([False] * 6000), numbers, vectors, none, pa.nulls(6000, vectors.type)], names),
              pa.RecordBatch.from_arrays([zeros, pa.array([True] * 6000), none, pa.nulls(6000, vectors.type), numbers, vectors], names)]
    schema = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("similarity", pa.float64())])
    tracemalloc.start()
    found = list(search.best_over_blocks(search.unit_vectors, search.cosine(None), 2, 0, schema)(iter(stream)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6     # all scores at once are 288 MB
    table = pa.Table.from_batches(found)
    assert table.num_rows == 12000
    assert table.filter(pc.equal(table["qid"], table["id"]))["similarity"].to_pylist() == [1.0] * 6000


def test_texts_are_searched_in_parts_of_bounded_size(monkeypatch):
    monkeypatch.setattr(search, "TILE_BYTES", 1000)
    texts = ["the " * n for n in [10] * 200 + [2000] + [3] * 50] + ["", "no"]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    parts = list(search.tiles([rows]))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([rows]))
    assert all(part.num_rows == 1 or part.column(1).nbytes <= 1000 for part in parts)
    loaded = []
    scorer = search.Scorer(lambda column: loaded.append(column.nbytes) or search.DENSITY.load(column), search.DENSITY.score)
    schema = pa.schema([("qid", pa.int32()), ("id", pa.int64()), ("score", pa.float64())])
    found = pa.Table.from_batches(search._best(pa.array([7], pa.int32()), [["the"]], [rows], scorer, 300, 0, schema))
    assert found.num_rows == 251 and sorted(loaded)[-2] <= 1000


# ---------------------------------------------------------------- trigrams

TEXTS = ["Acute pain of the knee", "KNEE pain, chronic", "", " ", "no match here", "aaaa aaa", "İstanbul knee \U0001F600 x",
         None, "the the the", "x\0y knee", "ab", "straße STRASSE"]
QUERIES = ["knee", "Knee pain", "aaa", "the", "zzz", "x", "İs", "\U0001F600 x", "ab", " kn", "strasse", "knee\0", "the the"]


@pytest.fixture(scope="module")
def texts(spark):
    rows = list(enumerate(TEXTS)) + [(None, "knee"), (40, "knee"), (40, "knee")]
    rows += [(100 + i, f"row {i} of the {'knee ' * (i % 4)}{'z' * (i % 3)}") for i in range(9000)]
    return spark.createDataFrame(rows, "id long, text string")


@pytest.fixture(scope="module")
def postings(spark, texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("grams") / "index")
    old = F.col("id") < 5000
    grams.build_grams(texts.where(old).coalesce(2), path, id_col="id", text_col="text")
    grams.build_grams(texts.where(~old | F.col("id").isNull()), path, id_col="id", text_col="text", append=True)
    return path


def scores(df):
    return sorted((r.qid, r["rank"], r.id, r.score) for r in df.collect())


@pytest.mark.parametrize("k", [1, 20, 3000])
def test_postings_give_the_rows_of_the_scan(spark, texts, postings, k):
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "qid int, query string")
    want = scores(search.keyword_topk(texts, asked, k, id_col="id", text_col="text"))
    assert scores(grams.search_grams(spark, postings, asked, k, id_col="id")) == want


def test_few_texts_are_opened(spark, postings):
    asked = spark.createDataFrame([(0, "row 77 of"), (1, "\U0001F600 x"), (2, "nothing like it")], "qid int, query string")
    opened = grams.gram_candidates(spark, postings, search.needles(asked))
    by_request = {r.qid: r["count"] for r in opened.groupBy("qid").count().collect()}
    assert by_request == {0: 3, 1: 1}    # rows 77, 777 and 7777 hold its rarest trigrams


def test_rare_queries_read_few_posting_files(spark, postings):
    stored = spark.read.parquet(f"{postings}/postings")
    assert stored.groupBy("gram", "batch", "block").count().where("count > 2").count() == 0
    plan = stored.where(F.col("gram").isin(["77 ", " 77"]))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan


def test_search_refuses_empty_queries(spark, postings):
    with pytest.raises(Exception, match="non-empty"):
        grams.search_grams(spark, postings, spark.createDataFrame([(0, "")], "qid int, query string"), id_col="id").collect()


def test_packed_rows_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 4096):
        rows = np.sort(rng.choice(4096, n, replace=False)).astype(np.int64)
        assert (grams.unpack_rows(grams.pack_rows(rows)) == rows).all()
    assert (grams.unpack_rows(grams.pack_rows(np.array([254, 509, 4095]))) == [254, 509, 4095]).all()


def test_postings_are_made_once_for_the_index(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield from grams._block_postings(0, list(range(batch.num_rows)), batch["text"].to_pylist())
    original, grams._postings = grams._postings, counted
    try:
        rows = spark.createDataFrame([(i, f"some text {i}") for i in range(3000)], "id long, text string")
        grams.build_grams(rows, str(tmp_path / "index"), id_col="id", text_col="text")
    finally:
        grams._postings = original
    assert calls.value == 3000


def test_postings_of_a_block_equal_those_by_text(monkeypatch):
    rng = np.random.default_rng(6)
    texts = ["", "ab", "abc", "\0\0\0", "\U0001F600xy\U0001F600xy", "aaaa"] + [
        "".join(rng.choice(list("abcdé \U0001F600"), rng.integers(0, 60))) for _ in range(5000)]
    rows = [(1 << 40) + i for i in range(len(texts))]
    want = {}
    for rid, text in zip(rows, texts):
        for gram in grams.text_grams(text):
            want.setdefault((gram, rid >> grams.BLOCK_BITS), []).append(rid & (1 << grams.BLOCK_BITS) - 1)
    batch = pa.RecordBatch.from_arrays([pa.array(rows), pa.array(texts)], ["rid", "text"])
    for part in (1 << 23, 3000):
        monkeypatch.setattr(grams, "PART_CHARS", part)
        got = {}
        for found in grams._postings(iter([batch])):
            for row in found.to_pylist():
                unpacked = grams.unpack_rows(row["rows"]).tolist()
                assert len(unpacked) == row["n"] and grams.pack_rows(np.array(unpacked)) == row["rows"]
                got.setdefault((row["gram"], row["block"]), []).extend(unpacked)
        assert got == want
