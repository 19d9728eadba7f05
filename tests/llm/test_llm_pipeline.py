"""Every stage on its own input, against brute force where it is exact."""

import brute
import corpus_pipeline
from corpus_pipeline import STAGES

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs.collect())
        assert docs.columns == columns or name == "packing"
    before, after = seen["language"]
    assert len(after) >= 0.98 * len(before)
    before, after = seen["near_duplicates"]
    ids = sorted(before)
    groups = brute.groups([before[i].text for i in ids])
    assert sorted(r.doc_id for r in after) == sorted({ids[g] for g in groups})
    assert all(r == before[r.doc_id] for r in after)
    before, after = seen["benchmark"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hits = dict(zip(before, brute.contamination([r.text for r in before.values()], items)))
    left = {r.doc_id: r for r in after}
    assert all(left[i] == before[i] for i, (_, hit, _) in hits.items() if not hit)
    assert any(hit for _, hit, _ in hits.values())
    for n, hit, found in brute.contamination([r.text for r in after], [i for i in items if len(brute.words(i[1])) >= 10]):
        assert not hit
    before, after = seen["personal_data"]
    assert {r.doc_id for r in after} == set(before)
    assert not any(brute.personal(r.text) for r in after)
    assert all(r == before[r.doc_id] for r in after if r.text == before[r.doc_id].text)
    before, after = seen["packing"]
    assert {r.doc_id for r in after} == set(before)


def test_benchmark_stage_removes_short_items(spark, tmp_path):
    items = [(1, "Which river flows through Paris?"), (2, "Name the capital city of France in a word"),
             (3, "alpha beta gamma delta"), (4, "one two three")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    around = " ".join(f"filler{i}" for i in range(500))
    docs = spark.createDataFrame(
        [(i, f"{around} {text} {around}", "en", "web", 0) for i, text in items],
        "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id: r for r in corpus_pipeline.benchmark(spark, docs, str(tmp_path)).collect()}
    assert len(left) == len(items)
    for i, text in items:  # the floor: three words and fewer stay
        kept = len(text.split()) < 4
        assert (brute.contamination([left[i].text], items)[0][2] == {"4"}) == kept
        assert bool(brute.contamination([left[i].text], items)[0][1]) == kept
        assert left[i].n_chars == (0 if kept else len(left[i].text)) and around in left[i].text


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(STAGES) <= 5
    assert corpus_pipeline.run(spark, SF).count() > 0
