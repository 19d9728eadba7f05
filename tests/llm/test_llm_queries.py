"""Every registered query against its SQL, a brute-force version, a round trip or labels."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from codeset_engine.llm import near_dup
from codeset_engine.llm.queries import ORACLES, QUERIES
from oracle import compare, connect

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = connect(SF)
    assert compare(spark, con, QUERIES[name], ORACLES[name], SF) is None
    con.close()


def test_decontamination_matches_brute_force(spark):
    docs = texts(spark, SMALL)
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    want = dict(zip(docs, brute.contamination(docs.values(), items)))
    for r in QUERIES["op1_benchmark_decontamination"](spark, SMALL).collect():
        n, hit, found = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_near_duplicates_match_brute_force(spark):
    docs = dict(sorted(texts(spark, SF).items()))
    ids = list(docs)
    first = [ids[g] for g in brute.groups(list(docs.values()))]
    got = {r.doc_id: r for r in QUERIES["op3_minhash_near_dedup"](spark, SF).collect()}
    assert len(got) == len(ids)
    for doc_id, component in zip(ids, first):
        r = got[doc_id]
        assert (r.n_shingles, r.component_id, r.kept) == (
            len(brute.shingle_set(docs[doc_id])), component, component == doc_id)


def test_min_hashes_estimate_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2 ** 63, 2000).astype(np.uint64))
    b = np.unique(np.concatenate([a[:1500], rng.integers(0, 2 ** 63, 500).astype(np.uint64)]))
    seeds = rng.integers(1, 2 ** 63, 600).astype(np.uint64)
    same = (near_dup.min_hashes(a, seeds) == near_dup.min_hashes(b, seeds)).mean()
    assert abs(same - 1500 / 2500) < 0.07


def test_language_is_right_on_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op4_language_id"](spark, SF).join(docs, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held) > 0
    assert all(0 <= r.score <= 1 for r in got)


def test_toxic_words_are_found_and_clean_texts_left(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    got = QUERIES["op5_toxicity"](spark, SF).join(labels, "doc_id").collect()
    assert all(0 <= r.severity <= 3 and r.toxic == (r.p_toxic >= 0.5) for r in got)
    toxic, clean = [r for r in got if r.label], [r for r in got if not r.label]
    assert sum(r.toxic for r in toxic) >= 0.7 * len(toxic)
    assert sum(r.toxic for r in clean) <= 0.02 * len(clean)


def test_personal_data_matches_brute_force(spark):
    docs, secrets = texts(spark, SF), 0
    kinds = list(brute.BASE)
    for r in QUERIES["op6_pii_candidates"](spark, SF).collect():
        base = [f"{kinds[k]}:{s}:{e}" for s, k, e in brute.personal(docs[r.doc_id])]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        spans = [s for s in r.spans.split(",") if s]
        assert set(base) <= set(spans)
        for kind, start, end in (s.split(":") for s in set(spans) - set(base)):
            assert kind == "secret" and docs[r.doc_id][int(start) - 9:int(start)].lower() == 'token = "'
            secrets += 1
    assert secrets == sum((t or "").lower().count('token = "') for t in docs.values()) > 0


def test_shards_are_whole_and_grow_into_one(spark):
    docs = texts(spark, SF)
    got = QUERIES["op9_external_shuffle"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    slots = {}
    for r in got:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 40) and 0 <= r.shard < 40
        slots.setdefault(r.shard, []).append((r.slot, r.doc_id))
    assert all(sorted(s for s, _ in v) == list(range(len(v))) for v in slots.values())
    assert len(slots) == 40 and max(map(len, slots.values())) < 3 * len(got) / 40
    assert any([d for _, d in sorted(v)] != sorted(d for _, d in v) for v in slots.values())


def test_written_shards_hold_the_documents(spark):
    want = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op9_external_shuffle"](spark, SF)
    files = got.inputFiles()
    assert len({f.split("shard=")[1].split("/")[0] for f in files if "shard=" in f}) == 40
    written = spark.read.option("basePath", files[0].split("/shard=")[0]).parquet(*files).collect()
    assert len(written) == len(want)
    for r in written:
        assert all(r[c] == want[r.doc_id][c] for c in want[r.doc_id].__fields__)
    assert {(r.doc_id, r.shard, r.slot, r.text_crc32) for r in got.collect()} == {
        (r.doc_id, r.shard, r.slot, zlib.crc32((r.text or "").encode())) for r in written}


def test_packing_gives_every_token_back(spark):
    docs = texts(spark, SF)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: e.ids + [0] for d, e in zip(docs, tokenizer.encode_batch(
        [t or "" for t in docs.values()], add_special_tokens=False))}
    got = QUERIES["op10_hilbert_packing"](spark, SF).collect()
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        own = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4")
        assert (r.ids_crc32, r.doc_tokens) == (zlib.crc32(own.tobytes()), len(ids[r.doc_id]))
    assert set(pieces) == set(docs)
    for doc_id, rows in pieces.items():
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids[doc_id])
    used = []
    for rows in sequences.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        used.append(at)
    assert max(used) <= 1024 and sum(used) >= 0.99 * 1024 * len(used)
