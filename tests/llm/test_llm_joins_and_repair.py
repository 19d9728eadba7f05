"""Spelling variants, the n-gram join and conversation repair against brute force and on edges."""

import heapq
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

import brute
from codeset_engine.llm import conversation_repair, ngram_join, packing, spelling
from codeset_engine.llm.common import Scratch, chosen_rows
from codeset_engine.llm.verification import WordHashes

DOCS = "doc_id long, text string"
TURNS = "conv_id long, turn long, role string, text string"


# ---------------------------------------------------------------- conversation repair

def cheapest(rows):
    """(cost, audit, repaired lines) by Dijkstra over (row, grammar state), audits as ties."""
    wanted = {0: ("u", "user", 2), 1: ("u", "user", 2), 2: ("a", "assistant", 3), 3: ("u", "user", 2)}
    queue, done = [(0, "", 0, 0, ())], set()
    while queue:
        cost, audit, at, state, lines = heapq.heappop(queue)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in (0, 3):
            return cost, audit, list(lines)
        initial, name, to = wanted[state]
        heapq.heappush(queue, (cost + 3, audit + "I", at, to, lines + (name + ":",)))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(queue, (cost + 4, audit + "D", at + 1, state, lines))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                heapq.heappush(queue, (cost + more + 3, audit + "R", at + 1, to, lines + (f"{name}:{text}",)))
                if role[:1] == initial or role[:1] == "s" and state == 0:
                    heapq.heappush(queue, (cost + more, audit + "K", at + 1, to if role[:1] == initial else 1,
                                           lines + (f"{role}:{text}",)))


def judged(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\f\r")
        fault = ("blank" if not bare else "duplicate" if (role, text) in seen
                 else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def test_repair_matches_brute_force(spark):
    rng = random.Random(5)
    talks = {c: [(rng.choice(["user", "assistant", "system", "tool", "s", ""]),
                  rng.choice(["yes.", "no", " ", "why?\n", "a.b", f"t{rng.random()}."]))
                 for _ in range(rng.randrange(1, 9))] for c in range(300)}
    rows = [(c, t, role, text) for c, talk in talks.items() for t, (role, text) in enumerate(talk)]
    report, repaired = conversation_repair.repair_conversations(spark.createDataFrame(rows, TURNS))
    lines = {}
    for r in sorted(repaired.collect(), key=lambda r: (r.conv_id, r.position)):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        assert (r.edit == "I") <= (r.text == "") and r.position == len(lines[r.conv_id])
    got = {r.conv_id: r for r in report.collect()}
    assert set(got) == set(talks)
    for c, talk in talks.items():
        faults = judged(talk)
        cost, audit, want = cheapest(faults)
        assert (got[c].cost, got[c].audit, lines.get(c, [])) == (cost, audit, want)
        for kind in ("blank", "duplicate", "truncated"):
            assert got[c][kind] == sum(f == kind for _, _, f in faults)
        assert got[c].illegal == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(talk, talk[1:]))
        assert got[c].gaps == 0


def test_nodes_are_shared_between_conversations(monkeypatch):
    """A suffix that neighbours in the range have in common is evaluated once."""
    calls = []
    plain = conversation_repair.extend
    monkeypatch.setattr(conversation_repair, "extend", lambda letter, after: calls.append(letter) or plain(letter, after))
    reverse = sorted(["auauS", "auaus", "auau", "auaux", "auau", "uu"])
    batches = [pa.RecordBatch.from_pydict({"reverse": reverse[:3]}), pa.RecordBatch.from_pydict({"reverse": reverse[3:]})]
    out = [r["solved"] for b in conversation_repair._walk(iter(batches)) for r in b.to_pylist()]
    assert len(calls) == len({w[:i] for w in reverse for i in range(1, len(w) + 1)})
    assert [o["audit"] for o in out] == ["KKKK", "KKKK", "KKKKK", "KKKKK", "DKKKK", "KR"]


def test_repair_edges(spark):
    rows = [(1, None, "user", "hi."), (1, 5, "assistant", "ok."), (1, 9, None, None),
            (2, 1, "user", " "), (2, 1, "user", " "), (None, 3, "user", "a."), (None, 4, "assistant", "b."),
            (3, None, "user", "x."), (4, 1, "system", "be kind.")]
    long_talk = [(5, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(20_000)]
    turns = spark.createDataFrame([r + (0, "z") for r in rows + long_talk],
                                  TURNS + ", n int, id string")  # clashing names
    report, repaired = conversation_repair.repair_conversations(turns)
    got = {r.conv_id: r for r in report.collect()}
    assert (got[1].gaps, got[1].blank, got[1].audit, got[1].cost) == (3, 1, "KKD", 4)
    assert (got[2].duplicate, got[2].truncated, got[2].gaps) == (1, 1, 0) and got[2].audit == "DD"
    assert (got[None].audit, got[None].cost) == ("KK", 0)
    assert (got[3].gaps, got[3].audit, got[3].cost) == (0, "KI", 3)
    assert (got[4].audit, got[4].cost) == ("D", 4)
    assert got[5].audit == "K" * 20_000
    assert repaired.where("conv_id IS NULL").count() == 2 and repaired.where("conv_id = 2").count() == 0
    empty = conversation_repair.repair_conversations(turns.limit(0))
    assert empty[0].count() == 0 and empty[1].count() == 0


# ---------------------------------------------------------------- spelling variants

def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants(words, ratio=5):
    out = {}
    for w, n in words.items():
        close = [v for v in words if near(w, v)]
        best = min(close, key=lambda v: (-words[v], v), default=None)
        out[w] = (best if best and words[best] >= ratio * n else None, len(close))
    return out


@pytest.mark.parametrize("letters, sizes", [("ab", (4, 8)), ("abcdé÷", (4, 7)), ("aèc", (6, 9))])
def test_variants_match_brute_force(spark, letters, sizes):
    rng = random.Random(hash(letters) % 1000 + 3)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(*sizes))): rng.choice([5, 6, 30, 150, 900, 900])
             for _ in range(250)}
    got = spelling.group_variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    want = variants(words)
    assert len(got) == len(words)
    for r in got:
        form, n_near = want[r.word]
        root = r.word
        while want[root][0]:
            root = want[root][0]
        assert (r.form, r.n_near, r.root, r.n) == (form, n_near, root, words[r.word])
        assert r.form_n == (words[form] if form else None)


def test_pivots_are_the_cheapest_that_do_not_overlap():
    rng = random.Random(8)
    for _ in range(300):
        at = sorted(rng.sample(range(12), rng.randint(3, 8)))
        places = [(p, rng.randint(0, 9)) for p in at]
        cost = dict(places)
        pivots = spelling.choose_pivots(places)
        least = min(cost[a] + cost[b] for a, b in itertools.combinations(at, 2) if b - a >= 2)
        assert abs(pivots[0] - pivots[1]) >= 2 and cost[pivots[0]] + cost[pivots[1]] == least
    assert spelling.choose_pivots([(0, 1), (1, 1)]) == []


def test_variant_edges(spark):
    rows = [("kitten", 3, "a"), ("kitten", 4, "b"), ("kitte", 70, "c"), (None, 9, "d"), ("sitten", None, "e"),
            ("x", 1, "f"), ("y", 50, "g"), ("", 2, "h"), ("kittez", 350, "i"), ("z" * 30_000, 6, "j")]
    got = {r.word: r for r in spelling.group_variants(
        spark.createDataFrame(rows, "word string, n long, key string")).collect()}
    assert set(got) == {"kitten", "kitte", "x", "y", "", "kittez", "z" * 30_000}
    assert (got["kitten"].n, got["kitten"].form, got["kitten"].n_near) == (7, "kittez", 2)
    assert (got["kitte"].form, got["kitte"].root) == ("kittez", "kittez") and got["x"].n_near == 0
    none = spark.createDataFrame([], "word string, n long")
    assert spelling.group_variants(none).count() == 0
    with pytest.raises(ValueError):
        spelling.group_variants(none, ratio=1)


def test_long_chains_of_forms(spark):
    chain = ["aaaaaaa", "aaaaaab", "aaaaabb", "aaaabbb", "aaabbbb", "aabbbbb"]
    rows = [(w, 2 * 5 ** i) for i, w in enumerate(chain)]
    got = {r.word: r for r in spelling.group_variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert {r.root for r in got.values()} == {chain[-1]} and got[chain[0]].form == chain[1]


def test_word_runs_and_counts(spark):
    docs = spark.createDataFrame([(1, "Banana-BANANA ÀÉÿx1 naïveté"), (None, None), (2, ""), (2, "banana")], DOCS)
    runs = spelling.word_runs(docs)
    assert sorted(r.run for r in runs.collect()) == sorted(["banana"] * 3 + ["ÀÉÿx", "naïveté"])
    assert [(r.word, r.n) for r in spelling.count_words(runs, rarest=2).collect()] == [("banana", 3)]


# ---------------------------------------------------------------- n-gram join

def family(seed, sizes, copies):
    rng = random.Random(seed)
    docs = []
    for f in range(copies):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice(sizes))]
        for _ in range(rng.randrange(1, 9)):
            words = list(base)
            for at in rng.sample(range(len(words)), min(len(words), rng.choice([0, 0, 1, 1, 2]))):
                words[at] = f"v{rng.randrange(10 ** 6)}"
            if rng.random() < 0.3:
                words += [f"x{i}" for i in range(rng.randrange(1, 6))]
            docs.append(" ".join(words))
    return [(i * 13 % 7919, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("boundary", [1, 30, 256])
def test_join_matches_brute_force_at_every_boundary(spark, monkeypatch, boundary):
    """All lists, subsets and lists, and nearly all subsets find the same links."""
    monkeypatch.setattr(ngram_join, "choose_boundary", lambda *a: ngram_join.Costs(boundary, 0.0, 0.0))
    docs = sorted(family(boundary, [4, 8, 10, 14, 25, 40, 90], 40))
    groups = brute.groups([t for _, t in docs], 80)
    got = {r.doc_id: r for r in ngram_join.join_similar(spark.createDataFrame(docs, DOCS)).collect()}
    assert [got[d].component_id for d, _ in docs] == [docs[g][0] for g in groups]
    assert [got[d].n_shingles for d, _ in docs] == [len(brute.shingle_set(t)) for _, t in docs]


def test_every_similar_pair_has_a_common_key():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 50, ngram_join.CELLS).astype(np.uint32)
    for n in [*range(4, 60), 200, 255, 300]:
        for boundary in (1, 20, 30, 200, 256):
            a = np.unique(rng.integers(0, 2 ** 63, n).astype(np.uint64) * np.uint64(2))
            for drop in range(0, n // 5 + 1):
                b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2 ** 63, rng.integers(0, 3)).astype(np.uint64)]))
                common = len(np.intersect1d(a, b))
                if 100 * common >= 80 * (len(a) + len(b) - common) and len(np.setxor1d(a, b)):
                    keys = [set(ngram_join.join_keys(s, counts, boundary, 80).tolist()) for s in (a, b)]
                    assert keys[0] & keys[1]


def test_boundary_follows_the_cost():
    sizes = np.zeros(257, np.int64)
    sizes[10:100] = 50
    even, hot = np.full(ngram_join.CELLS, 20), np.full(ngram_join.CELLS, 20)
    hot[:2000] = 90_000
    low, high = (ngram_join.choose_boundary(sizes, c, 80) for c in (even, hot))
    assert low.boundary < high.boundary
    for chosen, scan_counts in ((low, even), (high, hot)):
        scan = float((scan_counts.astype(float) ** 2).sum()) / scan_counts.sum() / scan_counts.mean()
        others = [ngram_join.estimate(b, sizes, scan, 80) for b in range(1, 257)]
        assert chosen.subsets + chosen.scanned == min(o.subsets + o.scanned for o in others)


def test_join_edges(spark):
    long_text = " ".join(f"word{i % 977}x{i % 13}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE  two"), (6, long_text), (7, long_text),
            (None, long_text), (None, None), (8, "a b c d e f g h"), (8, "a b c d e f g h"), (9, "a b c d e f g h i")]
    df = spark.createDataFrame([r + (1, "k") for r in rows], DOCS + ", n int, key string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join_similar(df).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 12701, 6), (7, 12701, 6),
                          (None, 12701, 6), (None, 0, None), (8, 4, 8), (8, 4, 8), (9, 5, 8)], key=str)
    assert ngram_join.join_similar(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        ngram_join.join_similar(df, percent=50)


def test_a_large_family_and_a_shared_passage(spark):
    """Most texts share one long passage, and many are variants of one text."""
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(60))
    base = [f"w{i}" for i in range(100)]
    docs = []
    for i in range(500):
        if i % 2:
            words = list(base)
            for at in rng.sample(range(100), rng.choice([1, 2, 3])):
                words[at] = f"v{i}_{at}"
            docs.append((i, " ".join(words)))
        else:
            docs.append((i, passage + " " + " ".join(f"u{i}_{j}" for j in range(rng.choice([2, 5, 50])))))
    groups = brute.groups([t for _, t in docs], 80)
    got = {r.doc_id: r.component_id for r in ngram_join.join_similar(spark.createDataFrame(docs, DOCS)).collect()}
    assert [got[d] for d, _ in docs] == [docs[g][0] for g in groups]


def test_short_tables_are_few_files(spark, monkeypatch):
    files, save = [], Scratch.save

    def counted(self, df, name, *args, **more):
        saved = save(self, df, name, *args, **more)
        files.append((name, len(saved.inputFiles())))
        return saved
    monkeypatch.setattr(Scratch, "save", counted)
    docs = sorted(family(3, [30, 60], 12))
    settings = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        got = {r.doc_id: r.component_id for r in ngram_join.join_similar(spark.createDataFrame(docs, DOCS)).collect()}
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert [got[d] for d, _ in docs] == [docs[g][0] for g in brute.groups([t for _, t in docs], 80)]
    heavy = {"signed", "runs", "bits", "held", "links", "meets", "rest"}
    assert {name for name, n in files if n > 1} <= heavy


def test_sums_of_counts_do_not_depend_on_the_partitions(spark):
    docs = [(i, " ".join(f"w{(i * j) % 97}" for j in range(30))) for i in range(60)]
    df = spark.createDataFrame(docs, DOCS)
    one, many = (ngram_join.shingle_counts(df.repartition(n), 80) for n in (1, 40))
    assert all((a == b).all() for a, b in zip(one, many))
    hashes, total = WordHashes(), 0
    for _, text in docs:
        total += len(hashes.shingles(text.encode()))
    assert one[0].sum() == total and one[1].sum() == 60


def test_chosen_rows(spark):
    rows = spark.range(0, 200_000, 1, 5).selectExpr("id", "monotonically_increasing_id() AS rid", "'t' AS text")
    ids = rows.where("id % 3 = 1").select("rid")
    got = chosen_rows(rows, ids.unionByName(ids), Scratch(spark, "test"))
    assert sorted(r.id for r in got.collect()) == [i for i in range(200_000) if i % 3 == 1]
    assert got.columns == rows.columns
    assert re.search("BroadcastHashJoin", got._jdf.queryExecution().executedPlan().toString())


# ---------------------------------------------------------------- stretches of the packing curve

def test_stretches_are_not_capped():
    rng = random.Random(7)
    borders = sorted(rng.randrange(packing.LAST_KEY) for _ in range(4095))
    keys = sorted(rng.randrange(packing.LAST_KEY) for _ in range(60_000)) + [packing.LAST_KEY]
    for each in (1, 2, 25):
        stretches = [packing.stretch_of(k, borders, each) for k in keys]
        assert stretches == sorted(stretches) and 0 <= stretches[0] and stretches[-1] == 4096 * each - 1
        assert len(set(stretches)) > 0.4 * min(4096 * each, len(keys))
    assert packing.stretch_of(5, [], 1) == 0 and packing.stretch_of(packing.LAST_KEY, [], 9) == 8


def test_more_stretches_than_regions_pack_every_token(spark, monkeypatch):
    import public_tokenizers
    monkeypatch.setattr(packing, "PART_BYTES", 400)
    monkeypatch.setattr(packing, "REGIONS", 5)
    monkeypatch.setattr(packing, "TASKS", 7)
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "x"]) for _ in range(rng.randrange(1, 90))))
            for i in range(200)]
    docs += [(i, docs[0][1]) for i in range(200, 320)]     # many equal documents
    got = packing.pack_documents(spark.createDataFrame(docs, DOCS), public_tokenizers.path("byte_bpe_50k.json")).collect()
    pieces, filled = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert set(pieces) == {i for i, _ in docs}
    assert all(sum(p.length for p in v) == v[0].doc_tokens for v in pieces.values())
    assert len({s >> 32 for s in filled}) > 10 and max(filled.values()) <= 1024    # of five regions
