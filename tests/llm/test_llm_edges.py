"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing names, and parts."""

import itertools
import random
import re
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from codeset_engine.llm import (chat_format, decontamination, language_id, near_dup, packing, pii, quality,
                                sharding, toxicity, url_filters, verification)
from codeset_engine.llm.common import Scratch, pieces
from codeset_engine.llm.components import connected_components

TOKENS = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(60_000))
PASSAGE = "one two three four five six seven eight nine ten eleven twelve"
ROWS = [(1, "The quick brown fox and the dog are in the house of " + PASSAGE), (2, None), (3, ""), (4, " \n\t "),
        (5, LONG), (6, LONG), (None, LONG + " more"), (None, None), (7, "42 !!! 17"), (8, "mail a.b@c.org now"),
        (8, "mail a.b@c.org now"), (9, "É" * 3000 + " \U0001F600 ip 10.0.0.1 +1 (651) 555-8500")]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def messy(spark):
    clashing = ("n_words", "shard", "slot", "host", "id", "c", "key", "row", "rid", "group", "spans", "words", "n",
                "record", "others", "base", "u", "page", "size", "part", "label", "lang", "tie", "e")
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.select("*", *[F.lit(None).cast("string").alias(c) for c in clashing])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))


def test_decontamination(spark, messy, empty):
    items = spark.createDataFrame([(7, PASSAGE), (8, "nine ten"), (8, "nine ten"), (None, "the quick"), (9, None),
                                   (10, "..."), (11, "seven EIGHT, nine")], "item_id long, text string")
    found = decontamination.decontaminate(messy, items)
    assert found.columns == messy.columns + ["decontamination"]
    rows = [r["decontamination"] for r in by_id(found.drop("key"))]
    assert (rows[0]["n_hit"], rows[0]["items"], rows[0]["n_words"]) == (12, ["11", "7", "8"], 24)
    assert rows[0]["clean"] == "The quick brown fox and the dog are in the house of "
    assert all(not r["contaminated"] for r in rows[1:])
    assert [r["clean"] for r in rows[1:4]] == [None, "", " \n\t "]
    assert decontamination.decontaminate(empty, items).count() == 0
    none = decontamination.decontaminate(messy, spark.createDataFrame([], "item_id long, text string"))
    assert none.where("decontamination.contaminated").count() == 0


def test_decontamination_in_blocks_equals_brute_force(spark):
    rng = random.Random(3)
    vocabulary = "a b c d".split()
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 5, 12, 30, 200])))) for i in range(30)]
    items = [(i, t) for i, t in items if len(t) > 8] + [(99, "b")]
    docs = [(i, " ".join(rng.choices(vocabulary + ["zz"], k=80)) + " " + rng.choice(items)[1]) for i in range(60)]
    want = brute.contamination([t for _, t in docs], items)
    for block in (50, 10_000):
        got = by_id(decontamination.decontaminate(
            spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"),
            block_words=block))
        for r, (n, hit, found) in zip(got, want):
            r = r["decontamination"]
            assert (r["n_words"], r["n_hit"], r["items"]) == (n, len(hit), sorted(found))


def test_quality(messy, empty):
    judged = quality.judge(messy)
    assert judged.columns == messy.columns + ["quality"]
    rows = [r["quality"] for r in by_id(judged)]
    assert [r["n_words"] for r in rows[1:4]] == [0, 0, 0] and all(r["base_failed"] for r in rows[1:4])
    assert rows[4]["n_words"] == 60_000 and rows[4]["n_repeat_words"] == 60_000
    assert quality.judge(empty).count() == 0


def test_quality_counts_equal_brute_force(spark):
    rng = random.Random(5)
    docs = [(i, rng.choice(["", " ", "\n"]) + "".join(rng.choice("ab#") + rng.choice([" ", "\n", "  ", "\x0b", ""])
                                                        for _ in range(rng.randrange(60)))) for i in range(80)]
    for r in by_id(quality.judge(spark.createDataFrame(docs, SCHEMA))):
        text, q = dict(docs)[r["doc_id"]], r["quality"]
        words = text.split()
        places = {}
        for i in range(len(words) - 2):
            places.setdefault(tuple(words[i:i + 3]), []).append(i)
        repeated = {p for v in places.values() if len(v) > 1 for i in v for p in range(i, i + 3)}
        lines = [x for x in text.split("\n") if x.strip()]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == (
            len(words), sum(map(len, words)), text.count("#"), len(lines) - len(set(lines)), len(repeated))


def test_near_duplicates(messy, empty):
    got = by_id(near_dup.near_duplicates(messy))
    assert [(r["doc_id"], r["component_id"], r["kept"]) for r in got] == [
        (1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 5, True), (6, 5, False), (7, 7, True),
        (8, 8, True), (8, 8, True), (9, 9, True), (None, 5, False), (None, None, True)] or sorted(
        (str(r["doc_id"]), str(r["component_id"])) for r in got if r["doc_id"] is None) == [
        ("None", "5"), ("None", "None")]
    assert near_dup.near_duplicates(empty).count() == 0
    kept = near_dup.drop_near_duplicates(messy)
    assert kept.columns == messy.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "7", "8", "9", "None"]
    assert near_dup.drop_near_duplicates(empty).count() == 0


def test_near_duplicates_of_a_large_family(spark):
    """Variants of one text, of which many are only linked over others, need the exact blocks."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    docs = [(0, " ".join(base))]
    for i in range(1, 250):
        words = list(base)
        for at in rng.sample(range(120), rng.choice([1, 2, 4, 6, 8])):
            words[at] = f"v{i}_{at}"
        docs.append((i * 7 % 251 + 1000, " ".join(words)))
    docs = sorted(docs, key=lambda d: d[0])
    groups = brute.groups([t for _, t in docs])
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert [got[d] for d, _ in docs] == [docs[g][0] for g in groups]


def test_joining_links_equal_brute_force():
    rng = np.random.default_rng(2)
    base = np.arange(200, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(100, 200), replace=False),
                                      rng.integers(1000, 1100, 15).astype(np.uint64)])) for _ in range(60)]
    for often in (2, 16, 100):
        links = verification.joining_links(sets, list(range(60)), often)
        parent = list(range(60))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x
        for a, b in itertools.combinations(range(60), 2):
            if verification.similar(sets[a], sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
        want = {frozenset(i for i in range(60) if find(i) == r) for r in {find(i) for i in range(60)}}
        parent = list(range(60))
        for a, b in links:
            assert verification.similar(sets[a], sets[b]) and find(a) != find(b)
            parent[max(find(a), find(b))] = min(find(a), find(b))
        assert {frozenset(i for i in range(60) if find(i) == r) for r in {find(i) for i in range(60)}} == want


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (200, 5)]
    got = {r.node: r.root for r in connected_components(
        spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 0}
    none = spark.createDataFrame([], "a long, b long")
    assert connected_components(none, Scratch(spark, "test")).count() == 0


def test_language(spark, messy, empty):
    learn = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(
        [("the house and the dog of the town", "en"), ("das haus und der hund der stadt", "de"),
         (None, "fr"), ("la maison", None)] * 8)], "doc_id long, text string, lang string")
    model = language_id.train(learn, "text", "lang", "doc_id")
    assert model.languages == ["de", "en"]
    rows = [r["language"] for r in by_id(language_id.identify(messy, model))]
    assert rows[0]["lang_pred"] == "en"
    assert [r["lang_pred"] for r in rows[1:4]] == ["und"] * 3 and rows[6]["lang_pred"] == "und"
    assert language_id.identify(empty, model).count() == 0
    nothing = language_id.train(learn.limit(0), "text", "lang", "doc_id")
    assert {r["language"]["lang_pred"] for r in by_id(language_id.identify(messy, nothing))} == {"und"}


@pytest.mark.parametrize("n", [1, 2, 4, 6, 9, 30])
def test_codewords_differ(n):
    code = language_id.codewords(n).astype(int)
    assert code.shape[0] == n and len({tuple(r) for r in code}) == n


def test_toxicity(spark, messy, empty):
    docs = spark.createDataFrame([(i, f"plain words {i} here" + (" nastyword" * (i % 3 + 1) if i % 4 == 0 else ""))
                                  for i in range(200)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(None, 1), (5, None)],
                                   "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    got = by_id(toxicity.grade_toxicity(docs, model))
    assert all(r["toxicity"]["toxic"] == (r["doc_id"] % 4 == 0) for r in got)
    severe = {n: {round(r["toxicity"]["severity"], 6) for r in got if r["text"].count("nastyword") == n} for n in (1, 3)}
    assert max(severe[1]) < min(severe[3])
    assert not any(r["toxicity"]["toxic"] for r in by_id(toxicity.grade_toxicity(messy, model)))
    assert toxicity.grade_toxicity(empty, model).count() == 0
    nothing = toxicity.train(docs, labels.limit(0))
    assert {r["toxicity"]["severity"] for r in by_id(toxicity.grade_toxicity(docs, nothing))} == {0.0}


def test_personal_data(spark, messy, empty):
    found = pii.find_personal_data(messy)
    assert found.columns == messy.columns + ["personal"]
    rows = by_id(found)
    for r in rows:
        kinds = list(brute.BASE)
        assert [(s["start"], kinds.index(s["kind"]), s["end"]) for s in r["personal"]["base"]] == brute.personal(r["text"])
    assert rows[1]["personal"]["redacted"] is None and rows[2]["personal"]["redacted"] == ""
    assert rows[7]["personal"]["redacted"] == "mail [EMAIL] now"
    assert pii.find_personal_data(empty).count() == 0


def test_personal_data_equals_brute_force_on_odd_texts(spark):
    rng = random.Random(9)
    alphabet = ["@", ".", "..", "-", " ", "  ", "+", "(", ")", "a", "é", "\n", "1", "23", "4", "255", "256", "007",
                "a@b.c", "x@y", "1.2.3.4", "4111 1111 1111 1111", "4111111111111111", "+1 (651) 555-8500", "%"]
    docs = [(i, "".join(rng.choices(alphabet, k=rng.randrange(40)))) for i in range(400)]
    docs += [(1000, "1 " * 20_000), (1001, "1" * 20_000), (1002, "a" * 20_000 + "@"), (1003, "1.1.1.1 " * 400),
             (1004, "a@" + "b." * 100_000 + "c"), (1005, "\ufeffa@b.c " * 3)]
    kinds = list(brute.BASE)
    for r in by_id(pii.find_personal_data(spark.createDataFrame(docs, SCHEMA))):
        got = [(s["start"], kinds.index(s["kind"]), s["end"]) for s in r["personal"]["base"]]
        assert got == brute.personal(r["text"]), r["text"][:200]


def test_contacts_and_numbers_beyond_the_base_kinds_are_found(spark):
    planted = {"contact": ["anna{0} @ host{0}.org", "bob.{0}x (at) mail{0}.example", "eva{0}[AT]site{0}.net"],
               "number": ["(651) 555-{1}", "651-555-{1}", "123-45-{1}", "tel: 651 555 {1}"]}
    others = ["ab{0} @ noon{0}", "on 2024-10-{2} at", "part 12345{1} of", "mail a{0}@b{0}.org.", "+1 (651) 555-{1}"]
    docs, want = [], {}
    for i in range(600):
        kind = ("contact", "number", None)[i % 3]
        form = (planted.get(kind) or others)[i // 3 % len(planted.get(kind) or others)].format(i, 1000 + i, 10 + i % 20)
        docs.append((i, f"É words here {form} and more"))
        begin = docs[-1][1].index(form) + (5 if form.startswith("tel: ") else 0)
        want[i] = [(kind, begin, docs[-1][1].index(" and more"))] if kind else []
    for r in by_id(pii.find_personal_data(spark.createDataFrame(docs, SCHEMA))):
        base = r["personal"]["base"]
        added = [(s["kind"], s["start"], s["end"]) for s in r["personal"]["spans"] if s not in base]
        assert added == want[r["doc_id"]], r["text"]


def test_a_text_of_very_many_matches(spark):
    """Time grows with the text, and the redacted text has every piece between the spans."""
    words = [f"user{i}@host{i % 7}.example.org ÄÖ +1 (651) 555-{1000 + i % 9000}, 1.2.3.{i % 256}" for i in range(33_400)]
    text = " ".join(words)
    r = pii.find_personal_data(spark.createDataFrame([(1, text)], SCHEMA)).first().personal
    kinds = list(brute.BASE)
    assert [(s.start, kinds.index(s.kind), s.end) for s in r.base] == brute.personal(text)
    assert len(r.base) == 100_200 and set(map(tuple, r.base)) <= set(map(tuple, r.spans))
    assert r.redacted.startswith("[EMAIL] ÄÖ [PHONE]") and r.redacted.count("ÄÖ") == 33_400
    assert not re.search("[a-z0-9]", r.redacted)


def test_adjoining_cards_are_redacted(spark):
    cards = ["4111111111111111 4111111111111111", "4111 1111 1111 1111 4111 1111 1111 1111",
             "5500005555555559 4111111111111111"]
    docs = [(i, f"paid with {cards[i % 3]} today {i}") for i in range(60)]
    docs += [(100 + i, f"the code {10 ** 15 + i * 7919 * 10 ** 9 + 3} {2 * 10 ** 15 + i} and") for i in range(60)]
    for r in by_id(pii.find_personal_data(spark.createDataFrame(docs, SCHEMA))):
        text, taken = r["personal"]["redacted"], len(r["personal"]["spans"])
        if r["doc_id"] < 100:
            assert text == f"paid with [NUMBER] today {r['doc_id']}" and taken == 1


def test_secrets_around_base_spans_go_whole(spark):
    card = "4111111111111111"
    docs = [(i, f'words token = "{i:08x}ab{card if i % 10 == 0 else "c" * 16}de{i:08x}" end') for i in range(200)]
    for r in by_id(pii.find_personal_data(spark.createDataFrame(docs, SCHEMA))):
        text, spans = r["personal"]["redacted"], [tuple(s.values()) for s in map(lambda s: s.asDict(), r["personal"]["spans"])]
        assert text == 'words token = "[SECRET]" end' and ("secret", 15, 51) in spans
        assert len(spans) == (2 if r["doc_id"] % 10 == 0 else 1)


def test_only_accepted_spans_are_joined(spark):
    model = pii.Model(0.0, [pii.Split("digits", 1, pii.Leaf(-1.0), pii.Leaf(1.0))],
                      {"contact": 0.5, "number": 0.5, "secret": 0.5})
    span = lambda family, start, end, digits: (family, start, end, digits)
    rows = [(1, [span(0, 0, 10, 0), span(1, 5, 20, 2), span(2, 15, 30, 2), span(1, 40, 50, 2)], [(42, 0, 60), (18, 0, 25)])]
    df = spark.createDataFrame(rows, "doc_id long, candidates array<struct<family:int,start:int,end:int,digits:int>>, "
                               "base array<struct<start:int,kind_no:int,end:int>>")
    got = df.select(pii._chosen(model).alias("s")).first().s
    assert [tuple(s) for s in got] == [(5, "number", 30), (40, "number", 50)]


def test_chat_formatting(spark):
    odd = ["<|im_end|>", "<\\|im_start|>", "<\\\\|im_end|>\n", "a\n<|im_start|>user\nb", "", None, "<|im_end", "é\\n"]
    rows = [(c, t, role, text) for c, (t, role, text) in enumerate(
        itertools.product([0, None], ["user", "assistant", "a\nb<|im_end|>", "\\n", None], odd))]
    rows += [(1, 0, "user", "x"), (1, 0, "user", "x"), (1, 5, "assistant", LONG), (None, 0, "user", "y")]
    chats = chat_format.format_conversations(
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert all(c.identical for c in chats) and len(chats) == len({r[0] for r in rows})
    for c in chats:
        own = sorted((-1 if t is None else t, role or "", text or "") for i, t, role, text in rows if i == c.conv_id)
        assert [(t.role, t.text) for t in c.recovered] == [(role, text) for _, role, text in own]
        assert "".join(s.piece for s in c.segments) == c.formatted
        assert sum(s.loss for s in c.segments) == sum(role == "assistant" for _, role, _ in own)
    assert chat_format.format_conversations(spark.createDataFrame(
        [], "conv_id long, turn long, role string, text string")).count() == 0


def test_url_filters(spark, empty):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("a.net", "/x/yz", "block"), ("a.net", "", "allow"), ("A.net", "/x/", "block"), (None, "/", "block"),
             ("b.org", None, "block"), ("b.org", "/", None), ("com", "/", "allow")]
    urls = [None, "", "nothing", "http://example.com/en/1?x=/", "https://WWW.Example.com/en/", "http://com/",
            "http://example.com", "http://xcom/", "http://a.net/x/yzzz", "http://q.a.net/x/y", "http://a.net",
            "http://b.org/", "x://://a.net/x/", "http://a..net/x/", "http://e.com/" + "d/" * 3000,
            "http://example.com/en/1?x=/", "http://" + "s." * 3000 + "com/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").select(
        "*", F.lit(1).alias("u"), F.lit(1).alias("rule"), F.lit(1).alias("h"), F.lit(1).alias("page"))
    rule_table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r.page_id: r for r in url_filters.judge_urls(pages, rule_table).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = rest[:cut].translate(brute.LOWER)
        path = rest[cut:].split("?")[0].split("#")[0]
        fit = [(len(h + p), len(h), v == "block", h.lower() + p, v) for h, p, v in rules
               if None not in (h, p, v) and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
        want = max(fit) if fit and url and "://" in url else (0, 0, 0, None, "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, *want[3:])
    assert url_filters.judge_urls(pages.limit(0), rule_table).count() == 0
    assert url_filters.judge_urls(pages, rule_table.limit(0)).where("verdict <> 'allow' OR rule IS NOT NULL").count() == 0


def test_sharding(messy, empty):
    records = messy.withColumn("bytes", F.octet_length("text").cast("long"))
    placed = sharding.shuffle_into_shards(records, "doc_id", "bytes", shards=3, bucket_rows=2)
    assert sorted(placed.columns) == sorted(records.columns)
    rows = placed.collect()
    assert len(rows) == len(ROWS)
    for shard in range(3):
        own = [r.slot for r in rows if r.shard == shard]
        assert sorted(own) == list(range(len(own)))
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
    assert sharding.shuffle_into_shards(empty.withColumn("bytes", F.lit(1)), "doc_id", "bytes").count() == 0


def test_a_shard_of_one_hot_key_has_buckets_of_bounded_size(spark):
    records = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit(10).cast("long").alias("bytes"))
    rows = sharding.shuffle_into_shards(records, "doc_id", "bytes", shards=4, bucket_rows=50).collect()
    hot = [r for r in rows if r.shard == next(r.shard for r in rows if r.doc_id is None)]
    assert len(hot) > 1000 and sorted(r.slot for r in hot) == list(range(len(hot))) and len(rows) == 3000
    places = [r.slot for r in hot if r.doc_id is not None]
    assert max(places) - min(places) > len(hot) * 0.8   # mixed with the copies


def test_packing(messy, empty):
    rows = packing.pack_documents(messy, TOKENS).collect()
    assert sum(r.start == 0 for r in rows) == len(ROWS)
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
    assert {r.doc_tokens for r in rows if r.doc_id in (2, 3)} == {1}
    assert packing.pack_documents(empty, TOKENS).count() == 0


def test_tokens_equal_the_tokenizer():
    from tokenizers import Tokenizer
    tokenizer, own, rng = Tokenizer.from_file(TOKENS), packing.Tokens(TOKENS), random.Random(4)
    alphabet = [" ", "  ", "\n", "\t", "\x0b", "\x1c", "\u00a0", "\u3000", "a", "I'm", "'s", "é", "12", "!?", "<|endoftext|>",
                "\U0001F600", "word", "\x85", "\u200b", "."]
    for _ in range(3000):
        text = "".join(rng.choices(alphabet, k=rng.randrange(1, 12)))
        assert np.frombuffer(own.encode(text), "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_long_white_space_is_encoded():
    from tokenizers import Tokenizer
    text = "a" + " " * 3_000_000 + "b"
    assert np.frombuffer(packing.Tokens(TOKENS).encode(text), "<u2").tolist() == Tokenizer.from_file(TOKENS).encode(
        text, add_special_tokens=False).ids


def test_words_that_never_repeat_cost_what_the_encoder_takes():
    own = packing.Tokens(TOKENS)
    texts = [" ".join(f"x{i * 1000 + j:b}"[:12] + f"{i * j}" for j in range(1000)) for i in range(300)]

    def seconds(encode):
        started = time.process_time()
        for text in texts:
            encode(text)
        return time.process_time() - started
    seconds(own.encode)
    assert min(seconds(own.encode) for _ in range(3)) < 1.5 * min(seconds(own.encoder.encode_ordinary) for _ in range(3))


def test_hilbert_neighbours_touch():
    for n, bits in ((2, 3), (3, 2)):
        grid = list(itertools.product(range(1 << bits), repeat=n))
        places = packing.hilbert_index(np.array(grid), bits).tolist()
        order = [p for _, p in sorted(zip(places, grid))]
        assert sorted(places) == list(range(len(grid)))
        assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(order, order[1:]))


def test_a_batch_is_taken_in_pieces_of_bounded_size():
    texts = pa.array(["word " * 10] * 3000 + [None, "x" * (3 << 20), ""])
    parts = list(pieces(iter([(texts, pa.array(range(3003)))])))
    assert all(len(text) <= 500 and (len(text) == 1 or text.nbytes <= 1 << 20) for text, _ in parts)
    assert pa.chunked_array([text for text, _ in parts]).to_pylist() == texts.to_pylist()
    assert [n for _, numbers in parts for n in numbers.to_pylist()] == list(range(3003))
    assert [len(part) for part in pieces(iter([texts.slice(0, 0)]))] == [0]
    signed = list(near_dup._signer(2)(iter([texts])))
    assert sum(map(len, signed)) == 3003 and max(map(len, signed)) <= 500


def test_no_plan_of_the_near_duplicate_step_has_many_exchanges(spark, monkeypatch):
    shuffles, save = [], Scratch.save

    def counted(self, df, *args, **kwargs):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        shuffles.append(len(re.findall(r"SortMergeJoin|ShuffledHashJoin|BroadcastHashJoin|HashAggregate|SortAggregate", plan)))
        return save(self, df, *args, **kwargs)
    monkeypatch.setattr(Scratch, "save", counted)
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 3, 40))) for i in range(9)], "doc_id long, text string")
    assert {r.component_id for r in near_dup.near_duplicates(docs).collect()} == {0}
    assert len(shuffles) > 10 and max(shuffles) <= 16, shuffles
