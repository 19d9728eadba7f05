"""Search queries over documents and embeddings.

Requests are the mean vectors of the labels, derived from the whole embeddings table, with a
fixed search word each; the corpus is every embedding and every document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ... import schemas
from ...functions import responses
from ...functions.strings import WHITESPACE_CLASS
from ...operators import cells, embed, grams, ranking, search
from ...session import checkpoint_root
from .registry import ctes, derived, int_rank, query, read, read_spread

WORDS = ("tion", "que", "der", "the", "and", "ion", "est", "ent", "ing", "sch")
KEYWORDS = ("tion", "que ", "NICHT", "the", "la ", ". on", "ß", "@")

REQUESTS_SQL = """
parts AS (SELECT label AS qid, unnest(embedding)::DOUBLE AS c,
                 generate_subscripts(embedding, 1) AS i FROM embeddings),
means AS (SELECT qid, i, avg(c) AS m FROM parts GROUP BY qid, i),
requests AS (SELECT qid, list(m ORDER BY i) AS vector FROM means GROUP BY qid),
semantic AS (SELECT qid, vec_id, label,
    round(list_cosine_similarity(embedding::DOUBLE[], vector), 9) AS similarity
    FROM embeddings CROSS JOIN requests)"""
KEYWORD_SQL = f"""
keyword AS (SELECT qid, doc_id, round(
    ((length(lower(text)) - length(replace(lower(text), lower(query), ''))) / length(query))::BIGINT
    / len(regexp_extract_all(lower(text), '[^{WHITESPACE_CLASS}]+'))::DOUBLE, 9) AS score
    FROM documents CROSS JOIN words WHERE contains(lower(text), lower(query)))"""


def _words_sql(words: tuple[str, ...]) -> str:
    return ("words AS (SELECT * FROM (VALUES "
            + ", ".join(f"({i}, '{w}')" for i, w in enumerate(words)) + ") AS t(qid, query))")


def _word(qid) -> F.Column:
    return F.element_at(F.array(*[F.lit(w) for w in WORDS]), qid + 1)


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.label_centroids(read(spark, sf_dir, "embeddings"), "label", "embedding")


def _rounded(hits: DataFrame, *names: str) -> DataFrame:
    for name in names:
        hits = hits.withColumn(name, F.round(name, 6))
    return hits


@query("semantic_topk", int_rank(f"""WITH {REQUESTS_SQL}
SELECT qid, vec_id, round(similarity, 6) AS similarity,
       row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, vec_id) AS rank
FROM semantic QUALIFY rank <= 10"""))
def semantic_topk(spark, sf_dir):
    hits = search.semantic_topk(read(spark, sf_dir, "embeddings"), _requests(spark, sf_dir), 10,
                                id_col="vec_id", vector_col="embedding")
    return _rounded(hits, "similarity")


@query("semantic_neighbours", int_rank("""WITH pairs AS (SELECT q.vec_id AS qid, c.vec_id,
    round(list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS similarity
    FROM embeddings q CROSS JOIN embeddings c)
SELECT qid, vec_id, round(similarity, 6) AS similarity,
       row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, vec_id) AS rank
FROM pairs QUALIFY rank <= 3"""))
def semantic_neighbours(spark, sf_dir):
    """Every embedding as a request."""
    vectors = read(spark, sf_dir, "embeddings")
    requests = vectors.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    return _rounded(search.semantic_topk(vectors, requests, 3, id_col="vec_id", vector_col="embedding"), "similarity")


def _cell_index(spark, sf_dir) -> str:
    path = f"{checkpoint_root(spark)}/cells-{uuid.uuid4().hex}"
    cells.build_cells(read(spark, sf_dir, "embeddings"), path, id_col="vec_id", vector_col="embedding")
    return path


@query("semantic_topk_cells", int_rank(f"""WITH {REQUESTS_SQL}
SELECT qid, vec_id, round(similarity, 6) AS similarity,
       row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, vec_id) AS rank
FROM semantic QUALIFY rank <= 10"""))
def semantic_topk_cells(spark, sf_dir):
    """The same hits through stored cells."""
    hits = cells.search_cells(spark, _cell_index(spark, sf_dir), _requests(spark, sf_dir), 10, id_col="vec_id")
    return _rounded(hits, "similarity")


@query("semantic_neighbours_cells", int_rank("""WITH pairs AS (SELECT q.vec_id AS qid, c.vec_id,
    round(list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS similarity
    FROM embeddings q CROSS JOIN embeddings c)
SELECT qid, vec_id, round(similarity, 6) AS similarity,
       row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, vec_id) AS rank
FROM pairs QUALIFY rank <= 3"""))
def semantic_neighbours_cells(spark, sf_dir):
    """Every embedding as a request, through stored cells."""
    requests = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    return _rounded(cells.search_cells(spark, _cell_index(spark, sf_dir), requests, 3, id_col="vec_id"), "similarity")


@query("semantic_topk_filtered", int_rank(f"""WITH {REQUESTS_SQL}
SELECT qid, vec_id, round(similarity, 6) AS similarity,
       row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, vec_id) AS rank
FROM semantic WHERE label = 3 QUALIFY rank <= 10"""))
def semantic_topk_filtered(spark, sf_dir):
    hits = search.semantic_topk(read(spark, sf_dir, "embeddings"), _requests(spark, sf_dir), 10,
                                id_col="vec_id", vector_col="embedding", where=F.col("label") == 3)
    return _rounded(hits, "similarity")


@query("semantic_topk_per_type", int_rank(f"""WITH {REQUESTS_SQL}
SELECT qid, label, vec_id, round(similarity, 6) AS similarity,
       row_number() OVER (PARTITION BY qid, label ORDER BY similarity DESC, vec_id) AS rank
FROM semantic QUALIFY rank <= 5"""))
def semantic_topk_per_type(spark, sf_dir):
    hits = search.semantic_topk(read(spark, sf_dir, "embeddings"), _requests(spark, sf_dir), 5,
                                id_col="vec_id", vector_col="embedding", per=["label"])
    return _rounded(hits, "similarity")


@query("similarity_threshold", int_rank(f"""WITH {REQUESTS_SQL}
SELECT qid, vec_id, round(similarity, 6) AS similarity, round(1 - (1 - similarity), 6) AS from_distance,
       row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, vec_id) AS rank
FROM semantic WHERE similarity >= 0.3 QUALIFY rank <= 20"""))
def similarity_threshold(spark, sf_dir):
    hits = search.semantic_topk(read(spark, sf_dir, "embeddings"), _requests(spark, sf_dir), 20,
                                id_col="vec_id", vector_col="embedding",
                                threshold=0.3)
    distance = 1 - F.col("similarity")
    return _rounded(hits.withColumn("from_distance", search.distance_to_similarity(distance)),
                    "similarity", "from_distance")


KEYWORD_TOPK_SQL = int_rank(f"""WITH {_words_sql(KEYWORDS)}, {KEYWORD_SQL}
SELECT qid, doc_id, round(score, 6) AS score,
       row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank
FROM keyword QUALIFY rank <= 20""")


@query("keyword_topk", KEYWORD_TOPK_SQL)
def keyword_topk(spark, sf_dir):
    requests = spark.createDataFrame(list(enumerate(KEYWORDS)), "qid int, query string")
    hits = search.keyword_topk(read_spread(spark, sf_dir, "documents", "doc_id", "text"), requests, 20, id_col="doc_id",
                               text_col="text")
    return _rounded(hits, "score")


HYBRID_SQL = int_rank(f"""WITH {REQUESTS_SQL}, {_words_sql(WORDS)}, {KEYWORD_SQL},
s AS (SELECT qid, vec_id AS doc_id, similarity FROM semantic
      QUALIFY row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, vec_id) <= 20),
k AS (SELECT qid, doc_id, score FROM keyword
      QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) <= 20),
merged AS (SELECT qid, doc_id, coalesce(similarity, 0.0) AS semantic_score,
                  coalesce(score, 0.0) AS keyword_score FROM s FULL OUTER JOIN k USING (qid, doc_id)),
scored AS (SELECT *, round(0.7::DOUBLE * semantic_score + 0.3::DOUBLE * keyword_score, 9) AS h FROM merged)
SELECT qid, doc_id, round(semantic_score, 6) AS semantic_score, round(keyword_score, 6) AS keyword_score,
       round(h, 6) AS hybrid_score,
       row_number() OVER (PARTITION BY qid ORDER BY h DESC, doc_id) AS rank
FROM scored QUALIFY rank <= 10""")


@query("hybrid_search", HYBRID_SQL)
def hybrid_search(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    requests = _requests(spark, sf_dir).withColumn("query", _word(F.col("qid")))
    hits = search.hybrid_topk(vectors, read_spread(spark, sf_dir, "documents", "doc_id", "text"), requests, 10,
                              id_col="doc_id", vector_col="embedding", text_col="text")
    return _rounded(hits, "semantic_score", "keyword_score", "hybrid_score")


def _gram_index(spark, sf_dir) -> str:
    path = f"{checkpoint_root(spark)}/grams-{uuid.uuid4().hex}"
    texts = read_spread(spark, sf_dir, "documents", "doc_id", "text")
    odd = F.col("doc_id") % 2 == 1
    grams.build_grams(texts.where(~odd), path, id_col="doc_id", text_col="text")
    grams.build_grams(texts.where(odd), path, id_col="doc_id", text_col="text", append=True)
    return path


@query("keyword_topk_grams", KEYWORD_TOPK_SQL)
def keyword_topk_grams(spark, sf_dir):
    """The same hits through stored postings, built in two batches."""
    requests = spark.createDataFrame(list(enumerate(KEYWORDS)), "qid int, query string")
    return _rounded(grams.search_grams(spark, _gram_index(spark, sf_dir), requests, 20, id_col="doc_id"), "score")


@query("hybrid_search_indexed", HYBRID_SQL)
def hybrid_search_indexed(spark, sf_dir):
    """Hybrid search through cells and postings."""
    asked = _requests(spark, sf_dir)
    semantic = cells.search_cells(spark, _cell_index(spark, sf_dir), asked, 20, id_col="vec_id")
    keyword = grams.search_grams(spark, _gram_index(spark, sf_dir), asked.select("qid", _word(F.col("qid")).alias("query")),
                                 20, id_col="doc_id")
    hits = search.weigh_hits(semantic.withColumnRenamed("vec_id", "doc_id"), keyword, 10, "doc_id")
    return _rounded(hits, "semantic_score", "keyword_score", "hybrid_score")


@query("code_lookup", """SELECT o_orderkey AS qid, o_orderkey AS code, p_name AS description,
       p_partkey IS NOT NULL AS found
FROM orders LEFT JOIN part ON o_orderkey = p_partkey""")
def code_lookup(spark, sf_dir):
    codes = read(spark, sf_dir, "part").selectExpr("p_partkey AS code", "p_name AS description")
    requests = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS qid", "o_orderkey AS code")
    return search.lookup_codes(codes, requests, ["code"])


_ENTRY = """code || ': ' || coalesce(description, '') || ' [' || collection_type || ']'"""
_COLLECTION_CODES = """codes AS (SELECT lpad(CAST(p_partkey AS STRING), 6, '0') AS code, p_name AS description,
    lower(p_type) AS collection_type, CASE WHEN p_size < 10 THEN NULL ELSE p_brand END AS category,
    p_size % 2 = 0 AS is_billable, CAST(2020 + p_size % 5 AS INT) AS year FROM part)"""


def _collection_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").selectExpr(
        "lpad(CAST(p_partkey AS STRING), 6, '0') AS code", "p_name AS description",
        "lower(p_type) AS collection_type",
        "CASE WHEN p_size < 10 THEN NULL ELSE p_brand END AS category",
        "p_size % 2 = 0 AS is_billable", "CAST(2020 + p_size % 5 AS INT) AS year",
        "lower(p_type) AS code_type")


@query("embedding_text", f"""WITH {_COLLECTION_CODES}
SELECT collection_type || '_' || CAST(year AS STRING) || '_' || code AS id,
       'medical_codes_' || collection_type || '_' || CAST(year AS STRING) AS collection,
       {_ENTRY} AS document FROM codes""")
def embedding_text(spark, sf_dir):
    return embed.code_entries(_collection_codes(spark, sf_dir)).select(
        "id", "collection", "document")


@query("entry_metadata", f"""WITH {_COLLECTION_CODES}
SELECT collection_type || '_' || CAST(year AS STRING) || '_' || code AS id, key, value FROM (
  SELECT codes.*, unnest(['code', 'description', 'code_type', 'year', 'category', 'is_billable']) AS key,
         unnest([code, description, collection_type, CAST(year AS STRING), category,
                 CASE WHEN is_billable THEN 'True' ELSE 'False' END]) AS value FROM codes)
WHERE value IS NOT NULL""")
def entry_metadata(spark, sf_dir):
    entries = embed.code_entries(_collection_codes(spark, sf_dir),
                                 ["code_type", "category", "is_billable"])
    return entries.select("id", F.explode("metadata").alias("key", "value"))


@query("incremental_insert", f"""WITH {_COLLECTION_CODES},
stored AS (SELECT DISTINCT lpad(CAST(l_orderkey AS STRING), 6, '0') AS code FROM lineitem)
SELECT collection_type || '_' || CAST(year AS STRING) || '_' || code AS id, {_ENTRY} AS document
FROM codes ANTI JOIN stored USING (code)""")
def incremental_insert(spark, sf_dir):
    """Order numbers of all lines play the codes that are stored already."""
    entries = embed.code_entries(_collection_codes(spark, sf_dir))
    stored = read(spark, sf_dir, "lineitem").selectExpr("lpad(CAST(l_orderkey AS STRING), 6, '0') AS code")
    return embed.only_new(entries, stored, "code").select("id", "document")


@query("collection_counts", f"""WITH {_COLLECTION_CODES}
SELECT 'medical_codes_' || collection_type || '_' || CAST(year AS STRING) AS collection, count(*) AS count
FROM codes GROUP BY 1""")
def collection_counts(spark, sf_dir):
    from ...sources.tables import collection_counts as counts
    return counts(embed.code_entries(_collection_codes(spark, sf_dir)))


@query("collection_stats", f"""WITH {_COLLECTION_CODES},
counts AS (SELECT collection_type, year, count(*) AS n FROM codes GROUP BY ALL),
asked AS (SELECT DISTINCT lower(p_type) AS code_type, CAST(2018 + p_size % 9 AS INT) AS year FROM part)
SELECT code_type, asked.year, 'medical_codes_' || code_type || '_' || asked.year AS collection, n IS NOT NULL AS exists,
    coalesce(n, 0) AS count FROM asked LEFT JOIN counts ON code_type = collection_type AND asked.year = counts.year""")
def collection_stats(spark, sf_dir):
    """Stored and absent collections of all types over nine years."""
    from ...sources.tables import collection_stats as stats
    asked = read(spark, sf_dir, "part").selectExpr(
        "lower(p_type) AS code_type", "CAST(2018 + p_size % 9 AS INT) AS year").distinct()
    return stats(embed.code_entries(_collection_codes(spark, sf_dir)), asked)


@query("metadata_filter", f"""WITH {_COLLECTION_CODES}
SELECT collection_type || '_' || CAST(year AS STRING) || '_' || code AS id, {_ENTRY} AS document FROM codes
WHERE is_billable AND category IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY collection_type, year ORDER BY id) <= 3""")
def metadata_filter(spark, sf_dir):
    """The first three billable entries with a category of each collection, without a vector."""
    entries = embed.code_entries(_collection_codes(spark, sf_dir), ["code_type", "category", "is_billable"])
    where = (F.col("metadata")["is_billable"] == "True") & F.col("metadata")["category"].isNotNull()
    return search.filter_entries(entries, where, 3, ["collection"]).select("id", "document")


_RERANKED = """'```json' || chr(10) || '{"reranked_codes": [{"code": "C' || lpad(CAST(event_id % 500 AS STRING), 3, '0')
    || '", "description": "' || event_type || '", "relevance_score": ' || CAST(value AS STRING) || ', "reasoning": "r"}, {"code": "X"}]}'
    || chr(10) || '```'"""


@query("rerank_responses", int_rank("""WITH scores AS (SELECT event_type AS session, 'C' || lpad(CAST(event_id % 500 AS STRING), 3, '0') AS code,
    max(value) AS relevance_score FROM events GROUP BY ALL),
candidates AS (SELECT event_type AS session, 'C' || lpad(CAST(user_id % 600 AS STRING), 3, '0') AS code, count(*) AS n FROM events GROUP BY ALL)
SELECT session, code, n, round(relevance_score, 6) AS relevance_score,
    row_number() OVER (PARTITION BY session ORDER BY relevance_score DESC, code) AS new_rank
FROM candidates JOIN scores USING (session, code) QUALIFY new_rank <= 5""", "new_rank"))
def rerank_responses(spark, sf_dir):
    """Candidates re-ordered by the scores in the responses of a model."""
    events = read(spark, sf_dir, "events")
    parsed = events.select(F.col("event_type").alias("session"), F.inline(responses.parse_response(
        F.expr(_RERANKED), schemas.RERANK_RESPONSE)["reranked_codes"]))
    scores = (parsed.where("relevance_score IS NOT NULL").groupBy("session", "code")
              .agg(F.max("relevance_score").alias("relevance_score")))
    candidates = events.selectExpr("event_type AS session", "'C' || lpad(CAST(user_id % 600 AS STRING), 3, '0') AS code").groupBy(
        "session", "code").agg(F.count(F.lit(1)).alias("n"))
    return _rounded(ranking.apply_rerank(candidates, scores, ["session"]), "relevance_score")


@query("embed_hash", r"""WITH tokens AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS token FROM documents),
buckets AS (SELECT doc_id, CAST(CAST('0x' || left(md5(token), 8) AS UBIGINT) % 64 AS INT) AS bucket, count(*) AS n
    FROM tokens WHERE token <> '' GROUP BY ALL)
SELECT doc_id, bucket, CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS FLOAT) AS DOUBLE) AS weight FROM buckets""")
def embed_hash(spark, sf_dir):
    """All components other than 0 of the hashed vectors."""
    vectors = embed.hashing_embed(read_spread(spark, sf_dir, "documents", "doc_id", "text"), "text", 64)
    parts = vectors.select("doc_id", F.posexplode("embedding").alias("bucket", "weight"))
    return parts.where("weight <> 0").select("doc_id", "bucket", F.col("weight").cast("double").alias("weight"))


@query("rerank", int_rank(f"""{ctes('suggested')},
best AS (SELECT session, code, max(confidence) AS relevance_score FROM suggested GROUP BY ALL),
parts AS (SELECT session, code, count(*) AS n FROM suggested WHERE kind = 'diagnosis' GROUP BY ALL)
SELECT session, code, n, round(relevance_score, 6) AS relevance_score,
       row_number() OVER (PARTITION BY session ORDER BY relevance_score DESC, code) AS new_rank
FROM parts JOIN best USING (session, code) QUALIFY new_rank <= 5""", "new_rank"))
def rerank(spark, sf_dir):
    suggested = derived(spark, sf_dir, "suggested")
    scores = suggested.groupBy("session", "code").agg(F.max("confidence").alias("relevance_score"))
    candidates = (suggested.filter("kind = 'diagnosis'").groupBy("session", "code")
                  .agg(F.count(F.lit(1)).alias("n")))
    return _rounded(ranking.apply_rerank(candidates, scores, ["session"]), "relevance_score")


@query("suggestion_cap", int_rank(f"""{ctes('suggested')}
SELECT doc_id, kind, event_id, code, round(confidence, 6) AS confidence,
       row_number() OVER (PARTITION BY doc_id, kind ORDER BY confidence DESC, code, event_id) AS rank
FROM suggested QUALIFY rank <= 5"""))
def suggestion_cap(spark, sf_dir):
    suggested = derived(spark, sf_dir, "suggested").select("doc_id", "kind", "event_id", "code",
                                                           "confidence")
    return _rounded(ranking.cap_suggestions(suggested, ["doc_id", "kind"], then=["event_id"]),
                    "confidence")


@query("context_budget", int_rank("""WITH ranked AS (SELECT source, doc_id, length(text) AS text_length,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank,
    sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used
    FROM documents WHERE length(text) > 0)
SELECT source, doc_id, text_length, rank, CAST(used AS BIGINT) AS used FROM ranked WHERE used <= 8000"""))
def context_budget(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("source", "doc_id", "text")
    return ranking.context_budget(docs, ["source"], [F.asc("doc_id")],
                                  salt_on=["doc_id"]).drop("text")
