"""Semantic, keyword and hybrid top-k for many requests in one plan, with one corpus scan.

Requests whose measured size is small go to the corpus tasks as one broadcast value, so that the
corpus is neither shuffled nor paired row by row with them. Any larger set of requests streams
past blocks of the corpus: both are dealt out by block once, and each task holds one block while
copies of the requests pass by. Ties are broken by id.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .ranking import top_k

# Default result sizes, weights and threshold.
TOP_K = 10
TOP_K_PER_TYPE = 5
KEYWORD_TOP_K = 20
SEMANTIC_WEIGHT, KEYWORD_WEIGHT = 0.7, 0.3
SIMILARITY_THRESHOLD = 0.7

BROADCAST_BYTES = 8 << 20   # measured size of the requests up to which they are broadcast
BLOCK_BYTES = 64 << 20      # what a task holds of the corpus at once when requests stream past it
SCORES = 2 << 20           # scores that a task holds at once
TILE_ROWS = 4096           # rows of the corpus that are compared at once, with as many requests as SCORES allows
TILE_BYTES = 4 << 20       # and the bytes of their values: texts are held several times while they are searched
MARK = "\0"            # between the texts that are searched as one
DECIMALS = 9          # scores are rounded so that ranks do not depend on summation order


def check_weights(semantic: float, keyword: float) -> None:
    """The two weights must add up to one (within a hundredth)."""
    total = semantic + keyword
    if not 0.99 <= total <= 1.01:
        raise ValueError(f"Search weights must sum to 1.0. Got: {total}")


def by_length(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Unit vectors of an Arrow list column by dimension: (positions, matrix) of those with a direction."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    found = {}
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        vectors = np.asarray(column.take(pa.array(rows)).flatten(), np.float64).reshape(len(rows), size)
        lengths = np.linalg.norm(vectors, axis=1)
        usable = np.isfinite(lengths) & (lengths > 0)
        if usable.any():
            found[size] = rows[usable], vectors[usable] / lengths[usable, None]
    return found


def unit_vectors(vectors: list) -> tuple:
    """Request vectors of unit length: their number, and (positions, matrix) by dimension."""
    return len(vectors), by_length(pa.array(vectors, pa.list_(pa.float64())))


class Scorer(NamedTuple):
    """``load`` makes of a column of corpus values what ``score`` compares with prepared requests.

    Scores are a (requests x rows) array in which NaN marks rows that are no hit.
    """

    load: Callable
    score: Callable


def cosine(threshold: float | None) -> Scorer:
    """Matrix products of request and corpus vectors of the same length."""

    def score(requests: tuple, corpus: tuple) -> np.ndarray:
        (n, asked), (rows, held) = requests, corpus
        scores = None
        for size in asked.keys() & held.keys():
            (positions, matrix), (places, vectors) = asked[size], held[size]
            found = matrix @ vectors.T
            np.round(found, DECIMALS, out=found)
            if found.shape == (n, rows):
                scores = found
                break
            scores = np.full((n, rows), np.nan) if scores is None else scores
            scores[np.ix_(positions, places)] = found
        if scores is None:
            return np.full((n, rows), np.nan)
        if threshold is not None:
            scores[scores < threshold] = np.nan
        return scores

    return Scorer(lambda column: (len(column), by_length(column)), score)


def _joined_texts(column: pa.Array) -> tuple[list[str], str, np.ndarray]:
    """Lower-cased texts, all of them as one with a mark between them, and where each starts in it."""
    texts = [text.lower() for text in column.to_pylist()]
    return texts, MARK.join(texts), np.cumsum([0] + [len(text) + 1 for text in texts])


def _keyword_density(needles: list[str], corpus: tuple) -> np.ndarray:
    """Scores of joined texts: occurrences per whitespace token of the text.

    The texts are searched as one, with a mark between them that no text holds across.
    """
    texts, joined, starts = corpus
    scores = np.full((len(needles), len(texts)), np.nan)
    tokens: dict[int, float] = {}
    for q, needle in enumerate(needles):
        if MARK in needle:
            counts = np.array([text.count(needle) for text in texts], dtype=np.int64)
        else:
            places = np.fromiter((m.start() for m in re.finditer(re.escape(needle), joined)), np.int64)
            counts = np.bincount(np.searchsorted(starts, places, side="right") - 1, minlength=len(texts))
        for row in np.flatnonzero(counts).tolist():
            if row not in tokens:   # a text of whitespace only has no tokens, and a match in it no score
                tokens[row] = len(texts[row].split()) or np.nan
            scores[q, row] = counts[row] / tokens[row]
    return np.round(scores, DECIMALS)


DENSITY = Scorer(_joined_texts, _keyword_density)


def tiles(batches: Iterable[pa.RecordBatch], value: int = 1) -> Iterator[pa.RecordBatch]:
    """Parts of batches of at most ``TILE_ROWS`` rows and, but for a longer value, ``TILE_BYTES``."""
    for batch in batches:
        column, start = batch.column(value), 0
        while start < batch.num_rows:
            end = min(start + TILE_ROWS, batch.num_rows)
            while end > start + 1 and column.slice(start, end - start).nbytes > TILE_BYTES:
                end = start + (end - start) // 2
            yield batch.slice(start, end - start)
            start = end


def chunks(n: int) -> list[slice]:
    """Slices of ``n`` requests so that their scores with a tile are bounded."""
    size = max(1, SCORES // TILE_ROWS)
    return [slice(at, at + size) for at in range(0, n, size)]


class Best:
    """The k best (score desc, id asc) of each of ``n`` requests among all rows that it is shown."""

    def __init__(self, n: int, k: int, least: np.ndarray | None = None):
        self.n, self.k = n, k
        self.least = np.full(n, -np.inf) if least is None else least   # scores below are of no use
        self.held: tuple[np.ndarray, ...] | None = None     # request, score, id
        self.new: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def show(self, requests: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take what is needed of a (requests x rows) array."""
        least, some = self.least[requests], scores[:, :16 * self.k + 256]
        fresh = np.flatnonzero(np.isneginf(least)) if some.shape[1] < scores.shape[1] else []
        if len(fresh):      # the k-th of some rows bounds the k-th of all; NaN where fewer than k are hits
            kth = -np.partition(-some[fresh], self.k - 1, axis=1)[:, self.k - 1]
            least[fresh] = np.where(np.isnan(kth), -np.inf, kth)
        at, place = np.nonzero(scores >= least[:, None])
        if not len(at):
            return
        self.new.append((requests[at], scores[at, place], ids[place]))
        self.waiting += len(at)
        if self.waiting > SCORES // 2:
            self.settle()

    def settle(self) -> None:
        """Keep the k best of what is held and new; a k-th score bounds what may still come."""
        if not self.new:
            return
        parts = self.new if self.held is None else [self.held, *self.new]
        at, scores, ids = (np.concatenate(column) for column in zip(*parts))
        order = np.lexsort((ids, -scores, at))
        at, scores, ids = at[order], scores[order], ids[order]
        counts = np.bincount(at, minlength=self.n)
        ends = np.cumsum(counts)
        keep = np.arange(len(at)) - (ends - counts)[at] < self.k
        full = counts >= self.k
        self.least[full] = np.maximum(self.least[full], scores[(ends - counts)[full] + self.k - 1])
        self.held, self.new, self.waiting = (at[keep], scores[keep], ids[keep]), [], 0


def ids_of(batch: pa.RecordBatch) -> np.ndarray:
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    return ids.astype(str) if ids.dtype == object else ids


def hit_rows(best: Best, qids: pa.Array, key: tuple, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """What ``best`` has found, as rows (qid, id, score, key...)."""
    best.settle()
    if best.held is not None:
        at, scores, ids = best.held
        columns = [qids.take(pa.array(at)), ids, scores, *([part] * len(at) for part in key)]
        yield pa.RecordBatch.from_arrays(
            [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def _best(qids: pa.Array, requests: list, batches: Iterable[pa.RecordBatch], scorer: Scorer, k: int,
          n_groups: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The k best rows per request and group over all ``batches``; ``requests`` are prepared by chunk.

    Scores are held of a chunk and a tile at once. At most k rows per request and group are kept
    and sent, however many rows there are.
    """
    best: dict[tuple, Best] = {}
    parts = chunks(len(qids))
    for tile in tiles(batches):
        ids, corpus = ids_of(tile), scorer.load(tile.column(1))
        groups: dict[tuple, list[int]] = {}
        for row, key in enumerate(zip(*(tile.column(2 + i).to_pylist() for i in range(n_groups)))):
            groups.setdefault(key, []).append(row)
        for part, asked in zip(parts, requests):
            scores = scorer.score(asked, corpus)
            for key, rows in groups.items() if n_groups else [((), slice(None))]:
                if (part.start, key) not in best:
                    best[part.start, key] = Best(len(scores), k)
                best[part.start, key].show(np.arange(len(scores)), scores[:, rows], ids[rows])
        for found in best.values():
            found.settle()
    for (start, key), found in best.items():
        yield from hit_rows(found, qids.slice(start, found.n), key, schema)


def _topk(corpus: DataFrame, requests: DataFrame, size: Callable[[str], Column], scorer: Scorer,
          prepare: Callable, k: int, id_col: str, value_col: str, asked: str, score_name: str,
          per: Sequence[str]) -> DataFrame:
    """Hits of ``requests`` (qid, ``asked``) among (id, value, per...), then their ranking.

    ``size`` gives the size in bytes of a value and ``prepare`` turns a list of requests into what
    ``scorer`` takes. Rows without an id are left out.
    """
    corpus = corpus.filter(F.col(id_col).isNotNull() & F.col(value_col).isNotNull())
    out = T.StructType([T.StructField("qid", requests.schema["qid"].dataType), corpus.schema[id_col],
                        T.StructField(score_name, T.DoubleType()),
                        *(corpus.schema[name] for name in per)])
    schema, n_groups = to_arrow_schema(out), len(per)
    rows = corpus.select(id_col, value_col, *per)
    measured = requests.agg(F.sum(size(asked) + 64)).first()[0] or 0
    if measured <= BROADCAST_BYTES:
        few = requests.collect()
        shared = corpus.sparkSession.sparkContext.broadcast(
            ([row["qid"] for row in few], [prepare([row[asked] for row in few[part]]) for part in chunks(len(few))]))

        def over_partition(batches):
            qids, values = shared.value
            return _best(pa.array(qids, schema.field(0).type), values, batches, scorer, k, n_groups, schema)

        hits = rows.mapInArrow(over_partition, out)
    else:
        held = rows.agg(F.sum(size(value_col) + 64)).first()[0] or 0
        hits = _streamed(rows, requests, asked, held).mapInArrow(
            best_over_blocks(prepare, scorer, k, n_groups, schema), out)
    return top_k(hits, ["qid", *per], [F.desc(score_name), F.asc(id_col)], k)


def _streamed(rows: DataFrame, requests: DataFrame, asked: str, held: int) -> DataFrame:
    """Corpus rows and copies of all requests by block, in each block the corpus first.

    Blocks are as many as keep each under ``BLOCK_BYTES`` of the ``held`` bytes measured, and no
    fewer than there are cores. Requests pass in batches, so a task holds no more than its block.
    """
    blocks = max(-(-held // BLOCK_BYTES), rows.sparkSession.sparkContext.defaultParallelism)
    id_col, value_col, *per = rows.columns
    own = rows.select(F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("block"),
                      F.lit(False).alias("asks"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(rows.columns)])
    asking = requests.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
                             F.lit(True).alias("asks"), "qid", F.col(asked).alias("value"))
    return (own.unionByName(asking, allowMissingColumns=True)
            .repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "asks"))


def best_over_blocks(prepare: Callable, scorer: Scorer, k: int, n_groups: int, schema: pa.Schema) -> Callable:
    names = [f"c{i}" for i in range(2 + n_groups)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for batch in batches:
            kinds = list(zip(batch["block"].to_pylist(), batch["asks"].to_pylist()))
            starts = [0] + [i for i in range(1, len(kinds)) if kinds[i] != kinds[i - 1]]
            for start, end in zip(starts, [*starts[1:], len(kinds)]):
                if end == start:
                    continue
                if kinds[start][0] != block:
                    block, held = kinds[start][0], []
                part = batch.slice(start, end - start)
                if kinds[start][1]:
                    asked = part["value"].to_pylist()
                    values = [prepare(asked[chunk]) for chunk in chunks(len(asked))]
                    yield from _best(part["qid"], values, held, scorer, k, n_groups, schema)
                else:
                    held.append(part.select(names))

    return run


def semantic_topk(corpus: DataFrame, requests: DataFrame, k: int = TOP_K, *, id_col: str,
                  vector_col: str, per: Sequence[str] = (), where: Column | None = None,
                  threshold: float | None = None) -> DataFrame:
    """Exact cosine top-k per request (and per value of the ``per`` columns).

    ``requests`` holds ``qid`` and ``vector``. ``where`` filters before the ranking and is
    pushed to the scan. Only id, vector and ``per`` columns travel to the Arrow workers;
    join the hits back for descriptions. Zero and null vectors have no direction, and vectors of
    different length no angle: neither are hits.
    """
    corpus = corpus if where is None else corpus.filter(where)
    requests = requests.select("qid", F.col("vector").cast("array<double>").alias("vector"))
    requests = requests.filter(F.size("vector") > 0)
    return _topk(corpus, requests, lambda c: 8 * F.size(c), cosine(threshold), unit_vectors, k, id_col,
                 vector_col, "vector", "similarity", per)


def _non_empty(requests: DataFrame) -> DataFrame:
    refused = F.raise_error(F.lit("keyword search needs a non-empty query")).cast("string")
    return requests.select("qid", F.when(F.length("query") > 0, F.col("query")).otherwise(refused).alias("query"))


def needles(requests: DataFrame) -> DataFrame:
    """(qid, query) with queries in lower case, as texts are compared; empty ones are refused."""
    @F.udf("string", useArrow=True)
    def lower(query: str) -> str:
        return query.lower()
    return _non_empty(requests).select("qid", lower("query").alias("query"))


def keyword_topk(corpus: DataFrame, requests: DataFrame, k: int = KEYWORD_TOP_K, *, id_col: str,
                 text_col: str, per: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """Best ``k`` rows per request whose lower-cased text contains the lower-cased query.

    Score: non-overlapping occurrences divided by whitespace tokens of the text. ``requests``
    holds ``qid`` and ``query``; empty queries would match everything and are refused. Texts go
    through Arrow because counting with ``replace`` and ``regexp_count`` took four times as long.
    """
    corpus = corpus if where is None else corpus.filter(where)
    requests = _non_empty(requests)
    return _topk(corpus, requests, F.octet_length, DENSITY,
                 lambda queries: [query.lower() for query in queries], k, id_col, text_col, "query",
                 "score", per)


def merge_hits(semantic: DataFrame, keyword: DataFrame, id_col: str) -> DataFrame:
    """Outer merge of both hit lists; the missing side scores 0."""
    left = semantic.select("qid", id_col, F.col("similarity").alias("semantic_score"))
    right = keyword.select("qid", id_col, F.col("score").alias("keyword_score"))
    return (left.join(right, ["qid", id_col], "full_outer")
            .withColumn("semantic_score", F.coalesce("semantic_score", F.lit(0.0)))
            .withColumn("keyword_score", F.coalesce("keyword_score", F.lit(0.0))))


def hybrid_topk(vectors: DataFrame, texts: DataFrame, requests: DataFrame, k: int = TOP_K, *,
                id_col: str, vector_col: str, text_col: str,
                semantic_weight: float = SEMANTIC_WEIGHT, keyword_weight: float = KEYWORD_WEIGHT,
                vector_where: Column | None = None, text_where: Column | None = None) -> DataFrame:
    """Weighted sum of semantic and keyword scores over 2k candidates of either kind.

    ``requests`` holds ``qid``, ``query`` and ``vector``. ``vectors`` and ``texts`` may be the
    same DataFrame or two tables that share ``id_col``. Both candidate lists are at most 2k
    rows per request, so the merge is small whatever the corpus.
    """
    check_weights(semantic_weight, keyword_weight)
    requests = requests.select("qid", "query", "vector")
    semantic = semantic_topk(vectors, requests, 2 * k, id_col=id_col, vector_col=vector_col,
                             where=vector_where)
    keyword = keyword_topk(texts, requests, 2 * k, id_col=id_col, text_col=text_col,
                           where=text_where)
    return weigh_hits(semantic, keyword, k, id_col, semantic_weight, keyword_weight)


def weigh_hits(semantic: DataFrame, keyword: DataFrame, k: int, id_col: str,
               semantic_weight: float = SEMANTIC_WEIGHT, keyword_weight: float = KEYWORD_WEIGHT) -> DataFrame:
    """The ``k`` best of two hit lists by the weighted sum of their scores."""
    check_weights(semantic_weight, keyword_weight)
    score = (F.lit(semantic_weight) * F.col("semantic_score")
             + F.lit(keyword_weight) * F.col("keyword_score"))
    merged = merge_hits(semantic, keyword, id_col).withColumn(
        "hybrid_score", F.round(score, DECIMALS))
    return top_k(merged, ["qid"], [F.desc("hybrid_score"), F.asc(id_col)], k)


def distance_to_similarity(distance: Column) -> Column:
    return F.lit(1.0) - distance


def lookup_codes(codes: DataFrame, requests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per request with the stored row, if any, and a ``found`` flag."""
    stored = codes.withColumn("found", F.lit(True))
    return (requests.join(stored, list(keys), "left")
            .withColumn("found", F.coalesce("found", F.lit(False))))


def filter_entries(entries: DataFrame, where: Column, limit: int, per: Sequence[str] = (),
                   id_col: str = "id") -> DataFrame:
    """The first ``limit`` entries by id (for each value of ``per``) that ``where`` accepts."""
    chosen = entries.filter(where)
    if not per:
        return chosen.orderBy(id_col).limit(limit)
    return top_k(chosen, list(per), [F.asc(id_col)], limit, rank="__place").drop("__place")
