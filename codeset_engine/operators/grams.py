"""Keyword search through stored postings of trigrams.

``build_grams`` stores the texts in blocks of consecutive rows and, for each trigram and block,
which rows hold it. A request intersects the lists of its rarest trigrams, shortest first, and
only the few texts that are left are opened, searched and scored. Requests of one or two
characters have no trigram; for them all stored texts are scanned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut_lineage, drop_cut
from .ranking import top_k
from .search import DECIMALS, KEYWORD_TOP_K, keyword_topk, needles

GRAM = 3
BLOCK_BITS = 12         # 4,096 consecutive rows are a block, which bounds what a task holds
PART_CHARS = 4 << 20    # of the texts of a block that are numbered at once
RAREST = 4              # lists that are intersected for a request; the texts decide about the rest
PUSHED_GRAMS = 2000     # up to so many trigrams are looked for by a filter of the scan


def text_grams(text: str) -> set[str]:
    return {text[i:i + GRAM] for i in range(len(text) - GRAM + 1)}


def pack_rows(rows: np.ndarray) -> bytes:
    """Ascending row numbers of a block as gaps of one byte, or 255 and two bytes where it is wider."""
    gaps = np.diff(rows, prepend=-1)
    out = bytearray()
    for gap in gaps.tolist():
        out += bytes((gap,)) if gap < 255 else b"\xff" + gap.to_bytes(2, "little")
    return bytes(out)


def unpack_rows(packed: bytes) -> np.ndarray:
    values = np.frombuffer(packed, np.uint8).astype(np.int64)
    if (values == 255).any():
        gaps, at = [], 0
        while at < len(packed):
            wide = packed[at] == 255
            gaps.append(int.from_bytes(packed[at + 1:at + 3], "little") if wide else packed[at])
            at += 3 if wide else 1
        values = np.array(gaps, np.int64)
    return np.cumsum(values) - 1


def _packed(rows: np.ndarray, starts: np.ndarray) -> pa.Array:
    """``pack_rows`` of many ascending lists, which begin at ``starts``."""
    gaps = np.diff(rows, prepend=-1)
    gaps[starts] = rows[starts] + 1
    sizes = np.where(gaps < 255, 1, 3)
    ends = np.cumsum(sizes)
    out = np.empty(ends[-1], np.uint8)
    out[ends - sizes] = np.minimum(gaps, 255)
    wide = gaps >= 255
    out[ends[wide] - 2], out[ends[wide] - 1] = gaps[wide] & 255, gaps[wide] >> 8
    offsets = np.append((ends - sizes)[starts], ends[-1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _block_postings(block: int, rows: list[int], texts: list[str]) -> Iterator[pa.RecordBatch]:
    """(gram, block, n, rows) of some texts of a block, by sorting numbers of gram and row."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    present = np.zeros(0x110000, bool)
    present[codes] = True
    chars = np.flatnonzero(present)
    n = len(chars)
    if n ** 3 << BLOCK_BITS >= 1 << 63 and len(rows) > 1:    # too many characters for one number
        half = len(rows) // 2
        yield from _block_postings(block, rows[:half], texts[:half])
        yield from _block_postings(block, rows[half:], texts[half:])
        return
    if len(codes) < GRAM:
        return
    ranks = (np.cumsum(present, dtype=np.int32) - 1)[codes]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    keys = ranks[:-2] * np.int64(n)
    keys += ranks[1:-1]
    keys *= n
    keys += ranks[2:]
    keys *= len(rows)
    keys += owner[:-2]
    keys = np.unique(keys[owner[:-2] == owner[2:]])
    if not len(keys):
        return
    keys, at = np.divmod(keys, len(rows))
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    found = keys[starts]
    letters = chars[np.stack([found // n // n, found // n % n, found % n], axis=1)].astype("<u4").tobytes().decode("utf-32-le")
    yield pa.RecordBatch.from_arrays([
        pa.array([letters[i:i + GRAM] for i in range(0, len(letters), GRAM)], pa.string()),
        pa.array(np.full(len(starts), block), pa.int64()),
        pa.array(np.diff(np.append(starts, len(keys))), pa.int32()), _packed(np.array(rows, np.int64)[at], starts)],
        ["gram", "block", "n", "rows"])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, block, n, rows) of texts (rid, text) whose rows come in order; at most a block and
    ``PART_CHARS`` characters are held, a block of more gives several lists of a trigram."""
    block, rows, texts, held = None, [], [], 0
    for batch in batches:
        for rid, text in zip(batch["rid"].to_pylist(), batch["text"].to_pylist()):
            if rid >> BLOCK_BITS != block or held + len(text) > PART_CHARS:
                if rows:
                    yield from _block_postings(block, rows, texts)
                block, rows, texts, held = rid >> BLOCK_BITS, [], [], 0
            rows.append(rid & (1 << BLOCK_BITS) - 1)
            texts.append(text.lower())
            held += len(text)
    if rows:
        yield from _block_postings(block, rows, texts)


def build_grams(corpus: DataFrame, path: str, *, id_col: str, text_col: str, append: bool = False) -> None:
    """Index the texts of ``corpus`` under ``path``; ``append`` adds them as a further batch.

    Rows without an id or a text are left out, as in a search without the index. Postings are one
    row a trigram and block, laid out by trigram, so that a search reads the files of its own.
    """
    spark = corpus.sparkSession
    batch = 0
    if append:
        last = spark.read.parquet(f"{path}/texts").agg(F.max("batch")).first()[0]
        batch = 0 if last is None else last + 1
    rows = corpus.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    mode, folder = "errorifexists", f"batch={batch}"
    (rows.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col), F.col(text_col).alias("text"))
     .write.mode(mode).parquet(f"{path}/texts/{folder}"))
    stored = spark.read.parquet(f"{path}/texts/{folder}")
    # rows of a block are neighbours in one file; a file that is read in several splits, or with
    # others, gives a few more lists of the same block, which a search joins
    postings = stored.select("rid", "text").mapInArrow(_postings, "gram string, block long, n int, rows binary")
    postings = cut_lineage(postings, "postings")    # finding the ranges would otherwise make them twice
    (postings.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block")
     .write.mode(mode).parquet(f"{path}/postings/{folder}"))
    drop_cut(postings)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate rows (qid, batch, rid) of blocks in which all lists of a request have one."""
    for batch in batches:
        at, rids = [], []
        for i, (block, needed, lists) in enumerate(zip(
                batch["block"].to_pylist(), batch["needed"].to_pylist(), batch["lists"].to_pylist())):
            by_gram: dict[str, list[bytes]] = {}
            for part in lists:
                by_gram.setdefault(part["gram"], []).append(part["rows"])
            if len(by_gram) < needed:
                continue
            left = None
            for parts in sorted(by_gram.values(), key=lambda p: sum(map(len, p))):
                rows = np.unique(np.concatenate([unpack_rows(p) for p in parts]))
                left = rows if left is None else np.intersect1d(left, rows, assume_unique=True)
                if not len(left):
                    break
            at += [i] * len(left)
            rids += ((block << BLOCK_BITS) + left).tolist()
        take = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch["qid"].take(take), batch["batch"].take(take), pa.array(rids, pa.int64())], ["qid", "batch", "rid"])


def _asked_grams(requests: DataFrame) -> DataFrame:
    @F.udf("array<string>", useArrow=True)
    def grams(query: str) -> list[str]:
        return sorted(text_grams(query))
    return requests.select("qid", F.explode(grams("query")).alias("gram"))


def gram_candidates(spark: SparkSession, path: str, requests: DataFrame) -> DataFrame:
    """(qid, batch, rid) of the texts that hold the rarest trigrams of a request (qid, lower-cased query)."""
    postings = spark.read.parquet(f"{path}/postings")
    asked = _asked_grams(requests)
    grams = asked.select("gram").distinct()
    few = [row["gram"] for row in grams.limit(PUSHED_GRAMS + 1).collect()]
    if len(few) <= PUSHED_GRAMS:
        postings = postings.where(F.col("gram").isin(few))
    counts = postings.join(grams, "gram", "left_semi").groupBy("gram").agg(F.sum("n").alias("texts"))
    # a trigram that no text has ranks first and leaves its request without candidates
    chosen = top_k(asked.join(counts, "gram", "left"), ["qid"],
                   [F.asc_nulls_first("texts"), F.asc("gram")], RAREST)
    needed = chosen.groupBy("qid").agg(F.count(F.lit(1)).alias("needed"))
    lists = (postings.join(chosen.select("qid", "gram"), "gram").groupBy("qid", "batch", "block")
             .agg(F.collect_list(F.struct("gram", "rows")).alias("lists")))   # at most RAREST lists of a block
    out = T.StructType([requests.schema["qid"], lists.schema["batch"], T.StructField("rid", T.LongType())])
    return lists.join(needed, "qid").select("qid", "batch", "block", "needed", "lists").mapInArrow(_lists, out)


def _scores(schema: pa.Schema):
    """(qid, id, score) from rows sorted by text: first the text, then the requests that may match."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, owner, tokens = "", None, 0
        for batch in batches:
            found: list[tuple] = []
            for asks, own, qid, value in zip(*(batch[c].to_pylist() for c in ("asks", "own", "qid", "value"))):
                if not asks:
                    text, owner, tokens = value.lower(), own, None
                    continue
                count = text.count(value)
                if count:
                    tokens = len(text.split()) if tokens is None else tokens
                    if tokens:
                        found.append((qid, owner, round(count / tokens, DECIMALS)))
            columns = list(zip(*found)) if found else [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)
    return run


def search_grams(spark: SparkSession, path: str, requests: DataFrame, k: int = KEYWORD_TOP_K, *,
                 id_col: str) -> DataFrame:
    """The rows of ``keyword_topk`` over the indexed texts: qid, id, score and rank.

    Empty queries are refused. A text is opened once, however many requests it may match; it is
    held by one task, and requests stream past it.
    """
    asked = needles(requests)
    long = asked.where(F.length("query") >= GRAM)
    texts = spark.read.parquet(f"{path}/texts")
    candidates = gram_candidates(spark, path, long)
    opened = texts.join(candidates.select("batch", "rid").distinct(), ["batch", "rid"], "left_semi")
    rows = opened.select("batch", "rid", F.lit(False).alias("asks"), F.col(id_col).alias("own"), F.col("text").alias("value"))
    asking = candidates.join(long, "qid").select(
        "batch", "rid", F.lit(True).alias("asks"), "qid", F.col("query").alias("value"))
    both = (rows.unionByName(asking, allowMissingColumns=True).repartition("batch", "rid")
            .sortWithinPartitions("batch", "rid", "asks"))
    out = T.StructType([requests.schema["qid"], texts.schema[id_col], T.StructField("score", T.DoubleType())])
    hits = both.mapInArrow(_scores(to_arrow_schema(out)), out)
    short = asked.where(F.length("query") < GRAM)
    if not short.isEmpty():
        hits = hits.unionByName(keyword_topk(texts, short, k, id_col=id_col, text_col="text").drop("rank"))
    return top_k(hits, ["qid"], [F.desc("score"), F.asc(id_col)], k)
