"""Packing of documents into fixed-length token sequences along a Hilbert curve."""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import pieces, utf8

LENGTH = 1024
PART_BYTES = 8 << 20  # text of one stretch of the curve
REGIONS = 4096  # regions, at most, with borders from a sample; more stretches divide them evenly
TASKS = 100_000  # tasks that pack, at most; each takes neighbouring stretches one after another
SAMPLE = 4096  # documents, at least, whose keys choose the borders of the regions
DIMENSIONS, BITS = 3, 10
CHUNK = 256 * LENGTH  # ids in one row at most
LONG = 100_000  # characters of white space without a break

SPECIAL = "<|endoftext|>"
_SPACE = re.compile(r"\s{%d}" % LONG)


class Tokens:
    """Byte-level BPE ids of whole texts as little-endian 16-bit numbers."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        ranks = path.removesuffix(".json") + ".tiktoken"
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.path, self.whole = path, None
        self.encoder = tiktoken.Encoding("ids", pat_str=public_tokenizers.PATTERN,
                                         mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> bytes:
        # the tokenizer file gives this string an id of its own; long white space overflows the other's stack
        if SPECIAL in text or len(text) > LONG and _SPACE.search(text):
            if self.whole is None:
                from tokenizers import Tokenizer
                self.whole = Tokenizer.from_file(self.path)
            ids = self.whole.encode(text, add_special_tokens=False).ids
        else:
            ids = self.encoder.encode_ordinary(text)
        return np.array(ids, "<u2").tobytes()


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Places of grid points (one a row) along the Hilbert curve, by Skilling's transform."""
    x = points.T.astype(np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(len(x)):
            high = x[i] & q != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    index = np.zeros_like(t)
    for bit in range(bits - 1, -1, -1):
        for v in x:
            index = index << 1 | v >> bit & 1
    return index


def curve_keys(texts: list[bytes], directions: np.ndarray) -> np.ndarray:
    """Hilbert indices of the documents' count vectors, of length one, along random directions."""
    places = np.zeros((len(texts), DIMENSIONS))
    for row, raw in enumerate(texts):
        ids = np.sort(np.frombuffer(raw, "<u2"))
        if len(ids):
            starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
            counts = np.diff(np.append(starts, len(ids))).astype(np.float64)
            places[row] = counts @ directions[ids[starts]] / np.sqrt(counts @ counts)
    grid = np.clip((places + 4) / 8 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    return hilbert_index(grid, BITS)


def _directions() -> np.ndarray:
    return np.random.default_rng(20240310).standard_normal((1 << 16, DIMENSIONS))


def _keys(path: str):
    def keys(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens, directions = Tokens(path), _directions()
        for column in pieces(columns):
            ids = [tokens.encode((t or b"").decode()) for t in utf8(column)]
            yield pa.array(curve_keys(ids, directions) << 31, pa.int64())
    return keys


def _borders(sample: list[tuple[int, int]], parts: int) -> list[int]:
    """Keys at which stretches of about equal bytes begin."""
    total, passed, borders = sum(size for _, size in sample), 0, []
    for key, size in sample:
        if passed * parts >= (len(borders) + 1) * total and key not in borders[-1:]:
            borders.append(key)
        passed += size
    return borders


_PIECES = "struct<key:bigint,part:int,total:bigint,chunks:array<struct<start:bigint,ids:binary>>>"
_PIECES_ARROW = pa.struct([
    ("key", pa.int64()), ("part", pa.int32()), ("total", pa.int64()),
    ("chunks", pa.list_(pa.struct([("start", pa.int64()), ("ids", pa.binary())])))])


LAST_KEY = (1 << DIMENSIONS * BITS + 31) - 1


def stretch_of(key: int, borders: list[int], each: int) -> int:
    """The number of a key's stretch: its region, of which ``each`` stretches divide the keys."""
    region = bisect_right(borders, key)
    if each == 1:
        return region
    low = borders[region - 1] if region else 0
    high = borders[region] if region < len(borders) else LAST_KEY
    return region * each + min(max(key - low, 0) * each // max(high - low, 1), each - 1)


def _encode(path: str, borders: list[int], each: int):
    def encode(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        tokens, directions = Tokens(path), _directions()
        for column, ties in pieces(columns):
            rows, encoded = [], [tokens.encode((t or b"").decode()) for t in utf8(column)]
            keys = (curve_keys(encoded, directions) << 31) + ties.to_numpy()
            for ids, key in zip(encoded, keys.tolist()):
                ids += b"\0\0"
                rows.append({"key": key, "part": stretch_of(key, borders, each), "total": len(ids) // 2,
                             "chunks": [{"start": at // 2, "ids": ids[at:at + 2 * CHUNK]}
                                        for at in range(0, len(ids), 2 * CHUNK)]})
            yield pa.array(rows, _PIECES_ARROW)
    return encode


def _pack(id_type: pa.DataType, length: int):
    schema = pa.schema([("id", id_type)] + [(c, pa.int64()) for c in (
        "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
        + [("ids", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sequence, used = None, 0, 0
        for batch in batches:
            ids_of, rows = batch["id"], {name: [] for name in schema.names[1:]}
            source = []
            for i, (p, start, total, ids) in enumerate(zip(*(batch[c].to_pylist() for c in (
                    "part", "start", "total", "ids")))):
                if p != part:
                    part, sequence, used = p, p << 32, 0
                words = np.frombuffer(ids, "<u2").astype("<u4")
                at = 0
                while at < len(words):
                    take = min(length - used, len(words) - at)
                    piece = words[at:at + take]
                    source.append(i)
                    for name, value in zip(rows, (start + at, take, zlib.crc32(piece), total,
                                                  sequence, used, ids[2 * at:2 * (at + take)])):
                        rows[name].append(value)
                    at += take
                    used += take
                    if used == length:
                        sequence, used = sequence + 1, 0
            yield pa.RecordBatch.from_arrays(
                [ids_of.take(pa.array(source, pa.int64()))]
                + [pa.array(rows[n], schema.field(n).type) for n in schema.names[1:]], schema=schema)
    return pack


def pack_documents(documents: DataFrame, tokenizer_path: str, id_col: str = "doc_id",
                   text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Pieces of documents laid into sequences of ``length`` tokens, one row per piece.

    Columns: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset and ids (the
    tokens as little-endian 16-bit numbers; a sequence is its pieces by offset). A document is its
    tokens and the id 0; null and empty texts are that id alone. Documents follow a Hilbert curve
    through three random projections of their token counts, ties by a hash of the id, so that
    neighbours in a sequence are alike. The curve is cut into stretches of about 8 MB of text, however
    many; only the last sequence of a stretch may be short. Null ids are kept, repeated rows are packed each
    for itself, an empty table gives no rows, and other columns are ignored.

    The borders of up to 4,096 regions come from the keys of a bounded sample, as in a range sort;
    further stretches divide the keys of a region evenly. They decide which task packs a document,
    not whether it is packed. Equal documents have equal keys
    but different hashes, so a large group of copies is spread over stretches. Tokens are made
    once, in chunks of bounded size, and shuffled once.
    """
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows, size = texts.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    parts = int(max(1, -(-(size or 0) // PART_BYTES)))
    regions = min(parts, REGIONS)
    each = -(-parts // regions)
    tie = F.pmod(F.xxhash64("id", F.length("text")), F.lit(1 << 31))
    borders: list[int] = []
    if parts > 1:
        wanted = max(SAMPLE, 40 * regions)
        some = texts.sample(min(1.0, wanted / rows), 7).select(
            (F.arrow_udf(_keys(tokenizer_path), "bigint")("text") + tie).alias("key"),
            F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"))
        borders = _borders(sorted((row["key"], row["bytes"]) for row in some.collect()), regions)
    encode = F.arrow_udf(_encode(tokenizer_path, borders, each), _PIECES)
    chunks = (texts.withColumn("tie", tie).select("id", encode("text", "tie").alias("e"))
              .select("id", "e.key", "e.part", "e.total", F.explode("e.chunks").alias("c"))
              .select("id", "key", "part", "total", "c.start", "c.ids"))
    stretches = (len(borders) + 1) * each
    at_once = -(-stretches // TASKS)
    placed = (chunks.repartitionById(-(-stretches // at_once), F.floor(F.col("part") / at_once).cast("int"))
              .sortWithinPartitions("key", "id", "total", "start"))
    id_type = documents.schema[id_col].dataType
    packed = placed.select("id", "part", "total", "start", "ids").mapInArrow(
        _pack(to_arrow_type(id_type), length),
        f"id {id_type.simpleString()}, start bigint, length bigint, ids_crc32 bigint, "
        "doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")
    return packed.withColumnRenamed("id", id_col)
