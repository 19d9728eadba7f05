"""Near-duplicate detection by MinHash with tensored banding.

Two collections of ``tables`` hashes, each hash a pair of min-hashes, are combined: collection A
and collection B give ``tables ** 2`` table keys (A_i, B_j) of four min-hashes each, while only
``4 * tables`` min-hashes are computed. Texts with a common key are candidates; candidates are
verified on their full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, chosen_rows, pieces, utf8
from .verification import MIX1, MIX2, SIMILARITY, WordHashes, linked_components

TABLES = 10
_SIGNATURE = "struct<n:bigint,d1:bigint,d2:bigint,h:array<bigint>>"


def min_hashes(shingles: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The smallest value of the shingles under each seeded hash."""
    return np.array([((shingles ^ seed) * MIX1).min() for seed in seeds], np.uint64)


def _signer(tables: int):
    seeds = np.random.default_rng(20240229).integers(1, 2 ** 63, 4 * tables).astype(np.uint64)

    def collections(shingles: np.ndarray) -> np.ndarray:
        """Collection A, then collection B: ``tables`` pairs of min-hashes each."""
        pairs = min_hashes(shingles, seeds).reshape(2 * tables, 2)
        mixed = (pairs[:, 0] * MIX1) ^ (pairs[:, 0] >> np.uint64(31))
        return ((mixed + pairs[:, 1]) * MIX2).view(np.int64)

    def sign(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = WordHashes()
        for column in pieces(columns):
            n, d1, d2, rows = [], [], [], []
            for text in utf8(column):
                shingles = hashes.shingles(text)
                digest = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), np.int64)
                n.append(len(shingles))
                d1.append(int(digest[0]))
                d2.append(int(digest[1]))
                rows.append(collections(shingles).tolist() if len(shingles) else [])
            yield pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                 pa.array(rows, pa.list_(pa.int64()))], ["n", "d1", "d2", "h"])

    return sign


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    tables: int = TABLES) -> DataFrame:
    """One row per input row: ``id_col``, n_shingles, component_id, kept.

    Words are runs of characters other than ASCII white space, with A-Z in lower case; a text's
    set holds its distinct five-word shingles, or all its words as one shingle where there are
    fewer. Texts are linked when their sets have a Jaccard similarity of 0.75 or more;
    ``component_id`` is the smallest id reachable over links, and ``kept`` marks the rows whose
    id it is. Null, empty and blank texts have no shingles and are linked with nothing. Repeated
    rows and equal sets form one class, which is compared once. Rows with a null id take part in
    links; their own ``kept`` is true only where their whole component has no id. An empty table
    gives no rows. Other columns are ignored, whatever their names.

    Equal sets are found by a 128-bit digest; shingles are compared by 64-bit hashes. Chances that
    a pair at the threshold shares no key are 5 in 10,000, and fall steeply above it.

    1. Signatures, and classes of equal sets, by aggregation.
    2. Collection entries that only one class has are dropped; the others form table keys.
    3. In every bucket, the class with most bucket neighbours is the hub, and each member is
       verified against it. So a bucket costs one comparison a member, however large it is.
    4. Where members of a bucket are still in different components, blocks of them are compared
       exactly: those outside the bucket's largest component with all others.
    """
    scratch = Scratch(documents.sparkSession, "near-dup")
    signed = _signed(documents.select(id_col, text_col), id_col, text_col, tables, scratch)
    grouped = _grouped(signed, tables, scratch)
    scratch.drop(signed)
    return grouped.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         tables: int = TABLES) -> DataFrame:
    """The rows of ``documents`` with one row of each group of near duplicates, all columns kept.

    Groups are those of ``near_duplicates``. The row with the smallest id stays, one of repeated
    ones; a row without an id stays only where none of its group has one. Texts without words stay.
    """
    scratch = Scratch(documents.sparkSession, "near-dup")
    signed = _signed(documents, id_col, text_col, tables, scratch)
    grouped = _grouped(signed, tables, scratch)
    first = grouped.groupBy("group").agg(F.min(F.struct(F.isnull("id").alias("none"), "id", "rid")).alias("first"))
    kept = chosen_rows(signed.select("rid", "text", "others"), first.select("first.rid"), scratch)
    return kept.select(*[F.col("text").alias(text_col) if c == text_col else F.col(f"others.`{c}`")
                         for c in documents.columns])


def _signed(documents: DataFrame, id_col: str, text_col: str, tables: int, scratch: Scratch) -> DataFrame:
    """The rows with a number of their own, their text and signature."""
    sign = F.arrow_udf(_signer(tables), _SIGNATURE)
    others = [c for c in documents.columns if c != text_col]
    return scratch.save(
        documents.select(F.struct(*others).alias("others"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .withColumn("rid", F.monotonically_increasing_id())
        .withColumn("s", sign(F.col("text").cast("string")))
        .select("rid", "id", "text", "others", "s.n", "s.d1", "s.d2", "s.h"), "signed")


def _grouped(signed: DataFrame, tables: int, scratch: Scratch) -> DataFrame:
    """(rid, id, n, group, component_id) of every signed row."""
    n_rows = signed.count()
    classes = scratch.save(signed.where("n > 0").groupBy("d1", "d2")
                           .agg(F.min("rid").alias("c"), F.min("id").alias("least_id")), "classes", rows=n_rows)
    live = _live_keys(signed, classes, tables, scratch)
    texts = scratch.save(chosen_rows(signed.select("rid", "text", "n"), live.select(F.col("c").alias("rid")), scratch)
                         .select(F.col("rid").alias("c"), F.col("text").cast("string").alias("text"), "n"), "texts")
    degree = live.groupBy("c").agg(F.sum("members").alias("degree"))
    hubs = (live.join(degree, "c").groupBy("key")
            .agg(F.max(F.struct("degree", F.negative("c").alias("c"))).alias("top"))
            .select("key", F.negative("top.c").alias("hub"), F.col("top.degree").alias("degree")))
    members = scratch.save(live.join(hubs, "key").select("key", "c", "hub", "degree"), "members", rows=live.count())
    roots = linked_components(members, texts, SIMILARITY, scratch)
    named = roots.join(classes.select(F.col("c").alias("node"), "least_id"), "node")
    least = named.groupBy("root").agg(F.min("least_id").alias("component"))
    components = scratch.save(
        named.join(least, "root").select(F.col("node").alias("c"), "root", "component"), "components", rows=n_rows)
    result = scratch.save(
        signed.select("rid", "id", "n", "d1", "d2").join(classes, ["d1", "d2"], "left")
        .join(components, "c", "left")
        .select("rid", "id", "n", F.when(F.col("n") > 0, F.coalesce("root", "c")).otherwise(F.col("rid")).alias("group"),
                F.when(F.col("n") > 0, F.coalesce("component", "least_id"))
                .otherwise(F.col("id")).alias("component_id")), "result", rows=n_rows)
    scratch.drop(live, texts, members, roots, classes, components)
    return result


def _live_keys(signed: DataFrame, classes: DataFrame, tables: int, scratch: Scratch) -> DataFrame:
    """(key, c, members) of all table keys that two or more classes have, as a table."""
    reps = scratch.save(signed.select(F.col("rid").alias("c"), "h").join(classes.select("c"), "c"), "reps")
    entries = reps.select("c", F.posexplode("h").alias("at", "value"))
    shared = entries.groupBy("at", "value").count().where("count > 1").select("at", "value")
    mine = scratch.save(entries.join(shared, ["at", "value"]).groupBy("c")
                        .agg(F.collect_list(F.struct("at", "value")).alias("e")), "mine")  # at most 2 * tables
    keys = (mine.select("c", "e", F.explode("e").alias("x")).where(F.col("x.at") < tables)
            .select("c", "x", F.explode("e").alias("y")).where(F.col("y.at") >= tables)
            .select("c", F.xxhash64("x.at", "x.value", "y.at", "y.value").alias("key")))
    counts = keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    live = scratch.save(keys.join(counts, "key"), "live")
    scratch.drop(reps, mine)
    return live
