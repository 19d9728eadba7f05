"""Exact comparison of candidate sets that share keys: hubs first, then blocks of what is left.

Candidates come as buckets: all classes of equal sets that have one key. A bucket costs one
comparison a member, however large it is; only where its members stay in different components are
they compared further, in blocks of bounded size. No task emits the pairs of a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import ASCII_LOWER, Scratch, grouped_batches, utf8
from .components import connected_components

SHINGLE = 5
SIMILARITY = 75  # per cent
LEAVES = 400  # rows that are compared with one copy of a hub
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1 << 21  # what a block of the exact comparison holds at most

MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """64-bit hash of each word; forgets all when it holds too many."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def shingles(self, text: bytes | None, size: int = SHINGLE) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the word shingles of a whole text."""
        words = (text or b"").translate(ASCII_LOWER).split()
        if not words:
            return np.empty(0, np.uint64)
        if len(self) > self.LIMIT:
            self.clear()
        hashes = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        k = min(size, len(hashes))
        n = len(hashes) - k + 1
        mixed = hashes[:n] + np.uint64(k)
        for i in range(1, k):
            mixed *= MIX1
            mixed ^= mixed >> np.uint64(29)
            mixed += hashes[i:i + n]
        mixed *= MIX2
        mixed ^= mixed >> np.uint64(32)
        mixed *= MIX1
        mixed ^= mixed >> np.uint64(29)
        mixed.sort()
        return mixed[np.concatenate(([True], mixed[1:] != mixed[:-1]))]


def similar(a: np.ndarray, b: np.ndarray, percent: int = SIMILARITY) -> bool:
    """Whether two sorted distinct sets have at least this Jaccard similarity."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    common = int((a[at] == b).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def linked_components(members: DataFrame, texts: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(node, root) of every class that is linked with another one.

    ``members`` (key, c, hub, degree) are the buckets, each with its hub and how central that is;
    ``texts`` (c, text, n) are the texts of all members and the sizes of their sets. Both are
    tables that can be read again.
    """
    rows = members.count()
    stars = scratch.save(members.where("c <> hub").select("hub", "c").distinct(), "stars", rows=rows)
    links = scratch.save(_verified_stars(stars, texts, percent), "links")
    labels = scratch.save(connected_components(links, scratch), "labels", rows=rows)
    scratch.drop(stars, links)
    rest = _verified_blocks(members, rows, labels, texts, percent, scratch)
    if rest is None:
        return labels
    edges = labels.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(rest)
    roots = scratch.save(connected_components(edges, scratch), "roots", rows=rows)
    scratch.drop(labels, rest)
    return roots


def _verified_stars(stars: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the pairs (hub, c). A hub with many members is copied once per LEAVES."""
    sizes = stars.groupBy("hub").agg(F.ceil(F.count("*") / LEAVES).cast("int").alias("copies"))
    leaf = (stars.join(sizes, "hub").join(texts, "c")
            .select("hub", F.pmod(F.xxhash64("c"), "copies").cast("int").alias("copy"),
                    F.lit(False).alias("is_hub"), "c", "text"))
    lead = (sizes.join(texts.withColumnRenamed("c", "hub"), "hub")
            .select("hub", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"),
                    F.lit(True).alias("is_hub"), F.col("hub").alias("c"), "text"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, hub = WordHashes(), None
        for batch in batches:
            found = []
            for is_hub, c, at, text in zip(batch["is_hub"].to_pylist(), batch["c"].to_pylist(),
                                           batch["hub"].to_pylist(), utf8(batch["text"])):
                shingles = hashes.shingles(text)
                if is_hub:
                    hub = shingles
                elif similar(hub, shingles, percent):
                    found.append((at, c))
            yield _pairs(found)

    return (leaf.unionByName(lead).repartition("hub", "copy")
            .sortWithinPartitions("hub", "copy", F.desc("is_hub"))
            .mapInArrow(verify, "a bigint, b bigint"))


def _verified_blocks(members: DataFrame, n_members: int, labels: DataFrame, texts: DataFrame, percent: int,
                     scratch: Scratch) -> DataFrame | None:
    """Links between different components of one bucket that the stars did not find, None if there are none.

    Members of a mixed bucket are put into blocks of bounded size, near their hub and by size of
    set; blocks meet where a bucket has an outsider in one and a member in the other. All pairs of
    two blocks are compared inside a task, and only links that join components leave it. Steps that
    are read again are tables: one plan of them all would cost the driver several times as much.
    """
    labelled = scratch.save(members.join(labels.withColumnRenamed("node", "c"), "c", "left")
                            .select("key", "c", "hub", F.coalesce("root", "c").alias("label")), "labelled")
    counts = labelled.groupBy("key", "label").count()
    mixed = (counts.groupBy("key").agg(F.max(F.struct("count", "label")).alias("top"),
                                       F.count("*").alias("n"))
             .where("n > 1").select("key", F.col("top.label").alias("main")))
    rows = scratch.save(labelled.join(mixed, "key"), "mixed", rows=n_members)
    scratch.drop(labelled)
    if rows.isEmpty():
        scratch.drop(rows)
        return None
    # near its hub with most neighbours, or near the hub of that one
    first = (members.groupBy("c").agg(F.max(F.struct("degree", F.negative("hub").alias("hub"))).alias("top"))
             .select("c", F.negative("top.hub").alias("hub")))
    second = first.select(F.col("c").alias("hub"), F.col("hub").alias("home"))
    home = scratch.save(rows.select("c", "label").distinct().join(first, "c").join(second, "hub")
                        .join(texts.select("c", "n"), "c")
                        .select("c", "label", "home", F.floor(F.log2("n")).cast("int").alias("size")), "home", rows=n_members)
    room = F.greatest(F.lit(1), F.least(F.lit(BLOCK_ROWS),
                                        F.floor(F.lit(BLOCK_SHINGLES) / F.pow(2.0, "size"))))
    blocks = (home.groupBy("home", "size").count()
              .select("home", "size", F.ceil(F.col("count") / room).alias("blocks")))
    placed = scratch.save(home.join(blocks, ["home", "size"]).select(
        "c", "label", "size",
        F.xxhash64("home", "size", F.pmod(F.xxhash64("c"), "blocks")).alias("block")), "placed", rows=n_members)
    seen = rows.join(placed.select("c", "block", "size"), "c")
    outside = seen.where("label <> main").select("key", F.col("block").alias("x"),
                                                 F.col("size").alias("x_size")).distinct()
    inside = seen.select("key", F.col("block").alias("y"), F.col("size").alias("y_size")).distinct()
    meets = scratch.save(outside.join(inside, "key").where("abs(x_size - y_size) <= 1")
                         .select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "meets")
    sides = meets.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    work = (sides.join(placed.select("c", "label", "block"), "block").join(texts, "c")
            .select("x", "y", "c", "label", "text"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for group in grouped_batches(batches, ["x", "y"]):
            sets = [hashes.shingles(text) for text in utf8(group["text"])]
            yield _pairs(joining_links(sets, group["label"].to_pylist(), percent=percent))

    rest = scratch.save(work.repartition("x", "y").sortWithinPartitions("x", "y")
                        .mapInArrow(compare, "a bigint, b bigint"), "rest")
    scratch.drop(rows, home, placed, meets)
    if rest.isEmpty():
        scratch.drop(rest)
        return None
    return rest


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def joining_links(sets: list[np.ndarray], labels: list[int], often: int = 16,
                  percent: int = SIMILARITY) -> list[tuple[int, int]]:
    """Pairs of labels that links between their sets join, without pairs that others imply.

    Common shingles are counted for all pairs at once: rare shingles by pairs of neighbours in
    sorted order, frequent ones by products of incidence matrices.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n, dtype=np.int64), sizes)
    values = np.concatenate(sets) if n else np.empty(0, np.uint64)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else []
    times = np.diff(np.append(starts, len(values)))
    times_each = np.repeat(times, times)
    common = np.zeros((n, n), np.float64)
    rare = (times_each > 1) & (times_each <= often)
    v, o = values[rare], owner[rare]
    for step in range(1, often):
        same = v[step:] == v[:-step] if len(v) > step else np.empty(0, bool)
        if not same.any():
            break
        code = o[:-step][same] * n + o[step:][same]
        common += np.bincount(code, minlength=n * n).reshape(n, n)
    dense = times_each > often
    if dense.any():
        o, column = owner[dense], np.cumsum(np.concatenate(([0], values[dense][1:] != values[dense][:-1])))
        for at in range(0, int(column[-1]) + 1, 2048):
            lo, hi = np.searchsorted(column, [at, at + 2048])
            matrix = np.zeros((n, 2048), np.float32)
            matrix[o[lo:hi], column[lo:hi] - at] = 1
            common += np.triu(matrix @ matrix.T, 1)
    common += np.tril(common, -1).T  # all counts above the diagonal
    union = sizes[:, None] + sizes[None, :] - common
    x, y = np.nonzero(np.triu(100 * common >= percent * union, 1) & (common > 0))
    parent: dict[int, int] = {}

    def find(node: int) -> int:
        while parent.setdefault(node, node) != node:
            parent[node] = node = parent[parent[node]]
        return node

    links = []
    for i, j in zip(x.tolist(), y.tolist()):
        a, b = find(labels[i]), find(labels[j])
        if a != b:
            parent[max(a, b)] = min(a, b)
            links.append((labels[i], labels[j]))
    return links
