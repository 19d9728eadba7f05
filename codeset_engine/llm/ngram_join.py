"""N-gram Jaccard join by size: fixed-size subsets of small sets, inverted lists of large sets.

All shingles have one order, rarest first. Sets of Jaccard similarity t share at least
``ceil(t * n)`` shingles, so the first ``n - ceil(t * n) + k`` shingles of both have k in common.
A light set (fewer shingles than the boundary) has a key for every subset of two of its first
shingles; a heavy set scans the inverted lists of its first shingles, with a k that grows with the
set, and is dropped where fewer lists than that hold another set. Light sets that can still be
similar to a heavy one are on lists as well. The boundary is where both together cost least.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, chosen_rows, utf8
from .verification import MIX1, MIX2, WordHashes, linked_components

SIMILARITY = 80     # per cent
SUBSET = 2          # shingles in a subset
HITS = 10           # per cent of a set that a similar one has on its lists, at least
PEELS = 2           # rounds in which sets with too few lists, and lists of one set, are dropped
CELLS = 1 << 22     # counters of the shingle order: a fixed 8 MB once they are broadcast
PART = 1 << 14      # counters in one row on their way to the sum
MOST_LIGHT = 256    # the boundary is looked for up to this size
SALTS = 16
_SIGNED = "struct<n:bigint,c:bigint,d:bigint,keys:array<bigint>>"


class Costs(NamedTuple):
    """Estimates for one boundary: subsets of light sets, postings read by scans of lists."""
    boundary: int
    subsets: float
    scanned: float


def shared_at_least(n: int, percent: int) -> int:
    """Shingles that a set of ``n`` has in common with any similar set, at least."""
    return -(-n * percent // 100)


def first_shingles(n: int, percent: int, subset: int) -> int:
    """How many of its rarest shingles a set needs to share ``subset`` with any similar set."""
    return n - shared_at_least(n, percent) + subset


def _hits(n: int) -> int:
    """Lists that a set has in common with a similar one of ``n`` shingles or more."""
    return max(1, n * HITS // 100)


def has_partners(n: int, percent: int) -> bool:
    """Whether a set of ``n`` can be similar to a set other than itself."""
    return 100 * n >= percent * (n + 1)


def estimate(boundary: int, sizes: np.ndarray, scan: float, percent: int) -> Costs:
    """Costs with sets below ``boundary`` light. ``sizes[n]``: sets of n shingles, in the last entry
    the postings of all larger sets; ``scan``: entries that are read for one posting."""
    subsets = postings = 0.0
    for n, many in enumerate(sizes[:-1].tolist()):
        if not many or not has_partners(n, percent):
            continue
        if n < boundary:
            k = first_shingles(n, percent, SUBSET)
            subsets += many * k * (k - 1) / 2
        if 100 * n >= percent * boundary:
            postings += many * first_shingles(n, percent, _hits(n))
    return Costs(boundary, subsets, (postings + float(sizes[-1])) * scan)


def choose_boundary(sizes: np.ndarray, counts: np.ndarray, percent: int) -> Costs:
    """The cheapest boundary. A posting meets as many others as the mean entry of the list it is
    on, measured by how unevenly the shingles fill the counters."""
    total = float(counts.sum())
    scan = 1.0 if not total else float((counts.astype(float) ** 2).sum()) / total / max(counts.mean(), 1e-9)
    return min((estimate(b, sizes, scan, percent) for b in range(1, MOST_LIGHT + 1)),
               key=lambda cost: (cost.subsets + cost.scanned, cost.boundary))


def _cells(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def _counter(percent: int):
    """Counts of a task: shingles by cell, in parts, and sizes of sets (part -1)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, cells, sizes = WordHashes(), np.zeros(CELLS, np.uint32), np.zeros(MOST_LIGHT + 1, np.int64)
        for batch in batches:
            for text in utf8(batch["text"]):
                shingles = hashes.shingles(text)
                np.add.at(cells, _cells(shingles), np.uint32(1))
                n = len(shingles)
                if n < MOST_LIGHT:
                    sizes[n] += 1
                else:
                    sizes[-1] += first_shingles(n, percent, _hits(n))
        parts = [(-1, sizes)] + [(i, cells[i * PART:(i + 1) * PART]) for i in range(CELLS // PART)]
        yield _counted([(i, values) for i, values in parts if values.any()])
    return count


def _counted(parts: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([i for i, _ in parts], pa.int32()),
        pa.array([pa.compress(values.astype(np.int64).tobytes(), "zstd", asbytes=True) for _, values in parts],
                 pa.binary())], ["part", "counts"])


def _uncounted(part: int, counts: bytes) -> np.ndarray:
    length = MOST_LIGHT + 1 if part < 0 else PART
    return np.frombuffer(pa.decompress(counts, 8 * length, "zstd", asbytes=True), np.int64)


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch["part"].to_pylist(), batch["counts"].to_pylist()):
            values = _uncounted(part, counts)
            sums[part] = sums[part] + values if part in sums else values
    yield _counted(sorted(sums.items()))


def shingle_counts(documents: DataFrame, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts by cell, sets by size) of the texts of ``documents`` (text).

    The counts are summed in two rounds of bounded rows; the sums reach the driver, at most 32 MB
    whatever the input.
    """
    rows = documents.select("text").mapInArrow(_counter(percent), "part int, counts binary")
    salted = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    once = salted.repartition("part", "salt").select("part", "counts").mapInArrow(_add, "part int, counts binary")
    twice = once.repartition("part").mapInArrow(_add, "part int, counts binary")
    cells, sizes = np.zeros(CELLS, np.int64), np.zeros(MOST_LIGHT + 1, np.int64)
    for part, counts in twice.collect():
        values = _uncounted(part, counts)
        if part < 0:
            sizes += values
        else:
            cells[part * PART:(part + 1) * PART] += values
    return cells, sizes


def join_keys(shingles: np.ndarray, counts: np.ndarray, boundary: int, percent: int) -> np.ndarray:
    """The keys of one set: subsets of its rarest shingles, its entries in inverted lists, or both."""
    n = len(shingles)
    if not has_partners(n, percent):
        return np.empty(0, np.uint64)
    light, listed = n < boundary, 100 * n >= percent * boundary
    pairs, lists = (first_shingles(n, percent, k) for k in (SUBSET, _hits(n)))
    ordered = shingles[np.argsort(counts[_cells(shingles)], kind="stable")[:max(pairs, lists)]]
    subsets = []
    if light:
        for members in itertools.combinations(ordered[:pairs], SUBSET):
            key = np.uint64(SUBSET)
            for member in sorted(members):
                key = (key ^ member) * MIX1
                key ^= key >> np.uint64(29)
            subsets.append(key)
    one = np.uint64(1)      # the last bit tells subsets from lists
    return np.concatenate([np.array(subsets, np.uint64) | one, ordered[:lists if listed else 0] * MIX2 & ~one])


def _signer(counts: Broadcast, boundary: int, percent: int, seed: int):
    def sign(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = WordHashes()
        with np.errstate(over="ignore"):
            for column in columns:
                n, c, d, keys = [], [], [], []
                for text in utf8(column):
                    shingles = hashes.shingles(text)
                    digest = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes(), seed), np.int64)
                    n.append(len(shingles))
                    c.append(int(digest[0]))
                    d.append(int(digest[1]))
                    keys.append(join_keys(shingles, counts.value, boundary, percent).view(np.int64))
                yield pa.StructArray.from_arrays(
                    [pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.int64()),
                     pa.array(keys, pa.list_(pa.int64()))], ["n", "c", "d", "keys"])
    return sign


_BUCKET = "key bigint, n bigint, c bigint"


def _runs(percent: int):
    """Buckets (key, n, c): classes that share a key with one of similar size.

    Rows come sorted by key, size and class. A bucket is a key and a run of sizes, each similar to
    the one before; one class alone is none.
    """
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = last = size = bucket = waiting = None
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            keys = batch["key"].to_numpy()
            same = keys[1:] == keys[:-1]    # most keys have one row, which only matters at the ends
            with_others = np.ones(len(keys), bool)
            with_others[1:-1] = same[:-1] | same[1:]
            rows = batch.filter(pa.array(with_others))
            for k, n, c in zip(rows["key"].to_pylist(), rows["n"].to_pylist(), rows["c"].to_pylist()):
                if k != key or 100 * size < percent * n:
                    bucket = (xxhash.xxh3_64_intdigest(f"{k},{n}") & -2 | k & 1) - (1 << 63)
                    waiting = (bucket, n, c)
                elif c != last:
                    if waiting:
                        out.append(waiting)
                        waiting = None
                    out.append((bucket, n, c))
                key, size, last = k, n, c
            yield _rows(out)
    return runs


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of buckets that have two or more left, from rows sorted by bucket."""
    key = waiting = None
    for batch in batches:
        out: list[tuple[int, int, int]] = []
        for row in zip(*(batch[c].to_pylist() for c in ("key", "n", "c"))):
            if row[0] != key:
                key, waiting = row[0], row
            else:
                if waiting:
                    out.append(waiting)
                    waiting = None
                out.append(row)
        yield _rows(out)


def _rows(out: list[tuple[int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*out)) if out else [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["key", "n", "c"])


def _hubs(percent: int):
    """Adds each member's hub, and how central that is: the first member of similar size.

    Rows come sorted by bucket, and the most central class first. A bucket has few hubs, as each is
    larger or smaller by the similarity than the others.
    """
    def hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, found = None, []
        for batch in batches:
            hub, degree = [], []
            for k, n, c, d in zip(*(batch[x].to_pylist() for x in ("key", "n", "c", "degree"))):
                if k != key:
                    key, found = k, []
                own = next((h for h in found if 100 * min(h[0], n) >= percent * max(h[0], n)), None)
                if own is None:
                    found.append(own := (n, c, d))
                hub.append(own[1])
                degree.append(own[2])
            yield pa.RecordBatch.from_arrays(
                [batch["key"], batch["c"], pa.array(hub, pa.int64()), pa.array(degree, pa.int64())],
                ["key", "c", "hub", "degree"])
    return hubs


def _members(signed: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(key, c, hub, degree) of the buckets that links can come from."""
    entries = signed.select("c", "n", F.explode("keys").alias("key"))
    rows = scratch.save(entries.repartition("key").sortWithinPartitions("key", "n", "c")
                        .mapInArrow(_runs(percent), _BUCKET), "runs")
    held = rows.count()
    subset = F.col("key").bitwiseAND(1) == 1
    smallest = F.ceil(F.col("n") * percent / 100)   # of the similar sets, which ask for least
    enough = F.greatest(F.lit(1), F.floor(smallest * HITS / 100))
    for _ in range(PEELS):
        told = rows.groupBy("c", "n").agg(F.count_if(~subset).alias("lists"), F.count_if(subset).alias("subsets"))
        good = told.where((F.col("lists") >= enough) | (F.col("subsets") > 0)).select("c")
        fewer = scratch.save(rows.join(good, "c", "left_semi").repartition("key").sortWithinPartitions("key")
                             .select("key", "n", "c").mapInArrow(_shared, _BUCKET), "peeled", rows=held)
        scratch.drop(rows)
        rows, held = fewer, fewer.count()
    sizes = rows.groupBy("key").agg(F.count("*").alias("size"))
    degree = rows.join(sizes, "key").groupBy("c").agg(F.sum("size").alias("degree"))
    central = (rows.join(degree, "c").select("key", "n", "c", "degree").repartition("key")
               .sortWithinPartitions("key", F.desc("degree"), "c"))
    members = scratch.save(central.mapInArrow(_hubs(percent), "key bigint, c bigint, hub bigint, degree bigint"),
                           "members", rows=held)
    scratch.drop(rows)
    return members


def join_similar(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 percent: int = SIMILARITY) -> DataFrame:
    """One row per input row: ``id_col``, n_shingles, component_id, class_id.

    Words are runs of characters other than ASCII white space, with A-Z in lower case; a text's
    set holds its distinct five-word shingles, or all its words as one shingle where there are
    fewer. Texts are linked when their sets have a Jaccard similarity of ``percent`` (67 to 100)
    or more; ``component_id`` is the smallest id reachable over links, and rows with equal sets
    have one ``class_id``. The join is exact but for collisions of 64-bit hashes of shingles.

    Null, empty and blank texts have no shingles, a null class and are linked with nothing. Rows
    with a null id take part in links; their component is null only where none of it has an id.
    Repeated rows are equal sets, compared once. An empty table gives no rows; other columns are
    ignored, whatever their names.

    1. Counts of shingles, in a fixed number of counters, order the shingles; with the sizes of the
       sets they give the boundary between light and heavy sets.
    2. Keys of all rows are sorted by key, size and class in one shuffle; runs of similar sizes with
       one key are buckets. Classes on too few lists go, then every bucket gets its hubs.
    3. Members are verified against hubs, and blocks of what is left (``verification``).
    """
    if not 67 <= percent <= 100:
        raise ValueError("percent must lie between 67 and 100")
    spark = documents.sparkSession
    scratch = Scratch(spark, "ngram-join")
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    counts, sizes = shingle_counts(texts, percent)
    order = spark.sparkContext.broadcast(np.minimum(counts, (1 << 16) - 1).astype(np.uint16))
    boundary = choose_boundary(sizes, counts, percent).boundary
    for seed in itertools.count():   # a class is named by half of its digest, if that is unique
        sign = F.arrow_udf(_signer(order, boundary, percent, seed), _SIGNED)
        signed = scratch.save(
            texts.withColumn("rid", F.monotonically_increasing_id()).withColumn("s", sign("text"))
            .select("rid", "id", "text", "s.*"), "signed")
        n_rows = signed.count()
        classes = scratch.save(signed.where("n > 0").groupBy("c").agg(
            F.min("rid").alias("rid"), F.min("id").alias("least_id"), F.max("n").alias("n"),
            (F.min("d") != F.max("d")).alias("ambiguous")), "classes", rows=n_rows)
        if classes.where("ambiguous").isEmpty():
            break
        scratch.drop(signed, classes)
    members = _members(signed, percent, scratch)
    live = classes.join(members.select("c").distinct(), "c", "left_semi").select("rid")
    held = scratch.save(chosen_rows(signed.select("rid", "c", "text", "n"), live, scratch)
                        .select("c", "text", "n"), "held")
    roots = linked_components(members, held, percent, scratch)
    named = roots.withColumnRenamed("node", "c").join(classes.select("c", "least_id"), "c")
    least = named.groupBy("root").agg(F.min("least_id").alias("component"))
    components = scratch.save(named.join(least, "root").select("c", "component"), "components", rows=n_rows)
    alone = classes.join(components, "c", "left").select(
        "c", F.coalesce("component", "least_id").alias("component"))
    result = scratch.save(
        signed.select("id", "n", F.when(F.col("n") > 0, F.col("c")).alias("c")).join(alone, "c", "left")
        .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"),
                F.col("c").alias("class_id")), "result", rows=n_rows)
    scratch.drop(signed, classes, members, held, roots, components)
    return result
