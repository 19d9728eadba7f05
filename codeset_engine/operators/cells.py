"""Vector search over stored cells, which opens only cells that can still hold a hit.

``build_cells`` fits spherical k-means to a bounded sample and writes every vector, partitioned by
its nearest centre. A cell's radius is its largest angle to the centre, so by the triangle
inequality no vector of a cell is nearer to a request than the angle to its centre less the
radius. ``search_cells`` opens a request's most promising cells, takes the k-th best similarity
from them, and then opens every other cell whose bound reaches it: the result is exact.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut_lineage, drop_cut
from .ranking import top_k
from .search import SCORES, TOP_K, Best, by_length, chunks, cosine, hit_rows, ids_of, tiles

MOST_CELLS = 4096       # bounds the broadcast centres: 4096 x 1536 doubles are 50 MB
FIT_ROWS = 100_000      # rows that centres are fitted to, chosen by a hash of the id
ROUNDS = 8
TILE_ROWS = 20_000      # vectors of a cell that a task holds at once
BLOCK_BYTES = 64 << 20  # of the tiles that a task holds together; at least one tile
ASK_ROWS = 100_000      # requests that one copy of a block answers
SLACK = 1e-6            # for rounding in angles and similarities
OTHER = -1              # the cell of vectors of another length than the centres


class Cells(NamedTuple):
    """What the driver knows of an index: at most ``MOST_CELLS`` + 1 rows."""

    ids: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    rows: np.ndarray
    tiles: np.ndarray
    schema: str         # of the stored vectors, as JSON


def _slices(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of which a matrix with ``width`` columns is bounded."""
    rows = max(1, SCORES // max(width, 1))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def _matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, unit vectors) of the rows of this length that have a direction."""
    rows = np.flatnonzero(column.value_lengths().to_numpy(zero_copy_only=False) == size)
    vectors = np.asarray(column.take(pa.array(rows)).flatten(), np.float64).reshape(len(rows), size)
    lengths = np.linalg.norm(vectors, axis=1)
    usable = np.isfinite(lengths) & (lengths > 0)
    return rows[usable], vectors[usable] / lengths[usable, None]


def _angles(similarities: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(similarities, -1.0, 1.0))


def _fit(sample: DataFrame, cells: int, size: int, rounds: int) -> np.ndarray:
    """Centres after some rounds of k-means; each round sums per task and then per cell."""
    spark = sample.sparkSession
    start = sample.orderBy(F.xxhash64(F.lit(7), "vector")).limit(cells).collect()
    centres = _matrix(pa.array([row["vector"] for row in start], pa.list_(pa.float64())), size)[1]
    sums_type = "cell int, n bigint, total array<double>"

    def summed(found: dict[int, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array(list(found), pa.int32()), pa.array([n for n, _ in found.values()], pa.int64()),
            pa.array([total.tolist() for _, total in found.values()], pa.list_(pa.float64()))],
            ["cell", "n", "total"])

    def add(found: dict[int, list], cell: int, n: int, total: np.ndarray) -> None:
        held = found.setdefault(cell, [0, np.zeros(size)])
        held[0], held[1] = held[0] + n, held[1] + total

    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(centres)

        def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, list] = {}
            for batch in (part for whole in batches for part in _slices(whole, cells)):
                _, vectors = _matrix(batch["vector"], size)
                nearest = (vectors @ shared.value.T).argmax(axis=1)
                for cell in np.unique(nearest).tolist():
                    own = vectors[nearest == cell]
                    add(found, cell, len(own), own.sum(axis=0))
            yield summed(found)

        def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, list] = {}
            for batch in batches:
                for cell, n, total in zip(*(batch[c].to_pylist() for c in ("cell", "n", "total"))):
                    add(found, cell, n, np.array(total))
            yield summed(found)

        parts = sample.select("vector").mapInArrow(assigned, sums_type)
        moved = parts.repartition("cell").mapInArrow(totals, sums_type).collect()   # a row a cell
        centres = centres.copy()
        for cell, _, total in moved:
            length = np.linalg.norm(total)
            if length > 0:
                centres[cell] = np.array(total) / length
    return centres


def _assign(rows: DataFrame, centres: np.ndarray, id_col: str, keep: Sequence[str]) -> DataFrame:
    """Adds cell and angle to (id, vector, kept columns); vectors without direction go."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)
    out = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()),
                        T.StructField("angle", T.DoubleType())])
    names = [f.name for f in out]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = shared.value.shape[1]
        for batch in (part for whole in batches for part in _slices(whole, len(shared.value))):
            cell = np.full(batch.num_rows, OTHER, np.int32)
            angle = np.zeros(batch.num_rows)
            positions, vectors = _matrix(batch["vector"], size)
            if len(positions) and len(shared.value):
                found = vectors @ shared.value.T
                cell[positions] = found.argmax(axis=1)
                angle[positions] = _angles(found.max(axis=1))
            lengths = batch["vector"].value_lengths().to_numpy(zero_copy_only=False)
            usable = (lengths != size) & (lengths > 0)
            usable[positions] = True
            whole = pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], names)
            yield whole.filter(pa.array(usable))

    return rows.mapInArrow(nearest, out)


def build_cells(corpus: DataFrame, path: str, *, id_col: str, vector_col: str, keep: Sequence[str] = (),
                cells: int | None = None, fit_rows: int = FIT_ROWS, rounds: int = ROUNDS) -> None:
    """Write an index of all vectors of ``corpus`` to ``path``.

    Centres (the square root of the number of rows, at most ``MOST_CELLS``, unless given) are fitted
    to at most ``fit_rows`` rows; every row with an id and a vector is stored, with ``keep``. Null and
    zero vectors have no direction and are left out; vectors of another length than the commonest
    form a cell of their own, which requests of other lengths open.
    """
    rows = _rows(corpus, id_col, vector_col, keep)
    sizes = rows.where(F.size("vector") > 0).groupBy(F.size("vector").alias("size")).count()
    common = sizes.orderBy(F.desc("count"), "size").first()
    size, many = (common["size"], common["count"]) if common else (0, 0)
    cells = min(cells or int(np.ceil(np.sqrt(many))), MOST_CELLS)
    chance = F.pmod(F.xxhash64(F.lit(1), id_col), F.lit(max(many, 1))) < fit_rows
    sample = cut_lineage(rows.where((F.size("vector") == size) & chance).select("vector").limit(fit_rows), "fit")
    centres = _fit(sample, cells, size, rounds) if many else np.zeros((0, 0))
    drop_cut(sample)
    _write(rows, path, centres, id_col, keep, "overwrite")


def add_vectors(corpus: DataFrame, path: str, *, id_col: str, vector_col: str, keep: Sequence[str] = ()) -> None:
    """Add rows to an index; its centres stay, radii grow where they must."""
    found = load_cells(corpus.sparkSession, path)
    _write(_rows(corpus, id_col, vector_col, keep), path, found.centres, id_col, keep, "append")


def _rows(corpus: DataFrame, id_col: str, vector_col: str, keep: Sequence[str]) -> DataFrame:
    vector = F.col(vector_col).cast("array<double>")
    return (corpus.where(F.col(id_col).isNotNull() & vector.isNotNull())
            .select(id_col, *keep, vector.alias("vector")))


def _write(rows: DataFrame, path: str, centres: np.ndarray, id_col: str, keep: Sequence[str], mode: str) -> None:
    spark = rows.sparkSession
    placed = _assign(rows, centres, id_col, keep)
    told = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.max("angle").alias("radius"))
    counted = {row["cell"]: row for row in told.collect()}   # at most a row a cell
    tiles = {cell: -(-row["rows"] // TILE_ROWS) for cell, row in counted.items()}
    known = spark.createDataFrame(list(tiles.items()), "cell int, tiles int")
    salted = (placed.join(F.broadcast(known), "cell")
              .withColumn("tile", F.pmod(F.xxhash64(id_col), F.col("tiles")).cast("int")))
    stored = salted.select(id_col, *keep, "vector", "tile", "cell")
    (stored.repartition("cell", "tile")
     .sortWithinPartitions("cell", "tile").write.mode(mode).partitionBy("cell").parquet(f"{path}/vectors"))
    listed = [(cell, centres[cell].tolist() if cell != OTHER else [], float(counted[cell]["radius"]) if cell in counted else 0.0,
               counted[cell]["rows"] if cell in counted else 0, tiles.get(cell, 0), stored.schema.json())
              for cell in [*range(len(centres)), OTHER]]
    (spark.createDataFrame(listed, "cell int, centre array<double>, radius double, rows long, tiles int, schema string")
     .coalesce(1).write.mode(mode).parquet(f"{path}/cells"))


def load_cells(spark: SparkSession, path: str) -> Cells:
    """Every write adds its rows, so that a cell's radius is the largest and its rows the sum."""
    rows = (spark.read.parquet(f"{path}/cells").groupBy("cell")
            .agg(F.first("centre").alias("centre"), F.max("radius").alias("radius"),
                 F.sum("rows").alias("rows"), F.max("tiles").alias("tiles"), F.first("schema").alias("schema"))
            .orderBy("cell").collect())
    centres = [row["centre"] for row in rows if row["cell"] != OTHER]
    ordered = [row for row in rows if row["cell"] != OTHER] + [row for row in rows if row["cell"] == OTHER]
    matrix = np.array(centres, np.float64) if centres else np.zeros((0, 0))
    return Cells(np.array([row["cell"] for row in ordered]), matrix,
                 *(np.array([row[c] for row in ordered]) for c in ("radius", "rows", "tiles")), rows[0]["schema"])


def cell_bounds(cells: Cells, vectors: np.ndarray) -> np.ndarray:
    """The largest similarity that each cell can hold, by (vector, cell) for cells with a centre."""
    n = len(cells.centres)
    angle = _angles(vectors @ cells.centres.T) - cells.radii[:n] - SLACK
    bounds = np.cos(np.maximum(angle, 0.0)) + SLACK
    bounds[:, cells.rows[:n] == 0] = -np.inf
    return bounds


class Deal(NamedTuple):
    """Which tiles are searched together: of each cell the first tile, and the block of every tile."""

    first: np.ndarray
    block: np.ndarray
    blocks: int


def _deal(cells: Cells, width: int, parallelism: int) -> Deal:
    """Tiles in the order of their cells, dealt to blocks of equal numbers of rows, each under ``BLOCK_BYTES``
    (or one tile), and no fewer than there are cores."""
    rows = np.repeat(cells.rows / np.maximum(cells.tiles, 1), cells.tiles)
    total = rows.sum()
    blocks = int(max(-(-total * (8 * width + 64) // BLOCK_BYTES), parallelism))
    block = np.minimum((np.cumsum(rows) - rows) * blocks // max(total, 1), blocks - 1).astype(np.int64)
    return Deal(np.cumsum(cells.tiles) - cells.tiles, block, blocks)


def _choose(held: Cells, column: pa.Array, least: np.ndarray | None, k: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(request, place of the cell) to be opened: without ``least`` the most promising cells, ``first`` of them
    and as many more as hold ``k`` rows; with it (k-th similarities) all cells that reach it."""
    size, n = held.centres.shape[1], len(held.centres)
    asks, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    positions, vectors = _matrix(column, size)
    if n and len(positions):
        bounds = cell_bounds(held, vectors)
        if least is None:
            order = np.argsort(-bounds, axis=1, kind="stable")
            rows = held.rows[:n][order]
            chosen = (np.cumsum(rows, axis=1) - rows < k) | (np.arange(n) < first)   # by place in the order
            chosen &= np.isfinite(np.take_along_axis(bounds, order, axis=1))
            at, place = np.nonzero(chosen)
            place = order[at, place]
        else:
            at, place = np.nonzero(np.isfinite(bounds) & (bounds >= least[positions][:, None]))
        asks.append(positions[at])
        places.append(place)
    if (held.rows[held.ids == OTHER] > 0).any():
        lengths = column.value_lengths().to_numpy(zero_copy_only=False)
        others = np.flatnonzero((lengths != size) & (lengths > 0))
        asks.append(others)
        places.append(np.full(len(others), np.flatnonzero(held.ids == OTHER)[0]))
    return np.concatenate(asks), np.concatenate(places)


def _chosen(batches: Iterator[pa.RecordBatch], held: Cells, k: int, first: int,
            known: str | None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for part in (part for whole in batches for part in _slices(whole, len(held.centres))):
        least = None if known is None else np.asarray(part[known].to_numpy(zero_copy_only=False), np.float64)
        yield part, *_choose(held, part["vector"], least, k, first)


def _pairs(requests: DataFrame, cells: Cells, k: int, first: int, known: str | None) -> DataFrame:
    """(cell, requests) for the cells that some of the ``requests`` open, a row a task and cell."""
    shared = requests.sparkSession.sparkContext.broadcast(cells)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        counts = np.zeros(len(held.ids), np.int64)
        for _, _, places in _chosen(batches, held, k, first, known):
            counts += np.bincount(places, minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held.ids[some], pa.int32()), pa.array(counts[some], pa.int64())],
                                         ["cell", "requests"])

    return requests.mapInArrow(count, "cell int, requests long")


def _asks(requests: DataFrame, cells: Cells, deal: Deal, k: int, first: int, known: str | None) -> DataFrame:
    """(qid, value, least, block, cells): a request goes once to a block, with the cells that it opens there."""
    shared = requests.sparkSession.sparkContext.broadcast((cells, deal))
    out = T.StructType([requests.schema["qid"], T.StructField("value", T.ArrayType(T.DoubleType())),
                        T.StructField("least", T.DoubleType()), T.StructField("block", T.IntegerType()),
                        T.StructField("cells", T.ArrayType(T.IntegerType()))])
    schema = to_arrow_schema(out)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, dealt = shared.value
        for part, at, places in _chosen(batches, held, k, first, known):
            many = held.tiles[places]
            ends = np.cumsum(many)
            tile = np.repeat(dealt.first[places] - (ends - many), many) + np.arange(many.sum())
            at, places, block = np.repeat(at, many), np.repeat(places, many), dealt.block[tile]
            order = np.lexsort((places, block, at))
            at, places, block = at[order], places[order], block[order]
            moved = (np.diff(at, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0)
            own = moved | (np.diff(places, prepend=-1) != 0)    # a cell counts once a block, however many tiles
            starts = np.append(np.cumsum(own)[moved] - 1, own.sum())
            take = pa.array(at[moved], pa.int64())
            least = pa.nulls(len(take), pa.float64()) if known is None else part[known].take(take)
            opened = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(held.ids[places[own]], pa.int32()))
            yield pa.RecordBatch.from_arrays([part["qid"].take(take), part["vector"].take(take), least,
                                              pa.array(block[moved], pa.int32()), opened], schema=schema)

    return requests.mapInArrow(send, out)


def opened_vectors(spark: SparkSession, path: str, cells: Cells, opened: Sequence[int]) -> DataFrame:
    """The stored vectors of some cells; only their folders are listed and read."""
    schema = T.StructType.fromJson(json.loads(cells.schema))
    if not opened:
        return spark.createDataFrame([], schema)
    return (spark.read.schema(schema).option("basePath", f"{path}/vectors")
            .parquet(*[f"{path}/vectors/cell={int(c)}" for c in sorted(opened)]))


def _best_of_cells(k: int, threshold: float | None, schema: pa.Schema):
    """The k best of each request from rows by block: first its vectors by cell, then what is asked."""
    scorer = cosine(threshold)

    def answer(part: pa.RecordBatch, held: dict[int, list]) -> Iterator[pa.RecordBatch]:
        n = part.num_rows
        least = np.array(part["least"].fill_null(-np.inf).to_numpy(zero_copy_only=False), np.float64)
        best, units = Best(n, k, least), by_length(part["value"])
        size_of, row_of = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for size, (positions, _) in units.items():
            size_of[positions], row_of[positions] = size, np.arange(len(positions))
        opened = part["cells"].flatten().to_numpy()
        order = np.argsort(opened, kind="stable")
        asking = np.repeat(np.arange(n), part["cells"].value_lengths().to_numpy())[order]
        numbers, starts = np.unique(opened[order], return_index=True)
        for cell, start, end in zip(numbers.tolist(), starts, [*starts[1:], len(order)]):
            for ids, corpus in held.get(cell, ()):
                for size in corpus[1]:
                    own = asking[start:end][size_of[asking[start:end]] == size]
                    for chunk in chunks(len(own)):
                        some = own[chunk]
                        asked = len(some), {size: (np.arange(len(some)), units[size][1][row_of[some]])}
                        best.show(some, scorer.score(asked, corpus), ids)
        yield from hit_rows(best, part["qid"], (), schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, {}
        for batch in batches:
            kinds = np.array([batch[c].to_numpy(zero_copy_only=False) for c in ("unit", "asks", "c2")], object).T
            marks = [tuple(row[:2]) + (row[2] if not row[1] else None,) for row in kinds.tolist()]
            starts = [i for i in range(len(marks)) if not i or marks[i] != marks[i - 1]]
            for start, end in zip(starts, [*starts[1:], len(marks)]):
                at, asks, cell = marks[start]
                if at != unit:
                    unit, held = at, {}
                part = batch.slice(start, end - start)
                if asks:
                    yield from answer(part, held)
                else:
                    held.setdefault(int(cell), []).extend(
                        (ids_of(tile), scorer.load(tile.column(1))) for tile in tiles([part.select(["c0", "c1"])]))

    return run


def _scored(spark: SparkSession, path: str, asks: DataFrame, cells: Cells, k: int, id_col: str, first: int,
            known: str | None, threshold: float | None) -> DataFrame:
    """The k best of the opened cells by request.

    Tiles are dealt to blocks and a request goes once to each block in which it opens a cell, however
    many cells it opens there. A task holds one block while its requests stream past; a block that
    very many requests open is copied once per ``ASK_ROWS`` of them.
    """
    deal = _deal(cells, cells.centres.shape[1], spark.sparkContext.defaultParallelism)
    asked = {row["cell"]: row["requests"] for row in      # a row a cell
             _pairs(asks, cells, k, first, known).groupBy("cell").agg(F.sum("requests").alias("requests")).collect()}
    listed = [(int(cell), int(tile), int(deal.block[start + tile]))
              for cell, start, n in zip(cells.ids, deal.first, cells.tiles) for tile in range(n)]
    requests = np.zeros(deal.blocks, np.int64)
    for cell, _, block in listed:
        requests[block] += asked.get(cell, 0)
    copies = -(-np.minimum(requests, asks.count()) // ASK_ROWS)
    base = np.cumsum(copies) - copies
    blocks = F.broadcast(spark.createDataFrame(
        [(b, int(copies[b]), int(base[b])) for b in range(deal.blocks)], "block int, copies int, base int"))
    known_tiles = F.broadcast(spark.createDataFrame(listed, "cell int, tile int, block int"))
    stored = opened_vectors(spark, path, cells, list(asked))
    own = (stored.join(known_tiles, ["cell", "tile"]).join(blocks, "block")
           .select(F.explode(F.sequence(F.col("base"), F.col("base") + F.col("copies") - 1)).alias("unit"),
                   F.lit(False).alias("asks"), F.col(id_col).alias("c0"), F.col("vector").alias("c1"),
                   F.col("cell").alias("c2")))
    asking = (_asks(asks, cells, deal, k, first, known).join(blocks, "block")
              .select((F.col("base") + F.pmod(F.xxhash64("qid"), F.col("copies"))).cast("int").alias("unit"),
                      F.lit(True).alias("asks"), "qid", "value", "least", "cells"))
    both = (own.unionByName(asking, allowMissingColumns=True).repartitionById(max(int(copies.sum()), 1), F.col("unit"))
            .sortWithinPartitions("unit", "asks", "c2"))
    out = T.StructType([T.StructField("qid", asks.schema["qid"].dataType), stored.schema[id_col],
                        T.StructField("similarity", T.DoubleType())])
    return both.mapInArrow(_best_of_cells(k, threshold, to_arrow_schema(out)), out)


def search_cells(spark: SparkSession, path: str, requests: DataFrame, k: int = TOP_K, *, id_col: str,
                 threshold: float | None = None, first: int = 2, approximate: bool = False) -> DataFrame:
    """The rows of ``semantic_topk`` over the indexed corpus: qid, id, similarity and rank.

    Exact unless ``approximate``, which opens the ``first`` most promising cells of each request only
    (and more where they hold fewer than ``k`` rows). Requests (qid, vector) without a direction
    have no hits. Equal similarities rank by id.
    """
    cells = load_cells(spark, path)
    asks = requests.select("qid", F.col("vector").cast("array<double>").alias("vector")).where(F.size("vector") > 0)
    order = [F.desc("similarity"), F.asc(id_col)]
    early = _scored(spark, path, asks, cells, k, id_col, first, None, threshold)
    if approximate:
        return top_k(early, ["qid"], order, k)
    early = cut_lineage(top_k(early, ["qid"], order, k), "cells-first")
    least = early.where(F.col("rank") == k).select("qid", F.col("similarity").alias("kth"))
    known = asks.join(least, "qid", "left").withColumn(
        "kth", F.greatest(F.coalesce("kth", F.lit(-1.0)), F.lit(-1.0 if threshold is None else threshold)))
    # the promising cells are opened again, so that nothing hangs on both rounds choosing alike
    return top_k(_scored(spark, path, known, cells, k, id_col, first, "kth", threshold), ["qid"], order, k)
