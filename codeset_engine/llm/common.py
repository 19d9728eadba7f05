"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import checkpoint_root

PART_ROWS = 1 << 16    # of a few numbers each, that are worth a task and a file of their own
PIECE_ROWS, PIECE_BYTES = 500, 1 << 20    # of a batch, that a function turns into Python objects at once
ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


class Scratch:
    """Intermediate tables in the shared checkpoint folder, removed once nothing reads them."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}

    def save(self, df: DataFrame, name: str, compression: str = "zstd",
             partition_by: tuple[str, ...] = (), rows: int | None = None) -> DataFrame:
        """Write ``df`` and read it back. ``rows``: how many the last stage reads at most, where that is known and
        they are short; it then has no more tasks, and the table no more files, than so many rows are worth.
        """
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // PART_ROWS)))
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", compression).partitionBy(*partition_by).parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(saved)] = path
        return saved

    def drop(self, *saved: DataFrame) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark._jvm
        for df in saved:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(df)))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def chosen_rows(rows: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of which ``rid`` is in ``ids`` (rid), by one bit a row.

    The ids become one bitmap per 32,768 row numbers, written to the shared folder, so that their
    size is known when the join is planned. Spark broadcasts them where they lie under its
    threshold (10 MB hold the bits of 80 million rows) and shuffles otherwise.
    """
    bits = scratch.save(ids.groupBy(F.bitmap_bucket_number("rid").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("rid")).alias("bits")), "bits")
    at = F.bitmap_bit_position("rid")
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return (rows.withColumn("bucket", F.bitmap_bucket_number("rid")).join(bits, "bucket")
            .where(F.getbit(byte, F.pmod(at, 8).cast("int")) == 1).drop("bucket", "bits"))


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z in lower case and everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(columns: Iterator) -> Iterator:
    """The columns (or tuples of them, the texts first) of an Arrow function in slices of bounded size.

    A batch has thousands of texts, however long; the Python objects made of them are many times
    larger, and a worker keeps for later stages the memory that it once took. A function may
    give its results by slice, in the same order.
    """
    for column in columns:
        parts = column if isinstance(column, tuple) else (column,)
        texts, start = parts[0], 0
        while start < len(texts) or not len(texts):
            n = min(PIECE_ROWS, len(texts) - start)
            while n > 1 and texts.slice(start, n).nbytes > PIECE_BYTES:
                n //= 2
            cut = tuple(part.slice(start, n) for part in parts)
            yield cut if isinstance(column, tuple) else cut[0]
            start += n
            if not n:
                break


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The texts of an Arrow column as UTF-8 bytes."""
    binary = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(binary).to_pylist()


def grouped_batches(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of a stream that is sorted by ``keys``, one table per group.

    Groups may run over several batches; only the current one is held.
    """
    held: list[pa.Table] = []
    last: tuple | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        values = list(zip(*(table[k].to_pylist() for k in keys)))
        start = 0
        for i, value in enumerate(values):
            if value != last:
                if i > start:
                    held.append(table.slice(start, i - start))
                if held:
                    yield pa.concat_tables(held)
                held, start, last = [], i, value
        if len(values) > start:
            held.append(table.slice(start))
    if held:
        yield pa.concat_tables(held)
