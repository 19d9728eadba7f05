"""Two-pass external shuffle of records into shards, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Scratch

SHARDS, SEED = 40, 20240401
BUCKET_BYTES = 8 << 20  # a bucket is shuffled in memory
BUCKET_ROWS = 20_000


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """Rendezvous hashing: the shard with the highest hash of (seed, key, shard).

    One more shard only ever takes keys into itself, about one in ``shards + 1``.
    """
    tries = [F.struct(F.xxhash64(F.lit(seed), key.cast("string"), F.lit(s)).alias("h"),
                      F.lit(s).alias("s")) for s in range(shards)]
    return F.greatest(*tries)["s"] if shards > 1 else F.lit(0)


def shuffle_into_shards(records: DataFrame, key_col: str, size_col: str, shards: int = SHARDS,
                        seed: int = SEED, bucket_bytes: int = BUCKET_BYTES,
                        bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``records`` with ``shard`` and ``slot``, their place in the shard, gapless from 0, as written.

    Pass 1 scatters records over the memory-sized buckets of their shard by a seeded hash and
    writes them to the shared folder. Pass 2 shuffles each bucket by Fisher-Yates (Spark's
    ``shuffle``), numbers its records and writes them there, too, in a folder for each shard, in
    order of slot in each file; a bucket begins where the one before it ends. The result reads
    these files. So a shard holds its records in random order, and a task holds one bucket on
    average and a handful at most (buckets are hashed to as many tasks). The rows and ``size_col``
    bytes of a bucket are bounded in expectation: each shard has as many buckets as its own rows
    and bytes need, also where one key holds most of them.

    The shard depends on the key and the number of shards alone. The bucket also depends on the
    record's number in the scan, so that equal keys and repeated rows spread over the buckets of
    their shard. Null keys are one key; null sizes count as 0. Columns named ``shard`` or ``slot``
    are replaced, all others are kept; an empty table gives no rows.
    """
    scratch = Scratch(records.sparkSession, "sharding")
    names = [c for c in records.columns if c not in ("shard", "slot")]
    shard = shard_of(F.col(key_col), shards, seed)
    sums = records.groupBy(shard.alias("s")).agg(F.count("*").alias("n"), F.sum(size_col).alias("bytes")).collect()
    needed = {r["s"]: max(1, -(-(r["bytes"] or 0) // bucket_bytes), -(-r["n"] // bucket_rows)) for r in sums}
    buckets = F.create_map(*[F.lit(x) for pair in needed.items() for x in pair])
    record = F.struct(*names).alias("record")
    scattered = scratch.save(
        records.select(record, F.monotonically_increasing_id().alias("number"))
        .select(shard_of(F.col(f"record.{key_col}"), shards, seed).alias("shard"),
                "number", "record")
        .select("shard", F.pmod(F.xxhash64(F.lit(seed), "number"), F.element_at(buckets, F.col("shard")) if sums else F.lit(1)).alias("bucket"),
                "number", "record"), "scattered")
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (scattered.groupBy("shard", "bucket").count()  # one row per bucket
              .select("shard", "bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("begin")))
    shuffled = (scattered.repartition(sum(needed.values()) or 1, "shard", "bucket").groupBy("shard", "bucket")
                .agg(F.shuffle(F.sort_array(F.collect_list(F.struct("number", "record"))),
                               seed).alias("records")))
    written = scratch.save(
        shuffled.join(starts, ["shard", "bucket"])
        .select("shard", "begin", F.posexplode("records").alias("place", "r"))
        .select("r.record.*", "shard", (F.col("begin") + F.col("place")).alias("slot"))
        .sortWithinPartitions("shard", "slot"), "shards", partition_by=("shard",))
    scratch.drop(scattered)
    return written
