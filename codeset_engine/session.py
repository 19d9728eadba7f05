"""Session settings, lineage cuts and size checks shared by all jobs."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, Row, SparkSession


def build_session(app_name: str = "codeset_engine", master: str | None = None,
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Session with the settings the jobs rely on.

    On a cluster leave ``shuffle_partitions`` unset: AQE coalesces the initial
    number, which the deployment sets from its executor count.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts, as named by ``spark.checkpoint.dir``.

    A folder of our own is made only for local masters that name none (tests); on a
    cluster a missing setting is an error, since a machine-local folder would lose
    the data together with its executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    return _local_root()


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="codeset-checkpoint-", dir="/tmp")


_CUTS: dict[int, str] = {}   # where the tables lie


def cut_lineage(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write ``df`` once as a table in the checkpoint folder and read it back.

    Used after expensive or paid steps (embedding, model calls) so that a lost
    executor or a second action never repeats them.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    cut = spark.read.schema(df.schema).parquet(path)
    _CUTS[id(cut)] = path
    return cut


def drop_cut(cut: DataFrame) -> None:
    """Delete what :func:`cut_lineage` has written, once nothing reads it any more."""
    jvm = cut.sparkSession._jvm
    folder = jvm.org.apache.hadoop.fs.Path(_CUTS.pop(id(cut)))
    folder.getFileSystem(cut.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def rows_if_small(df: DataFrame, max_rows: int) -> list[Row] | None:
    """The rows of ``df`` when there are at most ``max_rows`` of them, else None.

    Never brings more than ``max_rows + 1`` rows to the driver.
    """
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def spread(df: DataFrame) -> DataFrame:
    """Repartition a scan that has fewer splits than the session has cores.

    A Parquet row group is read by one task, so a few large ones would leave most cores idle
    in work that costs much CPU per row. Inputs with enough splits stay as they are, which at
    scale is every input.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
