"""Stored code tables and vector collections: partitioned Parquet, CSV and JSON exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..operators.embed import collection_name, only_new
from ..session import cut_lineage, drop_cut
from .spreadsheets import XlsxSource

CODE_PARTITIONS = ["collection_type", "year"]
# Export formats that are tables. (PDF is none.)
EXPORT_FORMATS = ("xlsx", "csv", "json")


def _folder(spark: SparkSession, path: str):
    """Hadoop file system and path object of a folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table folder holds anything; looks at its first level only."""
    file_system, folder = _folder(spark, path)
    return bool(file_system.exists(folder)) and any(
        not status.getPath().getName().startswith(("_", "."))
        for status in file_system.listStatus(folder))


def as_code_rows(codes: DataFrame) -> DataFrame:
    """Any code set in the common column list; columns its type lacks are null."""
    return codes.select(*[
        (F.col(f.name) if f.name in codes.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schemas.CODES])


def write_codes(codes: DataFrame, path: str) -> None:
    """Overwrite the (type, year) partitions present in ``codes`` and no others.

    Rows are range-partitioned by type, year and code: a large code set spreads over many
    tasks and files, and each file covers a narrow code range that scans can skip.
    """
    keys = [*CODE_PARTITIONS, "code"]
    (as_code_rows(codes).repartitionByRange(*keys).sortWithinPartitions(*keys)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*CODE_PARTITIONS).parquet(path))


def load_codes(spark: SparkSession, path: str, code_type: str | None = None,
               year: int | None = None) -> DataFrame:
    """Stored codes; type and year prune partitions. Missing tables give no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], schemas.CODES)
    codes = spark.read.schema(schemas.CODES).parquet(path)
    if code_type is not None:
        codes = codes.filter(F.col("collection_type") == code_type)
    if year is not None:
        codes = codes.filter(F.col("year") == year)
    return codes


def read_codes_csv(spark: SparkSession, path: str, code_type: str, year: int) -> DataFrame:
    """A code set kept as CSV with header. Codes stay text, so leading zeros survive."""
    schema = ", ".join(f"{name} string" for name in schemas.COLUMNS_BY_TYPE[code_type])
    raw = spark.read.schema(schema).option("header", "true").option("escape", '"').csv(path)
    return as_code_rows(raw.withColumn("collection_type", F.lit(code_type))
                        .withColumn("year", F.lit(year)))


def export_rows(df: DataFrame, path: str, file_format: str = "csv") -> None:
    if file_format not in EXPORT_FORMATS:
        raise ValueError(f"export format must be one of {EXPORT_FORMATS}, got {file_format!r}")
    if file_format == "xlsx":
        df.sparkSession.dataSource.register(XlsxSource)
    writer = df.write.mode("overwrite").format(file_format)
    (writer.option("header", "true").option("escape", '"') if file_format == "csv"
     else writer).save(path)


def stored_files(spark: SparkSession, path: str) -> DataFrame:
    """Listing of a code table with its partition values, for year metadata."""
    from .listing import list_files
    pattern = r"/collection_type=([^/]+)/year=([0-9]+)/[^/]+$"
    files = list_files(spark, path, glob="*.parquet")
    return files.select("path", "length", "modificationTime",
                        F.regexp_extract("path", pattern, 1).alias("code_type"),
                        F.regexp_extract("path", pattern, 2).cast("int").alias("year"))


# --- vector collections ------------------------------------------------------------------

def read_collections(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], schemas.COLLECTION_ENTRY)
    return spark.read.schema(schemas.COLLECTION_ENTRY).parquet(path)


def write_collection(entries: DataFrame, path: str, errors_path: str | None = None,
                     force: bool = False, only_new_ids: bool = False) -> dict[str, int]:
    """Add entries to their collections; returns counts of written, known and failed rows.

    Ids already stored are skipped, so a load that failed half way is completed by running it
    again; ``only_new_ids`` says that the caller has left them out already. ``force`` replaces the collections that occur in ``entries``. Rows whose vector is
    missing (see ``embed_error``) go to ``errors_path`` and do not stop the others.
    """
    spark = entries.sparkSession
    scratch = [cut_lineage(entries, "entries")]   # vectors are computed once, then read three times
    entries = scratch[0]
    total = entries.count()
    if not force and not only_new_ids and exists(spark, path):
        # The stored ids are read before the append, so the plan below cannot see its own output.
        names = [row["collection"] for row in entries.select("collection").distinct().collect()]
        stored = read_collections(spark, path).filter(F.col("collection").isin(names))
        scratch.append(cut_lineage(only_new(entries, stored), "new-entries"))
        entries = scratch[1]
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.COLLECTION_ENTRY]
    has_vector = F.col("embedding").isNotNull()
    counts = entries.agg(F.count_if(has_vector).alias("written"),
                         F.count_if(~has_vector).alias("failed")).first()
    writer = (entries.filter(has_vector).select(*columns)
              .repartitionByRange("collection", "id").write.partitionBy("collection"))
    if force:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode("append").parquet(path)
    if counts["failed"] and errors_path:
        entries.filter(~has_vector).write.mode("append").parquet(errors_path)
    for table in scratch:
        drop_cut(table)
    return {"written": counts["written"], "failed": counts["failed"],
            "known": total - counts["written"] - counts["failed"]}


def collection_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("collection").agg(F.count(F.lit(1)).alias("count"))


def collection_exists(entries: DataFrame, names: DataFrame) -> DataFrame:
    """``collection, exists, count`` for requested names."""
    return (names.select("collection").distinct()
            .join(collection_counts(entries), "collection", "left")
            .select("collection", F.col("count").isNotNull().alias("exists"),
                    F.coalesce("count", F.lit(0)).alias("count")))


def collection_stats(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """``code_type, year, collection, exists, count`` for requested types and years."""
    named = requests.select("code_type", "year", collection_name(
        F.col("code_type"), F.col("year")).alias("collection"))
    return named.join(collection_exists(entries, named), "collection")


def delete_collection(spark: SparkSession, path: str, name: str) -> bool:
    """Drop one collection's folder through Hadoop's file system API; false if absent."""
    file_system, folder = _folder(spark, f"{path}/collection={name}")
    return bool(file_system.delete(folder, True))
