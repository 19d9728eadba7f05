"""File discovery as DataFrames over directory listings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.ranking import first_per_key

# Directories per code type in order of preference, and file patterns in
# order of preference (matched against the file name).
SOURCE_DIRS = {
    "icd10cm": ("icd10cm_code_descriptions", "icd10cm_code_tables"),
    "icd10pcs": ("icd10pcs_order", "icd10pcs_codes"),
    "cpt": ("cpt_hcpcs_codes",),
}
FILE_PATTERNS = {
    "icd10cm": (r"^icd10cm_codes_.*\.txt$", r"^icd10cm_order_.*\.txt$", r"order.*\.txt$",
                r"codes.*\.txt$", r"\.txt$"),
    "icd10pcs": (r"^icd10pcs_codes_.*\.txt$", r"^icd10pcs_order_.*\.txt$", r"order.*\.txt$",
                 r"codes.*\.txt$", r"\.txt$"),
    "cpt": (r"\.xlsx$", r"\.csv$", r"\.txt$"),
}
LARGEST_WINS = ("icd10cm", "icd10pcs")


def list_files(spark: SparkSession, path: str, glob: str | None = None,
               recursive: bool = True) -> DataFrame:
    """(path, length, modificationTime) of files; contents are pruned and never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "length", "modificationTime")


def with_source_parts(files: DataFrame) -> DataFrame:
    """Adds ``code_type, source, year, name`` from ``.../{type}/{source}_{year}/.../{name}``."""
    kinds = "|".join(SOURCE_DIRS)
    pattern = rf"/({kinds})/([^/]+)_([0-9]{{4}})/(?:.*/)?([^/]+)$"

    def part(i: int) -> Column:
        return F.regexp_extract("path", pattern, i)

    return (files.filter(F.col("path").rlike(pattern))
            .select("*", part(1).alias("code_type"), part(2).alias("source"),
                    part(3).cast("int").alias("year"), part(4).alias("name")))


def _position(value: Column, key: Column, choices: Mapping[str, Sequence[str]],
              match) -> Column:
    """0-based position of the first choice of the row's key that matches, null if none."""
    result = F.lit(None).cast("int")
    for name, options in choices.items():
        ranked = F.coalesce(*[F.when(match(value, option), F.lit(i))
                              for i, option in enumerate(options)])
        result = F.when(key == name, ranked).otherwise(result)
    return result


def resolve_source_dirs(files: DataFrame) -> DataFrame:
    """(code_type, year, source): the preferred directory that exists.

    ``files``: at least ``code_type, year, source``.
    """
    rank = _position(F.col("source"), F.col("code_type"), SOURCE_DIRS, lambda v, o: v == o)
    ranked = files.select("code_type", "year", "source", rank.alias("priority"))
    return (ranked.filter(F.col("priority").isNotNull()).groupBy("code_type", "year")
            .agg(F.min_by("source", "priority").alias("source")))


def find_code_files(files: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """One file per (code_type, year, source): best pattern, then size where size decides, then path.

    ``files``: ``code_type, year, source, name, path, length``. Files with an extension in
    ``skip`` do not count.
    """
    for extension in skip:
        files = files.filter(~F.endswith(F.lower("name"), F.lit(extension)))
    priority = _position(F.col("name"), F.col("code_type"), FILE_PATTERNS,
                         lambda v, o: v.rlike(o))
    size = F.when(F.col("code_type").isin(*LARGEST_WINS), F.col("length")).otherwise(F.lit(0))
    return first_per_key(
        files.withColumn("priority", priority).filter(F.col("priority").isNotNull()),
        ["code_type", "year", "source"], [F.asc("priority"), F.desc(size), F.asc("path")])


def code_files(files: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """The code file of every (code_type, year): preferred directory, then best file in it."""
    parts = with_source_parts(files)
    return find_code_files(parts, skip).join(resolve_source_dirs(parts),
                                       ["code_type", "year", "source"], "left_semi")


def validate_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """``path, is_valid, error`` for expected paths against a listing (files and directories).

    A path that is only a prefix of listed files is a directory, not a file.
    """
    from ..functions.validate import validate_file
    listed = files.select("path", "length").distinct().withColumn("listed", F.lit(True))
    parents = F.transform(
        F.sequence(F.lit(1), F.size("pieces") - 1),
        lambda i: F.array_join(F.slice("pieces", 1, i), "/"))
    folders = (files.select(F.split("path", "/").alias("pieces"))
               .select(F.explode(parents).alias("path")).distinct()
               .withColumn("folder", F.lit(True)))
    joined = (manifest.select("path").join(listed, "path", "left").join(folders, "path", "left"))
    is_file, is_folder = (F.coalesce(name, F.lit(False)) for name in ("listed", "folder"))
    checked = validate_file(F.col("path"), F.col("length"), is_file | is_folder, is_file)
    return joined.select("path", checked.alias("r")).select("path", "r.is_valid", "r.error")
