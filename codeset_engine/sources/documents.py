"""Documents and archives from folders."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.validate import file_extension

# Document types that are scanned; schema files only on request.
TEXT_TYPES, MARKUP_TYPES, DECODED_TYPES = (".txt",), (".xml",), (".pdf", ".xlsx", ".xls")
OPTIONAL_TYPES = (".xsd",)

Decoder = Callable[[bytes], list[dict]]
# What an injected decoder may say about each element it returns, besides ``text``.
ELEMENT_FACTS = T.StructType([
    T.StructField("element_no", T.IntegerType()),
    T.StructField("page_number", T.IntegerType()), T.StructField("page_label", T.StringType()),
    T.StructField("total_pages", T.IntegerType()), T.StructField("sheet_name", T.StringType()),
    T.StructField("row_number", T.IntegerType())])


BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def document_listing(files: DataFrame, code_type: str, year: int,
                     include_xsd: bool = False) -> DataFrame:
    """Files directly inside ``{code_type}/*_{year}`` folders whose type is supported."""
    types = TEXT_TYPES + MARKUP_TYPES + DECODED_TYPES + (OPTIONAL_TYPES if include_xsd else ())
    return (files.filter(F.col("path").rlike(rf"/{code_type}/[^/]+_{year}/[^/]+$"))
            .withColumn("extension", file_extension(F.col("path")))
            .filter(F.col("extension").isin(*types))
            .withColumn("code_type", F.lit(code_type)).withColumn("year", F.lit(year)))


def _no_facts() -> list[Column]:
    return [F.lit(None).cast(f.dataType).alias(f.name) for f in ELEMENT_FACTS]


def _carried(files: DataFrame) -> list[str]:
    return [name for name in files.columns if name != "content"]


def load_plain(files: DataFrame) -> DataFrame:
    """Texts of plain text and XML files, decoded by built-in functions.

    XML gives its character data without tags, comments and declarations. Bytes that are no
    UTF-8 give an error instead of a text.
    """
    text = F.col("content").cast("string")
    readable = F.is_valid_utf8(text)
    unpacked = F.trim(F.regexp_replace(F.regexp_replace(
        text, r"(?s)<!--.*?-->|<\?.*?\?>|<[^>]*>", " "), r"\s+", " "))
    value = F.when(F.col("extension").isin(*MARKUP_TYPES), unpacked).otherwise(text)
    return files.select(*_carried(files), F.when(readable, value).alias("text"), *_no_facts(),
                        F.when(~readable, F.lit("not UTF-8")).alias("load_error"))


def load_decoded(files: DataFrame, decoders: Mapping[str, Decoder]) -> DataFrame:
    """Texts of files that need an injected decoder, keyed by extension.

    A decoder takes bytes and returns ``[{"text": ..., facts}]``; the elements of a file are
    numbered in ``element_no``. It runs over Arrow batches; its failure becomes the row's error.
    """
    decoders = dict(decoders)
    out = load_plain(files).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for record in batch.to_dict("records"):
                content = record.pop("content")
                try:
                    elements = decoders[record["extension"]](bytes(content))
                    rows = [{**record, "element_no": i, **element, "load_error": None}
                            for i, element in enumerate(elements)]
                except Exception as error:
                    rows = [{**record, "text": None,
                             "load_error": f"{type(error).__name__}: {error}"}]
                yield pd.DataFrame(rows).reindex(columns=out.names).astype(object).where(
                    lambda frame: frame.notna(), None)

    return files.mapInPandas(run, out)


def refuse(files: DataFrame) -> DataFrame:
    """Rows for files that nothing can load; their contents are not read."""
    return files.select(*_carried(files), F.lit(None).cast("string").alias("text"), *_no_facts(),
                        F.concat(F.lit("Unsupported file type: "), F.col("extension"))
                        .alias("load_error"))


def matching_folders(spark: SparkSession, pattern: str) -> list[str]:
    """Folders that match a path pattern; files of other folders are never listed or opened."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [str(status.getPath()) for status in found or () if status.isDirectory()]


def scan_documents(spark: SparkSession, raw_dir: str, code_type: str, year: int,
                   decoders: Mapping[str, Decoder] | None = None,
                   include_xsd: bool = False) -> DataFrame:
    """Documents of one code type and year under ``{raw_dir}/{code_type}/*_{year}/``.

    Each way of loading has its own scan, limited by file name, so no content is read twice.
    What cannot be loaded keeps a row with its error.
    """
    folders = matching_folders(spark, f"{raw_dir}/{code_type}/*_{year}")

    def scan(*types: str) -> DataFrame:
        # A name pattern for the extensions in any case.
        names = ",".join("".join(f"[{c.lower()}{c.upper()}]" for c in t[1:]) for t in types)
        reader = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{names}}}")
        files = reader.load(folders) if folders else spark.createDataFrame([], BINARY_FILE)
        return document_listing(files, code_type, year, include_xsd)

    decoders = {t: d for t, d in (decoders or {}).items() if t in DECODED_TYPES + OPTIONAL_TYPES}
    asked = DECODED_TYPES + (OPTIONAL_TYPES if include_xsd else ())
    docs = load_plain(scan(*TEXT_TYPES, *MARKUP_TYPES))
    if decoders:
        docs = docs.unionByName(load_decoded(scan(*decoders), decoders))
    unknown = [t for t in asked if t not in decoders]
    return docs.unionByName(refuse(scan(*unknown))) if unknown else docs


def expand_archives(archives: DataFrame) -> DataFrame:
    """Members of zip archives: ``archive, member, content, error``.

    ``archives``: ``path, content``. Members leave one at a time, so memory holds one archive
    and one member. A damaged archive gives one row with its error; the job goes on.
    """
    out = "archive string, member string, content binary, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        for info in archive.infolist():
                            if not info.is_dir():
                                yield pd.DataFrame({
                                    "archive": [path], "member": [info.filename],
                                    "content": [archive.read(info)], "error": [None]})
                except Exception as error:
                    yield pd.DataFrame({"archive": [path], "member": [None], "content": [None],
                                        "error": [f"{type(error).__name__}: {error}"]})

    return archives.select("path", "content").mapInPandas(run, out)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    return expand_archives(spark.read.format("binaryFile").option("pathGlobFilter", "*.zip")
                           .option("recursiveFileLookup", "true").load(path))


def expand_status(members: DataFrame) -> DataFrame:
    """Per archive: members and whether all of it could be read."""
    return members.groupBy("archive").agg(
        F.count("member").alias("members"),
        (F.count("error") == 0).alias("ok"), F.max("error").alias("error"))
