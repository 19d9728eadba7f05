"""Chunking of whole texts and the metadata of chunks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .. import schemas
from ..functions.validate import file_extension
from .ranking import first_per_key

# Default size, overlap and separators in order of preference.
CHUNK_SIZE, CHUNK_OVERLAP = 1000, 200
SEPARATORS = ("\n\n", "\n", ". ", " ")


def chunk_id(text: Column) -> Column:
    """First 16 hex digits of the MD5 of the UTF-8 text."""
    return F.substring(F.md5(F.encode(text, "UTF-8")), 1, 16)


def check_sizes(size: int, overlap: int) -> None:
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and smaller than the chunk size")


def chunk_fixed(docs: DataFrame, text: str = "text", size: int = CHUNK_SIZE,
                overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Character windows of ``size`` that advance by ``size - overlap``.

    Adds ``chunk_index, total_chunks, start_index, chunk``. The windows cover the whole text
    and end with it; empty texts have none. Row-local, no shuffle. The text is cut once into
    pieces of the step width and a chunk joins its piece with the next ones, so the cost is
    linear in the text however long it is.
    """
    check_sizes(size, overlap)
    step = size - overlap
    total = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / F.lit(float(step)))).cast("int")
    pieces_per_chunk = 1 - (-overlap // step)
    pieces = F.col("__pieces")
    chunks = F.transform(
        F.sequence(F.lit(1), F.col("total_chunks")),
        lambda i: F.substring(F.array_join(F.slice(pieces, i, pieces_per_chunk), ""), 1, size))
    others = [name for name in docs.columns if name != text]
    return (docs.filter(F.length(text) > 0)
            .select(*others, total.alias("total_chunks"),
                    F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
                    .alias("__pieces"))
            .select(*others, "total_chunks", F.posexplode(chunks).alias("chunk_index", "chunk"))
            .select(*others, "chunk_index", "total_chunks",
                    (F.col("chunk_index") * step).alias("start_index"), "chunk"))


def split_spans(text: str, size: int, overlap: int,
                separators: Sequence[str] = SEPARATORS) -> list[tuple[int, int]]:
    """(start, end) of chunks of one text.

    A chunk ends after the last occurrence of the most preferred separator in the part of its
    window that is new, else at the window's end. The next chunk starts ``overlap`` characters
    before that end but always later than the chunk before it.
    """
    spans, start, covered = [], 0, 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            for separator in separators:
                at = text.rfind(separator, covered, end)
                if at > start:
                    end = at + len(separator)
                    break
        spans.append((start, end))
        covered = end
        if end == len(text):
            break
        start = max(end - overlap, start + 1)
    return spans


def chunk_by_separator(docs: DataFrame, text: str = "text", size: int = CHUNK_SIZE,
                       overlap: int = CHUNK_OVERLAP,
                       separators: Sequence[str] = SEPARATORS) -> DataFrame:
    """As :func:`chunk_fixed`, preferring paragraph, line, sentence and word ends.

    Where a chunk ends decides where the next one starts, which no built-in expresses, so
    this runs over Arrow batches. Other columns are carried through unchanged.
    """
    check_sizes(size, overlap)
    separators = tuple(separators)
    others = [field for field in docs.schema if field.name != text]
    names = [field.name for field in others]
    out = T.StructType([*others, *[T.StructField(name, T.IntegerType()) for name in
                                   ("chunk_index", "total_chunks", "start_index")],
                        T.StructField("chunk", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            source, cut = [], []
            for row, value in enumerate(batch[text]):
                spans = split_spans(value or "", size, overlap, separators)
                source += [row] * len(spans)
                cut += [(i, len(spans), a, value[a:b]) for i, (a, b) in enumerate(spans)]
            chunks = pd.DataFrame(cut, columns=out.names[len(names):])
            carried = batch[names].iloc[source].reset_index(drop=True)
            yield pd.concat([carried, chunks], axis=1)

    return docs.select(*names, text).mapInPandas(run, out)


def chunk_metadata(chunks: DataFrame, path: str = "path", n_bytes: str = "length",
                   code_type: str = "code_type", year: str = "year",
                   root: str = "") -> DataFrame:
    """Chunk rows in the fixed chunk schema, plus ``id``, ``chunk`` and ``path``.

    Facts that only some file kinds have (page, sheet, element, ...) are taken from columns of
    the same name when present and stay null elsewhere.
    """
    name = F.substring_index(F.col(path), "/", -1)
    extension = file_extension(F.col(path))
    relative = F.when(F.startswith(F.col(path), F.lit(root)),
                      F.substring(path, len(root) + 1, (1 << 31) - 1)).otherwise(F.col(path))
    index, total = F.col("chunk_index"), F.col("total_chunks")
    values = {
        "source_file": name, "source_path": relative,
        "file_type": F.substring(F.regexp_extract(name, r"[^/](\.[^./]+)$", 1), 2, (1 << 31) - 1),
        "file_size_kb": F.round(F.col(n_bytes) / F.lit(1024.0), 2),
        "code_type": F.col(code_type), "year": F.col(year).cast("string"),
        "cms_category": F.upper(code_type), "chunk_index": index, "total_chunks": total,
        "chunk_id": chunk_id(F.col("chunk")), "chunk_size": F.length("chunk"),
        "has_previous_chunk": index > 0, "has_next_chunk": index < total - 1,
    }
    only_for = {"page_label": (".pdf",), "total_pages": (".pdf",), "element_type": (".xml",),
                "parent_element": (".xml",), "sheet_name": (".xlsx", ".xls"),
                "row_number": (".xlsx", ".xls")}
    for field in schemas.CHUNK:
        if field.name not in values:
            value = (F.col(field.name) if field.name in chunks.columns else F.lit(None))
            if field.name in only_for:
                value = F.when(extension.isin(*only_for[field.name]), value)
            values[field.name] = value
    return chunks.select(
        chunk_row_id(F.col(code_type), F.col(year), relative, index).alias("id"), "chunk", path,
        *[values[f.name].cast(f.dataType).alias(f.name) for f in schemas.CHUNK])


def chunk_row_id(code_type: Column, year: Column, relative_path: Column, index: Column) -> Column:
    """Row id from type, year, relative path and index; the path keeps equal stems apart."""
    return F.concat_ws("_", code_type, year.cast("string"), relative_path, F.lit("chunk"),
                       index.cast("string"))


def neighbour_flags(chunks: DataFrame, doc: str) -> DataFrame:
    """Total, previous and next flags for chunks that come without their total.

    The totals are counted with map-side aggregation and joined back, so a document with very
    many chunks is not gathered in one task.
    """
    totals = chunks.groupBy(doc).agg(F.count(F.lit(1)).cast("int").alias("total_chunks"))
    return (chunks.join(totals, doc)
            .withColumn("has_previous_chunk", F.col("chunk_index") > 0)
            .withColumn("has_next_chunk", F.col("chunk_index") < F.col("total_chunks") - 1))


def number_across_elements(chunks: DataFrame, doc: str = "path",
                           element: str = "element_no") -> DataFrame:
    """Chunk index and total over all elements (pages, sheets) of a document.

    Chunks of documents that are one element (null ``element``) are numbered already and are
    not moved. The others are gathered per document, which one task has decoded before.
    """
    whole = chunks.filter(F.col(element).isNull())
    by_doc = Window.partitionBy(doc)
    in_order = by_doc.orderBy(element, "chunk_index")
    parts = (chunks.filter(F.col(element).isNotNull())
             .withColumn("total_chunks", F.count(F.lit(1)).over(by_doc).cast("int"))
             .withColumn("chunk_index", F.row_number().over(in_order) - 1))
    return whole.unionByName(parts)


def dedupe_chunks(chunks: DataFrame, order: Sequence[Column],
                  text: str = "chunk") -> DataFrame:
    """One chunk per text: the first in ``order``.

    Texts are compared in full; their SHA-256 digest comes first, so that comparing is cheap.
    """
    digest = "__sha256"
    hashed = chunks.withColumn(digest, F.sha2(F.col(text), 256))
    return first_per_key(hashed, [digest, text], order).drop(digest)
