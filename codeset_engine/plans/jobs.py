"""The jobs a user runs: normalise, embed, index documents, search, extract."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..functions.prompts import TEMPLATES
from ..operators import chunk, embed, extract, normalize, search
from ..operators.ranking import first_per_key
from ..session import cut_lineage
from ..sources import code_files, documents, listing, tables


SPREADSHEETS = (".xlsx", ".xls")


def parse_code_file(spark: SparkSession, path: str, code_type: str,
                    decoders: Mapping[str, code_files.Decoder] | None = None) -> DataFrame:
    """Rows of one raw code file by type and extension, de-duplicated in line order.

    ``decoders`` read spreadsheets, by extension.
    """
    if code_type == "icd10cm":
        rows = normalize.parse_icd10cm_lines(code_files.read_lines(spark, path))
    elif code_type == "icd10pcs":
        rows = normalize.parse_icd10pcs_lines(code_files.read_lines(spark, path))
    elif code_type == "cpt":
        extension = path.lower()[path.rfind("."):]
        if extension in SPREADSHEETS:
            if extension not in (decoders or {}):
                raise ValueError(f"{extension} files need a decoder")
            sheet = code_files.read_decoded(spark, path, decoders[extension])
        else:
            sheet = code_files.number_rows(code_files.read_delimited(
                spark, path, sep="\t" if extension == ".txt" else ","), normalize.HEADER_ROWS_TRIED + 1)
        codes = normalize.read_sheet_codes(sheet, carry=("block_start", "line_id"))
        return normalize.dedupe_codes(codes, code_files.line_order())
    else:
        raise ValueError(f"Unknown code type: {code_type}")
    return normalize.dedupe_codes(rows, code_files.line_order())


def normalize_codes(spark: SparkSession, raw_dir: str, code_type: str, year: int, out: str,
                    decoders: Mapping[str, code_files.Decoder] | None = None) -> DataFrame | None:
    """Find, parse, de-duplicate and store the code set of one type and year.

    Spreadsheets count as code files where ``decoders`` has their extension; else the next file
    is taken. Returns the stored rows, or None when there is no code file or it holds no codes;
    the stored partition then stays as it is.
    """
    skip = [extension for extension in SPREADSHEETS if extension not in (decoders or {})]
    found = listing.code_files(listing.list_files(spark, raw_dir), skip).filter(
        (F.col("code_type") == code_type) & (F.col("year") == year)).select("path").first()
    if found is None:
        return None
    codes = parse_code_file(spark, found["path"], code_type, decoders)
    parsed = Observation("parsed")
    codes = (codes.withColumn("collection_type", F.lit(code_type)).withColumn("year", F.lit(year))
             .observe(parsed, F.count(F.lit(1)).alias("rows")))
    tables.write_codes(codes, out)   # without rows no partition is overwritten
    return tables.load_codes(spark, out, code_type, year) if parsed.get["rows"] else None


def embed_codes(spark: SparkSession, codes_path: str, collections_path: str, code_type: str,
                year: int, embedder: Callable | None = None, force: bool = False,
                dimension: int = 256) -> dict[str, int]:
    """Embed a stored code set into its collection. Without a model, hashed vectors are used."""
    codes = tables.load_codes(spark, codes_path, code_type, year)
    extra = [name for name in ("code_type", "category", "is_billable", "section", "body_system")]
    entries = _new_entries(spark, embed.code_entries(codes, extra), collections_path, code_type, year, force)
    return _embed_and_write(entries, collections_path, embedder, force, dimension)


def collection_names(code_type: str, year: int) -> list[str]:
    """The collections of a type and year: that of its codes and that of its documents."""
    return [f"{prefix}_{code_type}_{year}" for prefix in (embed.COLLECTION_PREFIX, embed.DOCUMENT_PREFIX)]


def _new_entries(spark: SparkSession, entries: DataFrame, path: str, code_type: str, year: int,
                 force: bool) -> DataFrame:
    """One entry per id; without ``force`` only ids that their collection does not hold yet."""
    entries = first_per_key(entries, ["id"], [F.asc("document")])
    if force or not tables.exists(spark, path):
        return entries
    stored = tables.read_collections(spark, path)
    return embed.only_new(entries, stored.filter(F.col("collection").isin(collection_names(code_type, year))))


def _embed_and_write(entries: DataFrame, path: str, embedder: Callable | None, force: bool,
                     dimension: int) -> dict[str, int]:
    vectors = (embed.hashing_embed(entries, "document", dimension) if embedder is None
               else embed.embed_batches(entries, embedder, "document"))
    return tables.write_collection(vectors, path, f"{path}-errors", force, only_new_ids=True)


def chunk_documents(docs: DataFrame, raw_dir: str, size: int = chunk.CHUNK_SIZE,
                    overlap: int = chunk.CHUNK_OVERLAP, dedupe: bool = False) -> DataFrame:
    """Loaded documents to chunk rows with metadata; ``dedupe`` keeps one chunk per text."""
    texts = docs.filter(F.col("load_error").isNull())
    chunks = chunk.number_across_elements(chunk.chunk_by_separator(texts, "text", size, overlap))
    rows = chunk.chunk_metadata(chunks, root=raw_dir.rstrip("/") + "/")
    return chunk.dedupe_chunks(rows, [F.asc("path"), F.asc("chunk_index")]) if dedupe else rows


def embed_documents(spark: SparkSession, raw_dir: str, collections_path: str, code_type: str,
                    year: int, decoders: Mapping | None = None, embedder: Callable | None = None,
                    force: bool = False, dimension: int = 256) -> dict[str, int]:
    """Scan, chunk and embed the documents of one type and year; one overwrite when forced."""
    docs = documents.scan_documents(spark, raw_dir, code_type, year, decoders)
    chunks = chunk_documents(docs, raw_dir)
    facts = [name for name in chunks.columns if name not in ("id", "chunk", "path")]
    pairs = [item for name in facts for item in (F.lit(name), embed._as_text(chunks, name))]
    entries = chunks.select(
        "id", embed.collection_name(F.lit(code_type), F.lit(year),
                                    embed.DOCUMENT_PREFIX).alias("collection"),
        F.col("chunk").alias("document"),
        F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()).alias("metadata"),
        F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("description"),
        F.lit(code_type).alias("collection_type"), F.lit(code_type).alias("code_type"),
        F.lit(year).alias("year"))
    entries = _new_entries(spark, entries, collections_path, code_type, year, force)
    return _embed_and_write(entries, collections_path, embedder, force, dimension)


def search_codes(entries: DataFrame, requests: DataFrame, code_type: str, year: int,
                 k: int = search.TOP_K, where: Column | None = None,
                 hybrid: bool = True) -> DataFrame:
    """Top-k of one type and year with code, description and metadata.

    Only the folders of the type's and year's collections are read, and ``where`` filters before
    the search; descriptions are joined back to the few hits.
    """
    chosen = entries.filter(F.col("collection").isin(collection_names(code_type, year))
                            & (F.col("collection_type") == code_type) & (F.col("year") == year))
    if where is not None:
        chosen = chosen.filter(where)
    if hybrid:
        hits = search.hybrid_topk(chosen, chosen, requests, k, id_col="id",
                                  vector_col="embedding", text_col="document")
    else:
        hits = search.semantic_topk(chosen, requests, k, id_col="id", vector_col="embedding")
    facts = chosen.select("id", "code", "description", "code_type", "year", "metadata")
    return hits.join(facts, "id")


def search_all_types(entries: DataFrame, requests: DataFrame, year: int,
                     k: int = search.TOP_K_PER_TYPE) -> DataFrame:
    """Top-k per collection type in one pass; types without hits do not occur."""
    chosen = entries.filter(F.endswith("collection", F.lit(f"_{year}")) & (F.col("year") == year))
    hits = search.semantic_topk(chosen, requests, k, id_col="id", vector_col="embedding",
                                per=["collection_type"])
    return hits.join(chosen.select("id", "code", "description", "code_type"), "id")


def extract_entities(docs: DataFrame, model: Callable, doc: str = "doc_id",
                     text: str = "document_text", kind: str = "extract_type",
                     templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """Diagnoses and procedures per document.

    Only rows with text reach the model, and responses are written before they are parsed, so
    that neither a lost executor nor a second action repeats a call.
    """
    requests = extract.extraction_requests(docs.select(doc, text, kind), text, kind, templates)
    asked = requests.filter(F.col("messages").isNotNull()).select(doc, "kind", "messages")
    responses = cut_lineage(extract.call_model(asked, model, "messages"), "model-calls")
    answered = responses.select(doc, "kind", F.col("response.content").alias("content"),
                                F.col("response.usage.total_tokens").alias("total_tokens"))
    unasked = requests.filter(F.col("messages").isNull()).select(
        doc, "kind", F.lit(None).cast("string").alias("content"),
        F.lit(None).cast("long").alias("total_tokens"))
    return extract.combine_extractions(extract.parse_entities(answered.unionByName(unasked)), doc)
