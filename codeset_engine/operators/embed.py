"""Embedding text, ids, metadata and vectors."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Batch size, attempts, delay, collection name prefixes.
BATCH_SIZE = 100
MAX_ATTEMPTS = 3
RETRY_DELAY = 2.0
COLLECTION_PREFIX = "medical_codes"
DOCUMENT_PREFIX = "cms_docs"


def embedding_text(code: Column, description: Column, collection_type: Column) -> Column:
    return F.concat(code, F.lit(": "), F.coalesce(description, F.lit("")), F.lit(" ["),
                    collection_type, F.lit("]"))


def entry_id(collection_type: Column, year: Column, code: Column) -> Column:
    return F.concat_ws("_", collection_type, year.cast("string"), code)


def collection_name(collection_type: Column, year: Column,
                    prefix: str = COLLECTION_PREFIX) -> Column:
    return F.concat_ws("_", F.lit(prefix), collection_type, year.cast("string"))


def _as_text(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, T.BooleanType):
        return F.initcap(F.col(name).cast("string"))
    return F.col(name).cast("string")


def entry_metadata(df: DataFrame, extra: Sequence[str] = ()) -> Column:
    """``map<string,string>`` of code, description, type, year and the non-null extra columns.

    An own ``code_type`` among the extras replaces the collection's, so an HCPCS row keeps its
    type inside the CPT collection. Booleans read ``True`` and ``False``.
    """
    own_type = "code_type" in extra
    entries = {
        "code": F.col("code"), "description": F.coalesce("description", F.lit("")),
        "code_type": F.coalesce(F.col("code_type") if own_type else F.lit(None),
                                F.col("collection_type")),
        "year": F.col("year").cast("string"),
    }
    for name in extra:
        entries.setdefault(name, _as_text(df, name))
    flat = [item for key, value in entries.items() for item in (F.lit(key), value)]
    return F.map_filter(F.create_map(*flat), lambda _, value: value.isNotNull())


def code_entries(codes: DataFrame, extra: Sequence[str] = ("code_type",)) -> DataFrame:
    """Code rows as collection entries that still lack their vector."""
    kind, year, code = F.col("collection_type"), F.col("year"), F.col("code")
    return codes.select(
        entry_id(kind, year, code).alias("id"), collection_name(kind, year).alias("collection"),
        embedding_text(code, F.col("description"), kind).alias("document"),
        entry_metadata(codes, extra).alias("metadata"), "code", "description",
        "collection_type", "code_type", "year")


def with_retry(call: Callable, attempts: int = MAX_ATTEMPTS, delay: float = RETRY_DELAY,
               factor: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``call`` repeated up to ``attempts`` times; the pause grows by ``factor``."""

    def attempt(*args):
        pause = delay
        for left in reversed(range(attempts)):
            try:
                return call(*args)
            except Exception:
                if not left:
                    raise
                sleep(pause)
                pause *= factor

    return attempt


def embed_batches(df: DataFrame, embedder: Callable[[list[str]], np.ndarray], text: str,
                  vector: str = "embedding", batch_size: int = BATCH_SIZE,
                  attempts: int = MAX_ATTEMPTS, delay: float = RETRY_DELAY) -> DataFrame:
    """Vectors from an external model, one call per ``batch_size`` texts.

    A batch that fails for good gets null vectors and its message in ``embed_error``; other
    batches go on. Write the result with ``session.cut_lineage`` before branching, because
    each evaluation repeats the calls. The number of partitions bounds concurrent calls.
    """
    out = T.StructType([*df.schema.fields, T.StructField(vector, T.ArrayType(T.FloatType())),
                        T.StructField("embed_error", T.StringType())])
    call = with_retry(embedder, attempts, delay)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for first in range(0, len(frame), batch_size):
                part = frame.iloc[first:first + batch_size].copy()
                try:
                    vectors = np.asarray(call(part[text].tolist()), dtype=np.float32)
                    if len(vectors) != len(part):
                        raise ValueError(f"{len(vectors)} vectors for {len(part)} texts")
                    part[vector], part["embed_error"] = list(vectors), None
                except Exception as error:
                    part[vector], part["embed_error"] = None, f"{type(error).__name__}: {error}"
                yield part

    return df.mapInPandas(run, out)


def hashing_embed(df: DataFrame, text: str, dimension: int = 256,
                  vector: str = "embedding") -> DataFrame:
    """Offline vectors on the JVM: counts of lower-cased tokens by bucket, at unit length.

    The bucket of a token is the number in the first eight hex digits of its MD5, modulo
    ``dimension``. Texts without tokens get a zero vector, which no search returns.
    """
    tokens = F.filter(F.split(F.lower(F.col(text)), r"\s+"), lambda token: token != "")
    buckets = F.transform(tokens, lambda token: F.pmod(
        F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long"), F.lit(dimension)).cast("string"))
    counts = CountVectorizerModel.from_vocabulary([str(i) for i in range(dimension)], "__buckets", "__tf")
    unit = Normalizer(inputCol="__tf", outputCol="__unit", p=2.0)
    bucketed = df.withColumn("__buckets", F.coalesce(buckets, F.array().cast("array<string>")))
    return unit.transform(counts.transform(bucketed)).select(
        *df.columns, vector_to_array("__unit", "float32").alias(vector))


def only_new(entries: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    """Entries whose id is not stored yet; also completes loads that failed half way."""
    return entries.join(existing.select(key).distinct(), key, "left_anti")


def label_centroids(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector per label as search requests (``qid``, ``vector``).

    One vector of sums per label and task is held and shuffled.
    """
    rows = vectors.where(F.col(vector).isNotNull()).select(
        F.col(label).alias("qid"), array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    means = rows.groupBy("qid").agg(Summarizer.mean(F.col("v")).alias("mean"))
    return means.select("qid", vector_to_array("mean").alias("vector"))
