"""Corpus preparation: language, near duplicates, benchmark passages, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and reread as the
``docs`` of the next one. All but the last return the columns of ``documents``. SQL cannot express
the trained stages; tests check the pipeline against a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from codeset_engine.llm import decontamination, language_id, near_dup, packing, pii
from codeset_engine.llm.common import Scratch
from codeset_engine.llm.queries import language_model, read

LEAST_SCORE = 0.5  # a language has to be likelier than all others together


def _with_text(docs: DataFrame, columns: list[str], text) -> DataFrame:
    """The columns of ``docs`` with another text, and the number of characters that goes with it."""
    changed = {"text": text, "n_chars": F.when(~text.eqNullSafe(F.col("text")), F.length(text).cast("long"))
               .otherwise(F.col("n_chars"))}
    return docs.select(*[changed.get(c, F.col(c)).alias(c) for c in columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letter, or no language likelier than all others together."""
    found = language_id.identify(docs, language_model(docs), result_col="__language")
    return found.where((F.col("__language.lang_pred") != language_id.UNKNOWN)
                       & (F.col("__language.score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    return near_dup.drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents go of which more than half are such passages."""
    found = decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"), result_col="__found")
    kept = found.where(~(F.col("__found.contaminated") & (F.trim("__found.clean") == "")))
    return _with_text(kept, docs.columns, F.col("__found.clean"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind."""
    found = pii.find_personal_data(docs, result_col="__personal")
    return _with_text(found, docs.columns, F.col("__personal.redacted"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences along the curve, one row per piece of a document."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark),
          ("personal_data", personal_data), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES, 1):
        result = stage(spark, docs, sf_dir)
        if number == len(STAGES):
            return result
        written = scratch.save(result, name)
        if number > 1:
            scratch.drop(docs)
        docs = written
