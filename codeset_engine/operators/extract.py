"""Model calls over messages and the entities found in the responses."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import schemas
from ..functions.prompts import TEMPLATES, build_messages, render_prompt
from ..functions.responses import object_body
from .embed import with_retry

# Entity kinds with their templates, and the retry settings of model calls.
KINDS = {"diagnoses": "diagnosis_extraction", "procedures": "procedure_extraction"}
RESPONSES = {"diagnoses": schemas.DIAGNOSES_RESPONSE, "procedures": schemas.PROCEDURES_RESPONSE}
RETRY_ATTEMPTS, INITIAL_DELAY, BACKOFF = 3, 1.0, 2.0
NO_TEXT, NOT_PARSED = "No document text provided", "Failed to parse JSON response"


def route_documents(docs: DataFrame, text: str = "document_text",
                    kind: str = "extract_type") -> DataFrame:
    """One row per document and entity kind to extract, with ``kind`` and ``error``.

    ``diagnoses`` and ``procedures`` ask for themselves, anything else for both. Documents
    without text keep one row with an error and no kind.
    """
    every = F.array(*[F.lit(name) for name in KINDS])
    asked = F.when(F.col(kind).isin(*KINDS), F.array(kind)).otherwise(every)
    has_text = F.coalesce(F.length(text) > 0, F.lit(False))
    kinds = F.when(has_text, asked).otherwise(F.array())
    return (docs.withColumn("kind", F.explode_outer(kinds))
            .withColumn("error", F.when(F.col("kind").isNull(), F.lit(NO_TEXT))))


def extraction_prompt(kind: Column, text: Column,
                      templates: Mapping[str, str] = TEMPLATES) -> Column:
    """Prompt for the row's entity kind."""
    prompt = F.lit(None).cast("string")
    for name, template in KINDS.items():
        rendered = render_prompt(templates[template], {"document_text": text})
        prompt = F.when(kind == name, rendered).otherwise(prompt)
    return prompt


def call_model(df: DataFrame, model: Callable[[list[dict[str, str]]], dict], messages: str,
               attempts: int = RETRY_ATTEMPTS, delay: float = INITIAL_DELAY,
               factor: float = BACKOFF) -> DataFrame:
    """Adds ``response`` (the model-call record), ``ok`` and ``call_error``.

    ``model`` gets the message list of one row and returns the record's fields except the
    duration. Write the result with ``session.cut_lineage`` before using it: evaluating the
    plan again would repeat the calls.
    """
    out = T.StructType([*df.schema.fields, T.StructField("response", schemas.MODEL_CALL),
                        T.StructField("ok", T.BooleanType()),
                        T.StructField("call_error", T.StringType())])
    call = with_retry(model, attempts, delay, factor)

    def one(value) -> tuple[dict | None, bool, str | None]:
        started = time.monotonic()
        try:
            record = call([dict(message) for message in value])
            return {**record, "duration": time.monotonic() - started}, True, None
        except Exception as error:
            return None, False, f"{type(error).__name__}: {error}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            results = [one(value) for value in batch[messages]]
            batch["response"], batch["ok"], batch["call_error"] = zip(*results) if results else ((), (), ())
            yield batch

    return df.mapInPandas(run, out)


def parse_entities(responses: DataFrame, content: str = "content", tokens: str = "total_tokens",
                   kind: str = "kind") -> DataFrame:
    """Adds ``success, diagnoses, procedures, n_found, tokens_used, error`` per response.

    A response counts as parsed when it holds a JSON object with any key; the entity list may
    be missing and is then empty. Each response is parsed once for both lists.
    """
    fields = T.StructType([field for schema in RESPONSES.values() for field in schema])
    result = (responses.withColumn("__body", object_body(F.col(content)))
              .withColumn("__parsed", F.from_json("__body", fields))
              .withColumn("success", F.col(kind).isNotNull() & F.col("__body").isNotNull()))
    for field in fields:
        wanted = F.col("success") & (F.col(kind) == field.name)
        result = result.withColumn(field.name, F.coalesce(
            F.when(wanted, F.col("__parsed")[field.name]), F.array().cast(field.dataType)))
    return (result
            .withColumn("n_found", F.size("diagnoses") + F.size("procedures"))
            .withColumn("tokens_used", F.when(F.col("success"), F.coalesce(F.col(tokens), F.lit(0)))
                        .otherwise(F.lit(0)))
            .withColumn("error", F.when(F.col(kind).isNull(), F.lit(NO_TEXT))
                        .when(~F.col("success"), F.lit(NOT_PARSED)))
            .drop("__body", "__parsed"))


def combine_extractions(parsed: DataFrame, doc: str, order: str | None = None) -> DataFrame:
    """One row per document: success of all kinds, both entity lists, counts and tokens.

    The lists hold the entities of all responses of their kind, by the column ``order`` (such as
    a chunk number), then by content.
    """
    place = F.col(order) if order else F.lit(0)
    lists = []
    for name in RESPONSES:
        own = F.when(F.col("kind") == name, F.struct(place.alias("place"), F.col(name).alias("found")))
        lists.append(F.flatten(F.sort_array(F.collect_list(own))["found"]).alias(name))
    return (parsed.groupBy(doc).agg(
        F.bool_and("success").alias("success"), *lists,
        F.sum("tokens_used").alias("tokens_used"), F.min("error").alias("error"))
        .withColumn("n_diagnoses", F.size("diagnoses"))
        .withColumn("n_procedures", F.size("procedures"))
        .withColumn("n_total", F.col("n_diagnoses") + F.col("n_procedures")))


def extraction_requests(docs: DataFrame, text: str = "document_text", kind: str = "extract_type",
                        templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """Routed documents with the messages to send; rows without text have none."""
    routed = route_documents(docs, text, kind)
    prompt = extraction_prompt(F.col("kind"), F.col(text), templates)
    return routed.withColumn("messages", F.when(F.col("kind").isNotNull(),
                                                build_messages(prompt)))


def usage_stats(calls: DataFrame, by: str = "agent") -> DataFrame:
    """Calls, successes, failures, tokens and time per agent; averages over successful calls."""
    ok = F.col("ok")
    tokens = F.sum(F.when(ok, F.col("total_tokens")).otherwise(F.lit(0)))
    seconds = F.sum(F.when(ok, F.col("duration")).otherwise(F.lit(0.0)))
    return (calls.groupBy(by).agg(
        F.count(F.lit(1)).alias("total_calls"), F.count_if(ok).alias("successful_calls"),
        F.count_if(~ok).alias("failed_calls"), tokens.alias("total_tokens"),
        seconds.alias("total_time"))
        .withColumn("avg_tokens_per_call", F.coalesce(
            F.try_divide("total_tokens", "successful_calls"), F.lit(0.0)))
        .withColumn("avg_time_per_call", F.coalesce(
            F.try_divide("total_time", "successful_calls"), F.lit(0.0))))
