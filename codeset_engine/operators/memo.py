"""Paid calls, once per distinct input: results are stored under the digest of what was asked.

Rows that ask the same collapse before the call, stored answers join back, and failures are asked
again: the store keeps their errors, by run, but they are no answers. New inputs are called in waves,
each appended to the store by one job when it is done, so a run that breaks off repeats at most one wave.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .. import schemas
from ..session import cut_lineage, drop_cut
from ..sources.tables import exists
from .embed import embed_batches
from .extract import call_model

WAVE = 50_000    # calls between two commits


def ask_digest(model: str, asked: Column) -> Column:
    """Key of a call: SHA-256 of the model's name and the whole input."""
    return F.sha2(F.to_json(F.struct(F.lit(model).alias("model"), asked.alias("asked"))), 256)


def _stored(spark: SparkSession, path: str, answer: T.DataType) -> DataFrame:
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("answer", answer),
                           T.StructField("call_error", T.StringType()), T.StructField("run", T.StringType())])
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def read_answers(spark: SparkSession, path: str, answer: T.DataType) -> DataFrame:
    """(key, answer) of the store; two runs at once may both have stored a key, one of them counts."""
    return (_stored(spark, path, answer).where("call_error IS NULL").select("key", "answer")
            .dropDuplicates(["key"]))


def answer_once(df: DataFrame, asked: str, model_name: str, path: str, answer: T.DataType,
                call: Callable[[DataFrame], DataFrame], wave: int = WAVE) -> DataFrame:
    """``df`` with ``answer`` and ``call_error``; ``call`` sees every distinct new input once.

    ``call`` gets (key, asked) and adds answer and call_error. Rows with a null input are not
    asked and have neither. Inputs that fail are asked again by the next run.
    """
    spark = df.sparkSession
    keyed = df.withColumn("__key", F.when(F.col(asked).isNotNull(), ask_digest(model_name, F.col(asked))))
    known = read_answers(spark, path, answer)
    new = cut_lineage(keyed.where(F.col("__key").isNotNull()).groupBy(F.col("__key").alias("key"))
                      .agg(F.first(asked).alias("asked")).join(known.select("key"), "key", "left_anti"), "to-ask")
    waves, run = -(-new.count() // wave), uuid.uuid4().hex
    if waves:
        # a folder for each wave, so that a wave reads its own inputs only, in files for several tasks
        number, tasks = F.pmod(F.xxhash64("key"), F.lit(waves)), spark.sparkContext.defaultParallelism
        deal = F.pmod(F.crc32("key"), F.lit(tasks))
        by_wave = cut_lineage(new.select("key", "asked", number.alias("wave")).repartition(tasks, deal), "waves", "wave")
        for n in range(waves):
            called = call(by_wave.where(F.col("wave") == n).drop("wave"))
            (called.select("key", F.col("answer").cast(answer).alias("answer"), "call_error", F.lit(run).alias("run"))
             .write.mode("append").parquet(path))
        drop_cut(by_wave)
    drop_cut(new)
    answers = read_answers(spark, path, answer).withColumnRenamed("key", "__key")
    failures = (_stored(spark, path, answer).where((F.col("run") == run) & F.col("call_error").isNotNull())
                .select(F.col("key").alias("__key"), "call_error"))
    return keyed.join(answers, "__key", "left").join(failures, "__key", "left").drop("__key")


def call_model_once(df: DataFrame, model: Callable[[list[dict[str, str]]], dict], messages: str, path: str,
                    model_name: str, wave: int = WAVE, **retry) -> DataFrame:
    """``extract.call_model`` through a store: adds ``response``, ``ok`` and ``call_error``."""
    def call(part: DataFrame) -> DataFrame:
        return call_model(part, model, "asked", **retry).withColumnRenamed("response", "answer")

    found = answer_once(df, messages, model_name, path, schemas.MODEL_CALL, call, wave)
    return (found.withColumnRenamed("answer", "response")
            .withColumn("ok", F.when(F.col(messages).isNotNull(), F.col("response").isNotNull())))


def embed_once(df: DataFrame, embedder: Callable[[list[str]], np.ndarray], text: str, path: str,
               model_name: str, vector: str = "embedding", wave: int = WAVE, **batches) -> DataFrame:
    """``embed.embed_batches`` through a store: adds the vector and ``embed_error``."""
    def call(part: DataFrame) -> DataFrame:
        return embed_batches(part, embedder, "asked", "answer", **batches).withColumnRenamed("embed_error", "call_error")

    found = answer_once(df, text, model_name, path, T.ArrayType(T.FloatType()), call, wave)
    return found.withColumnRenamed("answer", vector).withColumnRenamed("call_error", "embed_error")
