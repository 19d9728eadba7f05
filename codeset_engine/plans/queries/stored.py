"""Queries that write derived rows to the shared folder, by job or by stream, and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ...operators import embed, memo
from ...operators.ranking import first_per_key
from ...session import checkpoint_root
from ...sources import code_files, spreadsheets, tables
from ...streaming import logs, sessions
from . import logs as log_queries, search, texts
from .registry import DERIVED, ORACLES, query, read


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"


_CODES = search._COLLECTION_CODES


@query("stored_codes", f"""WITH {_CODES}
SELECT code, CASE WHEN year = 2020 THEN upper(description) ELSE description END AS description, category, is_billable,
    collection_type, year FROM codes""")
def stored_codes(spark, sf_dir):
    """All code sets, of which those of one year are written again."""
    codes, path = search._collection_codes(spark, sf_dir), new_folder(spark, "codes")
    tables.write_codes(codes, path)
    tables.write_codes(codes.where("year = 2020").withColumn("description", F.upper("description")), path)
    return tables.load_codes(spark, path).select(
        "code", "description", "category", "is_billable", "collection_type", "year")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = embed.code_entries(search._collection_codes(spark, sf_dir))
    return embed.hashing_embed(entries, "document", 16)


@query("stored_collection", f"""WITH {_CODES}
SELECT collection_type || '_' || CAST(year AS STRING) || '_' || code AS id,
    'medical_codes_' || collection_type || '_' || CAST(year AS STRING) AS collection,
    {search._ENTRY} AS document, 16 AS dimensions FROM codes""")
def stored_collection(spark, sf_dir):
    """Entries of two years first, then all: what is stored already is not written again."""
    path, entries = new_folder(spark, "collection"), _entries(spark, sf_dir)
    tables.write_collection(entries.where("year < 2022"), path)
    tables.write_collection(entries, path)
    return tables.read_collections(spark, path).select(
        "id", "collection", "document", F.size("embedding").alias("dimensions"))


@query("exported_codes", f"""WITH {_CODES}, formats AS (SELECT unnest(['xlsx', 'csv', 'json']) AS format)
SELECT format, code, description, category, is_billable, collection_type, year FROM codes CROSS JOIN formats""")
def exported_codes(spark, sf_dir):
    """All codes as spreadsheets, CSV and JSON lines, read back with their types."""
    codes = search._collection_codes(spark, sf_dir).drop("code_type")
    found = None
    for name in tables.EXPORT_FORMATS:
        path = new_folder(spark, f"export-{name}")
        tables.export_rows(codes, path, name)
        if name == "xlsx":
            cells = code_files.read_decoded(spark, f"{path}/*.xlsx", spreadsheets.first_sheet_rows).where("row_no > 0")
            rows = cells.select(*[F.get("cells", i).cast(f.dataType).alias(f.name) for i, f in enumerate(codes.schema)])
        else:
            reader = spark.read.schema(codes.schema).format(name)
            rows = (reader.option("header", "true").option("escape", '"') if name == "csv" else reader).load(path)
        rows = rows.withColumn("format", F.lit(name))
        found = rows if found is None else found.unionByName(rows)
    return found


def _streamed(stream: DataFrame, label: str) -> DataFrame:
    """What a stream writes until it has read all there is."""
    spark = stream.sparkSession
    path = new_folder(spark, label)
    logs.to_files(stream, path, f"{label}-{uuid.uuid4().hex}").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query("redaction_stream", f"SELECT source, id, log_line FROM ({ORACLES['phi_redact']})")
def redaction_stream(spark, sf_dir):
    """Log records that arrive as files are redacted on their way to the sink."""
    lines, path = texts._all_texts(spark, sf_dir).withColumnRenamed("text", "log_line"), new_folder(spark, "log-lines")
    lines.write.parquet(path)
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 4).parquet(path)
    return _streamed(logs.redact_stream(stream, "log_line"), "redacted").select("source", "id", "log_line")


@query("audit_stream", ORACLES["audit_events"])
def audit_stream(spark, sf_dir):
    """Audit events appended as JSON lines in two batches, read as a stream and kept as a table."""
    events, path = log_queries.audit_events(spark, sf_dir), new_folder(spark, "audit-log")
    first = F.pmod(F.xxhash64("resource"), F.lit(2)) == 0
    for part in (first, ~first):
        logs.append_audit_log(events.where(part), path)
    stored = _streamed(logs.read_audit_stream(spark, path), "audit-table")
    return stored.withColumn("timestamp", stored["timestamp"].cast("timestamp_ntz"))


def echo_model(messages: list[dict[str, str]]) -> dict:
    """A model for checks that needs no service; it fails for some requests."""
    asked = messages[-1]["content"]
    if asked.endswith("7"):
        raise ValueError("refused")
    return {"content": f"{len(messages)}:{asked[::-1]}", "role": "assistant", "finish_reason": "stop", "model": "echo",
            "usage": {"prompt_tokens": len(asked), "completion_tokens": 1, "total_tokens": len(asked) + 1}}


@query("memoised_calls", f"""WITH asked AS (SELECT event_id, event_type || ' of user ' || user_id AS question FROM events)
SELECT event_id, CASE WHEN question LIKE '%7' THEN NULL ELSE '2:' || reverse(question) END AS content,
    question NOT LIKE '%7' AS ok, CASE WHEN question LIKE '%7' THEN 'ValueError: refused' END AS call_error FROM asked""")
def memoised_calls(spark, sf_dir):
    """A question for every event, asked once each: first those of half the events, then of all."""
    path = new_folder(spark, "answers")
    question = F.concat("event_type", F.lit(" of user "), F.col("user_id").cast("string"))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    asked = read(spark, sf_dir, "events").select("event_id", F.array(
        message("system", F.lit("Answer.")), message("user", question)).alias("messages"))
    for part in (asked.where("event_id % 2 = 0"), asked):
        answered = memo.call_model_once(part, echo_model, "messages", path, "echo", wave=2000, attempts=1)
    return answered.select("event_id", F.col("response.content").alias("content"), "ok", "call_error")


@query("session_summary_stream", ORACLES["audit_summary"])
def session_summary_stream(spark, sf_dir):
    """The last running summary of every session, after its suggestions have come as a stream."""
    source, out = new_folder(spark, "suggestions"), new_folder(spark, "summaries")
    columns = DERIVED["suggested"][1]
    rows = read(spark, sf_dir, "events").select("ts", *[F.expr(e).alias(c) for c, e in columns.items()]).select(
        "session", F.col("ts").alias("timestamp"), "doc_id", "kind", "is_primary", "confidence",
        F.when(F.col("confidence") < 0.2, F.col("severity")).alias("severity"))
    rows.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
    always = "4000 days"    # the files come in no order of time

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)
    (sessions.running_summaries(stream, always, always).writeStream.outputMode("update")
     .option("checkpointLocation", new_folder(spark, "summary-state")).foreachBatch(keep)
     .trigger(availableNow=True).start().awaitTermination())
    last = first_per_key(spark.read.parquet(out), ["session"], [F.desc("batch")])
    return last.withColumn("avg_confidence", F.round("avg_confidence", 6)).drop("batch", "last_event", "closed")
