"""Audit events, usage and durations over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import audit
from ...operators import extract, reports
from ...streaming import logs
from .registry import ctes, derived, query, read


@query("agent_stats", f"""{ctes('calls')}
SELECT agent, count(*) AS total_calls, count(*) FILTER (ok) AS successful_calls, count(*) FILTER (NOT ok) AS failed_calls,
    CAST(coalesce(sum(total_tokens) FILTER (ok), 0) AS BIGINT) AS total_tokens,
    round(coalesce(sum(duration) FILTER (ok), 0.0), 4) AS total_time,
    round(coalesce(avg(total_tokens) FILTER (ok), 0.0), 6) AS avg_tokens_per_call,
    round(coalesce(avg(duration) FILTER (ok), 0.0), 6) AS avg_time_per_call FROM calls GROUP BY agent""")
def agent_stats(spark, sf_dir):
    stats = extract.usage_stats(derived(spark, sf_dir, "calls"))
    for name, digits in (("total_time", 4), ("avg_tokens_per_call", 6), ("avg_time_per_call", 6)):
        stats = stats.withColumn(name, F.round(name, digits))
    return stats


@query("slow_calls", """SELECT event_id, CASE WHEN value > 1.0 THEN 'WARNING' ELSE 'INFO' END AS level,
    CASE WHEN value > 1.0 THEN event_type || ' took ' || printf('%.2f', value) || 's (threshold: 1.0s)'
         ELSE event_type || ' completed in ' || printf('%.2f', value) || 's' END AS message FROM events""")
def slow_calls(spark, sf_dir):
    duration = F.col("value")
    return read(spark, sf_dir, "events").select(
        "event_id", audit.duration_level(duration).alias("level"),
        audit.duration_message(F.col("event_type"), duration).alias("message"))


@query("duration_windows", """SELECT time_bucket(INTERVAL '60 seconds', ts) AS window_start, event_type AS operation,
    count(*) AS n_calls, round(avg(value), 6) AS avg_duration, max(value) AS max_duration,
    count(*) FILTER (value > 1.0) AS n_slow FROM events GROUP BY ALL""")
def duration_windows(spark, sf_dir):
    calls = read(spark, sf_dir, "events").selectExpr("ts AS timestamp", "event_type AS operation",
                                                     "value AS duration")
    return logs.duration_windows(calls).withColumn("avg_duration", F.round("avg_duration", 6))


@query("audit_events", """WITH e AS (SELECT event_id, ts AS timestamp, 'event_' || event_id AS resource,
    CASE WHEN user_id % 10 = 0 THEN 'system' ELSE 'u' || user_id END AS user FROM events)
SELECT timestamp, 'INFO' AS level, 'batch' AS module, 'load' AS function, 0 AS line,
    'Action: document_upload | Resource: ' || resource || ' | User: ' || user AS message, user,
    'document_upload' AS action, resource FROM e""")
def audit_events(spark, sf_dir):
    return audit.with_audit(
        read(spark, sf_dir, "events"), "document_upload", F.expr("'event_' || event_id"),
        F.expr("CASE WHEN user_id % 10 = 0 THEN NULL ELSE 'u' || user_id END"),
        timestamp=F.col("ts"), module="batch", function="load").withColumn(
        "timestamp", F.col("timestamp").cast("timestamp_ntz"))


_DETAILS = """'{"kind": "' || event_type || '", "value": ' || CAST(value AS STRING) || ', "user": ' || user_id || ', "note": null}'"""


@query("log_encode", f"""SELECT event_id, 'Code suggested | Data: ' || {_DETAILS} AS line,
    'Action: code_suggestion | Resource: r' || event_id || ' | User: u' || user_id || ' | Details: ' || {_DETAILS} AS message,
    'code_suggestion' AS action, 'r' || event_id AS resource, 'u' || user_id AS user, {_DETAILS} AS details FROM events""")
def log_encode(spark, sf_dir):
    values = {"kind": F.col("event_type"), "value": F.col("value"), "user": F.col("user_id"),
              "note": F.lit(None).cast("string")}
    lines = read(spark, sf_dir, "events").select(
        "event_id", audit.structured_line(F.lit("Code suggested"), values).alias("line"),
        audit.audit_message(F.lit("code_suggestion"), F.expr("'r' || event_id"),
                            F.expr("'u' || user_id"), audit.json_object(values)).alias("message"))
    parts = audit.audit_parts(F.col("message"))
    return lines.select("*", parts.alias("p")).select("event_id", "line", "message", "p.action",
                                                      "p.resource", "p.user", "p.details")


@query("log_encode_texts", r"""SELECT doc_id, '{"text": "' || array_to_string(list_transform(string_split(text, ''),
    lambda c: CASE WHEN c = '"' THEN '\"' WHEN c = '\' THEN '\\' WHEN c = chr(10) THEN '\n' WHEN c = chr(9) THEN '\t'
    WHEN unicode(c) > 127 THEN printf('\u%04x', unicode(c)) ELSE c END), '') || '"}' AS details FROM documents""")
def log_encode_texts(spark, sf_dir):
    """Details with texts beyond ASCII."""
    return read(spark, sf_dir, "documents").select("doc_id", audit.json_object({"text": F.col("text")}).alias("details"))


@query("audit_summary", f"""{ctes('suggested')},
codes AS (SELECT session, count(DISTINCT doc_id) AS documents, count(*) AS codes, round(avg(confidence), 6) AS avg_confidence,
    count(*) FILTER (kind = 'diagnosis' AND is_primary) AS primary_diagnoses,
    count(*) FILTER (kind = 'diagnosis' AND NOT is_primary) AS secondary_diagnoses,
    count(*) FILTER (kind = 'diagnosis' AND confidence > 0.85) AS high_diagnoses,
    count(*) FILTER (kind = 'diagnosis' AND confidence < 0.6) AS review_diagnoses,
    count(*) FILTER (kind <> 'diagnosis') AS procedures,
    count(*) FILTER (kind <> 'diagnosis' AND confidence > 0.85) AS high_procedures,
    count(*) FILTER (kind <> 'diagnosis' AND confidence < 0.6) AS review_procedures FROM suggested GROUP BY session),
issues AS (SELECT session, count(*) AS issues, count(*) FILTER (severity = 'critical') AS critical,
    count(*) FILTER (severity = 'warning') AS warnings FROM suggested WHERE confidence < 0.2 GROUP BY session)
SELECT codes.*, coalesce(issues, 0) AS issues, coalesce(critical, 0) AS critical, coalesce(warnings, 0) AS warnings
FROM codes LEFT JOIN issues USING (session)""")
def audit_summary(spark, sf_dir):
    suggested = derived(spark, sf_dir, "suggested")
    summary = reports.audit_summary(suggested, suggested.filter("confidence < 0.2"))
    return summary.withColumn("avg_confidence", F.round("avg_confidence", 6))


@query("confidence_bands", f"""{ctes('suggested')}
SELECT kind, CASE WHEN confidence > 0.85 THEN 'high' WHEN confidence < 0.6 THEN 'review' ELSE 'medium' END AS band,
    count(*) AS n FROM suggested GROUP BY ALL""")
def confidence_bands(spark, sf_dir):
    return (derived(spark, sf_dir, "suggested")
            .groupBy("kind", audit.confidence_band(F.col("confidence")).alias("band"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("retention", """SELECT o_orderkey, o_orderdate FROM orders
WHERE o_orderdate >= TIMESTAMP '2005-01-01' - INTERVAL 2555 DAY""")
def retention(spark, sf_dir):
    kept = audit.within_retention(F.col("o_orderdate"), F.expr("TIMESTAMP_NTZ '2005-01-01'"))
    return read(spark, sf_dir, "orders").filter(kept).select("o_orderkey", "o_orderdate")


@query("step_summary", """SELECT event_type AS step, count(*) FILTER (value > 0.05) AS success_count, count(*) AS total,
    CAST(sum(user_id) AS BIGINT) AS total_embedded, count(*) FILTER (value > 0.05) = count(*) AS step_success
FROM events GROUP BY event_type""")
def step_summary(spark, sf_dir):
    return reports.step_summary(read(spark, sf_dir, "events").selectExpr(
        "event_type AS step", "value > 0.05 AS ok", "user_id AS embedded_count"))
