"""Summaries over logs, sessions and PHI findings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.audit import HIGH_CONFIDENCE, MIN_CONFIDENCE
from ..functions.phi import PATTERNS, detect_phi


def phi_report(docs: DataFrame, text: str, by: Sequence[str] = (),
               patterns: Mapping[str, str] = PATTERNS) -> DataFrame:
    """Documents and matches per PHI type (and per ``by``)."""
    found = docs.select(*by, F.explode(detect_phi(F.col(text), patterns))
                        .alias("phi_type", "matches"))
    return (found.groupBy("phi_type", *by)
            .agg(F.count(F.lit(1)).alias("n_documents"),
                 F.sum(F.size("matches").cast("long")).alias("n_matches")))


def step_summary(log: DataFrame) -> DataFrame:
    """Successes, total and embedded rows per step of a job log (``step, ok, embedded_count``)."""
    return (log.groupBy("step").agg(
        F.count_if("ok").alias("success_count"), F.count(F.lit(1)).alias("total"),
        F.sum(F.coalesce("embedded_count", F.lit(0))).alias("total_embedded"))
        .withColumn("step_success", F.col("success_count") == F.col("total")))


def audit_summary(suggestions: DataFrame, findings: DataFrame | None = None,
                  by: str = "session") -> DataFrame:
    """Per session: documents, codes, mean confidence, primary/secondary/procedure codes, bands.

    ``suggestions``: session, doc_id, code, kind (diagnosis or procedure), is_primary,
    confidence. ``findings``: session, severity, one row per issue; both inputs are reduced to
    one row per session before they meet.
    """
    diagnosis, high, low = (F.col("kind") == "diagnosis", F.col("confidence") > HIGH_CONFIDENCE,
                            F.col("confidence") < MIN_CONFIDENCE)
    codes = suggestions.groupBy(by).agg(
        F.count_distinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("codes"),
        F.avg("confidence").alias("avg_confidence"),
        F.count_if(diagnosis & F.col("is_primary")).alias("primary_diagnoses"),
        F.count_if(diagnosis & ~F.col("is_primary")).alias("secondary_diagnoses"),
        F.count_if(diagnosis & high).alias("high_diagnoses"),
        F.count_if(diagnosis & low).alias("review_diagnoses"),
        F.count_if(~diagnosis).alias("procedures"),
        F.count_if(~diagnosis & high).alias("high_procedures"),
        F.count_if(~diagnosis & low).alias("review_procedures"))
    if findings is None:
        return codes
    issues = findings.groupBy(by).agg(
        F.count(F.lit(1)).alias("issues"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "warning").alias("warnings"))
    joined = codes.join(issues, by, "left")
    return joined.na.fill(0, ["issues", "critical", "warnings"])
