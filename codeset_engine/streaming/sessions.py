"""Running summaries of coding sessions, kept as state from batch to batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.audit import HIGH_CONFIDENCE, MIN_CONFIDENCE

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
IDLE = "30 minutes"      # after which a session is closed
LATE = "10 minutes"
BLOCK_BITS = 12          # of a document's number that tell it from the others of its block
SETTLE_ROWS = 1 << 18    # rows whose documents wait, at least, until they are joined to the distinct ones

COUNTS = ("codes", "primary_diagnoses", "secondary_diagnoses", "high_diagnoses", "review_diagnoses", "procedures",
          "high_procedures", "review_procedures", "issues", "critical", "warnings")
_STATE = "last_event long, documents long, scored long, confidence double, " + ", ".join(f"{c} long" for c in COUNTS)
SUMMARY = ("session string, documents long, avg_confidence double, "
           + ", ".join(f"{c} long" for c in COUNTS) + ", last_event timestamp, closed boolean")


def _raised() -> Column:
    """The counters that a suggestion raises, a bit each; what is null belongs to no kind and no band."""
    diagnosis, procedure = F.col("kind") == "diagnosis", F.col("kind") != "diagnosis"
    number = F.col("confidence").isNotNull() & ~F.isnan("confidence")
    high, low = number & (F.col("confidence") > HIGH_CONFIDENCE), number & (F.col("confidence") < MIN_CONFIDENCE)
    raised = {"codes": F.lit(True), "primary_diagnoses": diagnosis & F.col("is_primary"),
              "secondary_diagnoses": diagnosis & ~F.col("is_primary"), "high_diagnoses": diagnosis & high,
              "review_diagnoses": diagnosis & low, "procedures": procedure, "high_procedures": procedure & high,
              "review_procedures": procedure & low, "issues": F.col("severity").isNotNull(),
              "critical": F.col("severity") == "critical", "warnings": F.col("severity") == "warning"}
    bits = F.lit(0)
    for i, name in enumerate(COUNTS):
        bits += F.when(raised[name], F.lit(1 << i)).otherwise(0)
    return bits


class SessionSummary(StatefulProcessor):
    """Counters of one session, the set of its documents, and a timer that closes it when idle.

    Rows come in frames and are counted as such. Documents are kept by block of neighbouring
    numbers, so that those of a batch cost a read and a write of the state a block, not each.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counters = handle.getValueState("counters", _STATE)
        self.documents = handle.getMapState("documents", "block long", "places binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.counters.exists():
            last, documents, scored, confidence, *counts = self.counters.get()
        else:
            last, documents, scored, confidence, counts = 0, 0, 0, 0.0, [0] * len(COUNTS)
        raised, before = np.zeros(1 << len(COUNTS), np.int64), last
        seen, new, waiting = np.empty(0, np.int64), [], 0
        for frame in rows:
            raised += np.bincount(frame["raised"].to_numpy(), minlength=len(raised))
            scored += int(frame["scored"].sum())
            confidence += float(frame["confidence"].to_numpy().sum())
            new.append(frame["doc_id"].to_numpy()[frame["has_doc"].to_numpy(bool)])
            waiting += len(new[-1])
            if waiting > max(len(seen), SETTLE_ROWS):     # not for every frame: what is seen is sorted again
                seen, new, waiting = np.unique(np.concatenate([seen, *new])), [], 0
            last = max(last, int(frame["at_ms"].max()))
        documents += self._remember(np.unique(np.concatenate([seen, *new])))
        if before:
            self.handle.deleteTimer(before + self.idle_ms)
        self.handle.registerTimer(last + self.idle_ms)
        kinds = np.arange(len(raised))
        counts = [count + int(raised[kinds >> i & 1 == 1].sum()) for i, count in enumerate(counts)]
        state = (last, documents, scored, confidence, *counts)
        self.counters.update(state)
        yield self._summary(key, state, False)

    def _remember(self, seen: np.ndarray) -> int:
        """Adds distinct sorted documents to the session's; how many are new."""
        new, blocks = 0, seen >> BLOCK_BITS
        starts = np.flatnonzero(np.concatenate(([True], blocks[1:] != blocks[:-1]))) if len(seen) else []
        for part in np.split(seen, starts)[1:]:
            block = int(part[0] >> BLOCK_BITS)
            places = (part & (1 << BLOCK_BITS) - 1).astype("<u2")
            if self.documents.containsKey((block,)):
                held = np.frombuffer(bytes(self.documents.getValue((block,))[0]), "<u2")
                places = np.union1d(held, places)
                if len(places) == len(held):
                    continue
                new -= len(held)
            new += len(places)
            self.documents.updateValue((block,), (places.tobytes(),))
        return new

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.counters.exists():
            yield self._summary(key, self.counters.get(), True)
            self.counters.clear()
            self.documents.clear()

    def _summary(self, key, state, closed: bool) -> pd.DataFrame:
        last, documents, scored, confidence, *counts = state
        mean = pa.array([confidence / scored if scored else None], pa.float64())
        return pd.DataFrame({
            "session": [key[0]], "documents": [documents], "avg_confidence": pd.Series(mean, dtype=pd.ArrowDtype(pa.float64())),
            **{name: [count] for name, count in zip(COUNTS, counts)},
            "last_event": [pd.Timestamp(last, unit="ms", tz="UTC")], "closed": [closed]})

    def close(self) -> None:
        pass


def _milliseconds(interval: str) -> int:
    number, unit = interval.split()
    return int(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")] * 1000


def running_summaries(events: DataFrame, idle: str = IDLE, late_by: str = LATE) -> DataFrame:
    """A row (``SUMMARY``) for every session that a batch touches or closes, for update mode.

    ``events``: session, timestamp, doc_id, kind, is_primary, confidence, and severity where the
    suggestion has a finding. The last row of an open session equals ``reports.audit_summary`` over
    all its events so far. A session without events for ``idle`` (in event time) is closed: it is
    sent once more, and its state is dropped. Events older than the watermark are left out.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = (events.where("session IS NOT NULL AND timestamp IS NOT NULL")
            .withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", late_by)
            .withColumns({"doc_id": F.col("doc_id").cast("long"), "confidence": F.col("confidence").cast("double")})
            .select("session", "timestamp", F.unix_millis("timestamp").alias("at_ms"), _raised().alias("raised"),
                    F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), F.col("doc_id").isNotNull().alias("has_doc"),
                    F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.col("confidence").isNotNull().alias("scored")))
    return rows.groupBy("session").transformWithStateInPandas(
        SessionSummary(_milliseconds(idle)), SUMMARY, "Update", "EventTime")
