"""The running session summary against the summary of the whole log."""

import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from codeset_engine.operators import reports
from codeset_engine.streaming import sessions

EVENTS = ("session string, timestamp timestamp, doc_id long, kind string, is_primary boolean, confidence double, "
          "severity string")
START = datetime(2024, 5, 1, 8)


def events(seed, n, minutes=60, first=0):
    rng = random.Random(seed)
    return [(f"s{rng.randrange(6)}", START + timedelta(minutes=first + i * minutes / n), rng.choice([1, 2, 3, 4, None]),
             rng.choice(["diagnosis", "procedure", None]), rng.choice([True, False, None]),
             rng.choice([None, 0.1, 0.5, 0.7, 0.9]), rng.choice([None, "critical", "warning", "info"])) for i in range(n)]


def feed(spark, folder, number, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{folder}/in/batch={number}")


def run(spark, folder):
    """Reads what has arrived since the last run, from the checkpoint."""
    def keep(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{folder}/out")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    (sessions.running_summaries(stream).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state")
     .foreachBatch(keep).trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(f"{folder}/out")


def latest(rows):
    found = {}
    for r in sorted(rows.where("NOT closed").collect(), key=lambda r: r.batch):
        found[r.session] = r
    return found


def summary(spark, rows):
    df = spark.createDataFrame(rows, EVENTS)
    return {r.session: r for r in reports.audit_summary(df, df.where("severity IS NOT NULL")).collect()}


def test_stream_equals_the_summary_after_a_restart(spark, tmp_path):
    first, second = events(1, 120), events(2, 90, first=61)
    feed(spark, tmp_path, 0, first[:70])
    feed(spark, tmp_path, 1, first[70:])
    run(spark, tmp_path)
    feed(spark, tmp_path, 2, second)
    got, want = latest(run(spark, tmp_path)), summary(spark, first + second)
    assert set(got) == set(want)
    for name, row in want.items():
        for c in ("documents", *sessions.COUNTS):
            assert got[name][c] == row[c], (name, c)
        assert abs(got[name].avg_confidence - row.avg_confidence) < 1e-9


def test_idle_sessions_close_and_late_events_are_left_out(spark, tmp_path):
    one = ("old", START, 1, "diagnosis", True, 0.9, "critical")
    feed(spark, tmp_path, 0, [one, one[:1] + (START + timedelta(minutes=5),) + one[2:]])
    feed(spark, tmp_path, 1, [("new", START + timedelta(hours=3), 2, "procedure", None, None, None)])
    feed(spark, tmp_path, 2, [("new", START + timedelta(hours=3, minutes=1), 2, "procedure", None, 0.2, None)])
    feed(spark, tmp_path, 3, [("new", START + timedelta(minutes=1), 9, "procedure", None, 0.2, None),   # too late
                              ("old", START + timedelta(hours=3, minutes=2), 7, "diagnosis", False, 0.7, None)])
    rows = run(spark, tmp_path)
    closed = rows.where("closed").collect()
    assert [(r.session, r.codes, r.documents, r.critical) for r in closed] == [("old", 2, 1, 2)]
    assert closed[0].last_event == START + timedelta(minutes=5)
    got = latest(rows)
    assert (got["new"].codes, got["new"].documents, got["new"].procedures) == (2, 1, 2)
    assert (got["old"].codes, got["old"].documents, got["old"].secondary_diagnoses) == (1, 1, 1)   # begun anew


class Documents(dict):
    """A map state that counts its writes."""
    writes = 0

    def containsKey(self, key):
        return key in self

    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self.writes += 1
        self[key] = value


def test_documents_cost_a_write_of_the_state_a_block():
    processor = sessions.SessionSummary(1)
    processor.documents, rng, known = Documents(), random.Random(5), set()
    for batch in (range(9000), range(4000, 12_000), range(100), [-1, -5000, 2 ** 63 - 1, -2 ** 63, 40_000],
                  [rng.randrange(-10 ** 6, 10 ** 6) for _ in range(500)], []):
        seen, before = np.unique(np.array(batch, np.int64)), processor.documents.writes
        assert processor._remember(seen) == len(set(seen.tolist()) - known)
        known |= set(seen.tolist())
        assert processor.documents.writes - before <= len({d >> sessions.BLOCK_BITS for d in batch})
    before = processor.documents.writes
    assert processor._remember(np.array(sorted(known), np.int64)) == 0 and processor.documents.writes == before
