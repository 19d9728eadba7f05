"""Toxicity severity by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import utf8
from .decontamination import normal_words

PER_CLASS = 3000  # labelled texts of each class that the model learns from, at most
FEATURES = 20_000  # features with the strongest evidence that the model keeps, at most
PREFIXES = range(3, 8)
GRADES = (3, 6)  # marked words from which a toxic text is of grade 2, and 3
# A feature needs this many toxic texts, and this share of them, that hold it, and these log odds
LEAST_TEXTS, LEAST_SHARE, LEAST_ODDS = 3, 0.01, 2.0


class Model(NamedTuple):
    """P(grade > k) = sigmoid(weights . log2(1 + counts) - thresholds[k])."""

    features: dict[int, int]
    weights: np.ndarray
    thresholds: np.ndarray


def word_features(word: bytes) -> list[int]:
    """Hashes of a word and of its beginnings of three to seven letters."""
    letters = word.decode()
    parts = {letters} | {letters[:k] + "*" for k in PREFIXES if k < len(letters)}
    return [xxhash.xxh32_intdigest(p) for p in parts]


def words_of(text: bytes | None) -> list[bytes]:
    return normal_words(text.decode().lower().encode() if text else None)


class _Known(dict):
    """The model's feature numbers of each word; forgets all when it holds too many."""

    def __init__(self, features: dict[int, int]):
        super().__init__()
        self.features = features

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > 400_000:
            self.clear()
        value = self[word] = tuple(self.features[f] for f in word_features(word) if f in self.features)
        return value

    def counts(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray, int]:
        """Feature numbers in a whole text, log2(1 + count) of each, and the number of marked words."""
        marked = [f for f in map(self.__getitem__, words_of(text)) if f]
        counts = Counter(n for f in marked for n in f)
        at = np.array(sorted(counts), np.int64)
        return at, np.log2(1.0 + np.array([counts[n] for n in at.tolist()], float)), len(marked)


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_features: int,
                n_grades: int, rounds: int = 400, rate: float = 0.3,
                penalty: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of greatest cumulative-link likelihood, by Adagrad steps."""
    row = np.repeat(np.arange(len(rows)), [len(at) for at, _ in rows])
    column = np.concatenate([at for at, _ in rows]) if rows else np.empty(0, np.int64)
    value = np.concatenate([v for _, v in rows]) if rows else np.empty(0)
    weights, w_seen = np.zeros(n_features), np.full(n_features, 1e-8)
    steps = np.concatenate(([1.0], np.zeros(n_grades - 2)))  # first threshold, log distances
    s_seen = np.full(len(steps), 1e-8)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for _ in range(rounds):
        gaps = np.exp(steps[1:])
        thresholds = steps[0] + np.concatenate(([0.0], np.cumsum(gaps)))
        edges = np.concatenate(([-np.inf], thresholds, [np.inf]))
        place = np.bincount(row, weights[column] * value, len(rows))
        low, high = sigmoid(edges[grades] - place), sigmoid(edges[grades + 1] - place)
        low[grades == 0], high[grades == n_grades - 1] = 0.0, 1.0
        share = np.maximum(high - low, 1e-9)
        pull = low + high - 1
        gradient = np.bincount(column, pull[row] * value, n_features) / len(rows) - penalty * weights / 100
        up = np.bincount(grades, high * (1 - high) / share, n_grades)[:-1]
        down = np.bincount(grades, low * (1 - low) / share, n_grades)[1:]
        by_threshold = (up - down) / len(rows)
        by_step = np.concatenate(([by_threshold.sum()], gaps * np.cumsum(by_threshold[::-1])[::-1][1:]))
        w_seen += gradient ** 2
        s_seen += by_step ** 2
        weights += rate * gradient / np.sqrt(w_seen)
        steps += rate * by_step / np.sqrt(s_seen)
    return weights, steps[0] + np.concatenate(([0.0], np.cumsum(np.exp(steps[1:]))))


def _distinct_features(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in columns:
        yield pa.array([sorted({f for w in set(words_of(t)) for f in word_features(w)})
                        for t in utf8(column)], pa.list_(pa.int64()))


def _counted(features: dict[int, int]):
    def counted(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = _Known(features)
        for column in columns:
            rows = [known.counts(t) for t in utf8(column)]
            yield pa.array([{"at": at, "values": v, "marked": m} for at, v, m in rows],
                           pa.struct([("at", pa.list_(pa.int64())), ("values", pa.list_(pa.float64())),
                                      ("marked", pa.int64())]))
    return counted


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          toxic_col: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """Learn from at most ``per_class`` labelled ids of each class, the first by a hash of the id.

    Features that toxic texts hold far more often than others are kept. Labels only say toxic or
    not; a toxic text is of grade 1 to 3 by the number of its words that have such features.
    """
    known = (labels.select(F.col(id_col).alias("id"), (F.col(toxic_col) > 0).alias("toxic"),
                           F.xxhash64(F.lit(20240601), id_col).alias("h"))
             .where("id IS NOT NULL AND toxic IS NOT NULL").groupBy("id", "h").agg(F.max("toxic").alias("toxic")))
    # by far most labels are left out by their hash before the exact choice, which then is small
    rates = {r["toxic"]: (1.5 * per_class + 100) / r["count"] for r in known.groupBy("toxic").count().collect()}
    rate = F.when(F.col("toxic"), rates.get(True, 1.0)).otherwise(rates.get(False, 1.0))
    first = Window.partitionBy("toxic").orderBy("h", "id")
    chosen = (known.where(F.pmod("h", F.lit(1 << 30)) < rate * (1 << 30))
              .withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_class)
              .select("id", "toxic"))
    rows = (documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            .where("text IS NOT NULL").join(F.broadcast(chosen), "id")  # 2 * per_class rows at most
            .dropDuplicates(["toxic", "text"]))
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, other = sizes.get(True, 0), sizes.get(False, 0)
    if not toxic or not other:
        return Model({}, np.zeros(0), np.array([1.0, 2.0, 3.0]))
    seen = rows.select(F.explode(F.arrow_udf(_distinct_features, "array<bigint>")("text")).alias("feature"), "toxic")
    odds = (F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("o") + 0.5) / (other + 1))).alias("odds")
    strong = (seen.groupBy("feature").agg(F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("o"))
              .where(F.col("t") >= max(LEAST_TEXTS, LEAST_SHARE * toxic)).select("feature", odds, "t").where(F.col("odds") >= LEAST_ODDS)
              .orderBy(F.desc("odds"), F.desc("t"), "feature").limit(FEATURES).collect())
    features = {r["feature"]: i for i, r in enumerate(strong)}
    struct = "struct<at:array<bigint>,values:array<double>,marked:bigint>"
    held = (rows.withColumn("f", F.arrow_udf(_counted(features), struct)("text"))
            .select("id", "toxic", "f.at", "f.values", "f.marked").toArrow().sort_by("id"))
    marked, is_toxic = held["marked"].to_numpy(), held["toxic"].to_numpy(zero_copy_only=False).astype(bool)
    grades = np.where(is_toxic, 1 + (marked[:, None] >= np.array(GRADES)).sum(axis=1), 0)
    weights, thresholds = fit_ordinal(
        [(np.array(a, np.int64), np.array(v)) for a, v in zip(held["at"].to_pylist(), held["values"].to_pylist())],
        grades, len(features), len(GRADES) + 2)
    return Model(features, weights, thresholds)


def _graded(shared):
    def graded(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Model(*shared.value)
        known = _Known(model.features)
        for column in columns:
            out = []
            for text in utf8(column):
                at, values, _ = known.counts(text)
                above = 1 / (1 + np.exp(np.clip(model.thresholds - values @ model.weights[at], -30, 30)))
                if not len(at):
                    above[:] = 0.0
                share = np.diff(np.concatenate(([1.0], above, [0.0]))) * -1
                out.append({"p_toxic": float(above[0]), "severity": float(above.sum()),
                            "grade": int(np.argmax(share)), "toxic": bool(above[0] >= 0.5)})
            yield pa.array(out, pa.struct([("p_toxic", pa.float64()), ("severity", pa.float64()),
                                           ("grade", pa.int32()), ("toxic", pa.bool_())]))
    return graded


def grade_toxicity(documents: DataFrame, model: Model, text_col: str = "text",
                   result_col: str = "toxicity") -> DataFrame:
    """``documents`` with a struct column: p_toxic, severity, grade, toxic.

    One weight per feature serves all thresholds between the grades 0 to 3. ``severity`` is the
    expected grade, ``grade`` the likeliest (ties: the lower), ``toxic`` whether a grade above 0 is
    as likely as not. Whole texts are read. Null texts, and texts without any feature of the model,
    are of grade and severity 0; without labels of both classes no feature is learned, so all
    are. Repeated rows agree; an empty table gives no rows. Other columns stay; one named as
    ``result_col`` is replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast(tuple(model))
    grade = F.arrow_udf(_graded(shared), "struct<p_toxic:double,severity:double,grade:int,toxic:boolean>")
    return documents.withColumn(result_col, grade(F.col(text_col).cast("string")))
