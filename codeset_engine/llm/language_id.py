"""Language identification by error-correcting output codes over hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import pieces, utf8

DIMENSIONS = 1 << 14
PER_LANGUAGE = 500  # labelled texts per language that the classifiers learn from, at most
ORDERS = (1, 2, 3)  # bytes in an n-gram
AMBIGUOUS = 0.2  # smallest lead of the nearest codeword over the next, as a share of a bit's loss
UNKNOWN = "und"

_MULTIPLIERS = {1: 1, 2: 2654435761, 3: 40503 * 65599}


class Model(NamedTuple):
    languages: list[str]
    code: np.ndarray  # language x bit, +1 or -1
    weights: np.ndarray  # n-gram x bit
    bias: np.ndarray


def ngram_counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte n-grams of a whole text, A-Z in lower case, and their shares (root of counts)."""
    raw = np.frombuffer(b" " + text.lower() + b" ", np.uint8).astype(np.int64)
    codes = []
    for order in ORDERS:
        code = raw[:len(raw) - order + 1].copy()
        for i in range(1, order):
            code = code * 256 + raw[i:len(raw) - order + 1 + i]
        codes.append((code * _MULTIPLIERS[order] + order * 7919 >> 3) % DIMENSIONS)
    counts = np.bincount(np.concatenate(codes), minlength=DIMENSIONS)
    seen = np.flatnonzero(counts)
    values = np.sqrt(counts[seen])
    return seen, (values / np.sqrt((values ** 2).sum())).astype(np.float32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def codewords(n: int, seed: int = 20240501) -> np.ndarray:
    """One codeword of +1 and -1 per language, rows far apart, no two bits alike.

    Up to six languages get all different splits into two groups; more get the best of many seeded
    random codes of 10 log2(n) bits.
    """
    if n <= 6:
        splits = [[1 if i == 0 or split >> (i - 1) & 1 else -1 for i in range(n)]
                  for split in range((1 << max(0, n - 1)) - 1)]
        return np.array(splits or [[1] * n], np.int8).T
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    best, distance = None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        products = code.astype(int) @ code.T.astype(int)
        nearest = (bits - (products - 4 * bits * np.eye(n, dtype=int)).max()) // 2
        if nearest > distance and (np.abs(code.sum(axis=0)) < n).all():
            best, distance = code, nearest
    return best


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 12, rate: float = 4.0,
        penalty: float = 1e-5) -> Model:
    """One logistic classifier per bit of the codewords, by averaged gradient steps."""
    languages = sorted({language for language, _, _ in rows})
    code = codewords(len(languages))
    weights = np.zeros((DIMENSIONS, code.shape[1]), np.float32)
    bias = np.zeros(code.shape[1], np.float32)
    index = {language: i for i, language in enumerate(languages)}
    order = np.random.default_rng(20240502)
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for i in order.permutation(len(rows)):
            language, seen, values = rows[i]
            target = code[index[language]]
            margin = target * (values @ weights[seen] + bias)
            pull = (step * target / (1 + np.exp(np.clip(margin, -30, 30)))).astype(np.float32)
            weights[seen] += values[:, None] * pull
            bias += 0.01 * pull
        weights *= 1 - penalty
    return Model(languages, code, weights, bias)


def decode(model: Model, margins: np.ndarray) -> tuple[str, float, bool]:
    """Language with the least logistic loss over all bits, its score and whether it is ambiguous."""
    losses = np.logaddexp(0, -model.code * margins[None, :]).sum(axis=1)
    odds = np.exp(losses.min() - losses)
    best = int(np.argmin(losses))
    lead = np.partition(losses, 1)[1] - losses[best] if len(losses) > 1 else np.inf
    return model.languages[best], float(odds[best] / odds.sum()), bool(lead < AMBIGUOUS * len(margins))


_RESULT = "struct<lang_pred:string,score:double,ambiguous:boolean>"
_SEEN = "struct<seen:array<int>,values:array<float>>"


def _featurize(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in pieces(columns):
        seen, values = zip(*(ngram_counts(t or b"") for t in utf8(column))) if len(column) else ((), ())
        yield pa.StructArray.from_arrays(
            [pa.array([s.astype(np.int32) for s in seen], pa.list_(pa.int32())),
             pa.array(list(values), pa.list_(pa.float32()))], ["seen", "values"])


def _predict(shared):
    def predict(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Model(*shared.value)
        for column in pieces(columns):
            out: tuple[list, list, list] = ([], [], [])
            for text in utf8(column):
                if not text or not model.languages or not has_letter(text.decode()):
                    row = (UNKNOWN, 0.0, True)
                else:
                    seen, values = ngram_counts(text)
                    row = decode(model, values @ model.weights[seen] + model.bias)
                for values_of, value in zip(out, row):
                    values_of.append(value)
            yield pa.StructArray.from_arrays(
                [pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.bool_())],
                ["lang_pred", "score", "ambiguous"])
    return predict


def train(labelled: DataFrame, text_col: str, lang_col: str, order_col: str,
          per_language: int = PER_LANGUAGE) -> Model:
    """Fit on the ``per_language`` texts of each language that come first by a hash of ``order_col``."""
    rows = (labelled.select(F.col(lang_col).cast("string").alias("lang"),
                            F.col(text_col).cast("string").alias("text"),
                            F.xxhash64(F.lit(20240503), order_col).alias("h"))
            .where("lang IS NOT NULL AND text IS NOT NULL"))
    # by far most rows are left out by their hash before the exact choice, which then is small;
    # the languages are the classes of the model, which the driver holds anyway
    counts = rows.groupBy("lang").count().collect()
    rates = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], (1.5 * per_language + 100) / r["count"])])
    rate = F.try_element_at(rates, F.col("lang")) if counts else F.lit(1.0)
    first = Window.partitionBy("lang").orderBy("h", "text")
    some = (rows.where(F.pmod("h", F.lit(1 << 30)) < rate * (1 << 30))
            .withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_language))
    rows = (some.withColumn("f", F.arrow_udf(_featurize, _SEEN)("text"))
            .select("lang", "h", "f.seen", "f.values").toArrow().sort_by([("lang", "ascending"), ("h", "ascending")]))
    return fit([(lang, np.array(s), np.array(v, np.float32)) for lang, s, v in zip(
        rows["lang"].to_pylist(), rows["seen"].to_pylist(), rows["values"].to_pylist())])


def identify(documents: DataFrame, model: Model, text_col: str = "text",
             result_col: str = "language") -> DataFrame:
    """``documents`` with a struct column: lang_pred, score, ambiguous.

    Every whole text is mapped to hashed byte n-grams; a binary classifier predicts each bit of the
    language's codeword, and the codeword with the least total loss wins (ties: first language in
    order). ``score`` is its share of the softmax of negative losses; ``ambiguous`` marks texts
    whose second codeword is nearly as close. Null texts, texts without a letter, and all texts if
    no language was learned, give ``und``, 0 and ambiguous. Rows are judged one by one, so repeated
    rows agree; an empty table gives no rows. Other columns stay; one named as ``result_col`` is
    replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast(tuple(model))
    predict = F.arrow_udf(_predict(shared), _RESULT)
    return documents.withColumn(result_col, predict(F.col(text_col).cast("string")))
