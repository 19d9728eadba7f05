"""Spelling variants of words by pivotal grams: words that differ by one code point.

Bigrams have one order, rarest first. One edit destroys at most two bigrams, so a word's prefix is
its three rarest bigrams (and all that tie with the last of them), and its pivots are two of them
that do not overlap: one edit spares one pivot. Of two near words, the one whose prefix ends
earlier in the order has a pivot that the other has in its prefix. An edit lies wholly on one side
of the spared pivot, so on the other side the words agree: pivots are looked up with the length of
the other word, and with the position and text that this leaves possible.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, ascii_lower

RUNS = "[A-Za-zÀ-ÿ]+"
SHORTEST, RAREST = 6, 5     # code points and occurrences of a word, at least
RATIO = 5                   # how many times as often as its variants a form occurs
GRAM, EDITS = 2, 1
CELLS = 1 << 16             # counters of the bigram order
_KEYS = "struct<last:string,pivots:array<bigint>,prefix:array<bigint>>"


def word_runs(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """The letter runs of all texts, ``run`` in lower case (A-Z only), beside the other columns."""
    others = [c for c in documents.columns if c != text_col]
    runs = F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(RUNS), F.lit(0)))
    return documents.select(*others, runs.alias("run")).withColumn("run", ascii_lower(F.col("run")))


def count_words(runs: DataFrame, run_col: str = "run", shortest: int = SHORTEST, rarest: int = RAREST) -> DataFrame:
    """(word, n) of the runs that are long and frequent enough."""
    return (runs.where(F.length(run_col) >= shortest).groupBy(F.col(run_col).alias("word"))
            .agg(F.count("*").alias("n")).where(F.col("n") >= rarest))


def cell(gram: str) -> int:
    return zlib.crc32(gram.encode()) % CELLS


def choose_pivots(places: list[tuple[int, int]], many: int = EDITS + 1) -> list[int]:
    """Positions of ``many`` bigrams that do not overlap and have the least sum of counts.

    ``places``: (position, count) by position. Dynamic programming over the bigrams from left to
    right: the best choice of j among the first i either leaves the i-th out, or takes it with the
    best j - 1 of those that end before it.
    """
    best: list[list[tuple[int, list[int]] | None]] = [[(0, [])] + [None] * many]
    free = 0    # how many of them end before the i-th
    for i, (position, count) in enumerate(places, 1):
        while free < i - 1 and places[free][0] + GRAM <= position:
            free += 1
        row: list[tuple[int, list[int]] | None] = [(0, [])]
        for j in range(1, many + 1):
            options = [best[i - 1][j]] if best[i - 1][j] else []
            before = best[free][j - 1]
            if before is not None:
                options.append((before[0] + count, before[1] + [position]))
            row.append(min(options) if options else None)
        best.append(row)
    return best[-1][many][1] if best[-1][many] else []


def _beginnings(word: str) -> list[int]:
    """A hash of each beginning of a word, the empty one first."""
    running = xxhash.xxh3_64()
    hashes = [running.intdigest()]
    for letter in word:
        running.update(letter)
        hashes.append(running.intdigest())
    return hashes


def _key(length: int, side: str, text: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{length}{side}{text}") - (1 << 63)


def word_keys(word: str, counts: list[int]) -> tuple[str, list[int], list[int]]:
    """(end of the prefix in the order of bigrams, keys of the pivots, keys of the prefix)."""
    n = len(word)
    grams = [word[i:i + GRAM] for i in range(n - GRAM + 1)]
    order = [f"{counts[cell(g)]:020d}{g}" for g in grams]
    last = sorted(order)[GRAM * EDITS]
    prefix = [i for i, o in enumerate(order) if o <= last]
    pivots = choose_pivots([(i, counts[cell(grams[i])]) for i in prefix])
    left, right = _beginnings(word), _beginnings(word[::-1])    # up to, and from, each place
    looked_up = set()
    for p in pivots:
        for other in (n - 1, n, n + 1):     # the length of the other word
            if other > n or p + GRAM < n:   # the edit is on the right
                looked_up.add(_key(other, "<", left[p + GRAM]))
            if other > n or p > 0:          # the edit is on the left
                looked_up.add(_key(other, ">", right[n - p]))
    listed = {_key(n, "<", left[p + GRAM]) for p in prefix} | {_key(n, ">", right[n - p]) for p in prefix}
    return last, sorted(looked_up), sorted(listed)


def _keyer(counts: list[int]):
    def keys(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            last, pivots, prefix = [], [], []
            for word in column.to_pylist():
                found = word_keys(word, counts)
                for values, value in zip((last, pivots, prefix), found):
                    values.append(value)
            yield pa.StructArray.from_arrays(
                [pa.array(last, pa.string()), pa.array(pivots, pa.list_(pa.int64())),
                 pa.array(prefix, pa.list_(pa.int64()))], ["last", "pivots", "prefix"])
    return keys


def near_pairs(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, a_n, b, b_n), a < b, of all words (word, n; four code points at least) with one edit between them."""
    at = F.sequence(F.lit(1), F.length("word") - GRAM + 1)
    grams = words.select(F.explode(F.array_distinct(F.transform(
        at, lambda i: F.crc32(F.substring("word", i, F.lit(GRAM)).cast("binary")) % CELLS))).alias("cell"))
    counts = [0] * CELLS
    for cell_, many in grams.groupBy("cell").count().collect():   # a row a cell at most
        counts[cell_] = many
    keyed = scratch.save(words.withColumn("k", F.arrow_udf(_keyer(counts), _KEYS)("word"))
                         .select("word", "n", "k.*"), "keyed")
    pivots = keyed.select(F.col("word").alias("x"), F.col("n").alias("x_n"), F.col("last").alias("x_last"),
                          F.explode("pivots").alias("key"))
    lists = keyed.select(F.col("word").alias("y"), F.col("n").alias("y_n"), F.col("last").alias("y_last"),
                         F.explode("prefix").alias("key"))
    met = pivots.join(lists, "key").where("x <> y AND x_last <= y_last").where(
        F.levenshtein("x", "y", EDITS) == EDITS)
    first = F.col("x") < F.col("y")
    return met.select(F.least("x", "y").alias("a"), F.when(first, F.col("x_n")).otherwise(F.col("y_n")).alias("a_n"),
                      F.greatest("x", "y").alias("b"),
                      F.when(first, F.col("y_n")).otherwise(F.col("x_n")).alias("b_n")).distinct()


def group_variants(words: DataFrame, word_col: str = "word", n_col: str = "n", ratio: int = RATIO) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Two words are near if they differ by one inserted, deleted or replaced code point. A word's
    ``form`` is its near word of the largest n (ties: the smallest in code-point order) if that is at
    least ``ratio`` times the word's own, else null; ``root`` follows forms to the last, and is
    the word itself if it has none. ``ratio`` is 2 or more, so forms make no circle.

    Rows of one word are added up; null words and null counts are left out; words of fewer than
    four code points are near nothing (two bigrams that do not overlap need four). Equal counts
    are ties as above, words of any length count. An empty table gives no rows, other columns are
    ignored. Where very many words share a key, the join spreads over tasks as Spark splits it.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    scratch = Scratch(words.sparkSession, "spelling")
    own = scratch.save(words.select(F.col(word_col).alias("word"), F.col(n_col).cast("long").alias("n"))
                       .dropna().groupBy("word").agg(F.sum("n").alias("n")), "words")
    pairs = scratch.save(near_pairs(own.where(F.length("word") >= 2 * GRAM), scratch), "pairs")
    near = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = near.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct(F.negative("near_n").alias("less"), "near")).alias("best"))
    chosen = F.negative("best.less") >= ratio * F.col("n")
    formed = scratch.save(own.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(chosen, F.col("best.near")).alias("form"),
        F.when(chosen, F.negative("best.less")).alias("form_n")), "formed")
    roots = _roots(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")), scratch)
    result = formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    return result


def _roots(steps: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) at the end of the chains of ``steps``; every round doubles the step."""
    now = scratch.save(steps, "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = scratch.save(now.join(ahead, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"),
            F.col("further").isNotNull().alias("moved")), "roots")
        scratch.drop(now)
        now = longer
        if now.where("moved").isEmpty():
            return now.select("word", "root")
