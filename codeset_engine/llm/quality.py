"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

SYMBOLS = "#*$%&|<>"


class Rule(NamedTuple):
    """``low`` <= 1000 * measure / base <= ``high``, where given. A base of 0 counts as 1.

    Limits are in thousandths (``base`` None: of the measure itself), so that rules are decided by
    whole numbers.
    """

    name: str
    measure: str
    base: str | None = None
    low: int | None = None
    high: int | None = None


#: Judged on texts that pass the base checks.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2_000, 15_000),
    Rule("symbols", "n_symbols", "n_words", None, 100),
    Rule("stop_words", "n_stop_kinds", None, 2_000, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 600),
)

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a and are as be by for from have in is it of on or that the this to was with "
    "auf das dem den der des die ein eine für im ist mit nicht sich und von zu "
    "au avec dans de des du en est et la le les par pour que qui sur un une "
    "con de del el en es la las los no para por que se su un una y")


def _lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: F.trim(line, F.lit(" \t\x0b\x0c\r")) != "")


def _sorted_windows(words: Column) -> Column:
    """All windows of three words with their places, equal windows side by side."""
    n = F.greatest(F.size(words) - 2, F.lit(0))
    return F.sort_array(F.arrays_zip(
        F.slice(words, F.lit(1), n).alias("a"), F.slice(words, F.lit(2), n).alias("b"),
        F.slice(words, F.lit(3), n).alias("c"),
        F.slice(F.sequence(F.lit(1), n + 1), F.lit(1), n).alias("at")))


def _repeated_places(windows: Column) -> Column:
    """Start places, ascending, of the windows that have an equal one beside them."""
    def same(x: Column, i: Column) -> Column:
        y = F.get(windows, i)
        return (x["c"] == y["c"]) & (x["b"] == y["b"]) & (x["a"] == y["a"])
    found = F.filter(windows, lambda x, i: F.coalesce(same(x, i + 1), F.lit(False))
                     | F.coalesce(same(x, i - 1), F.lit(False)))
    return F.sort_array(found["at"])


def _covered(places: Column) -> Column:
    """Words covered by windows of three at these places."""
    steps = F.transform(places, lambda at, i: F.coalesce(
        F.least(F.get(places, i + 1) - at, F.lit(3)), F.lit(3)))
    return F.aggregate(steps, F.lit(0), lambda total, step: total + step)


def judge(documents: DataFrame, text_col: str = "text", result_col: str = "quality",
          rules: Sequence[Rule] = RULES) -> DataFrame:
    """``documents`` with a struct column of counts, base_failed, failed and kept.

    Words are runs of characters other than ASCII white space. Counts (long): n_words, word_chars,
    n_symbols, n_lines (with a word), n_dup_lines (equal to an earlier one), n_repeat_words (words
    in three-word windows found twice or more) and n_stop_kinds (different stop words). A text
    fails the base checks with fewer than 50 words, or if more than half of its words repeat.
    ``failed`` names the rules that it breaks, ``kept`` is true if it passes the base checks and
    all rules.

    Null and blank texts have no words and fail the base checks. Every row is judged for itself,
    so repeated rows get equal results; an empty table gives no rows. Other columns stay; one named
    as ``result_col`` is replaced. Work is in proportion to the text, but for sorting its windows.
    """
    names = [F.col(c) for c in documents.columns if c != result_col]
    row, text = F.struct(*names).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    split = documents.select(row, text.alias("text")).select(
        "row", "text", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "").alias("words"),
        _lines(F.col("text")).alias("lines"))
    sized = split.select(
        "row", _sorted_windows(F.col("words")).alias("windows"),
        F.size("words").alias("n_words"), F.length(F.array_join("words", "")).alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size(F.array_intersect("words", F.array(*[F.lit(w) for w in sorted(set(STOP_WORDS.split()))])))
        .alias("n_stop_kinds"))
    counts = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_kinds"]
    placed = sized.select("row", *counts, _repeated_places(F.col("windows")).alias("places"))
    counted = placed.select("row", *[F.col(c).cast("long").alias(c) for c in counts],
                            _covered(F.col("places")).cast("long").alias("n_repeat_words"))
    broken = [F.when(~_holds(rule), F.lit(rule.name)) for rule in rules]
    judged = counted.withColumn("base_failed", (F.col("n_words") < 50)
                                | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    judged = judged.withColumn("failed", F.array_compact(F.array(*broken)))
    return judged.select("row.*", F.struct(
        *counts, "n_repeat_words", "base_failed", "failed",
        (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept")).alias(result_col))


def _holds(rule: Rule) -> Column:
    base = F.greatest(F.col(rule.base), F.lit(1)) if rule.base else F.lit(1)
    value, holds = 1000 * F.col(rule.measure), F.lit(True)
    if rule.low is not None:
        holds &= value >= rule.low * base
    if rule.high is not None:
        holds &= value <= rule.high * base
    return holds
