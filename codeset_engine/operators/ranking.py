"""First-per-key, top-k and budgets.

All rankings are ``row_number`` windows filtered by a constant. Spark turns that into a
group limit that runs before the shuffle, so each task sends at most k rows per key
however many rows a hot key has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

# Defaults for re-ranking, context length and suggestions per entity.
RERANK_TOP_K = 5
MAX_CONTEXT_LENGTH = 8000
MAX_SUGGESTIONS = 5


SALTS = 64                # sub-groups of a key when the pre-shuffle limit does not apply


def _salt(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """Stable sub-group number of a row."""
    names = columns or [f.name for f in df.schema if not isinstance(f.dataType, T.MapType)]
    return F.pmod(F.xxhash64(*names), F.lit(SALTS))


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int,
          rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per key with their 1-based rank.

    From ``windowGroupLimitThreshold`` on, Spark no longer limits before the shuffle. A hot
    key is then cut in salted sub-groups first: a row among the first k of its key is also
    among the first k of its sub-group, so the result is the same.
    """
    threshold = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold",
                                             "1000"))
    if k >= threshold:
        salted = Window.partitionBy(*by, "__salt").orderBy(*order)
        df = (df.withColumn("__salt", _salt(df))
              .withColumn("__position", F.row_number().over(salted))
              .filter(F.col("__position") <= k).drop("__salt", "__position"))
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order``. (``dropDuplicates`` would take any row.)"""
    return top_k(df, keys, order, 1, rank="__first").drop("__first")


def apply_rerank(candidates: DataFrame, scores: DataFrame, by: Sequence[str],
                 k: int = RERANK_TOP_K) -> DataFrame:
    """Re-order candidates by an external ``relevance_score`` and keep the best ``k``.

    Candidates without a score are not in the re-ranked list. Equal scores keep the code order.
    """
    scored = candidates.join(scores.select(*by, "code", "relevance_score"), [*by, "code"])
    return top_k(scored, by, [F.desc("relevance_score"), F.asc("code")], k, rank="new_rank")


def cap_suggestions(suggestions: DataFrame, by: Sequence[str], k: int = MAX_SUGGESTIONS,
                    then: Sequence[str] = ()) -> DataFrame:
    """At most ``k`` suggestions per entity, most confident first; ``then`` breaks ties on code."""
    return top_k(suggestions, by, [F.desc("confidence"), F.asc("code"), *map(F.asc, then)], k)


def context_budget(texts: DataFrame, by: Sequence[str], order: Sequence[Column],
                   text: str = "text", budget: int = MAX_CONTEXT_LENGTH,
                   salt_on: Sequence[str] | None = None) -> DataFrame:
    """The longest ranked prefix of texts per key whose total length fits the budget.

    Empty texts add nothing and are left out. A hot key is first summed in salted sub-groups:
    once the rows before a row exceed the budget within its sub-group, they also do within
    the key, so such rows go; the row that crosses the budget stays, so that the final sum
    over what is left still stops in the same place. ``order`` must be total.
    """
    sized = texts.withColumn("text_length", F.length(text).cast("long")).filter("text_length > 0")
    salted = (Window.partitionBy(*by, "__salt").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    before = F.coalesce(F.sum("text_length").over(salted), F.lit(0))
    reduced = (sized.withColumn("__salt", _salt(sized, salt_on)).withColumn("__before", before)
               .filter(F.col("__before") <= budget).drop("__salt", "__before"))
    in_order = Window.partitionBy(*by).orderBy(*order)
    running = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (reduced.withColumn("rank", F.row_number().over(in_order))
            .withColumn("used", F.sum("text_length").over(running))
            .filter(F.col("used") <= budget))
