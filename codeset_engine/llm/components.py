"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from .common import Scratch


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long); root is the smallest node reachable.

    Each step gives every node's neighbours the smallest of them: an aggregation, which combines
    before the shuffle, and a join, which Spark splits where a node has very many neighbours.
    The number of rounds grows with the logarithm of the longest path. Every round is written to
    the shared folder, so lineage stays short; few links are few files. Self links and repeated
    links change nothing; no links give no rows. ``links`` is a table that can be read again.
    """
    edges, state = _saved(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(), scratch, links.count())
    while state[0]:
        ends = 2 * state[0]
        # large star: every larger neighbour of a node is linked to the node's smallest neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = scratch.save(both.join(least, "a").where("b > a")
                             .select(F.col("b").alias("a"), F.least("m", "a").alias("b")), "large", rows=ends)
        # small star: the smaller neighbours of a node, and itself, are linked to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(least, "a")
        small = (linked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        before = state
        small, state = _saved(small, scratch, ends)
        scratch.drop(edges, large)
        edges = small
        if before == state:
            break
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _saved(edges: DataFrame, scratch: Scratch, rows: int) -> tuple[DataFrame, tuple]:
    """The written edges and their fingerprint, which is taken while they are written."""
    h, seen = F.xxhash64("a", "b"), Observation()
    saved = scratch.save(edges.observe(seen, F.count("*").alias("n"), F.bit_xor(h).alias("x"),
                                       F.sum(h.cast("decimal(38,0)")).alias("s")), "edges", rows=rows)
    return saved, (seen.get["n"], seen.get["x"], seen.get["s"])
