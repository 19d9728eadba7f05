"""URL rules by hashed host-suffix and path-prefix expressions, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower

PREFIX_HEX = 8  # hex digits (32 bits) of the short hash


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case, or ''."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end, or ''."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _to_slash(path: Column) -> Column:
    """The path up to its last slash, which is included; '' without one."""
    return F.regexp_extract(path, r"(?s)^(.*/)", 1)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict of each URL.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains if the URL's path
    starts with the rule's path. Of the fitting rules the one with the longest ``host + path`` wins,
    then the longer host, then ``block``. Without a rule, the verdict is ``default`` and ``rule`` null.

    Each distinct URL is expanded into its host suffixes and its path prefixes that end with a
    slash; expressions longer than any rule's are left out. Their short hashes are joined with
    those of the rules, full SHA-256 digests and the rest of a rule's path are then compared, and
    the winner goes back to all pages with the URL. Null URLs, and those without ``://``, have an
    empty host and path and fit no rule. Null rule fields make a rule void; repeated rules count
    once. Without rules all pages get the default; without pages there are no rows. Other columns
    stay; those named like the four results are replaced.
    """
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    stem = _to_slash(F.col("rule_path"))
    known = (rules.select(ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"),
                          F.col("verdict").alias("rule_verdict"))
             .where("rule_host IS NOT NULL AND rule_path IS NOT NULL AND rule_verdict IS NOT NULL")
             .distinct().withColumn("rule_digest", _digest(F.col("rule_host"), stem))
             .withColumn("labels", F.size(F.split("rule_host", r"\.")))
             .withColumn("depth", F.size(F.split("rule_path", "/")) - 1))
    labels, depth = known.agg(F.max("labels"), F.max("depth")).first()
    urls = (pages.select(F.col(url_col).alias("u")).where(F.col(url_col).contains("://")).distinct()
            .select("u", url_host(F.col("u")).alias("h"), url_path(F.col("u")).alias("p")))
    parts, steps = F.split("h", r"\."), F.split("p", "/")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels or 1))),
        lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "."))
    prefixes = F.transform(
        F.sequence(F.lit(0), F.least(F.size(steps) - 1, F.lit(depth or 0))),
        lambda k: F.when(k == 0, F.lit("")).otherwise(
            F.concat(F.array_join(F.slice(steps, F.lit(1), k), "/"), F.lit("/"))))
    expressions = (urls.select("u", "p", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
                   .select("u", "p", "suffix", F.explode("prefixes").alias("prefix"))
                   .select("u", "p", _digest(F.col("suffix"), F.col("prefix")).alias("digest"))
                   .withColumn("short", F.substring("digest", 1, PREFIX_HEX)))
    fitting = (expressions.join(known.withColumn("short", F.substring("rule_digest", 1, PREFIX_HEX)), "short")
               .where("digest = rule_digest AND startswith(p, rule_path)"))
    rank = F.struct(F.length(F.concat("rule_host", "rule_path")).alias("n"),
                    F.length("rule_host").alias("h"), (F.col("rule_verdict") == "block").alias("b"),
                    F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict"))
    best = fitting.groupBy("u").agg(F.max(rank).alias("best"))
    page = pages.select(F.struct(*names).alias("page"), F.col(url_col).alias("u"))
    return page.join(best, "u", "left").select(
        "page.*", url_host(F.col("u")).alias("host"), url_path(F.col("u")).alias("path"),
        F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
