"""Availability, comparison and history of code sets across years.

Input rows carry at least ``code_type``, ``year`` and ``code``. Each operator is one pass
over the rows with map-side aggregation; no year is read twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schemas import COLUMNS_BY_TYPE
from .ranking import first_per_key, top_k

# Known code types and years, and the length of sample lists.
CODE_TYPES = ("icd10cm", "icd10pcs", "cpt")
CURRENT_YEAR = 2025
ALL_YEARS = (2025, 2024, 2023, 2022)
SAMPLE_SIZE = 100
# The wording of report lines.
PRESENT, MISSING, CURRENT, NOT_AVAILABLE = "✓", "✗", " (CURRENT)", "Not available"


def code_counts(codes: DataFrame) -> DataFrame:
    """Rows per (code_type, year)."""
    return codes.groupBy("code_type", "year").agg(F.count(F.lit(1)).alias("total_codes"))


def availability(codes: DataFrame, years: Sequence[int],
                 types: DataFrame | None = None) -> DataFrame:
    """(code_type, year, exists, total_codes) for every asked pair, present or not.

    The types are those that occur, or those of ``types``. The counts of a type, one per year,
    are held in a map and looked up for each asked year: one scan, no join with a grid. Rows
    without a year are in none.
    """
    counted = F.when(F.col("year").isNotNull(), F.struct("year", "total_codes"))
    by_year = code_counts(codes).groupBy("code_type").agg(
        F.map_from_entries(F.collect_list(counted)).alias("by_year"))
    if types is not None:
        by_year = types.select("code_type").distinct().join(by_year, "code_type", "left")
    asked = by_year.select("code_type", "by_year", F.explode(
        F.array(*[F.lit(int(y)) for y in years])).alias("year"))
    total = F.try_element_at("by_year", F.col("year"))
    return asked.select("code_type", "year", total.isNotNull().alias("exists"),
                        F.coalesce(total, F.lit(0)).alias("total_codes"))


def available_years(codes: DataFrame) -> DataFrame:
    """(code_type, year) that have rows; sort descending for display."""
    return codes.select("code_type", "year").distinct()


def year_metadata(codes: DataFrame, files: DataFrame, years: Sequence[int],
                  types: DataFrame | None = None) -> DataFrame:
    """Counts joined with file facts and, for known types, the column names.

    ``files``: ``code_type, year, path, length, modificationTime`` of the stored files.
    """
    known = F.lit(None).cast("array<string>")
    for name, columns in COLUMNS_BY_TYPE.items():
        known = F.when(F.col("code_type") == name, F.array(*map(F.lit, columns))).otherwise(known)
    facts = files.groupBy("code_type", "year").agg(
        F.sum("length").alias("file_size"), F.min("path").alias("file_path"),
        F.max("modificationTime").alias("last_updated"))
    return (availability(codes, years, types).join(facts, ["code_type", "year"], "left")
            .withColumn("file_size", F.coalesce("file_size", F.lit(0)))
            .withColumn("columns", F.when(F.col("exists"), known)))


def summary_lines(metadata: DataFrame, current_year: int = CURRENT_YEAR) -> DataFrame:
    """One formatted report line per (code_type, year)."""
    info = F.when(F.col("exists"), F.concat(
        F.format_number("total_codes", 0), F.lit(" codes | "),
        F.format_string("%.2f MB", F.col("file_size") / F.lit(1024.0 * 1024.0))))
    line = F.concat(
        F.lit("  "), F.when(F.col("exists"), F.lit(PRESENT)).otherwise(F.lit(MISSING)), F.lit(" "),
        F.col("year").cast("string"),
        F.when(F.col("year") == current_year, F.lit(CURRENT)).otherwise(F.lit("")),
        F.lit(": "), F.coalesce(info, F.lit(NOT_AVAILABLE)))
    return metadata.select(F.upper("code_type").alias("code_type"), "year", line.alias("line"))


def _presence(codes: DataFrame, year1: Column, year2: Column, *keys: str) -> DataFrame:
    return codes.groupBy(*keys, "code").agg(
        F.max(year1).alias("in_year1"), F.max(year2).alias("in_year2"))


def _difference_counts(presence: DataFrame, *keys: str) -> DataFrame:
    one, two = F.col("in_year1"), F.col("in_year2")
    return presence.groupBy(*keys).agg(
        F.count_if(one).alias("year1_total"), F.count_if(two).alias("year2_total"),
        F.count_if(two & ~one).alias("added_in_year2"),
        F.count_if(one & ~two).alias("removed_from_year1"),
        F.count_if(one & two).alias("common_codes"))


def compare_years(codes: DataFrame, year1: int, year2: int) -> DataFrame:
    """Counts of added, removed and common codes per code type.

    ``error`` is set, and the counts null, when one of the years has no rows.
    """
    both = codes.filter(F.col("year").isin(year1, year2))
    presence = _presence(both, F.col("year") == year1, F.col("year") == year2, "code_type")
    counts = _difference_counts(presence, "code_type")
    missing = (F.col("year1_total") == 0) | (F.col("year2_total") == 0)
    return counts.select(
        "code_type", F.lit(year1).alias("year1"), F.lit(year2).alias("year2"),
        *[F.when(~missing, F.col(name)).alias(name) for name in counts.columns[1:]],
        F.when(missing, F.lit("One or both years not available")).alias("error"))


def code_years(codes: DataFrame) -> DataFrame:
    """(code_type, code, years): the years in which the code occurs, ascending.

    A single aggregation whose state is one entry per year of a code. Rows without a year are
    in no year.
    """
    return (codes.where(F.col("year").isNotNull()).groupBy("code_type", "code")
            .agg(F.sort_array(F.collect_set("year")).alias("years")))


def compare_consecutive_years(codes: DataFrame) -> DataFrame:
    """The comparison for every pair (y, y+1) of stored years of each type.

    One shuffle by code; what follows works on one list of years per code. Pairs of which one
    year is not stored are dropped at the end.
    """
    years, year1 = F.col("years"), F.col("year1")
    either = F.array_union(years, F.transform(years, lambda year: year - 1))
    presence = (code_years(codes).select("code_type", "years", F.explode(either).alias("year1"))
                .select("code_type", "year1", F.array_contains(years, year1).alias("in_year1"),
                        F.array_contains(years, year1 + 1).alias("in_year2")))
    counts = _difference_counts(presence, "code_type", "year1")
    return (counts.filter((F.col("year1_total") > 0) & (F.col("year2_total") > 0))
            .withColumn("year2", F.col("year1") + 1))


def changed_code_samples(codes: DataFrame, year1: int, year2: int,
                         size: int = SAMPLE_SIZE) -> DataFrame:
    """The first ``size`` added and removed codes per type, ascending."""
    both = codes.filter(F.col("year").isin(year1, year2))
    presence = _presence(both, F.col("year") == year1, F.col("year") == year2, "code_type")
    changed = (presence.filter(F.col("in_year1") != F.col("in_year2"))
               .select("code_type", "code",
                       F.when(F.col("in_year2"), F.lit("added")).otherwise(F.lit("removed"))
                       .alias("change")))
    return top_k(changed, ["code_type", "change"], [F.asc("code")], size)


def comparison_report(codes: DataFrame, year1: int, year2: int,
                      size: int = SAMPLE_SIZE) -> DataFrame:
    """Counts plus the sample lists as arrays (at most ``size`` codes each)."""
    samples = changed_code_samples(codes, year1, year2, size)
    ordered = F.array_sort(F.collect_list(F.col("code")))
    lists = samples.groupBy("code_type", "change").agg(ordered.alias("codes"))
    wide = lists.groupBy("code_type").agg(*[
        F.coalesce(F.max(F.when(F.col("change") == change, F.col("codes"))),
                   F.array().cast("array<string>")).alias(f"{change}_codes")
        for change in ("added", "removed")])
    return compare_years(codes, year1, year2).join(wide, "code_type", "left")


def code_changes(codes1: DataFrame, codes2: DataFrame) -> DataFrame:
    """(code, change): every code of either set as ``added``, ``removed`` or ``common``.

    One aggregation over both sets. Repeated codes are combined before the shuffle, so a code
    that fills a third of the rows costs no more than any other.
    """
    both = codes1.select("code", F.lit(True).alias("one"), F.lit(False).alias("two")).unionByName(
        codes2.select("code", F.lit(False).alias("one"), F.lit(True).alias("two")))
    flags = both.groupBy("code").agg(F.max("one").alias("one"), F.max("two").alias("two"))
    change = (F.when(F.col("one") & F.col("two"), F.lit("common"))
              .when(F.col("two"), F.lit("added")).otherwise(F.lit("removed")))
    return flags.select("code", change.alias("change"))


def _changed(codes1: DataFrame, codes2: DataFrame, change: str) -> DataFrame:
    return code_changes(codes1, codes2).filter(F.col("change") == change).select("code")


def added(codes1: DataFrame, codes2: DataFrame) -> DataFrame:
    """Codes of the second set that the first lacks."""
    return _changed(codes1, codes2, "added")


def removed(codes1: DataFrame, codes2: DataFrame) -> DataFrame:
    """Codes of the first set that the second lacks."""
    return _changed(codes1, codes2, "removed")


def common(codes1: DataFrame, codes2: DataFrame) -> DataFrame:
    """Codes in both sets."""
    return _changed(codes1, codes2, "common")


def code_history(codes: DataFrame, order: Sequence[Column], code: str | None = None,
                 code_type: str | None = None) -> DataFrame:
    """First matching row per (code_type, code, year); filters are pushed to the scan."""
    if code is not None:
        codes = codes.filter(F.col("code") == code)
    if code_type is not None:
        codes = codes.filter(F.col("code_type") == code_type)
    return first_per_key(codes, ["code_type", "code", "year"], order)


def history_flags(codes: DataFrame) -> DataFrame:
    """Per (code_type, code, year): first and last year of the code, years missing before."""
    years = F.col("years")
    return (code_years(codes)
            .select("code_type", "code", "years", F.posexplode("years").alias("i", "year"))
            .select("code_type", "code", "year",
                    F.get(years, F.lit(0)).alias("first_year"),
                    F.array_max(years).alias("last_year"),
                    F.coalesce(F.col("year") - F.get(years, F.col("i") - 1) - 1, F.lit(0))
                    .alias("gap_before")))


def presence_patterns(codes: DataFrame) -> DataFrame:
    """(code_type, years, codes): how many codes occur in exactly these years.

    One shuffle by code; the patterns are few, however many codes there are.
    """
    return code_years(codes).groupBy("code_type", "years").agg(F.count(F.lit(1)).alias("codes"))


def compare_all_years(codes: DataFrame) -> DataFrame:
    """The comparison of every stored year of a type with every other one, in both directions.

    All counts follow from the patterns: two years have the codes of all patterns in common that
    hold both. So the codes are shuffled once, whatever the number of years.
    """
    patterns = presence_patterns(codes)
    one = patterns.select("code_type", "years", "codes", F.explode("years").alias("year1"))
    totals = one.groupBy("code_type", "year1").agg(F.sum("codes").alias("total"))
    both = (one.select("code_type", "year1", F.explode("years").alias("year2"), "codes")
            .groupBy("code_type", "year1", "year2").agg(F.sum("codes").alias("common")))
    other = totals.select("code_type", F.col("year1").alias("year2"), F.col("total").alias("total2"))
    pairs = totals.join(other, "code_type").where("year1 <> year2")     # years of a type are few
    shared = F.coalesce("common", F.lit(0))
    return (pairs.join(both, ["code_type", "year1", "year2"], "left")
            .select("code_type", "year1", "year2", F.col("total").alias("year1_total"),
                    F.col("total2").alias("year2_total"), (F.col("total2") - shared).alias("added_in_year2"),
                    (F.col("total") - shared).alias("removed_from_year1"), shared.alias("common_codes")))


def validity_intervals(codes: DataFrame, order: Sequence[Column]) -> DataFrame:
    """(code_type, code, description, valid_from, valid_to): runs of years with one description.

    A run ends where a year is missing or the description changes (null is a description like any
    other). A year's description is that of its first row in ``order``. Rows without a year are in
    no run. After the first step a code has one row a year, so its window is small.
    """
    yearly = first_per_key(codes.where(F.col("year").isNotNull()), ["code_type", "code", "year"], order)
    by_year = Window.partitionBy("code_type", "code").orderBy("year")
    follows = ((F.lag("year").over(by_year) == F.col("year") - 1)
               & F.lag("description").over(by_year).eqNullSafe(F.col("description")))
    starts = yearly.withColumn("starts", (~F.coalesce(follows, F.lit(False))).cast("int"))
    return (starts.withColumn("run", F.sum("starts").over(by_year)).groupBy("code_type", "code", "run")
            .agg(F.first("description").alias("description"), F.min("year").alias("valid_from"),
                 F.max("year").alias("valid_to")).drop("run"))


def as_of_lookup(intervals: DataFrame, requests: DataFrame, salts: int = 8) -> DataFrame:
    """``requests`` (code_type, code, as_of, ...) with the interval in force, or the last one before.

    Adds description, valid_from, valid_to and ``status``: ``valid``, ``lapsed`` (the last interval
    ended before) or ``unknown`` (none has begun). Intervals and requests are sorted together and the
    last interval is carried on, so there is no range join. A code's requests are dealt to
    ``salts`` groups, each with a copy of the code's few intervals.
    """
    found = F.struct("description", "valid_from", "valid_to")
    begun = intervals.select(
        "code_type", "code", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"),
        F.col("valid_from").cast("int").alias("__at"), F.lit(0).alias("__asks"), found.alias("__found"),
        F.lit(None).cast(requests.schema).alias("__request"))
    row = F.struct(*[F.col(c) for c in requests.columns])
    asking = requests.select(
        "code_type", "code", F.pmod(F.xxhash64(row), F.lit(salts)).cast("int").alias("__salt"),
        F.col("as_of").cast("int").alias("__at"), F.lit(1).alias("__asks"),
        F.lit(None).cast(begun.schema["__found"].dataType).alias("__found"), row.alias("__request"))
    until_now = (Window.partitionBy("code_type", "code", "__salt").orderBy(F.asc_nulls_first("__at"), "__asks")
                 .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    carried = (begun.unionByName(asking).withColumn("__last", F.last("__found", ignorenulls=True).over(until_now))
               .where("__asks = 1"))
    last = F.col("__last")
    status = (F.when(last.isNull() | F.col("__at").isNull(), "unknown")
              .when(F.col("__at") <= last["valid_to"], "valid").otherwise("lapsed"))
    return carried.select("__request.*", last["description"].alias("description"), last["valid_from"].alias("valid_from"),
                          last["valid_to"].alias("valid_to"), status.alias("status"))
