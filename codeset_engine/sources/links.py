"""Download links found in pages, and the choice of a URL per code type and year."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Site, folders, groups, known files and link forms per detailed code type.
SITE = "https://www.cms.gov"
FILES_BASE = "https://www.cms.gov/files/zip/"
TYPE_GROUPS = {
    "icd10cm": ("icd10cm_code_descriptions", "icd10cm_code_tables"),
    "icd10pcs": ("icd10pcs_order", "icd10pcs_codes"),
    "cpt": ("cpt_hcpcs_codes",),
}
FAMILIES = ("cpt", "icd10cm", "icd10pcs")
PREDEFINED = {
    ("cpt_hcpcs_codes", 2025):
        "/files/zip/list-codes-effective-january-1-2025-published-november-26-2024.zip",
    ("cpt_hcpcs_codes", 2024):
        "/files/zip/updated-list-codes-effective-january-1-2024-published-march-1-2024-all-codes-effective-january-1-2024-unless-otherwise-indicated-code-list.zip",
    ("cpt_hcpcs_codes", 2023):
        "/files/zip/list-codes-effective-january-1-2023-published-december-1-2022.zip",
}
PREDEFINED_ONLY = ("cpt_hcpcs_codes",)
FALLBACK_SLUGS = {
    "icd10cm_poa": "{year}-poa-exempt-codes.zip",
    "icd10cm_conversion": "{year}-conversion-table.zip",
    "icd10cm_code_descriptions": "{year}-code-descriptions-tabular-order.zip",
    "icd10cm_addendum": "{year}-addendum.zip",
    "icd10cm_code_tables": "{year}-code-tables-tabular-and-index.zip",
    "icd10pcs_order": "{year}-icd-10-pcs-order-file-long-and-abbreviated-titles.zip",
    "icd10pcs_codes": "{year}-icd-10-pcs-codes-file.zip",
    "icd10pcs_conversion": "{year}-icd-10-pcs-conversion-table.zip",
    "icd10pcs_tables": "{year}-icd-10-pcs-code-tables-and-index.zip",
    "icd10pcs_addendum": "{year}-icd-10-pcs-addendum.zip",
}
LINK_FORMS = {
    "icd10cm_code_descriptions": r"(?i)/files/zip/([0-9]{4})-code-descriptions-tabular-order\.zip$",
    "icd10cm_code_tables": r"(?i)/files/zip/([0-9]{4})-code-tables-tabular-and-index\.zip$",
    "icd10pcs_order": r"(?i)/files/zip/([0-9]{4})-icd-10-pcs-order-file.*\.zip$",
    "icd10pcs_codes": r"(?i)/files/zip/([0-9]{4})-icd-10-pcs-codes-file\.zip$",
}
HREF = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""


NOT_SHOWN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
# The entities that attribute values need.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


def decode_entities(text: Column) -> Column:
    """Numeric entities up to U+FFFF and the five of XML, ``&amp;`` last."""
    def numbered(value: Column, entity: Column) -> Column:
        digits = F.regexp_extract(entity, r"&#[xX]?([0-9A-Fa-f]+);", 1)
        code = F.when(entity.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).cast("long")
        char = F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")
        return F.when(code.between(1, 0xFFFF), F.replace(value, entity, char)).otherwise(value)
    found = F.regexp_extract_all(text, F.lit("&#(?:[xX][0-9A-Fa-f]{1,6}|[0-9]{1,7});"), F.lit(0))
    text = F.when(text.contains("&#"), F.aggregate(found, text, numbered)).otherwise(text)
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def resolve_href(href: Column, site: str = SITE) -> Column:
    """Absolute URL of a link found on ``site``."""
    return (F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
            .when(F.startswith(href, F.lit("//")), F.concat(F.lit(site.split("//")[0]), href))
            .when(F.startswith(href, F.lit("/")), F.concat(F.lit(site), href))
            .otherwise(F.concat(F.lit(site + "/"), F.regexp_replace(href, r"^(\.\.?/)+", ""))))


def page_links(pages: DataFrame, html: str = "html", suffix: str = ".zip",
               contains: str = "/files/", site: str = SITE) -> DataFrame:
    """Distinct ``url`` of the anchors in all pages whose href passes both conditions."""
    shown = F.regexp_replace(html, NOT_SHOWN, " ")
    raw = pages.select(F.explode(F.regexp_extract_all(shown, F.lit(HREF), F.lit(1))).alias("raw"))
    href = decode_entities(F.trim(F.regexp_replace("raw", "^[\"']|[\"']$", "")))
    return (raw.select(href.alias("href"))
            .filter(F.endswith("href", F.lit(suffix)) & F.contains("href", F.lit(contains)))
            .select(resolve_href(F.col("href"), site).alias("url")).distinct())


def extract_links(pages: DataFrame, **options: str) -> DataFrame:
    """Links of all pages, sorted."""
    return page_links(pages, **options).orderBy("url")


def expand_type_groups(requested: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Distinct detailed ``code_type`` (with the ``keep`` columns) of types and groups.

    Groups are ``all`` and the families; anything else stands for itself.
    """
    every = [name for names in TYPE_GROUPS.values() for name in names]
    groups = {"all": every, **TYPE_GROUPS}
    kind = F.col("code_type")
    detailed = F.array(kind)
    for name, members in groups.items():
        detailed = F.when(kind == name, F.array(*[F.lit(m) for m in members])).otherwise(detailed)
    return requested.select(*keep, F.explode(detailed).alias("code_type")).distinct()


def code_family(code_type: Column) -> Column:
    family = F.lit("other")
    for name in FAMILIES:
        family = F.when(F.startswith(code_type, F.lit(name)), F.lit(name)).otherwise(family)
    return family


def download_paths(requests: DataFrame) -> DataFrame:
    """Adds ``family, zip_path, extract_dir`` relative to the raw folder."""
    stem = F.concat(code_family(F.col("code_type")), F.lit("/"), F.col("code_type"), F.lit("_"),
                    F.col("year").cast("string"))
    return requests.select("*", code_family(F.col("code_type")).alias("family"),
                           F.concat(stem, F.lit(".zip")).alias("zip_path"),
                           stem.alias("extract_dir"))


def classify_links(links: DataFrame, forms: Mapping[str, str] = LINK_FORMS) -> DataFrame:
    """(code_type, year, url) of links that have a known form.

    Type and year are read out of the link itself, so that finding the link of a request is
    an equality join and not a comparison of every request with every link.
    """
    year = F.coalesce(*[F.nullif(F.regexp_extract("url", form, 1), F.lit(""))
                        for form in forms.values()])
    kind = F.coalesce(*[F.when(F.col("url").rlike(form), F.lit(name))
                        for name, form in forms.items()])
    return (links.select("url", kind.alias("code_type"), year.cast("int").alias("year"))
            .filter(F.col("code_type").isNotNull()))


def _with_year(form: str, year: Column) -> Column:
    before, after = form.split("{year}")
    return F.concat(F.lit(before), year.cast("string"), F.lit(after))


def resolve_download_urls(requests: DataFrame, links: DataFrame,
                          forms: Mapping[str, str] = LINK_FORMS) -> DataFrame:
    """(code_type, year, url, origin): predefined, first scraped, fallback slug or none."""
    kind, year = F.col("code_type"), F.col("year")
    predefined = F.coalesce(*[F.when((kind == name) & (year == y), F.lit(url))
                              for (name, y), url in PREDEFINED.items()])
    slug = F.coalesce(*[F.when(kind == name, _with_year(FILES_BASE + form, year))
                        for name, form in FALLBACK_SLUGS.items()])
    fixed = kind.isin(*PREDEFINED_ONLY)
    scraped = classify_links(links, forms).groupBy("code_type", "year").agg(
        F.min("url").alias("scraped"))
    joined = requests.select("code_type", "year").distinct().join(
        scraped, ["code_type", "year"], "left")
    found = F.when(~fixed, F.col("scraped"))
    fallback = F.when(~fixed, slug)
    return joined.select(
        "code_type", "year", F.coalesce(predefined, found, fallback).alias("url"),
        F.when(predefined.isNotNull(), F.lit("predefined"))
        .when(found.isNotNull(), F.lit("scraped"))
        .when(fallback.isNotNull(), F.lit("fallback")).otherwise(F.lit("none")).alias("origin"))
