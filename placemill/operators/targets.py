"""The sheet of regions: implied countries, distinct targets, links and settings lifted from cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placemill.functions.text import extract_urls, is_safe_http_url, looks_like_path, opt, trimmed
from placemill.operators.rank import SPAN, first_per, last_value_before, number_rows
from placemill.operators.resolve import distinct_targets

MAX_LINKS = 20


def fill_country(sheet: DataFrame, keys: list[str] | None = None, span: int = SPAN) -> DataFrame:
    """Country of the nearest row above that names one, carried over spans of rows."""
    named = opt(trimmed(F.col("country")))
    filled = last_value_before(sheet, keys or [], ["ord"], named, "_filled", F.floor(F.col("ord") / span))
    return filled.withColumn("country", F.col("_filled")).drop("_filled")


def region_rows(filled: DataFrame) -> DataFrame:
    """A row per named city and province, in sheet order."""
    both = F.array(
        F.struct(F.lit("city").alias("kind"), opt(trimmed(F.col("city"))).alias("region")),
        F.struct(F.lit("province").alias("kind"), opt(trimmed(F.col("province"))).alias("region")),
    )
    rows = filled.select("ord", "country", F.posexplode(both).alias("at", "t"))
    return rows.select(
        (F.col("ord") * 2 + F.col("at")).alias("ord"), "country", F.col("t.kind").alias("kind"), F.col("t.region").alias("region")
    ).where(F.col("region").isNotNull())


def targets_of(filled: DataFrame) -> DataFrame:
    return distinct_targets(region_rows(filled).where(F.col("country").isNotNull()))


def target_warnings(filled: DataFrame) -> DataFrame:
    skipped = region_rows(filled).where(F.col("country").isNull())
    return skipped.select(
        "ord", F.concat(F.lit('Skipped "'), "region", F.lit('" — no country on or above its row.')).alias("warning")
    )


def sheet_settings(sheet: DataFrame) -> DataFrame:
    """First attribute and first usable path of the sheet."""
    attribute, path = opt(trimmed(F.col("attributes"))), trimmed(F.col("path"))
    return sheet.agg(
        F.min_by(attribute, F.when(attribute.isNotNull(), F.col("ord"))).alias("attribute"),
        F.min_by(path, F.when(looks_like_path(path), F.col("ord"))).alias("output_path"),
    )


def distinct_links(links: DataFrame) -> DataFrame:
    """First occurrence of each link."""
    return first_per(links, ["url"], [F.col("ord")])


def sheet_links(sheet: DataFrame) -> DataFrame:
    """Links of every cell outside the city and province columns, first occurrence kept."""
    urls = F.flatten(F.transform("cells", extract_urls))
    found = sheet.select("ord", F.posexplode(urls).alias("at", "url"))
    return distinct_links(found.select((F.col("ord") * 1_000_000 + F.col("at")).alias("ord"), "url"))


def split_links(typed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid distinct links, rejected entries) of comma- or line-separated text."""
    parts = F.transform(F.split("text", r"[,\n]+"), trimmed)
    entries = typed.select("ord", F.posexplode(F.filter(parts, lambda p: p != "")).alias("at", "url"))
    entries = entries.select((F.col("ord") * 1_000_000 + F.col("at")).alias("ord"), "url").withColumn("ok", is_safe_http_url(F.col("url")))
    return distinct_links(entries.where("ok").drop("ok")), entries.where(~F.col("ok")).drop("ok")


def first_links(links: DataFrame, n: int = MAX_LINKS) -> DataFrame:
    """The first ``n`` links; each task keeps only its own first ``n``."""
    return links.orderBy("ord").limit(n)


def merge_links(typed: DataFrame, from_sheet: DataFrame, n: int = MAX_LINKS) -> DataFrame:
    """Typed links first, then the sheet's, distinct, the first ``n``."""
    both = typed.select(F.lit(0).alias("part"), "ord", "url").unionByName(from_sheet.select(F.lit(1).alias("part"), "ord", "url"))
    kept = first_per(both, ["url"], [F.col("part"), F.col("ord")])
    return kept.orderBy("part", "ord").limit(n)


def number_targets(targets: DataFrame) -> DataFrame:
    """Position of each target in the run."""
    return number_rows(targets, [], [], "ord", "region_ord")
