"""Snapshot readers: each file kind to place rows, photos, pages or responses."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placemill import dims, schema
from placemill.functions import geo, tags as tg
from placemill.functions.text import (
    clean_text, hash31, html_title, opt, percent_encode, strip_html, strip_tags_short,
)


def read_json(spark: SparkSession, path: str, shape: str) -> DataFrame:
    """Line-delimited JSON with a fixed schema; unparsable lines are kept aside in ``_corrupt``."""
    return spark.read.schema(shape).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


# --- places ----------------------------------------------------------------

def osm_places(elements: DataFrame, label: Column, category: Column) -> DataFrame:
    """Map elements to place rows; anonymous or unplaced elements drop out."""
    at = geo.coords(F.col("lat"), F.col("lon"), F.col("center"))
    known = (
        elements.withColumn("_tags", F.coalesce("tags", F.create_map().cast("map<string,string>")))
        .withColumn("_at", at).withColumn("_name", tg.preferred_name(F.col("_tags")))
        .where(F.col("_at").isNotNull() & F.col("_name").isNotNull())
    )
    return known.select(
        "search_id", "ord", F.concat_ws("/", "type", F.col("id").cast("string")).alias("id"),
        F.col("type").alias("osm_type"), F.col("id").alias("osm_id"), F.col("_name").alias("name"),
        F.col("_at.lat").alias("lat"), F.col("_at.lon").alias("lon"),
        tg.keep_local_name(F.col("_tags"), F.col("_name")).alias("tags"),
        category.alias("category"), tg.label_from_tags(F.col("_tags"), label).alias("category_label"),
        F.lit("overpass").alias("source"),
    )


def read_osm_elements(spark: SparkSession, path: str, label: str = "Place", category: str = "custom") -> DataFrame:
    return osm_places(read_json(spark, path, schema.OSM_ELEMENT), F.lit(label), F.lit(category))


def entity_places(rows: DataFrame, label: Column, category: Column) -> DataFrame:
    """Knowledge-base rows to place rows; a label that is only an id is no name."""
    qid = opt(F.regexp_extract("item", "([^/]*)$", 1))
    name = opt(clean_text(F.col("itemLabel"), 160))
    commons = opt(clean_text(F.col("commons"), 200))
    found = (
        rows.withColumn("_q", qid).withColumn("_name", name).withColumn("_at", geo.parse_point(F.col("coord")))
        .where(F.col("_q").isNotNull() & F.col("_name").isNotNull() & F.col("_at").isNotNull() & ~F.col("_name").rlike("^Q[0-9]+$"))
    )
    tags = tg.tag_map(
        name=F.col("_name"), wikidata=F.col("_q"), description=opt(clean_text(F.col("itemDescription"), 400)),
        website=opt(F.col("website")),
        wikimedia_commons=F.concat(F.lit("Category:"), F.regexp_replace(commons, "(?i)^Category:", "")),
    )
    return found.select(
        "search_id", "ord", F.concat(F.lit("wikidata/"), "_q").alias("id"), F.lit("node").alias("osm_type"),
        F.coalesce(F.expr("try_cast(substring(_q, 2) as bigint)"), F.lit(0)).alias("osm_id"),
        F.col("_name").alias("name"), F.col("_at.lat").alias("lat"), F.col("_at.lon").alias("lon"), tags.alias("tags"),
        category.alias("category"), F.coalesce(opt(clean_text(F.col("typeLabel"), 80)), label).alias("category_label"),
        F.lit("wikidata").alias("source"),
    )


def read_entity_places(spark: SparkSession, path: str, label: str = "Place", category: str = "custom") -> DataFrame:
    return entity_places(read_json(spark, path, schema.ENTITY_ROW), F.lit(label), F.lit(category))


ADDRESS_KEYS = ["road", "suburb", "city", "postcode", "state"]


def gazetteer_places(rows: DataFrame) -> DataFrame:
    """Gazetteer rows to place rows; address parts become ``addr:`` tags."""
    name = opt(clean_text(F.coalesce(F.col("name"), F.split_part("display_name", F.lit(","), F.lit(1))), 160))
    empty = F.create_map().cast("map<string,string>")
    address = F.transform_keys(
        F.map_filter(F.coalesce("address", empty), lambda k, _: k.isin(ADDRESS_KEYS)),
        lambda k, _: F.concat(F.lit("addr:"), F.when(k == "road", "street").otherwise(k)),
    )
    kind = F.when(
        opt(F.col("category")).isNotNull() & opt(F.col("type")).isNotNull(), F.create_map("category", "type")
    ).otherwise(empty)
    found = (
        rows.withColumn("_lat", F.col("lat").try_cast("double")).withColumn("_lon", F.col("lon").try_cast("double"))
        .withColumn("_name", name)
        .where(
            F.col("_name").isNotNull() & F.col("_lat").isNotNull() & F.col("_lon").isNotNull()
            & ~F.isnan("_lat") & ~F.isnan("_lon") & (F.col("osm_id") != 0) & F.col("osm_type").isin("node", "way", "relation")
        )
    )
    tags = tg.overlay(
        tg.overlay(tg.overlay(F.create_map(F.lit("name"), F.col("_name")), F.coalesce("extratags", empty)), kind), address
    )
    return found.select(
        "search_id", "ord", F.concat_ws("/", "osm_type", F.col("osm_id").cast("string")).alias("id"), "osm_type", "osm_id",
        F.col("_name").alias("name"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), tags.alias("tags"),
        F.lit("custom").alias("category"),
        F.coalesce(opt(clean_text(F.replace("type", F.lit("_"), F.lit(" ")), 80)), F.lit("Place")).alias("category_label"),
        F.lit("nominatim").alias("source"),
    )


def read_gazetteer_places(spark: SparkSession, path: str) -> DataFrame:
    return gazetteer_places(read_json(spark, path, schema.GAZETTEER_ROW))


def google_places(found: DataFrame, details: DataFrame) -> DataFrame:
    """Search rows with their optional details; details win. Rows without id, name or place drop out."""
    d = details.select(F.col("place_id").alias("_id"), F.struct(*[c for c in details.columns if c != "place_id"]).alias("d"))
    base = opt(clean_text(F.col("name"), 200))
    rows = (
        found.withColumn("base", base)
        .where(opt(F.col("place_id")).isNotNull() & F.col("base").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
        .join(d, F.col("place_id") == F.col("_id"), "left")
    )
    pick = lambda c: F.coalesce(F.col(f"d.{c}"), F.col(c))
    kinds = pick("types")
    rating, count = pick("rating"), F.coalesce(pick("user_ratings_total"), F.lit(0))
    address, hours = pick("formatted_address"), F.array_join(F.col("d.weekday_text"), "; ")
    typed = F.filter(F.slice(F.coalesce(kinds, F.array().cast("array<string>")), 1, 6), lambda t: ~t.isin(dims.GENERIC_TYPES))
    tags = tg.overlay(
        tg.tag_map(
            google_place_id=F.col("place_id"),
            rating=F.concat(tg.plain_number(rating), F.lit(" / 5 ("), count.cast("string"), F.lit(" reviews)")),
            opening_hours=opt(hours), addr__full=opt(address), website=opt(F.col("d.website")),
            phone=opt(F.col("d.formatted_phone_number")),
        ),
        F.map_from_arrays(
            F.array_distinct(F.transform(typed, lambda t: F.concat(F.lit("google:"), t))),
            F.transform(F.array_distinct(typed), lambda _: F.lit("yes")),
        ),
    )
    rated = F.concat(F.lit("Rated "), tg.plain_number(rating), F.lit("/5 by "), count.cast("string"), F.lit(" Google reviewers."))
    label = tg.label_from_types(kinds)
    address_link = F.concat(
        F.lit("https://www.google.com/maps/search/?api=1&query="), percent_encode(F.col("base")),
        F.lit("&query_place_id="), F.col("place_id"),
    )
    return rows.select(
        "search_id", "ord", F.concat(F.lit("google/"), "place_id").alias("id"), F.lit("node").alias("osm_type"),
        hash31(F.col("place_id")).alias("osm_id"),
        clean_text(F.coalesce(F.col("d.name"), F.col("base")), 200).alias("name"), "lat", "lon", tags.alias("tags"),
        label["id"].alias("category"), label["label"].alias("category_label"), F.lit("google").alias("source"),
        clean_text(F.concat_ws(" ", opt(F.col("d.overview")), rated), 4000).alias("summary"),
        F.struct(
            F.coalesce(F.col("d.formatted_phone_number"), F.col("d.international_phone_number")).alias("phone"),
            F.lit(None).cast("string").alias("email"), F.col("d.website").alias("website"),
            address.alias("address"), hours.alias("opening_hours"),
        ).alias("contact"),
        tg.rating_score(rating).alias("quality"),
        F.coalesce(F.col("d.url"), address_link).alias("map_url"),
    )


def read_google_places(spark: SparkSession, search_path: str, details_path: str) -> DataFrame:
    return google_places(
        read_json(spark, search_path, schema.GOOGLE_ROW), read_json(spark, details_path, schema.GOOGLE_DETAILS)
    )


# --- corpus ----------------------------------------------------------------

def read_corpus(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Frozen records in order; blank lines are no records."""
    rows = read_json(spark, path, schema.CORPUS).where(F.col("place").isNotNull()).drop("_corrupt")
    return rows.orderBy("ord").limit(limit) if limit else rows


# --- pages, responses, entities, photos --------------------------------------

MIN_PAGE_CHARS = 200


def page_documents(pages: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Readable text of every page, whole unless ``max_chars`` is given; ``usable`` marks pages long enough."""
    text = strip_html(F.col("html"))
    text = F.substring(text, 1, max_chars) if max_chars else text
    return pages.select(
        F.col("page_id").alias("doc_id"), "url", html_title(F.col("html"), F.col("url")).alias("label"), text.alias("text")
    ).withColumn("usable", F.length("text") >= MIN_PAGE_CHARS)


def page_warnings(docs: DataFrame) -> DataFrame:
    return docs.where(~F.col("usable")).select(
        "doc_id", F.concat(F.lit("Source "), "url", F.lit(" returned too little readable text to use.")).alias("warning")
    )


def read_pages(spark: SparkSession, path: str, max_chars: int | None = None) -> DataFrame:
    return page_documents(spark.read.parquet(path).select("page_id", "url", "html"), max_chars)


def read_completions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.COMPLETION).parquet(path)


def claims_of(entities: DataFrame) -> DataFrame:
    """One row per claim, in the order of each property's list."""
    listed = entities.select("entity_id", F.explode("claims").alias("property", "values"))
    return listed.select("entity_id", "property", F.posexplode("values").alias("ord", "v")).select(
        "entity_id", F.col("ord").cast("bigint").alias("ord"), "property", "v.datatype", "v.value"
    )


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, schema.ENTITY)


def read_entity_claims(spark: SparkSession, path: str) -> DataFrame:
    return claims_of(read_entities(spark, path))


def _photo(df: DataFrame, **columns: Column) -> DataFrame:
    """One photo row; columns a source lacks are null."""
    fields = [part.split() for part in schema.PHOTO_COLUMNS.split(", ")]
    return df.select(*[columns.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields])


def commons_photos(info: DataFrame, source: str = "commons") -> DataFrame:
    """File info to photos: a scaled copy stands in for very large originals."""
    scaled = F.when(F.col("thumburl").isNotNull() & (F.col("thumbwidth") >= 1024), F.col("thumburl"))
    good = info.where((F.col("mime").isNull() | F.col("mime").isin(dims.ALLOWED_MIME)) & opt(F.col("url")).isNotNull())
    return _photo(
        good, place_id=F.col("place_id"), ord=F.col("ord"), url=F.coalesce(scaled, F.col("url")),
        download_url=F.when((F.col("width") > 2560) & scaled.isNotNull(), scaled).otherwise(F.col("url")),
        thumb_url=F.coalesce(F.regexp_replace("thumburl", r"/\d+px-", "/640px-"), scaled, F.col("url")),
        width=F.col("width"), height=F.col("height"), source=F.lit(source),
        title=opt(clean_text(F.regexp_replace("title", "^File:", ""), 160)),
        credit=F.coalesce(opt(strip_tags_short(F.col("artist"))), opt(strip_tags_short(F.col("credit")))),
        license=opt(strip_tags_short(F.col("license"))), source_page=F.col("descriptionurl"),
    )


def flickr_photos(rows: DataFrame, min_width: int = dims.HD_WIDTH) -> DataFrame:
    """Largest rendition of each photo; below the width floor it is dropped."""
    sizes = [F.when(opt(F.col(f"url_{s}")).isNotNull(), F.struct(F.col(f"url_{s}").alias("url"), F.col(f"width_{s}").alias("width"),
             F.col(f"height_{s}").alias("height"))) for s in "okhb"]
    best = rows.withColumn("best", F.coalesce(*sizes)).where(F.coalesce(F.col("best.width"), F.lit(0)) >= min_width)
    pairs = [x for k, v in dims.FLICKR_LICENSES.items() for x in (F.lit(k), F.lit(v))]
    return _photo(
        best, place_id=F.col("place_id"), ord=F.col("ord"), url=F.col("best.url"), download_url=F.col("best.url"),
        thumb_url=F.coalesce(F.col("url_b"), F.col("best.url")), width=F.col("best.width"), height=F.col("best.height"),
        source=F.lit("flickr"), title=F.coalesce(opt(clean_text(F.col("title"), 160)), F.concat_ws(", ", "place_name", "city")),
        credit=opt(clean_text(F.col("ownername"), 120)),
        license=F.coalesce(F.create_map(*pairs)[F.col("license")], F.lit("Creative Commons")),
        source_page=F.concat(F.lit("https://www.flickr.com/photos/"), F.coalesce("ownername", F.lit("")), F.lit("/"), F.col("id")),
    )


def europeana_photos(rows: DataFrame) -> DataFrame:
    first = lambda c: F.try_element_at(F.col(c), F.lit(1))
    return _photo(
        rows.where(opt(first("edmIsShownBy")).isNotNull()), place_id=F.col("place_id"), ord=F.col("ord"),
        url=first("edmIsShownBy"), download_url=first("edmIsShownBy"), thumb_url=F.coalesce(first("edmPreview"), first("edmIsShownBy")),
        source=F.lit("europeana"), title=F.coalesce(opt(clean_text(first("title"), 160)), F.col("place_name")),
        credit=opt(clean_text(first("dataProvider"), 120)),
        license=F.coalesce(opt(clean_text(first("rights"), 160)), F.lit("Europeana (open reuse)")), source_page=F.col("guid"),
    )


def openverse_photos(rows: DataFrame) -> DataFrame:
    from placemill.operators.photos import allowed_image_url

    return _photo(
        rows.where(allowed_image_url(F.col("url"))), place_id=F.col("place_id"), ord=F.col("ord"), url=F.col("url"),
        download_url=F.col("url"), thumb_url=F.coalesce(F.col("thumbnail"), F.col("url")), width=F.col("width"),
        height=F.col("height"), source=F.lit("openverse"), title=opt(clean_text(F.col("title"), 160)),
        credit=opt(clean_text(F.col("creator"), 160)),
        license=opt(F.concat_ws(" ", opt(F.upper("license")), opt(F.col("license_version")))),
        source_page=F.col("foreign_landing_url"),
    )


def unsplash_photos(rows: DataFrame) -> DataFrame:
    sized = lambda w, q: F.concat("raw", F.lit(f"&w={w}&fit=max&fm=jpg&q={q}"))
    return _photo(
        rows, place_id=F.col("place_id"), ord=F.col("ord"), url=sized(2560, 90), download_url=sized(2560, 95), thumb_url=sized(640, 80),
        width=F.least(F.col("width"), F.lit(2560)), height=F.col("height"), source=F.lit("unsplash"),
        title=opt(clean_text(F.coalesce("description", "alt_description"), 160)),
        credit=F.concat("user_name", F.lit(" on Unsplash")), license=F.lit("Unsplash License"), source_page=F.col("html_link"),
    )


def google_photos(details: DataFrame, base_url: str, per_place: int = dims.IMAGES_PER_PLACE) -> DataFrame:
    """Photo references of a place, the first ``per_place`` of those that have one."""
    valid = F.slice(F.filter("photos", lambda p: opt(p["photo_reference"]).isNotNull()), 1, per_place)
    rows = details.select("place_id", "name", F.posexplode(valid).alias("at", "p"))
    link = lambda w: F.concat(F.lit(f"{base_url}/api/google-photo?ref="), percent_encode(F.col("p.photo_reference")), F.lit(f"&w={w}"))
    credit = opt(clean_text(F.regexp_replace(F.try_element_at(F.col("p.html_attributions"), F.lit(1)), "<[^>]+>", ""), 160))
    return _photo(
        rows, place_id=F.concat(F.lit("google/"), "place_id"), ord=F.col("at"), url=link(1200), download_url=link(dims.HD_WIDTH),
        thumb_url=link(480), width=F.col("p.width"), height=F.col("p.height"), source=F.lit("google"),
        title=F.concat("name", F.lit(" ("), (F.col("at") + 1).cast("string"), F.lit(")")), credit=credit,
        license=F.lit("Google Maps user content"),
    )


def union_all(*frames: DataFrame) -> DataFrame:
    """Sources under one schema; an absent source counts as empty."""
    given = [f for f in frames if f is not None]
    out = given[0]
    for frame in given[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


# --- sheet of regions --------------------------------------------------------

def _sheet_records(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records of whole CSV files with all their cells; records without text are left out."""
    csv.field_size_limit(2**31 - 1)
    for frame in frames:
        for text in frame["value"]:
            rows = ([c.replace("\r", "").strip() for c in row] for row in csv.reader(io.StringIO(text, newline="")))
            cells = [row for row in rows if any(row)]
            yield pd.DataFrame({"first": [i == 0 for i in range(len(cells))], "cells": cells})


def read_targets_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Quoted, possibly multi-line CSV to rows (ord, country, city, province, attribute, path, cells, has_header).

    Records may be wider than the header. Only the header row comes to the driver;
    it is skipped where it opens a file, not where a later record repeats it.
    ``cells`` holds the cells that may carry links. A quoted record can hold line
    ends, so a file is read by one task.
    """
    rows = spark.read.text(path, wholetext=True).mapInPandas(_sheet_records, "first boolean, cells array<string>")
    rows = rows.withColumn("ord", F.monotonically_increasing_id())
    head = rows.where("first").orderBy("ord").limit(1).collect()
    header = [c.lower() for c in head[0]["cells"]] if head else []
    at = locate_columns(header)
    has_header = any(at[k] is not None for k in ("country", "city", "province"))
    if has_header:
        same = F.transform("cells", F.lower) == F.array(*map(F.lit, header))
        rows = rows.where(~(F.col("first") & same))
    else:
        at.update(country=0, city=1)
    pick = lambda k: opt(F.get("cells", F.lit(at[k]))) if at[k] is not None else F.lit(None).cast("string")
    named = [at[k] for k in ("city", "province") if at[k] is not None]
    links = F.filter("cells", lambda _, i: ~i.isin(named)) if named else F.col("cells")
    return rows.select(
        "ord", pick("country").alias("country"), pick("city").alias("city"), pick("province").alias("province"),
        pick("attribute").alias("attributes"), pick("path").alias("path"), links.alias("cells"), F.lit(has_header).alias("has_header"),
    )


# How a column is recognised, exact names first.
COLUMN_PATTERNS = {
    "country": ["^country$", "country"], "city": ["^city$", "city"], "province": ["province|state"],
    "attribute": ["attribute"], "path": ["^path$", "path|folder|destination"],
}


def locate_columns(header: list[str]) -> dict[str, int | None]:
    import re

    def first(patterns: list[str]) -> int | None:
        hits = (i for p in patterns for i, cell in enumerate(header) if re.search(p, cell))
        return next(hits, None)

    return {key: first(patterns) for key, patterns in COLUMN_PATTERNS.items()}
