"""Exports as tables: folder names, manifest rows, listings and the run report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placemill import dims
from placemill.functions.text import sanitize_path_segment
from placemill.operators.photos import allowed_image_url
from placemill.operators.rank import number_rows, top_k


def unique_names(df: DataFrame, keys: list[str], name: str = "name", ord_col: str = "ord", out: str = "unique_name") -> DataFrame:
    """A second same-named row (without case) gets `` (2)``, a third `` (3)``."""
    rows = number_rows(df.withColumn("_key", F.lower(F.col(name))), [*keys, "_key"], [], ord_col, "_nth")
    numbered = F.concat(F.col(name), F.lit(" ("), F.col("_nth").cast("string"), F.lit(")"))
    return rows.withColumn(out, F.when(F.col("_nth") > 1, numbered).otherwise(F.col(name))).drop("_key", "_nth")


def file_names(photos: DataFrame, per_place: int = dims.MAX_IMAGES_PER_PLACE, keys: tuple[str, ...] = ("place_id",)) -> DataFrame:
    """``base_name`` plus a two-digit number for the first pictures of each place, counted per ``keys``."""
    first = top_k(photos, list(keys), [F.col("ord")], per_place, out="n")
    number = F.when(F.col("n") < 10, F.concat(F.lit("0"), F.col("n").cast("string"))).otherwise(F.col("n").cast("string"))
    return first.withColumn("file_name", F.concat("base_name", F.lit("_"), number, F.lit(".jpeg")))


def export_manifest(
    places: DataFrame, photos: DataFrame, max_places: int = dims.MAX_RESULTS, *, ascii_only: bool = False
) -> DataFrame:
    """One row per file: a document and its pictures per place, a summary per city.

    ``places``: country, city, ord, place_id, osm_id, name; ``photos``: place_id, ord, url.
    A city is its folder: cities whose names clean up to one folder share it, its
    numbering and its bound. A city of more than ``max_places`` places is cut; a row of
    kind ``note`` without a path then says so in ``note``, which is null elsewhere.
    """
    seg = lambda c, fallback: sanitize_path_segment(c, fallback, ascii_only=ascii_only)
    city = ["country_dir", "city_dir"]
    placed = places.withColumn("country_dir", seg(F.col("country"), "Unknown Country")).withColumn("city_dir", seg(F.col("city"), "Unknown City"))
    rows = top_k(placed, city, [F.col("ord")], max_places, out="place_no")
    safe = seg(F.col("name"), F.concat(F.lit("place-"), F.col("osm_id").cast("string")))
    rows = unique_names(rows.withColumn("_safe", safe), city, "_safe", "ord", "base_name").drop("_safe")
    rows = rows.withColumn("folder", F.concat_ws("/", *city, "base_name"))
    head = [*city, "place_id"]
    nobody, silent = F.lit(None).cast(places.schema["place_id"].dataType).alias("place_id"), F.lit(None).cast("string")
    documents = rows.select(*head, F.lit("document").alias("kind"), F.concat("folder", F.lit("/"), "base_name", F.lit("_details.pdf")).alias("path"), silent.alias("note"))
    named = file_names(photos.where(allowed_image_url(F.col("url"))).join(rows.select(*head, "folder", "base_name"), "place_id"), keys=tuple(head))
    pictures = named.select(*head, F.lit("picture").alias("kind"), F.concat("folder", F.lit("/"), "file_name").alias("path"), silent.alias("note"))
    sizes = placed.groupBy(*city).agg(F.count(F.lit(1)).alias("n"))
    summaries = sizes.select(*city, nobody, F.lit("summary").alias("kind"), F.concat_ws("/", *city, F.lit("_search-summary.pdf")).alias("path"), silent.alias("note"))
    said = F.format_string(f"Only the first {max_places} of %d places were included.", "n")
    notes = sizes.where(F.col("n") > max_places).select(*city, nobody, F.lit("note").alias("kind"), silent.alias("path"), said.alias("note"))
    return documents.unionByName(pictures).unionByName(summaries).unionByName(notes)


def summary_listing(places: DataFrame) -> DataFrame:
    """Numbered lines of a search's places in result order."""
    rows = number_rows(places, ["search_id"], [], "ord", "n")
    spot = F.format_string("%s · %.5f, %.5f", "category_label", "lat", "lon")
    return rows.select("search_id", "n", F.concat(F.col("n").cast("string"), F.lit(". "), "display_name").alias("line"), spot.alias("detail"))


def report_lines(outcomes: DataFrame) -> DataFrame:
    """Status lines of a run; ``outcomes``: region_ord, region, country, status, place_count, duplicates_skipped, error."""
    count = F.concat(F.coalesce("place_count", F.lit(0)).cast("string"), F.lit(" place(s)"))
    skipped = F.when(F.col("duplicates_skipped") > 0, F.concat(F.lit(", "), F.col("duplicates_skipped").cast("string"), F.lit(" duplicate(s) skipped"))).otherwise("")
    detail = F.coalesce(F.col("error"), F.when(F.col("status") == "skipped", "already exported").otherwise(F.concat(count, skipped)))
    line = F.concat(F.rpad("status", 9, " "), F.lit(" "), "region", F.lit(", "), "country", F.lit(" — "), detail)
    return outcomes.select(F.col("region_ord").cast("bigint").alias("ord"), line.alias("line"))


def report_total(claimed: DataFrame) -> DataFrame:
    total = claimed.agg(F.count_distinct("place_id").alias("n"))
    return total.select(F.lit(2**62).alias("ord"), F.concat(F.lit("Unique places exported: "), F.col("n").cast("string")).alias("line"))


def run_report(outcomes: DataFrame, claimed: DataFrame) -> DataFrame:
    return report_lines(outcomes).unionByName(report_total(claimed))
