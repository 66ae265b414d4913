"""Run counters and quality measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placemill.functions import hours
from placemill.functions.text import has_residual_script, is_mostly_non_latin, percent
from placemill.operators.rank import next_value, value_at


def search_stats(raw: DataFrame, deduped: DataFrame, kept: DataFrame, photos: DataFrame) -> DataFrame:
    """Rows per search at each stage; every stage is one map-side count.

    The stages are read several times, so they should be stored tables.
    """
    count = lambda df, name: df.groupBy("search_id").agg(F.count(F.lit(1)).alias(name))
    pictured = kept.join(photos.select("place_id").distinct(), "place_id", "left_semi")
    out = count(raw, "raw_count")
    for df, name in ((deduped, "after_dedupe"), (kept, "after_filter"), (pictured, "with_images")):
        out = out.join(count(df, name), "search_id", "left")
    zero = {c: 0 for c in ("after_dedupe", "after_filter", "with_images")}
    return out.fillna(zero)


def extra_source_gain(raw: DataFrame, deduped: DataFrame, first_source: DataFrame) -> DataFrame:
    """How many places the further sources added beyond the first one's own deduplicated rows."""
    count = lambda df, name: df.groupBy("search_id").agg(F.count(F.lit(1)).alias(name))
    rows = count(raw, "found").join(count(deduped, "total"), "search_id", "left").join(count(first_source, "first"), "search_id", "left")
    gain = F.coalesce("total", F.lit(0)) - F.coalesce("first", F.lit(0))
    note = F.when(gain > 0, F.concat(gain.cast("string"), F.lit(" additional place(s) came from Wikidata/Nominatim rather than OpenStreetMap.")))
    return rows.select("search_id", gain.alias("gain"), note.alias("warning"))


def dropped_counts(found: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows a mapping dropped, per search."""
    a = found.groupBy("search_id").agg(F.count(F.lit(1)).alias("found"))
    b = kept.groupBy("search_id").agg(F.count(F.lit(1)).alias("kept"))
    return a.join(b, "search_id", "left").select("search_id", (F.col("found") - F.coalesce("kept", F.lit(0))).alias("dropped"))


def name_quality(rows: DataFrame, span: int = 100_000) -> DataFrame:
    """``rows``: ord, original, name. One row of counts over the names that needed translation."""
    needing = rows.where(is_mostly_non_latin(F.col("original"))).withColumn("changed", F.col("name") != F.col("original"))
    changed = F.col("changed")
    base = needing.agg(
        F.count(F.lit(1)).alias("needing"), F.count_if(changed).alias("translated"),
        F.count_if(changed & has_residual_script(F.col("name"))).alias("residual_script"),
        F.count_if(changed & F.col("name").contains(F.col("original"))).alias("echoed_original"),
        F.count_if(changed & (F.length(F.regexp_replace("name", "[^A-Za-z]", "")) < 3)).alias("too_short"),
    )
    named = needing.where(changed).withColumn("key", F.lower("name"))
    following = next_value(named, ["key"], ["ord"], "original", "_next", F.floor(F.col("ord") / span))
    collisions = following.agg(F.count_if(F.col("_next") != F.col("original")).alias("collisions"))
    names = ["needing", "translated", "residual_script", "echoed_original", "too_short", "collisions"]
    return base.unionByName(collisions, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in names])


def filter_quality(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows``: keys, original_name, name, keep, llm_processed, summary, tag."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("scored"), F.count_if(~F.col("keep")).alias("dropped"),
        F.count_if("llm_processed").alias("llm_processed"), F.count_if(F.trim(F.coalesce("summary", F.lit(""))) == "").alias("empty_summary"),
        F.count_if(~is_mostly_non_latin(F.col("original_name")) & is_mostly_non_latin(F.col("name"))).alias("renamed_to_non_latin"),
        F.count_if((F.coalesce("tag", F.lit("")) == "") & hours.claims_hours(F.col("summary"))).alias("hours_without_source"),
    )


SECTION_COLUMNS = ["history", "architecture", "context", "visiting", "practical"]


def article_quality(rows: DataFrame) -> DataFrame:
    """``rows``: overview, sections, highlights, llm_generated, redactions."""
    texts = ["overview", *[s for s in SECTION_COLUMNS if s in rows.columns]]
    everything = F.concat_ws(" ", *texts, F.array_join("highlights", " "))
    measured = rows.withColumn("_all", everything)
    return measured.agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if("llm_generated").alias("generated"), F.count_if(~F.col("llm_generated")).alias("fell_back"),
        F.count_if(F.length(F.trim(F.coalesce("overview", F.lit("")))) < 40).alias("thin_overview"),
        F.count_if(has_residual_script(F.col("_all"))).alias("residual_script"),
        F.sum(F.size("redactions")).alias("redactions"),
    )


def section_fill(rows: DataFrame) -> DataFrame:
    """(section, filled, rate): over 20 characters, or three highlights; counted in one pass, then unpivoted."""
    sections = [s for s in SECTION_COLUMNS if s in rows.columns]
    counts = [F.count_if(F.length(F.trim(F.coalesce(F.col(s), F.lit("")))) > 20).alias(s) for s in sections]
    counts += [F.count_if(F.size("highlights") >= 3).alias("highlights"), F.count(F.lit(1)).alias("_total")]
    one = rows.agg(*counts)
    return one.unpivot(["_total"], [*sections, "highlights"], "section", "filled").select(
        "section", "filled", percent(F.col("filled"), F.col("_total")).alias("rate")
    )


def upper_median(rows: DataFrame, keys: list[str], value: str, out: str = "upper_median") -> DataFrame:
    """sorted[floor(n/2)] of each key, from a histogram of the distinct values that no task holds whole."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_times"))
    return value_at(counts, keys, value, "_times", F.floor(F.col("_total") / 2) + 1, out)


def duplicate_totals(merged: DataFrame) -> DataFrame:
    """Groups, near-duplicates merged, and a note per search that had any."""
    return merged.groupBy("search_id").agg(F.sum(F.col("merged") - 1).alias("merged")).withColumn(
        "note", F.when(F.col("merged") > 0, F.concat(F.lit("Merged "), F.col("merged").cast("string"), F.lit(" near-duplicate place name(s).")))
    )


def duplicate_summary(totals: DataFrame, most_notes: int = 5) -> DataFrame:
    """One row over all groups of ``duplicate_totals``: groups, places merged, and the first notes in order of search."""
    first = totals.where(F.col("note").isNotNull()).orderBy("search_id").limit(most_notes)
    notes = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("search_id", "note"))), lambda n: n["note"]).alias("notes"))
    return totals.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("merged"), F.lit(0)).alias("merged")).join(notes)


def progress_totals(rows: DataFrame) -> DataFrame:
    """Run progress over region rows (status, place_count)."""
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status").isin("done", "skipped", "failed")).alias("finished"),
        F.count_if(F.col("status") == "failed").alias("failed"), F.coalesce(F.sum("place_count"), F.lit(0)).alias("places"),
    )


def region_outcomes(found: DataFrame, claimed: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """(region_ord, place_count, duplicates_skipped, status, note): how each region ended.

    ``regions`` (region_ord, region, and where known ``error`` and ``skipped``) adds the
    regions that found nothing: one with an error has failed, one skipped was not
    searched, all others are done. The note says why a region has nothing to write, or
    how many places other regions had already. Without ``regions`` only those that found places are
    listed, without notes.
    """
    total = found.groupBy("region_ord").agg(F.count_distinct("place_id").alias("matches"))
    fresh = claimed.groupBy("region_ord").agg(F.count(F.lit(1)).alias("place_count"))
    rows = total.join(fresh, "region_ord", "left")
    if regions is not None:
        rows = regions.join(rows, "region_ord", "left")
    rows = rows.fillna({"place_count": 0, "matches": 0}).withColumn("duplicates_skipped", F.col("matches") - F.col("place_count"))
    known = lambda c, none: F.col(c) if c in rows.columns else F.lit(none)
    status = F.when(known("error", None).isNotNull(), "failed").when(F.coalesce(known("skipped", False), F.lit(False)), "skipped").otherwise("done")
    said = F.when(F.col("duplicates_skipped") > 0, F.when(F.col("place_count") == 0, "every match was already exported elsewhere; nothing new to write.").otherwise(
        F.concat(F.lit("skipped "), F.col("duplicates_skipped").cast("string"), F.lit(" place(s) already exported for another region in this run."))
    )).when(F.col("place_count") == 0, "no matching places found; nothing exported.")
    note = F.when(status == "done", F.concat(known("region", None), F.lit(": "), said))
    kept = [c for c in ("region", "country", "error") if regions is not None and c in regions.columns]
    return rows.select("region_ord", *kept, "place_count", "duplicates_skipped", status.alias("status"), note.alias("note"))


def result_bounds(places: DataFrame, areas: DataFrame | None = None, pad: float = 0.02) -> DataFrame:
    """Padded box around each search's places, or its area's box when it has none."""
    box = places.groupBy("search_id").agg(
        F.min("lat").alias("south"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.max("lon").alias("east")
    )
    if areas is not None:
        a = areas.select("search_id", *[F.col(c).alias(f"_{c}") for c in ("south", "west", "north", "east")])
        box = a.join(box, "search_id", "left").select("search_id", *[F.coalesce(c, f"_{c}").alias(c) for c in ("south", "west", "north", "east")])
    return box.select(
        "search_id", (F.col("south") - pad).alias("south"), (F.col("west") - pad).alias("west"),
        (F.col("north") + pad).alias("north"), (F.col("east") + pad).alias("east"),
    )


def count_by(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def stage_durations(progress: DataFrame) -> DataFrame:
    """Microseconds from each event to the next of the same id; ten minutes per span."""
    from placemill.operators.store import SPAN_US, epoch_us

    rows = progress.withColumn("us", epoch_us(F.col("ts")))
    timed = next_value(rows, ["id"], ["us", "ord"], "us", "_next", F.floor(F.col("us") / SPAN_US))
    return timed.withColumn("duration_us", F.col("_next") - F.col("us")).drop("_next", "us")
