"""Stored responses joined back to the places they describe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemill.functions import hours, responses as rs, tags as tg
from placemill.functions.text import bind, clean_text, first_of, is_mostly_non_latin, is_safe_http_url
from placemill.operators.resolve import drop_collisions


def heuristic_rows(places: DataFrame) -> DataFrame:
    """Rule-based result of every place; needs ``city`` and ``country``."""
    df, t = tg.promote(places, tg.RULE_TAGS)
    return tg.demote(df.withColumns({
        "keep": F.length("name") > 1,
        "summary": tg.heuristic_summary(F.col("name"), F.col("category_label"), F.col("city"), F.col("country"), t),
        "contact": tg.extract_contact(t),
        "quality": tg.heuristic_score(t, F.col("osm_type")),
        "llm_processed": F.lit(False),
    }))


def completions_to_records(completions: DataFrame, keys: list[str]) -> DataFrame:
    """One row per valid record: keys, position, number of records in the response, fields."""
    parsed = completions.withColumn("records", rs.valid_records(F.col("raw")))
    rows = parsed.select(*keys, F.size("records").alias("record_count"), F.posexplode("records").alias("position", "r"))
    return rows.select(*keys, "record_count", "position", "r")


def records_to_places(records: DataFrame, batches: DataFrame, keys: list[str]) -> DataFrame:
    """The last record that names each place: by its index, or by position when the counts agree.

    ``batches``: keys, batch_pos, place columns. The batch size is the row count of the keys.
    """
    sizes = batches.groupBy(*keys).agg(F.count(F.lit(1)).alias("batch_size"))
    index = F.coalesce(F.col("r.i"), F.when(F.col("record_count") == F.col("batch_size"), F.col("position")))
    placed = records.join(sizes, keys).withColumn("batch_pos", index.cast("bigint")).where(F.col("batch_pos").isNotNull())
    last = placed.groupBy(*keys, "batch_pos").agg(F.max_by("r", "position").alias("r"))
    return batches.join(last, [*keys, "batch_pos"])


def readable_name(candidate: Column, fallback: Column) -> Column:
    """The candidate, unless empty or a step back from a readable name."""

    def choose(c: Column) -> Column:
        undone = is_mostly_non_latin(c) & ~is_mostly_non_latin(fallback)
        return F.when((c != "") & ~undone, c).otherwise(fallback)

    return bind(candidate, choose)


def merge_responses(rows: DataFrame) -> DataFrame:
    """Heuristic rows with an optional record ``r``: tags win contacts, unsupported hours go, gaps are filled."""
    r, had = F.col("r"), F.col("r").isNotNull()
    checked = hours.strip_unsupported_hours(clean_text(r["summary"], 1200), F.col("tags")["opening_hours"])
    site = clean_text(r["website"], 500)
    told = lambda field, n: first_of(clean_text(r[field], n))
    c = F.col("contact")
    contact = F.struct(
        F.coalesce(c["phone"], told("phone", 120)).alias("phone"),
        F.coalesce(c["email"], told("email", 160)).alias("email"),
        F.coalesce(c["website"], F.try_element_at(F.filter(F.array(site), is_safe_http_url), F.lit(1))).alias("website"),
        F.coalesce(c["address"], told("address", 400)).alias("address"),
        c["opening_hours"].alias("opening_hours"),
    )
    return rows.withColumns({
        "_fallback_keep": F.col("keep"),
        "keep": F.when(had, rs.should_keep(r)).otherwise(F.col("keep")),
        "enriched_name": F.when(had, readable_name(clean_text(r["name"], 200), F.col("name"))).otherwise(F.col("name")),
        "summary": F.when(had, first_of(checked["kept"], F.col("summary"))).otherwise(F.col("summary")),
        "contact": F.when(had, contact).otherwise(c),
        "quality": F.when(had, F.floor(r["score"] + 0.5).cast("int")).otherwise(F.col("quality")),
        "llm_processed": had,
        "reason": F.when(had, first_of(clean_text(r["reason"], 300))),
    }).drop("r")


def guard_all_rejected(rows: DataFrame, key: str = "search_id") -> DataFrame:
    """If nothing of a search survives, its rule-based keep flags come back."""
    any_kept = rows.groupBy(key).agg(F.max("keep").alias("_any"))
    return rows.join(any_kept, key).withColumn("keep", F.when(F.col("_any"), F.col("keep")).otherwise(F.col("_fallback_keep"))).drop("_any", "_fallback_keep")


def enrich(places: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """Rule-based rows, responses merged over them, all-rejected guard. ``places`` carries keys and batch_pos."""
    base = heuristic_rows(places)
    found = records_to_places(records, places.select(*keys, "batch_pos"), keys)
    return guard_all_rejected(merge_responses(base.join(found, [*keys, "batch_pos"], "left")))


def keep_rows(places: DataFrame, enriched: DataFrame, on: list[str]) -> DataFrame:
    """Places whose enrichment does not reject them; a missing enrichment keeps the place."""
    flags = enriched.select(*on, F.col("keep").alias("_keep"))
    return places.join(flags, on, "left").where(F.coalesce("_keep", F.lit(True))).drop("_keep")


def final_name(enriched: Column, name: Column) -> Column:
    return readable_name(F.coalesce(enriched, F.lit("")), name)


def translations(completions: DataFrame, keys: list[str], sizes: DataFrame | None = None) -> DataFrame:
    """(keys, number, name) of the usable, unrepeated answers of each numbered list.

    ``sizes`` (keys, batch_size) bounds the numbers: one outside its batch answers
    nothing, and repeats of its text do not count.
    """
    rows = completions.select(*keys, F.posexplode(rs.parse_numbered_list(F.col("raw"))).alias("line", "e"))
    named = rows.select(*keys, "line", F.col("e.number").alias("number"), rs.translated_name(F.col("e.text")).alias("name"))
    named = named.where(F.col("name").isNotNull() & (F.col("number") >= 1))
    if sizes is not None:
        named = named.join(sizes, keys).where(F.col("number") <= F.col("batch_size")).drop("batch_size")
    once = drop_collisions(named, keys)
    return once.groupBy(*keys, "number").agg(F.max_by("name", "line").alias("name"))


def parse_articles(completions: DataFrame, keys: list[str]) -> DataFrame:
    """Article columns of each response whose text holds an object; others drop out."""
    obj = completions.withColumn("o", rs.object_text(F.col("raw"))).where(F.col("o").isNotNull())
    field = lambda f: rs.json_field(F.col("o"), f)
    text = lambda f: F.coalesce(rs.to_prose(field(f)), F.lit("")).alias(f)
    return obj.select(
        *keys, *[text(f) for f in ("overview", "history", "architecture", "context", "visiting", "practical")],
        F.slice(F.coalesce(rs.to_bullets(field("highlights")), F.expr("cast(array() as array<string>)")), 1, 8).alias("highlights"),
    )
