"""All searches of a run as one lazy chain: resolve, select, merge, name, enrich, rank, picture."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placemill import dims
from placemill.functions import tags as tg
from placemill.operators import content, links, photos as ph, quality, resolve, responses, score, select
from placemill.operators.rank import batch_ids, number_rows
from placemill.session import cut
from placemill.sources.readers import osm_places, union_all


@dataclass(frozen=True)
class Settings:
    limit: int = dims.MAX_RESULTS
    batch_rows: int = 5
    per_place: int = dims.IMAGES_PER_PLACE
    cosine: float = dims.DUPLICATE_COSINE
    providers: tuple[str, ...] = tuple(dims.DEFAULT_PROVIDERS)


# Source blocks arrive one after the other; a block never holds this many rows of one search.
BLOCK = 2**40


def arrive(places: DataFrame, block: int, ord_col: str = "ord") -> DataFrame:
    return places.withColumn("ord", F.col(ord_col).cast("bigint") + block * BLOCK)


def union_discovered(osm: DataFrame, entities: DataFrame, gazetteer: DataFrame, limit: int) -> DataFrame:
    """Map records merged and sorted by richness first, then the two further sources, each cut to its fetch size.

    Each source is stored once: the merges read it for their size check and
    their fold, and the plan stays short.
    """
    osm, entities, gazetteer = (
        cut(score.first_fetched(df, name, limit))
        for df, name in ((osm, "overpass"), (entities, "wikidata"), (gazetteer, "nominatim"))
    )
    first = resolve.dedupe_places(osm)
    first = number_rows(first, ["search_id"], ["-score", "bucket_ord"], "first_ord", "_rank").drop("ord")
    first = cut(arrive(first, 0, "_rank").select(*osm.columns))
    return first.unionByName(arrive(entities, 1)).unionByName(arrive(gazetteer, 2))


def top_places(places: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` richest places of every search after merging duplicates."""
    merged = resolve.dedupe_places(places)
    return score.top_k(merged, ["search_id"], [F.col("score").desc(), *score.arrival_order(merged)], n, out="place_rank")


def candidates_of(searches: DataFrame, elements: DataFrame, entities: DataFrame, gazetteer: DataFrame, s: Settings) -> DataFrame:
    """Merged and ranked candidates of each search; ``searches``: search_id, keyword.

    Selectors test the raw elements, whose tags are a plain column, before names are derived.
    """
    asked = select.resolve_keyword(searches.select("search_id", "keyword"))
    entities, gazetteer = (df.join(searches.select("search_id"), "search_id", "left_semi") for df in (entities, gazetteer))
    wanted = cut(select.select_candidates(elements, asked))  # stored: the long filter is planned once
    osm = osm_places(wanted, F.col("label"), F.coalesce(F.try_element_at("categories", F.lit(1)), F.lit("custom")))
    found = union_discovered(osm, entities, gazetteer, s.limit)
    return score.cut_candidates(resolve.dedupe_places(found), s.limit)


def name_candidates(candidates: DataFrame, labels: DataFrame, answers: DataFrame | None, vectors: DataFrame | None, s: Settings) -> DataFrame:
    """Readable names, the second exact pass, and the vector pass where vectors are given."""
    cols = ["search_id", "ord", "id", "osm_type", "osm_id", "name", "lat", "lon", "tags", "category", "category_label", "source"]
    ordered = candidates.drop("ord").withColumn("ord", F.col("candidate_rank").cast("bigint"))
    named = content.apply_english_names(ordered.select(*cols), labels, answers)
    again = renumbered(resolve.dedupe_after_naming(named), ["bucket_ord"]).select(*cols)
    if vectors is None:
        return again
    with_vectors = again.join(vectors.select("id", "vector"), "id", "left")
    return renumbered(resolve.semantic_dedupe(with_vectors, s.cosine)).select(*cols)


def renumbered(merged: DataFrame, before: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """``ord`` anew after a merge: records keep the place of their first arrival, bucket by bucket where ``before`` says so."""
    rows = number_rows(merged, ["search_id"], list(before), "first_ord", "_at")
    return rows.drop("ord").withColumn("ord", F.col("_at").cast("bigint")).drop("_at")


def run_searches(
    searches: DataFrame, elements: DataFrame, entities: DataFrame, gazetteer: DataFrame, labels: DataFrame,
    completions: DataFrame | None = None, answers: DataFrame | None = None, vectors: DataFrame | None = None,
    photos: DataFrame | None = None, settings: Settings = Settings(),
) -> dict[str, DataFrame]:
    """Tables ``results``, ``pictures``, ``links`` and ``stats``.

    ``searches``: search_id, keyword, city, country, country_code; ``elements``: raw map elements;
    ``completions``: search_id, batch_no, raw. The merged candidates feed four branches, so they are checkpointed once.
    """
    s = settings
    candidates = cut(candidates_of(searches, elements, entities, gazetteer, s))
    named = cut(name_candidates(candidates, labels, answers, vectors, s))
    area = searches.select("search_id", "city", "country", "country_code")
    batched = batch_ids(named, ["search_id"], s.batch_rows).join(area, "search_id")
    keys = ["search_id", "batch_no"]
    if completions is None:
        enriched = responses.heuristic_rows(batched).withColumn("enriched_name", F.col("name"))
    else:
        enriched = responses.enrich(batched, responses.completions_to_records(completions, keys), keys)
    kept = score.cut_results(enriched.where("keep"), s.limit, arrival="ord")
    results = cut(kept.select(
        "search_id", F.col("id").alias("place_id"), "place_rank", "osm_type", "osm_id",
        responses.final_name(F.col("enriched_name"), F.col("name")).alias("name"), F.col("enriched_name").alias("link_name"),
        "lat", "lon", "tags", "category", "category_label", "source", "summary", "contact", "quality", "llm_processed",
        "city", "country", "country_code", tg.article_url(F.col("tags")["wikipedia"]).alias("article_url"),
        tg.entity_url(F.col("tags")["wikidata"]).alias("entity_url"), tg.osm_url(F.col("osm_type"), F.col("osm_id")).alias("osm_url"),
        tg.map_url(F.col("name"), F.col("lat"), F.col("lon")).alias("map_url"),
    ))
    out = {"results": results, "candidates": candidates}
    named_links = results.select(F.concat_ws("|", "search_id", "place_id").alias("ord"), F.col("link_name").alias("name"), "city", "country_code")
    out["links"] = links.travel_links(named_links, list(s.providers))
    if photos is not None:
        out["pictures"] = pictures_of(results, photos, s)
        raw = union_all(*[df.select("search_id") for df in (elements, entities, gazetteer)])
        out["stats"] = quality.search_stats(raw, candidates, results, out["pictures"])
    return out


def pictures_of(results: DataFrame, photos: DataFrame, s: Settings) -> DataFrame:
    """Sources poured in order, duplicates dropped, ranked and cut, each file claimed once per search."""
    ranked = results.select("search_id", "place_id", "place_rank")
    poured = ph.waterfall_union(photos.join(ranked.select("place_id").distinct(), "place_id", "left_semi"), s.per_place)
    first = ph.rank_images(ph.dedupe_images(poured, ["place_id"]), ["place_id"], s.per_place)
    return ph.claim_across_places(first.join(ranked, "place_id"), ["search_id"])
