"""Ranks and cuts of candidates and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemill import dims
from placemill.functions.tags import information_score
from placemill.operators.rank import number_in_order, number_rows, top_k


def with_information_score(places: DataFrame) -> DataFrame:
    return places.withColumn("score", information_score(F.col("tags"), F.col("osm_type")))


def rank_candidates(places: DataFrame, out: str = "candidate_rank") -> DataFrame:
    """Position of every candidate of a search: richest first, then arrival."""
    return number_rows(places, ["search_id"], ["-score"], "ord", out)


def arrival_order(df: DataFrame) -> list[Column]:
    """Merged records arrive by their bucket, then by the first record folded into them."""
    return [F.col("bucket_ord"), F.col("first_ord")] if "bucket_ord" in df.columns else [F.col("ord")]


def cut_candidates(places: DataFrame, limit: int = dims.MAX_RESULTS) -> DataFrame:
    """The first ceil(limit * 1.8) candidates of every search."""
    keep = -(-limit * 18 // 10)
    return top_k(places, ["search_id"], [F.col("score").desc(), *arrival_order(places)], keep, out="candidate_rank")


def cut_results(places: DataFrame, limit: int = dims.MAX_RESULTS, arrival: str = "candidate_rank") -> DataFrame:
    """Best quality first, unscored last, at most ``limit`` per search."""
    return top_k(places, ["search_id"], [F.coalesce("quality", F.lit(0)).desc(), F.col(arrival)], limit, out="place_rank")


def fetch_size(source: str, limit: int) -> int:
    """Rows a discovery source is asked for."""
    return {"overpass": min(3000, max(6 * limit, 150)), "wikidata": min(3 * limit, 120), "nominatim": min(limit, 40)}[source]


def first_fetched(records: DataFrame, source: str, limit: int) -> DataFrame:
    """A source's first rows of each search."""
    return top_k(records, ["search_id"], [F.col("ord")], fetch_size(source, limit), out="fetch_rank").drop("fetch_rank")


def over_fetch(records: DataFrame, limit: int) -> DataFrame:
    """Each source's first rows of a search, as many as that source is asked for."""
    parts = [first_fetched(records.where(F.col("source") == s), s, limit) for s in ("overpass", "wikidata", "nominatim")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def first_pages(found: DataFrame, limit: int, page_rows: int = 20, pages: int = 3) -> DataFrame:
    """At most ``pages`` result pages of a search, then cut to its limit."""
    return top_k(found, ["search_id"], [F.col("ord")], min(page_rows * pages, limit), out="rn")


def order_results(places: DataFrame, by: str, out: str = "result_no") -> DataFrame:
    """Each search's places numbered by quality, name (language-aware) or image_count, ties by ``ord``."""
    keys = {
        "quality": F.col("quality").desc(), "name": F.collate("name", "UNICODE").asc(), "image_count": F.col("image_count").desc(),
    }
    return number_in_order(places, ["search_id"], [keys[by], F.col("ord").asc()], out)
