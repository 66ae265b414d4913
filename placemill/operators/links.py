"""Outbound search links of a place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemill import dims
from placemill.functions.text import opt, percent_encode, trimmed, WHITE


def search_term(name: Column, city: Column) -> Column:
    return trimmed(F.regexp_replace(F.concat_ws(" ", opt(name), opt(city)), f"{WHITE}+", " "))


def travel_links(
    places: DataFrame, providers: list[str] | None = None, tags: dict[str, str] | None = None, storefront: str = "www.trip.com"
) -> DataFrame:
    """One row per place and provider; regional providers only in their countries, no links without a query.

    The provider list is a fixed array in the plan, so this is a projection and not a join.
    """
    enabled = dims.DEFAULT_PROVIDERS if providers is None else providers
    known = []
    for pos, (pid, label, kind, url, countries, generic) in enumerate(p for p in dims.PROVIDERS if p[0] in enabled):
        known.append(F.struct(
            F.lit(pos).alias("pos"), F.lit(pid).alias("id"), F.lit(label).alias("label"), F.lit(kind).alias("kind"),
            F.lit(url.replace("www.trip.com", storefront)).alias("base"),
            (F.array(*[F.lit(c) for c in countries]) if countries else F.expr("cast(null as array<string>)")).alias("countries"),
            F.lit(generic).alias("generic"), F.lit((tags or {}).get(pid)).cast("string").alias("affiliate"),
        ))
    country = F.upper("country_code")
    rows = places.withColumn("term", search_term(F.col("name"), F.col("city"))).where(F.col("term") != "")
    offered = F.filter(
        F.array(*known), lambda p: p["countries"].isNull() | F.coalesce(F.array_contains(p["countries"], country), F.lit(False))
    )
    rows = rows.withColumn("p", F.explode(offered))
    url = F.when(F.col("p.generic"), F.col("p.base")).otherwise(F.concat(F.col("p.base"), percent_encode(F.col("term"))))
    joint = F.when(url.contains("?"), "&").otherwise("?")
    tagged = F.when(F.col("p.affiliate").isNotNull(), F.concat(url, joint, F.col("p.affiliate"))).otherwise(url)
    return rows.select(
        "ord", F.col("p.pos").alias("pos"), F.col("p.id").alias("id"), F.col("p.label").alias("label"),
        F.col("p.kind").alias("kind"), tagged.alias("url"), F.col("p.generic").alias("generic"),
    )
