"""Photos: what may be used, how near they are, which are the same, and which come first."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemill import dims
from placemill.functions import geo
from placemill.functions.text import host_of, opt, percent_decode
from placemill.operators.rank import first_per, top_k
from placemill.session import written


def allowed_image_url(url: Column) -> Column:
    """https on a known image host or a wiki host; the local photo proxy is let through."""
    host = host_of(url)
    known = host.isin(dims.ALLOWED_HOSTS) | host.endswith(".wikipedia.org") | host.endswith(".wikimedia.org")
    proxy = host.isin("localhost", "127.0.0.1") & url.rlike(r"(?i)^https?://[^/?#]+/api/google-photo([?#].*)?$")
    return F.coalesce((url.rlike("(?i)^https://") & known) | proxy, F.lit(False))


def filter_images(photos: DataFrame, min_flickr_width: int = dims.HD_WIDTH) -> DataFrame:
    return photos.where(
        (F.col("mime").isNull() | F.col("mime").isin(dims.ALLOWED_MIME))
        & allowed_image_url(F.col("url"))
        & ((F.col("source") != "flickr") | (F.coalesce("width", F.lit(0)) >= min_flickr_width))
    )


def is_furniture(title: Column) -> Column:
    """Icons, logos, flags and the like, or a format no photograph uses."""
    return title.rlike(r"(?i)\.(svg|gif)$") | title.rlike(f"(?i)({dims.FURNITURE_WORDS})")


def image_identity(url: Column) -> Column:
    """File name without query and thumbnail prefix, decoded, lower case."""
    path = F.regexp_extract(url, r"^([^?]*)", 1)
    name = percent_decode(F.regexp_extract(path, "([^/]*)$", 1))
    return F.lower(F.regexp_replace(name, "^[0-9]+px-", ""))


def title_stem(title: Column) -> Column:
    """Title without extension and trailing number, letters and digits only."""
    t = F.lower(F.coalesce(title, F.lit("")))
    t = F.regexp_replace(t, r"\.[a-z]{3,4}$", "")
    t = F.regexp_replace(t, r"[\s_-]*\(?[0-9]+\)?$", "")
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def dedupe_images(photos: DataFrame, keys: list[str]) -> DataFrame:
    """First of each file, then first of each title stem longer than 8 characters.

    First is by source where ``source_order`` tells it, then by ``ord``.
    """
    order = _arrival(photos)
    by_file = first_per(photos.withColumn("identity", image_identity(F.col("url"))), [*keys, "identity"], order)
    by_file = by_file.withColumn("stem", title_stem(F.col("title")))
    # Short stems are no key: each row then stands for itself.
    own = F.when(F.length("stem") > 8, F.concat(F.lit("t"), "stem")).otherwise(F.concat(F.lit("i"), "identity"))
    return first_per(by_file.withColumn("_stem", own), [*keys, "_stem"], order).drop("_stem")


def _arrival(photos: DataFrame) -> list[Column]:
    return [F.col(c) for c in ("source_order", "ord") if c in photos.columns]


def source_weight(source: Column) -> Column:
    pairs = [x for k, v in dims.SOURCE_WEIGHTS.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.create_map(*pairs)[source], F.lit(0))


def rank_images(photos: DataFrame, keys: list[str], per_place: int = dims.IMAGES_PER_PLACE) -> DataFrame:
    """Sharp pictures first, then the surer source, then the wider; at most ``per_place``."""
    width = F.coalesce("width", F.lit(0))
    ranked = photos.withColumn("hd", (width >= dims.HD_WIDTH).cast("int")).withColumn("weight", source_weight(F.col("source")))
    order = [F.col("hd").desc(), F.col("weight").desc(), width.desc(), *_arrival(photos)]
    if per_place > dims.MAX_IMAGES_PER_PLACE:
        raise ValueError(f"at most {dims.MAX_IMAGES_PER_PLACE} pictures per place")
    return top_k(ranked, keys, order, per_place, out="image_rank").drop("hd", "weight")


def claim_across_places(photos: DataFrame, keys: list[str]) -> DataFrame:
    """Pictures tied to a place by an explicit link stay; any other file appears once, with the best-ranked place.

    One aggregate per file says whether a link owns it and which row comes first;
    rows that equal the first one in rank and arrival are all kept.
    """
    photos = photos.withColumn("identity", image_identity(F.col("url")))
    explicit = F.coalesce(F.col("source").isin(dims.PLACE_SPECIFIC_SOURCES), F.lit(False))
    place = F.struct("place_rank", *_arrival(photos))
    file = [*keys, "_file"]
    photos = photos.withColumn("_file", F.coalesce("identity", F.lit("")))
    claims = photos.groupBy(*file).agg(F.max(explicit).alias("_owned"), F.min(place).alias("_first"))
    return photos.join(claims, file).where(explicit | (~F.col("_owned") & (place == F.col("_first")))).drop("_file", "_owned", "_first")


def waterfall_union(photos: DataFrame, per_place: int = dims.IMAGES_PER_PLACE) -> DataFrame:
    """Sources in order of certainty; one is used only while the place still lacks pictures.

    Counts per place and source (at most one row per source) decide how many
    pictures each source adds; the photos themselves are never gathered.
    """
    order = {name: i for i, (name, _, _) in enumerate(dims.WATERFALL)}
    places = [x for k, v in order.items() for x in (F.lit(k), F.lit(v))]
    rows = photos.withColumn("source_order", F.create_map(*places)[F.col("source")]).where(F.col("source_order").isNotNull())
    counts = rows.groupBy("place_id", "source_order").agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy("place_id").agg(F.map_from_entries(F.collect_list(F.struct("source_order", "n"))).alias("have"))
    acc = F.struct(F.lit(0).cast("bigint").alias("total"), F.expr("cast(array() as array<bigint>)").alias("takes"))
    for i, (_, factor, ceiling) in enumerate(dims.WATERFALL):
        acc = _pour(acc, F.coalesce(F.col("have")[F.lit(i)], F.lit(0)), factor, ceiling, per_place)
    takes = per.select("place_id", F.posexplode(acc["takes"]).alias("source_order", "take"))
    # A bounded source can add at most a fixed number of rows: cut to it before the join.
    bounds = {name: min(x for x in (ceiling, factor and factor * per_place) if x) for name, factor, ceiling in dims.WATERFALL if factor or ceiling}
    most = max(bounds.values())
    bounded = top_k(rows.where(F.col("source").isin(list(bounds))), ["place_id", "source_order"], [F.col("ord")], most, out="_rn")
    free = rows.where(~F.col("source").isin(list(bounds))).withColumn("_rn", F.lit(0))
    return (
        bounded.unionByName(free).join(takes, ["place_id", "source_order"])
        .where((F.col("take") > 0) & (F.col("_rn") <= F.col("take"))).drop("_rn", "take")
    )


def _pour(acc: Column, have: Column, factor: int | None, ceiling: int | None, per_place: int) -> Column:
    def step(a: Column) -> Column:
        missing = F.lit(per_place) - a["total"]
        caps = [have]
        if factor:
            caps.append(missing * factor)
        if ceiling:
            caps.append(F.lit(ceiling).cast("bigint"))
        take = F.when(missing > 0, F.least(*caps) if len(caps) > 1 else have).otherwise(F.lit(0).cast("bigint"))
        return F.transform(
            F.array(take), lambda t: F.struct((a["total"] + t).alias("total"), F.concat(a["takes"], F.array(t)).alias("takes"))
        )[0]

    return F.transform(F.array(acc), step)[0]


# Halvings of the ring in which photos are looked for: down to a few metres for a radius of one kilometre.
LEVELS = 9


def photos_near(places: DataFrame, photos: DataFrame, km: float = 1.0) -> DataFrame:
    """(place, photo, metres) within ``km`` (at most 10), by grid cell and exact distance.

    Cosines are taken once per row and side; pairs fail on the squared half-chord
    before the arc is computed.
    """
    metres = round(km * 1000)
    if metres > 10_000:
        raise ValueError("the radius is 10 km at most")
    row = geo.lat_cell(F.col("lat"), metres)
    placed = places.select(
        "place_id", F.radians("lat").alias("_lat"), F.radians("lon").alias("_lon"), F.cos(F.radians("lat")).alias("_cos"),
        F.explode(geo.neighbour_cells(F.col("lat"), F.col("lon"), metres)).alias("cell"),
    )
    placed = placed.select("place_id", "_lat", "_lon", "_cos", F.col("cell.row").alias("_row"), F.col("cell.col").alias("_col"))
    shot = photos.withColumns({
        "_row": row, "_col": geo.lon_cell(F.col("lon"), row, metres), "_plat": F.radians("lat"), "_plon": F.radians("lon"), "_pcos": F.cos(F.radians("lat")),
    })
    half = F.pow(F.sin((F.col("_plat") - F.col("_lat")) / 2), 2) + F.pow(F.sin((F.col("_plon") - F.col("_lon")) / 2), 2) * F.col("_cos") * F.col("_pcos")
    bound = math.sin(metres / (2 * geo.EARTH_M)) ** 2 * (1 + 1e-9)
    # Many meet many in a cell: both sides are shuffled by cell, where skewed cells can be split,
    # instead of tying the work to however the photos happen to be partitioned.
    near = placed.hint("merge").join(shot, ["_row", "_col"]).withColumn("_half", half).where(F.col("_half") <= bound)
    near = near.withColumn("metres", F.lit(2.0 * geo.EARTH_M) * F.asin(F.least(F.lit(1.0), F.sqrt("_half"))))
    return near.where(F.col("metres") <= metres).drop("_row", "_col", "_lat", "_lon", "_cos", "_plat", "_plon", "_pcos", "_half")


def photo_totals(places: DataFrame, photos: DataFrame, km: float = 1.0) -> DataFrame:
    """(place_id, n, photo_ids, metres): how many photos lie within ``km`` of each place that has any, the sum of their ids and of their distances.

    Photos at one spot are counted and places at one spot looked up once, so the
    pairs made are pairs of spots, however many rows lie on them.
    """
    piles = photos.groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("n"), F.sum("photo_id").alias("photo_ids"))
    spots = places.select("lat", "lon").distinct().withColumn("place_id", F.struct("lat", "lon"))
    near = photos_near(spots, piles, km).groupBy("place_id").agg(
        F.sum("n").alias("n"), F.sum("photo_ids").alias("photo_ids"), F.sum(F.col("metres") * F.col("n")).alias("metres")
    )
    near = near.select(F.col("place_id.lat").alias("lat"), F.col("place_id.lon").alias("lon"), "n", "photo_ids", "metres")
    each = places.select("place_id", "lat", "lon").join(near, ["lat", "lon"])
    return each.groupBy("place_id").agg(F.sum("n").alias("n"), F.sum("photo_ids").alias("photo_ids"), F.sum("metres").alias("metres"))


def _at_levels(rows: DataFrame, levels: list[int], metres: float) -> DataFrame:
    """``rows`` once for each level, with its ``level`` and the ``size`` of its cells."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.lit(metres / 2**n).alias("size")) for n in levels]))
    return rows.withColumn("_at", each).withColumns({"level": F.col("_at.level"), "size": F.col("_at.size")}).drop("_at")


def _cell(lat: Column, lon: Column) -> Column:
    row = geo.lat_cell(lat, F.col("size"))
    return F.struct("level", row.alias("row"), geo.lon_cell(lon, row, F.col("size")).alias("col"))


def _cells_around(lat: Column, lon: Column) -> Column:
    return F.transform(geo.neighbour_cells(lat, lon, F.col("size")), lambda c: F.struct("level", c["row"].alias("row"), c["col"].alias("col")))


def search_radii(places: DataFrame, photos: DataFrame, metres: float, per_place: int, levels: int = LEVELS) -> DataFrame:
    """(place_id, lat, lon, radius, level): how far to look for ``per_place`` photos of each place, ``metres`` at most.

    Rings of cells are halved in size from ``metres`` on. The smallest ring around a
    place that holds as many photos, by the counts of its cells, bounds the distance of
    the last one wanted; ``level`` is that of the smallest cells that tall. Levels are
    rows, so the plan does not grow with them.
    """
    lat, lon = F.col("lat"), F.col("lon")
    counts = _at_levels(photos.select("lat", "lon"), range(levels), metres).groupBy(_cell(lat, lon).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    around = _at_levels(places.select("place_id", "lat", "lon"), range(levels), metres).withColumn("cell", F.explode(_cells_around(lat, lon)))
    rings = around.join(counts, "cell").groupBy("place_id", "lat", "lon", "size").agg(F.sum("n").alias("n")).where(F.col("n") >= per_place)
    reach = F.least(F.lit(float(metres)), geo.ring_reach(lat, F.col("size")) + 0.01)
    smallest = rings.groupBy("place_id", "lat", "lon").agg(F.min(reach).alias("radius"))
    radii = places.select("place_id", "lat", "lon").join(smallest, ["place_id", "lat", "lon"], "left").withColumn("radius", F.coalesce("radius", F.lit(float(metres))))
    return radii.withColumn("level", F.least(F.lit(levels - 1), F.floor(F.log2(F.lit(float(metres)) / F.col("radius")))).cast("int"))


def nearest_photos(places: DataFrame, photos: DataFrame, km: float = 1.0, per_place: int = 30) -> DataFrame:
    """The ``per_place`` nearest photos of each place within ``km``, numbered by distance to the millimetre, then by ``ord``.

    Places where photos are dense look only as far as their counts ask, places at one
    spot look once, and of photos at one spot only the first can be among the nearest,
    so the pairs made follow ``per_place`` and not the density.
    """
    metres = round(km * 1000)
    if metres > 10_000:
        raise ValueError("the radius is 10 km at most")
    lat, lon = F.col("lat"), F.col("lon")
    piled = top_k(photos, ["lat", "lon"], [F.col("ord")], per_place, out="_pile").drop("_pile")
    spots = places.groupBy("lat", "lon").agg(F.min("place_id").alias("place_id"))
    radii = written(search_radii(spots, piled, metres, per_place), "radii")
    used = sorted(r["level"] for r in radii.select("level").distinct().collect())  # LEVELS at most
    if not used:
        return photos_near(places, photos, km).withColumn("near_rank", F.lit(1)).limit(0)
    asked = radii.withColumn("size", F.lit(float(metres)) / F.pow(F.lit(2.0), F.col("level"))).withColumn("_cell", F.explode(_cells_around(lat, lon)))
    asked = asked.select("place_id", lat.alias("_lat"), lon.alias("_lon"), "radius", "_cell")
    shot = _at_levels(piled, used, metres).withColumn("_cell", _cell(lat, lon)).drop("level", "size")
    pairs = asked.join(shot, "_cell")
    pairs = pairs.withColumn("metres", F.round(geo.haversine_m(F.col("_lat"), F.col("_lon"), lat, lon), 3)).where((F.col("metres") <= F.col("radius")) & (F.col("metres") <= metres))
    found = top_k(pairs.drop("_cell", "radius", "place_id"), ["_lat", "_lon"], [F.col("metres"), F.col("ord")], per_place, out="near_rank").drop("near_rank")
    each = places.select("place_id", lat.alias("_lat"), lon.alias("_lon")).distinct().join(found, ["_lat", "_lon"]).drop("_lat", "_lon")
    return top_k(each, ["place_id"], [F.col("metres"), F.col("ord")], per_place, out="near_rank")


def entity_photos(places: DataFrame, claims: DataFrame, files: DataFrame) -> DataFrame:
    """Pictures named in a place's own statements, joined to their file info."""
    named = F.concat(F.lit("File:"), F.regexp_replace(F.trim("value"), "^File:", ""))
    wanted = claims.where(F.col("property").isin("P18", "P3451", "P5252") & opt(F.trim("value")).isNotNull())
    wanted = wanted.select("entity_id", "property", F.col("ord").alias("claim_ord"), named.alias("file"))
    info = files.withColumnRenamed("title", "file")
    return places.select("place_id", "entity_id").join(wanted, "entity_id").join(info, "file").withColumn("source", F.lit("wikidata"))


def with_photos(places: DataFrame, photos: DataFrame) -> DataFrame:
    return places.join(photos.select("place_id").distinct(), "place_id", "left_semi")
