"""Distances, grid cells, coordinates and area ids."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000
METRES_PER_DEGREE = math.pi * EARTH_M / 180


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.pow(F.sin(dlon / 2), 2) * F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))
    return F.lit(2.0 * EARTH_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def lat_cell(lat: Column, metres: float) -> Column:
    """Row of a grid at least ``metres`` tall: two points within ``metres`` differ by at most one row."""
    return F.floor(lat / F.lit(metres * 1.001 / METRES_PER_DEGREE)).cast("bigint")


def lon_cell(lon: Column, row: Column, metres: float) -> Column:
    """Column number of the grid at latitude row ``row``.

    A degree of longitude shrinks towards the poles, so each row has its own
    width, taken at the row edge nearest the pole, one row further out.
    """
    return F.floor(lon / lon_width(row, metres)).cast("bigint")


def lon_width(row: Column, metres: float) -> Column:
    step = metres * 1.001 / METRES_PER_DEGREE
    edge = F.least(F.lit(90.0), (F.greatest(F.abs(row), F.abs(row + 1)) + 1) * F.lit(step))
    return F.when(edge >= 89.9, F.lit(360.0)).otherwise(
        F.least(F.lit(360.0), F.lit(step) / F.cos(F.radians(F.least(edge, F.lit(89.9)))))
    )


def neighbour_cells(lat: Column, lon: Column, metres: float) -> Column:
    """Every grid cell that can hold a point within ``metres``, across the date line too: array of (row, col)."""
    row = lat_cell(lat, metres)
    turns = F.filter(
        F.array(F.lit(0.0), F.lit(360.0), F.lit(-360.0)), lambda s: F.abs(lon + s) <= 180.0 + lon_width(row + 1, metres)
    )
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    return F.array_distinct(
        F.flatten(
            F.flatten(
                F.transform(
                    F.array(row - 1, row, row + 1),
                    lambda r: F.transform(
                        turns,
                        lambda s: F.transform(
                            steps, lambda d: F.struct(r.alias("row"), (lon_cell(lon + s, r, metres) + d).alias("col"))
                        ),
                    ),
                )
            )
        )
    )


def ring_reach(lat: Column, metres: float) -> Column:
    """No point of the neighbouring cells is further away than this: two cells along the meridian, then two along the parallel."""
    row = lat_cell(lat, metres)
    wide = F.greatest(*[lon_width(row + n, metres) for n in (-1, 0, 1)])
    step = metres * 1.001 / METRES_PER_DEGREE
    nearest = F.greatest(F.lit(0.0), F.abs(lat) - 2 * step)
    return F.lit(2 * step * METRES_PER_DEGREE) + 2 * wide * METRES_PER_DEGREE * F.cos(F.radians(nearest))


def area_id(osm_type: Column, osm_id: Column) -> Column:
    """Offset ids under which relations and ways act as areas."""
    present = F.when(osm_id != 0, osm_id.cast("bigint"))
    return F.when(osm_type == "relation", present + F.lit(3_600_000_000)).when(
        osm_type == "way", present + F.lit(2_400_000_000)
    )


def parse_point(wkt: Column) -> Column:
    """``Point(lon lat)`` to a (lat, lon) struct, null when it does not parse."""
    pattern = r"(?i)Point\(\s*(-?[0-9.]+)\s+(-?[0-9.]+)\s*\)"
    lon = F.regexp_extract(wkt, pattern, 1).try_cast("double")
    lat = F.regexp_extract(wkt, pattern, 2).try_cast("double")
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))


def format_coordinate(lat: Column, lon: Column) -> Column:
    return F.format_string(
        "%.6f° %s, %.6f° %s  (%.6f, %.6f)",
        F.abs(lat), F.when(lat >= 0, "N").otherwise("S"),
        F.abs(lon), F.when(lon >= 0, "E").otherwise("W"),
        lat, lon,
    )


def coords(lat: Column, lon: Column, centre: Column) -> Column:
    """Own coordinates when both are present, else the centre."""
    own = F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))
    mid = F.when(centre.isNotNull(), F.struct(centre["lat"].alias("lat"), centre["lon"].alias("lon")))
    return F.coalesce(own, mid)
