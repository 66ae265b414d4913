"""All pairs of near vectors, exactly, without comparing all pairs.

Some rows of a search become pivots, and every row goes to the cell of the pivot at
the smallest angle. Angles obey the triangle inequality, so a row can be within the
angle ``theta`` of a row of another cell only if it is at most 2 ``theta`` further from
that cell's pivot than from its own, and at most ``theta`` beyond the cell's widest row.
Rows visit only such cells, of each two cells the lower one, and are compared there
with the rows at home. Cells and visits of many rows are cut into tiles, so every
comparison is one matrix product of bounded size in a group of its own.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placemill.functions.vectors import dot
from placemill.operators.rank import top_k
from placemill.session import written

TILE = 2048
SLICE = 4096
PIVOTS_MOST = 64
# Angles are computed with errors far below this.
SLACK = 1e-6


def pivots_of(rows: DataFrame, sizes: DataFrame, tile_rows: int) -> DataFrame:
    """(search_id, pivot, vector): one row in ``tile_rows``, PIVOTS_MOST at most, chosen by a hash."""
    first = top_k(rows, ["search_id"], [F.xxhash64("ord"), F.col("ord")], PIVOTS_MOST, out="n_pivot")
    wanted = F.least(F.ceil(F.col("n") / tile_rows), F.lit(PIVOTS_MOST))
    return first.join(sizes, "search_id").where(F.col("n_pivot") <= wanted).select("search_id", (F.col("n_pivot") - 1).alias("pivot"), F.col("vector").alias("pivot_vector"))


def _unit(vectors: pd.Series) -> np.ndarray:
    v = np.stack(vectors.to_numpy()).astype("float64")
    return v / np.linalg.norm(v, axis=1)[:, None]


def _place(theta: float):
    def place(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        unit = _unit(rows["vector"])
        numbers = pivots["pivot"].to_numpy()
        angles = np.arccos(np.clip(unit @ _unit(pivots["pivot_vector"]).T, -1, 1))
        angles = angles[:, np.argsort(numbers)]
        home = angles.argmin(axis=1)
        own = angles[np.arange(len(home)), home]
        near = (angles <= own[:, None] + 2 * theta) & (np.arange(angles.shape[1]) < home[:, None])
        near[np.arange(len(home)), home] = True
        cells = [np.flatnonzero(n).astype("int32") for n in near]
        return pd.DataFrame({
            "search_id": rows["search_id"], "ord": rows["ord"], "vector": list(unit), "home": home.astype("int32"),
            "cells": cells, "angles": [a[c] for a, c in zip(angles, cells)],
        })

    return place


def placed_rows(places: DataFrame, threshold: float, tile_rows: int = TILE) -> DataFrame:
    """(search_id, ord, vector, home, cells, angles): each row's cell, and the cells that it visits with its angle to their pivots."""
    rows = written(places.where(dot(F.col("vector"), F.col("vector")) > 0).select("search_id", "ord", "vector"), "vectors")
    sizes = rows.groupBy("search_id").agg(F.count(F.lit(1)).alias("n"))
    slices = F.ceil(F.col("n") / SLICE).cast("int")
    sliced = rows.join(sizes, "search_id").withColumn("slice", F.pmod(F.xxhash64("ord", F.lit("slice")), slices).cast("int")).drop("n")
    pivots = pivots_of(rows, sizes, tile_rows).join(sizes, "search_id").withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1))).drop("n")
    # Columns of their own, as both sides come from the same rows.
    pivots = pivots.select(*[F.col(c).alias(c) for c in pivots.columns])
    kind = rows.schema["search_id"].dataType.simpleString()
    keys = ["search_id", "slice"]
    shape = f"search_id {kind}, ord bigint, vector array<double>, home int, cells array<int>, angles array<double>"
    return written(sliced.groupBy(*keys).cogroup(pivots.groupBy(*keys)).applyInPandas(_place(_theta(threshold)), shape), "placed")


def _theta(threshold: float) -> float:
    return math.acos(max(-1.0, min(1.0, threshold))) + SLACK


def visits(placed: DataFrame, threshold: float) -> DataFrame:
    """The rows of ``placed`` once for each cell they are compared in: ``cell``, and whether it is their own."""
    radii = placed.select("search_id", F.col("home").alias("cell"), F.element_at("angles", -1).alias("radius")).groupBy("search_id", "cell").agg(F.max("radius").alias("radius"))
    each = placed.withColumn("visit", F.explode(F.arrays_zip(F.col("cells").alias("cell"), F.col("angles").alias("angle"))))
    each = each.withColumn("cell", F.col("visit.cell")).withColumn("angle", F.col("visit.angle")).withColumn("own", F.col("cell") == F.col("home"))
    return each.join(radii, ["search_id", "cell"]).where(F.col("own") | (F.col("angle") <= F.col("radius") + _theta(threshold))).drop("visit", "angle", "radius", "cells", "angles", "home")


def compared_pairs(placed: DataFrame, threshold: float) -> DataFrame:
    """(search_id, pairs, compared): all pairs of a search, and those that are measured."""
    cells = visits(placed.drop("vector"), threshold).groupBy("search_id", "cell").agg(F.count_if("own").alias("h"), F.count_if(~F.col("own")).alias("v"))
    n = F.sum("h")
    return cells.groupBy("search_id").agg((n * (n - 1) / 2).cast("bigint").alias("pairs"), F.sum(F.col("h") * (F.col("h") - 1) / 2 + F.col("h") * F.col("v")).cast("bigint").alias("compared"))


def _compare(threshold: float):
    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j, visit = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0]), bool(pdf["visit"].iloc[0])
        unit, ords, own, tile = np.stack(pdf["vector"].to_numpy()), pdf["ord"].to_numpy(), pdf["own"].to_numpy(), pdf["tile"].to_numpy()
        left = own & (tile == i)
        right = ~own if visit else own & (tile == j)
        near = unit[left] @ unit[right].T
        a, b = np.nonzero(near >= threshold)
        oa, ob = ords[left][a], ords[right][b]
        keep = oa < ob if not visit and i == j else oa != ob
        return pd.DataFrame({"search_id": pdf["search_id"].iloc[0], "ord_a": np.minimum(oa, ob)[keep], "ord_b": np.maximum(oa, ob)[keep], "cosine": near[a, b][keep]})

    return compare


def near_pairs(places: DataFrame, threshold: float, tile_rows: int = TILE) -> DataFrame:
    """(search_id, ord_a, ord_b, cosine): all pairs of a search's rows with a cosine of ``threshold`` or more, ord_a < ord_b.

    ``places``: search_id, ord, vector. Rows without a vector, or whose vector has no
    length, pair with nothing. A row is copied once for each tile it is compared with:
    cells of up to ``tile_rows`` rows are one tile.
    """
    placed = placed_rows(places, threshold, tile_rows)
    counts = visits(placed.drop("vector"), threshold).groupBy("search_id", "cell").agg(
        F.ceil(F.count_if("own") / tile_rows).cast("int").alias("homes"), F.ceil(F.count_if(~F.col("own")) / tile_rows).cast("int").alias("guests")
    )
    here = visits(placed, threshold).join(counts, ["search_id", "cell"])
    tiles = F.when(F.col("own"), F.col("homes")).otherwise(F.col("guests"))
    here = here.withColumn("tile", F.pmod(F.xxhash64("ord", F.lit("tile")), tiles).cast("int"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    meeting = lambda visit, i, j: F.struct(F.lit(visit).alias("visit"), i.alias("i"), j.alias("j"))
    tile = F.col("tile")
    at_home = F.transform(upto(F.col("homes")), lambda o: meeting(False, F.least(tile, o), F.greatest(tile, o)))
    with_guests = F.transform(upto(F.col("guests")), lambda g: meeting(True, tile, g))
    as_guest = F.transform(upto(F.col("homes")), lambda h: meeting(True, h, tile))
    groups = here.withColumn("meet", F.explode(F.when(F.col("own"), F.concat(at_home, with_guests)).otherwise(as_guest)))
    groups = groups.select("search_id", "cell", "meet.visit", "meet.i", "meet.j", "tile", "own", "ord", "vector")
    kind = placed.schema["search_id"].dataType.simpleString()
    return groups.groupBy("search_id", "cell", "visit", "i", "j").applyInPandas(_compare(threshold), f"search_id {kind}, ord_a bigint, ord_b bigint, cosine double")
