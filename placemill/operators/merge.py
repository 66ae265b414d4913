"""Ordered first-match merge: each record joins the first kept one it matches.

The result depends on arrival order and on the kept record's current state, so
it is a fold, not a grouping. The rows of a group pass through one task in order,
as a stream: what the task holds is what decides the further course of the kept
records, found by cells of the ground, so a row meets only the records beside it.
A row that changes nothing is merely counted; those that begin a record or change
it go on, and Spark puts them together.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from math import asin, cos, inf, radians, sin, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placemill import dims
from placemill.functions.geo import EARTH_M
from placemill.functions.tags import BRAND_KEYS, INFORMATION_POINTS, information_score, is_chain_like, overlay
from placemill.functions.text import bind

MAX_GROUP = 20_000
EVENTS_PER_ROUND = 500
ROWS_AT_A_TIME = 10_000
# Tag sets, and cells with the records beside them, that a task remembers.
REMEMBERED = 50_000

# Cells are cubes through which the globe passes: points within the radius lie in the same or in touching ones, at the poles and the date line too.
CELL_M = dims.CHAIN_RADIUS_M * 1.001
SIDE = 1 << 20
AROUND = [x * SIDE * SIDE + y * SIDE + z for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)]

# What of a tag's value decides matches and scores.
FILLED, CHAIN = 1, 2


def _cells(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """The cell of each position, -1 where there is none."""
    with np.errstate(invalid="ignore"):
        la, lo = np.radians(lat), np.radians(lon)
        x, y, z = (np.floor(v * (EARTH_M / CELL_M)) + SIDE // 2 for v in (np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)))
    there = np.isfinite(x) & np.isfinite(y) & np.isfinite(z)
    x, y, z = (np.where(there, v, 0).astype(np.int64) for v in (x, y, z))
    return np.where(there, (x * SIDE + y) * SIDE + z, -1)


def _marks(keys: pa.Array, values: pa.Array, names: dict[str, int]) -> list[int]:
    """A number per tag: its key's in ``names``, times four, with what its value decides."""
    keyed = keys.dictionary_encode()
    own = keyed.dictionary.to_pylist()
    number = np.array([names.setdefault(k, len(names)) for k in own], np.int64)
    brand, utility = np.array([k in BRAND_KEYS for k in own], bool), np.array([k in dims.CHAIN_KEYS for k in own], bool)
    at = keyed.indices.to_numpy(zero_copy_only=False)
    filled = pc.fill_null(pc.not_equal(values, ""), False).to_numpy(zero_copy_only=False).astype(bool)
    everyday = pc.is_in(values, value_set=pa.array(dims.CHAIN_VALUES, values.type)).to_numpy(zero_copy_only=False).astype(bool)
    if not len(at):
        return []
    return (number[at] * 4 + FILLED * filled + CHAIN * ((brand[at] & filled) | (utility[at] & everyday))).tolist()


class _Shapes:
    """Tag sets as {key: marks}, one object for each that came lately; None for a null map."""

    def __init__(self):
        self.names, self.known = {}, {}

    def of(self, tags: pa.MapArray) -> list[dict[str, int] | None]:
        if len(self.known) > REMEMBERED or len(self.names) > REMEMBERED:
            self.names, self.known = {}, {}
        ends = tags.offsets.to_pylist()
        low, n = ends[0], ends[-1] - ends[0]
        marks = _marks(tags.keys.slice(low, n), tags.items.slice(low, n), self.names)
        names, known, out = [*self.names], self.known, []
        for begin, end, there in zip(ends, ends[1:], tags.is_valid().to_pylist()):
            sign = tuple(marks[begin - low:end - low])
            shape = known.get(sign)
            if shape is None:
                shape = known[sign] = {names[m >> 2]: m & 3 for m in sign}
            out.append(shape if there else None)
        return out


def _score(shape: dict[str, int], other: bool) -> int:
    """``information_score`` of the tags of a record."""
    return len(shape) + sum(n for keys, n in INFORMATION_POINTS if any(shape.get(k, 0) & FILLED for k in keys)) + other


class _Kept:
    """What decides the further course of a kept record."""

    __slots__ = ("slot", "lat", "lon", "cell", "chain", "score", "shape", "other")

    def __init__(self, slot, lat, lon, cell, chain, score, shape, other):
        self.slot, self.lat, self.lon, self.cell, self.chain, self.score, self.shape, self.other = slot, lat, lon, cell, chain, score, shape, other


def _slot(kept: _Kept) -> int:
    return kept.slot


def _metres(kept: _Kept, lat: float, lon: float) -> float:
    """``haversine_m``; what it makes of a root below zero is not near either."""
    h = sin(radians(lat - kept.lat) / 2) ** 2 + sin(radians(lon - kept.lon) / 2) ** 2 * cos(radians(kept.lat)) * cos(radians(lat))
    return 2.0 * EARTH_M * asin(min(1.0, sqrt(h))) if h >= 0 else inf


class _Group:
    """Kept records in the order in which they began. Landmarks match each other anywhere, a chain only what is beside it."""

    def __init__(self, key: tuple, first_ord):
        self.key, self.first_ord = key, first_ord
        self.rows = self.slots = 0
        self.landmarks: list[_Kept] = []
        self.cells: dict[int, list[_Kept]] = {}
        self.near: dict[int, list[_Kept]] = {}
        self.counted: dict[int, int] = {}

    def beside(self, cell: int) -> list[_Kept]:
        found = self.near.get(cell)
        if found is None:
            if len(self.near) > REMEMBERED:
                self.near.clear()
            cells = self.cells
            found = self.near[cell] = sorted((k for c in AROUND for k in cells.get(cell + c, ())), key=_slot)
        return found

    def match(self, lat: float, lon: float, cell: int, chain: bool) -> _Kept | None:
        landmark = None if chain or not self.landmarks else self.landmarks[0]
        if cell < 0:
            return landmark
        for kept in self.beside(cell):
            if landmark is not None and kept.slot >= landmark.slot:
                break
            if (chain or kept.chain) and _metres(kept, lat, lon) < dims.CHAIN_RADIUS_M:
                return kept
        return landmark

    def _moved(self, cell: int) -> None:
        if self.near:
            for c in AROUND:
                self.near.pop(cell + c, None)

    def put(self, kept: _Kept) -> None:
        """Where later rows find it; a chain without a place matches none."""
        if not kept.chain:
            insort(self.landmarks, kept, key=_slot)
        if kept.cell >= 0:
            self.cells.setdefault(kept.cell, []).append(kept)
            self._moved(kept.cell)

    def take(self, kept: _Kept) -> None:
        if not kept.chain:
            self.landmarks.remove(kept)
        if kept.cell >= 0:
            here = self.cells[kept.cell]
            here.remove(kept)
            if not here:
                del self.cells[kept.cell]
            self._moved(kept.cell)

    def add(self, lat, lon, cell, chain, score, shape, other) -> int:
        """The slot of the record that the row joins; -1 for a row that is merely counted."""
        self.rows += 1
        kept = self.match(lat, lon, cell, chain)
        if kept is None:
            self.put(_Kept(self.slots, lat, lon, cell, chain, score, shape, other))
            self.slots += 1
            return self.slots - 1
        old = kept.shape
        better = score is not None and kept.score is not None and score > kept.score
        if old is None or (not better and shape is not None and (shape is old or shape.keys() <= old.keys())):
            self.counted[kept.slot] = self.counted.get(kept.slot, 0) + 1
            return -1
        if shape is None:
            merged = None
        else:
            merged = old | shape if better else shape | old
        become = merged is not None and any(m & CHAIN for m in merged.values())
        if become != kept.chain or (better and (lat, lon) != (kept.lat, kept.lon)):
            self.take(kept)
            kept.chain = become
            if better:
                kept.lat, kept.lon, kept.cell = lat, lon, cell
            self.put(kept)
        if better:
            kept.other = other
        kept.shape, kept.score = merged, None if merged is None else _score(merged, kept.other)
        return kept.slot


def _streamed(keys: list[str], rows_at_a_time: int):
    """The rows that begin or change a record, with its slot and their place in the order; and how many more were counted, at the end of a group."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, group, kinds = _Shapes(), None, None

        def ended(groups: list[_Group]) -> pa.RecordBatch:
            left = [(g, slot, n) for g in groups for slot, n in g.counted.items()]
            columns = [pa.array([g.key[i] for g, _, _ in left], kinds[k]) for i, k in enumerate(keys)]
            columns += [pa.nulls(len(left), kinds["place"]), pa.array([slot for _, slot, _ in left], pa.int64()), pa.nulls(len(left), pa.int64())]
            columns += [pa.array([n for _, _, n in left], pa.int64()), pa.nulls(len(left), kinds["ord"])]
            return pa.RecordBatch.from_arrays(columns, [*keys, "place", "slot", "at", "rows", "group_ord"])

        for whole in batches:
            for begin in range(0, whole.num_rows, rows_at_a_time):
                batch = whole.slice(begin, rows_at_a_time)
                place = batch.column("place")
                of = place.field
                if kinds is None:
                    kinds = {k: batch.column(k).type for k in keys} | {"place": place.type, "ord": of("ord").type}
                lat, lon = (of(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("lat", "lon"))
                other = pc.fill_null(pc.not_equal(of("osm_type"), "node"), False).to_pylist()
                row = zip(
                    lat.tolist(), lon.tolist(), _cells(lat, lon).tolist(), of("chain").to_pylist(), of("score").to_pylist(), shapes.of(of("tags")), other,
                )
                ords, chosen, slots, ats, firsts, done = of("ord"), [], [], [], [], []
                for i, (key, x) in enumerate(zip(zip(*(batch.column(k).to_pylist() for k in keys)), row)):
                    if group is None or key != group.key:
                        if group is not None and group.counted:
                            done.append(group)
                        group = _Group(key, ords[i].as_py())
                    slot = group.add(*x)
                    if slot >= 0:
                        chosen.append(i)
                        slots.append(slot)
                        ats.append(group.rows)
                        firsts.append(group.first_ord)
                if chosen:
                    kept = batch.take(pa.array(chosen, pa.int64()))
                    columns = [kept.column(k) for k in [*keys, "place"]]
                    columns += [pa.array(slots, pa.int64()), pa.array(ats, pa.int64()), pa.array([1] * len(chosen), pa.int64()), pa.array(firsts, kinds["ord"])]
                    yield pa.RecordBatch.from_arrays(columns, [*keys, "place", "slot", "at", "rows", "group_ord"])
                if done:
                    yield ended(done)
        if group is not None and group.counted:
            yield ended([group])

    return fold


def _absorb(old: Column, x: Column) -> Column:
    """The richer record stays on top and keeps both records' tags; ties keep the earlier one."""
    better = x["score"] > old["score"]
    base = F.when(better, x).otherwise(old)
    tags = F.when(better, overlay(old["tags"], x["tags"])).otherwise(overlay(x["tags"], old["tags"]))
    return bind(
        tags,
        lambda t: base.withField("tags", t).withField("score", information_score(t, base["osm_type"])).withField("chain", is_chain_like(t)),
    )


def _in_order(rows: Column) -> Column:
    return F.array_sort(rows, lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0))


def ordered_merge(rows: DataFrame, keys: list[str], rows_at_a_time: int = ROWS_AT_A_TIME) -> DataFrame:
    """``rows`` holds the keys and a ``place`` struct with ord, lat, lon, osm_type, tags, score and chain.

    Same-named landmarks are one place, chains (``is_chain_like``) only within the
    radius. Returns one row per kept record: keys, place, n (records folded),
    first_ord, and group_ord, the first arrival of its group.
    """
    rows = rows.select(*keys, "place")
    place = rows.schema["place"].dataType
    more = [T.StructField("slot", T.LongType()), T.StructField("at", T.LongType()), T.StructField("rows", T.LongType()), T.StructField("group_ord", place["ord"].dataType)]
    shape = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema] + more)
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "place.ord")
    parts = ordered.mapInArrow(_streamed(keys, rows_at_a_time), shape)
    changes = F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "place")))
    kept = parts.groupBy(*keys, "slot").agg(F.min("group_ord").alias("group_ord"), F.sum("rows").alias("n"), _in_order(changes).alias("changes"))
    first = F.col("changes")[0]["place"]
    merged = F.aggregate(F.slice("changes", F.lit(2), F.size("changes")), first, lambda old, x: _absorb(old, x["place"]))
    return kept.select(*keys, "group_ord", merged.alias("place"), "n", first["ord"].alias("first_ord"))
