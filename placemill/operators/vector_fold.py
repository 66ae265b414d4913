"""Ordered first-match merge of rows with near vectors, along their pairs.

A record always has the vector of one of its rows, so a row can only join records
whose vector is paired with its own: a fold looks up the pairs of each row instead of
measuring every record. The rows of a connected set are taken in slices of their order.
A slice meets its own pairs and only those records of earlier slices that they reach.
Rows say which record they join and how they rank in it; records are put together by
a join and an aggregate, so a record of many rows is never in one place.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placemill.functions.tags import INFORMATION_POINTS
from placemill.operators.merge import MAX_GROUP
from placemill.operators.rank import number_rows
from placemill.session import written

KEYS = ["search_id", "component"]
STATE = "first_ord bigint, cls bigint, keys array<string>, filled array<string>, score int, other boolean, low bigint, high bigint"


def _score(tags: dict[str, bool], other: bool) -> int:
    """``information_score`` of tags of which is known whether they are filled."""
    return len(tags) + sum(n for keys, n in INFORMATION_POINTS if any(tags.get(k) for k in keys)) + other


def _tags(keys, filled) -> dict[str, bool]:
    full = set(filled)
    return {k: k in full for k in keys}


class _Record:
    """What decides the further course of a record: its vector, tags, score, and the ranks taken below and above its first row."""

    def __init__(self, first_ord, cls, keys, filled, score, other, low=0, high=0):
        self.first_ord, self.cls, self.tags, self.score, self.other, self.low, self.high = first_ord, cls, _tags(keys, filled), score, other, low, high

    def absorb(self, x: "_Record") -> int:
        """Takes in a row; its rank: below all others when it becomes the record's face, above them when not."""
        if x.score > self.score:
            self.tags.update(x.tags)
            self.cls, self.other, self.low = x.cls, x.other, self.low - 1
            rank = self.low
        else:
            self.tags = x.tags | self.tags
            self.high += 1
            rank = self.high
        self.score = _score(self.tags, self.other)
        return rank

    def row(self) -> tuple:
        return (self.first_ord, self.cls, list(self.tags), [k for k, v in self.tags.items() if v], self.score, self.other, self.low, self.high)


def _fold(rows: pd.DataFrame, beside: pd.DataFrame) -> pd.DataFrame:
    """One slice. ``beside``: the pairs of its vectors, and the records of earlier slices that they reach."""
    joined = []
    records: dict[int, _Record] = {}
    at: dict[int, set[int]] = {}
    near = {}
    for r in beside.itertuples(index=False):
        if r.first_ord is None or pd.isna(r.first_ord):
            near[r.cls] = r.near
        else:
            records[int(r.first_ord)] = _Record(int(r.first_ord), r.cls, r.keys, r.filled, int(r.score), bool(r.other), int(r.low), int(r.high))
            at.setdefault(r.cls, set()).add(int(r.first_ord))
    touched = set()
    for r in rows.sort_values("ord").itertuples(index=False):
        x = _Record(r.ord, r.cls, r.keys, r.filled, r.score, r.other)
        slot = min((min(at[c]) for c in near.get(r.cls, ()) if c in at), default=None)
        if slot is None:
            slot, rank, records[r.ord] = r.ord, 0, x
            at.setdefault(r.cls, set()).add(slot)
        else:
            record = records[slot]
            before = record.cls
            rank = record.absorb(x)
            if record.cls != before:
                at[before].discard(slot)
                if not at[before]:
                    del at[before]
                at.setdefault(record.cls, set()).add(slot)
        touched.add(slot)
        joined.append((r.ord, slot, rank))
    search, component = rows["search_id"].iloc[0], rows["component"].iloc[0]
    out = [(search, component, o, n, *([None] * 7), slot) for o, slot, n in joined]
    if rows["more"].iloc[0]:
        out += [(search, component, None, None, *(state := records[k].row())[1:], state[0]) for k in sorted(touched)]
    names = ["search_id", "component", "ord", "rank", "cls", "keys", "filled", "score", "other", "low", "high", "first_ord"]
    table = pd.DataFrame(out, columns=names)
    whole = {c: "Int64" for c in ("ord", "rank", "cls", "score", "low", "high", "first_ord")}
    return table.astype(whole | {"other": "boolean"})


def sliced(rows: DataFrame, max_group: int, batch: int, most: int = MAX_GROUP) -> DataFrame:
    """``slice`` and ``more``: sets up to ``max_group`` rows are one slice; others begin with ``batch`` rows, and slices double up to ``most`` rows."""
    sizes = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("size"))
    numbered = number_rows(rows, KEYS, [], "ord", "at").join(sizes, KEYS)
    most = max(most, batch)
    doubled = max(0, math.ceil(math.log2(most / batch)))
    at, begun = F.col("at") - 1, batch * (2**doubled - 1)
    grown = F.least(F.floor(F.log2(at / batch + 1)), F.lit(max(doubled - 1, 0)))
    number = F.when(at < begun, grown).otherwise(F.floor((at - begun) / most) + doubled)
    small = F.col("size") <= max_group
    return numbered.withColumn("slice", F.when(small, 0).otherwise(number).cast("int")).withColumn("more", ~small).drop("size", "at")


def fold_along_pairs(rows: DataFrame, near: DataFrame, max_group: int, batch: int) -> DataFrame:
    """(search_id, component, ord, first_ord, rank): the record that each row joins; the lowest rank gives it its columns, lower ranks its tags.

    ``rows``: search_id, component, ord, cls (the number of its vector), tags, score, other
    (no node). ``near``: search_id, cls, near: the vectors that match each, itself among them.
    """
    kind = rows.schema["search_id"].dataType.simpleString()
    filled = F.map_keys(F.map_filter("tags", lambda _, v: F.coalesce(v != "", F.lit(False))))
    slim = rows.select(*KEYS, "ord", "cls", F.map_keys("tags").alias("keys"), filled.alias("filled"), F.col("score").cast("int").alias("score"), "other")
    slim = written(sliced(slim, max_group, batch), "slices")
    last = slim.agg(F.max("slice")).first()[0]
    shape = f"search_id {kind}, component bigint, ord bigint, rank bigint, " + ", ".join(c for c in STATE.split(", ") if not c.startswith("first_ord")) + ", first_ord bigint"
    names = [c.split(" ")[0] for c in STATE.split(", ")]
    state, parts = None, []
    for n in range(0 if last is None else last + 1):
        here = slim.where(F.col("slice") == n)
        asked = here.select(*KEYS, "cls").distinct().join(near, ["search_id", "cls"])
        pairs = asked.select(*KEYS, "near", *[(F.col(c) if c == "cls" else F.lit(None).cast(t)).alias(c) for c, t in (x.split(" ") for x in STATE.split(", "))])
        if state is None:
            beside = pairs
        else:
            reached = asked.select(*KEYS, F.explode("near").alias("cls")).distinct()
            found = state.join(reached, [*KEYS, "cls"], "left_semi")
            beside = pairs.unionByName(found.select(*KEYS, F.lit(None).cast("array<bigint>").alias("near"), *names))
        # Columns of their own, as both sides come from the same rows.
        beside = beside.select(*[F.col(c).alias(c) for c in beside.columns])
        done = written(here.groupBy(*KEYS).cogroup(beside.groupBy(*KEYS)).applyInPandas(_fold_or_nothing, shape), "folded")
        parts.append(done.where("ord is not null").select(*KEYS, "ord", "first_ord", "rank"))
        if n < last:
            new = done.where("ord is null").select(*KEYS, *names)
            state = new if state is None else written(state.join(new.select(*KEYS, "first_ord"), [*KEYS, "first_ord"], "left_anti").unionByName(new), "records")
    if not parts:
        return rows.select(*KEYS, "ord", F.col("ord").alias("first_ord"), F.lit(0).cast("bigint").alias("rank")).limit(0)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _fold_or_nothing(rows: pd.DataFrame, beside: pd.DataFrame) -> pd.DataFrame:
    return _fold(rows, beside) if len(rows) else _NOTHING


_NOTHING = pd.DataFrame({c: [] for c in ["search_id", "component", "ord", "rank", "cls", "keys", "filled", "score", "other", "low", "high", "first_ord"]})


def merged_tags(members: DataFrame) -> DataFrame:
    """(search_id, first_ord, tags): of each key the value of the lowest rank. ``members``: search_id, first_ord, rank, tags."""
    each = members.select("search_id", "first_ord", "rank", F.explode("tags").alias("key", "value"))
    chosen = each.groupBy("search_id", "first_ord", "key").agg(F.min_by("value", "rank").alias("value"))
    return chosen.groupBy("search_id", "first_ord").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("tags"))
