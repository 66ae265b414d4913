"""Vector codes by k-means over the parts of vectors, with adaptive distance bounds.

A vector's components become whole numbers and are cut into equal parts; each part
position has a codebook. Between rounds every vector keeps, for each part, its
``tracked`` closest entries in order with a lower bound on the distance to each but
the first, and one outer bound for all entries beyond them. When entries move, a
bound falls by as much as its entry has moved, the outer one by the longest move. A
part whose exact distance to its entry stays below the first bound keeps it unseen; if
it stays below a later bound, only the entries before that are measured again; else
all are. Distances are compared as whole numbers, so ties are decided exactly and a
bound that merely touches counts as uncertain. How many entries are tracked follows
from how far the last round had to look.

A round is one pass over a written table: it writes the next state and one row of
sums an entry and task, from which the driver makes the next codebooks. The table
before goes when the next one stands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placemill.llm.scratch import Scratch

SCALE = 1024
TRACKED = 12
TRACKED_LEAST = 4
# The next round tracks as many entries as this share of the parts that had to look on needed.
SETTLED_SHARE = 0.9
BOUND_MOST = np.int64(65_535)
# Labels up to this many are broadcast with their sums.
LABELS_BROADCAST = 100_000
_SUMS = "part int, entry int, n bigint, sums array<bigint>"


def _roots(squares: np.ndarray) -> np.ndarray:
    """Whole numbers not above the roots of ``squares``, and not above BOUND_MOST."""
    r = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    r -= r * r > squares
    return np.minimum(r, BOUND_MOST)


def distances(x: np.ndarray, book: np.ndarray, exact_floats: bool) -> np.ndarray:
    """Squared distances of all rows to all entries, as whole numbers."""
    if exact_floats:
        xf, bf = x.astype(np.float64), book.astype(np.float64)
        return ((xf * xf).sum(axis=1)[:, None] - 2 * xf @ bf.T + (bf * bf).sum(axis=1)).astype(np.int64)
    out = np.zeros((x.shape[0], book.shape[0]), np.int64)
    for j in range(x.shape[1]):
        out += (x[:, j, None] - book[:, j]) ** 2
    return out


def _closest(d: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` closest entries of each row in order, ties to the lower index."""
    k = d.shape[1]
    if d.max(initial=0) < 1 << 52:
        keys = d * k + np.arange(k)
        if n < k:
            keys = np.partition(keys, n - 1, axis=1)[:, :n]
        return np.sort(keys, axis=1) % k
    return np.argsort(d, axis=1, kind="stable")[:, :n]


def search(x: np.ndarray, book: np.ndarray, tracked: int, exact_floats: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entries, bounds, distance) from all distances: entries[0] is the closest, bounds[i] holds for entries[i + 1], the last one for the rest."""
    d = distances(x, book, exact_floats)
    order = _closest(d, min(tracked + 2, book.shape[0]))
    at = np.take_along_axis(d, order, axis=1)
    bounds = np.full((x.shape[0], tracked + 1), BOUND_MOST)
    bounds[:, : at.shape[1] - 1] = _roots(at[:, 1:])
    entries = np.zeros((x.shape[0], tracked + 1), np.int64)
    entries[:, : min(tracked + 1, order.shape[1])] = order[:, : tracked + 1]
    return entries, bounds, at[:, 0]


def moved(entries: np.ndarray, bounds: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The bounds after entries have moved by at most ``moves``, again in rising order."""
    out = np.empty_like(bounds)
    out[:, :-1] = bounds[:, :-1] - moves[entries[:, 1:]]
    out[:, -1] = bounds[:, -1] - moves.max(initial=0)
    return np.maximum(0, np.minimum.accumulate(out[:, ::-1], axis=1)[:, ::-1])


def assign(x: np.ndarray, book: np.ndarray, entries: np.ndarray, bounds: np.ndarray, moves: np.ndarray, exact_floats: bool):
    """(entries, bounds, distance, how many of the tracked entries had to be measured) after the entries moved.

    The count is 1 for a part that kept its entry unseen and the number of tracked
    entries plus 1 for one that was measured against the whole codebook.
    """
    own = ((x - book[entries[:, 0]]) ** 2).sum(axis=1)
    bounds = moved(entries, bounds, moves)
    safe = own[:, None] < bounds * bounds
    reach = np.where(safe.any(axis=1), safe.argmax(axis=1) + 1, entries.shape[1] + 1)
    entries, d = entries.copy(), own
    some = np.flatnonzero((reach > 1) & (reach <= entries.shape[1]))
    if some.size:
        e = entries[some]
        near = ((x[some, None, :] - book[e]) ** 2).sum(axis=2)
        order = np.lexsort((e, near), axis=1)
        e, near = np.take_along_axis(e, order, axis=1), np.take_along_axis(near, order, axis=1)
        entries[some], d[some] = e, near[:, 0]
        b = np.concatenate([_roots(near[:, 1:]), bounds[some, -1:]], axis=1)
        bounds[some] = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1]
    every = np.flatnonzero(reach > entries.shape[1])
    if every.size:
        entries[every], bounds[every], d[every] = search(x[every], book, entries.shape[1] - 1, exact_floats)
    return entries, bounds, d, reach


def _shortened(entries: np.ndarray, bounds: np.ndarray, tracked: int) -> tuple[np.ndarray, np.ndarray]:
    """Fewer tracked entries: as bounds rise, the first one dropped holds for all beyond."""
    return entries[:, : tracked + 1], bounds[:, : tracked + 1]


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of equal length as a binary column."""
    rows = np.ascontiguousarray(rows)
    size = rows.dtype.itemsize * rows.shape[1]
    offsets = (np.arange(rows.shape[0] + 1) * size).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), rows.shape[0], [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def _rows(column: pa.BinaryArray, kind: str, width: int) -> np.ndarray:
    """The binary column that ``_fixed`` made."""
    n, size = len(column), np.dtype(kind).itemsize * width
    if not n:
        return np.zeros((0, width), kind)
    start = int(np.frombuffer(column.buffers()[1], np.int32)[column.offset])
    return np.frombuffer(column.buffers()[2], kind, count=n * width, offset=start).reshape(n, width) if size else np.zeros((n, 0), kind)


def whole_numbers(vectors: pa.ListArray, width: int) -> np.ndarray:
    """floor(SCALE * x) of each component, zeros up to ``width``."""
    offsets = vectors.offsets.to_numpy().astype(np.int64)
    size = np.diff(offsets)
    flat = np.floor(vectors.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.float64) * SCALE).astype(np.int64)
    out = np.zeros((size.size, width), np.int64)
    row = np.repeat(np.arange(size.size), size)
    out[row, np.arange(flat.size) - np.repeat(offsets[:-1] - offsets[0], size)] = flat
    return out


class _Sums:
    """Counts and sums of the parts of each entry that one task has seen."""

    def __init__(self, parts: int, entries: int, width: int):
        self.n = np.zeros((parts, entries), np.int64)
        self.total = np.zeros((parts, entries, width), np.int64)
        self.reach: dict[int, int] = {}

    def add(self, part: int, entry: np.ndarray, x: np.ndarray, reach: np.ndarray | None) -> None:
        order = np.argsort(entry, kind="stable")
        found, first = np.unique(entry[order], return_index=True)
        self.n[part] += np.bincount(entry, minlength=self.n.shape[1])
        if found.size and x.shape[1]:
            self.total[part, found] += np.add.reduceat(x[order], first, axis=0)
        if reach is not None:
            for z, n in zip(*np.unique(reach, return_counts=True)):
                self.reach[int(z)] = self.reach.get(int(z), 0) + int(n)

    def rows(self) -> list[tuple]:
        """(part, entry, n, sums), and (-1, reach, n, []) for the look-ups."""
        used = np.argwhere(self.n)
        return [(int(p), int(e), int(self.n[p, e]), self.total[p, e].tolist()) for p, e in used] + [(-1, z, n, []) for z, n in self.reach.items()]


def _gathered(table: DataFrame, parts: int, entries: int, width: int) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """Counts, sums and look-ups over all tasks: entries * width numbers a part at most."""
    rows = table.where(F.col("part").isNotNull()).select("part", "entry", "n", F.posexplode_outer("sums").alias("place", "x"))
    n, total, reach = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64), {}
    for r in rows.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect():
        if r["part"] < 0:
            reach[r["entry"]] = r["n"]
        else:
            n[r["part"], r["entry"]] = r["n"]
            if r["place"] is not None:
                total[r["part"], r["entry"], r["place"]] = r["x"]
    return n, total, reach


def next_tracked(tracked: int, reach: dict[int, int]) -> int:
    """As many as SETTLED_SHARE of the parts needed that found their entry among more than one tracked; never more than before."""
    looked = {z: n for z, n in reach.items() if 1 < z <= tracked + 1}
    total, have = sum(looked.values()), 0
    for z in sorted(looked):
        have += looked[z]
        if have >= SETTLED_SHARE * total:
            return max(min(tracked, TRACKED_LEAST), z - 1)
    return tracked


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, tracked: int = TRACKED) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error) of every kept row, the final codebooks as whole numbers [part, entry, place]).

    Rows whose ``embedding`` is null or holds a null or a component that is not finite
    are dropped. The codebooks begin with the ``entries`` (256 at most) rows of the
    smallest ids, rows without an id last and rows of one id by their vectors, or with
    all rows if they are fewer; equal rows are entries of their own, of which the first
    is used. Vectors shorter than the longest, or whose length ``parts`` does not
    divide, count as filled up with zeros. Entries that no part uses stay. A table
    without kept rows gives no rows and empty codebooks. Components so large that a
    squared distance would not fit 62 bits are an error. ``vectors`` must read the same
    each time; other columns are dropped.
    """
    if not 1 <= entries <= 256:
        raise ValueError("1 to 256 entries")
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select("vec_id", "label", "embedding").where(F.col("embedding").isNotNull() & finite)
    id_kind, label_kind = (kept.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    most = F.greatest(F.abs(F.array_max("embedding")), F.abs(F.array_min("embedding"))).cast("double")
    size, largest = kept.agg(F.max(F.size("embedding")), F.max(most)).first()
    wide = -(-(size or 0) // parts)
    top = int((largest or 0) * SCALE) + 1
    if 4 * max(1, wide) * parts * top**2 >= 1 << 62:
        raise ValueError("components too large for whole distances")
    exact_floats = 4 * max(1, wide) * top**2 < 1 << 53
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"

    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    books = whole_numbers(pa.array([list(r[0]) for r in first], pa.list_(pa.float64())), wide * parts).reshape(len(first), parts, wide).transpose(1, 0, 2)
    count = books.shape[1]
    tracked = max(1, min(tracked, count - 1))

    def state_schema() -> str:
        return f"vec_id {id_kind}, label {label_kind}, vector binary, near binary, bounds binary, {_SUMS}"

    def state(batch_ids, x, near, bounds) -> pa.RecordBatch:
        n = len(x)
        empty = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
        columns = [*batch_ids, _fixed(x.astype(kind)), _fixed(near.reshape(n, -1).astype(np.uint8)), _fixed(bounds.reshape(n, -1).astype("<u2")), *empty]
        return pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "vector", "near", "bounds", "part", "entry", "n", "sums"])

    def sums_batch(like: list[pa.DataType], sums: _Sums) -> pa.RecordBatch:
        rows = sums.rows()
        filled = [pa.nulls(len(rows), t) for t in (*like, pa.binary(), pa.binary(), pa.binary())]
        typed = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))]
        return pa.RecordBatch.from_arrays([*filled, *typed], names=["vec_id", "label", "vector", "near", "bounds", "part", "entry", "n", "sums"])

    def begin(shared) -> Iterator:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books, sums, like = shared.value, _Sums(parts, count, wide), None
            for batch in batches:
                ids = [batch.column(0), batch.column(1)]
                like = [c.type for c in ids]
                x = whole_numbers(batch.column(2), wide * parts)
                found = [search(x[:, p * wide : (p + 1) * wide], books[p], tracked, exact_floats) for p in range(parts)]
                for p, (near, _, _) in enumerate(found):
                    sums.add(p, near[:, 0], x[:, p * wide : (p + 1) * wide], None)
                yield state(ids, x, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1))
            if like:
                yield sums_batch(like, sums)

        return run

    def unpacked(batch: pa.RecordBatch, have: int):
        n = batch.num_rows
        x = _rows(batch.column(2), kind, wide * parts).astype(np.int64)
        near = _rows(batch.column(3), "u1", parts * (have + 1)).reshape(n, parts, have + 1).astype(np.int64)
        bounds = _rows(batch.column(4), "<u2", parts * (have + 1)).reshape(n, parts, have + 1).astype(np.int64)
        return x, near, bounds

    def again(shared, have: int, keep: int) -> Iterator:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (books, moves), sums, like = shared.value, _Sums(parts, count, wide), None
            for batch in batches:
                ids = [batch.column(0), batch.column(1)]
                like = [c.type for c in ids]
                x, near, bounds = unpacked(batch, have)
                found = []
                for p in range(parts):
                    part = x[:, p * wide : (p + 1) * wide]
                    e, b = _shortened(near[:, p], bounds[:, p], keep)
                    e, b, _, reach = assign(part, books[p], e, b, moves[p], exact_floats)
                    sums.add(p, e[:, 0], part, reach)
                    found.append((e, b))
                yield state(ids, x, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1))
            if like:
                yield sums_batch(like, sums)

        return run

    def finish(shared, have: int) -> Iterator:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books, moves = shared.value
            for batch in batches:
                x, near, bounds = unpacked(batch, have)
                codes, error = np.zeros((batch.num_rows, parts), np.uint8), np.zeros(batch.num_rows, np.int64)
                for p in range(parts):
                    e, _, d, _ = assign(x[:, p * wide : (p + 1) * wide], books[p], near[:, p], bounds[:, p], moves[p], exact_floats)
                    codes[:, p] = e[:, 0]
                    error += d
                written = codes.tobytes().hex()
                text = pa.array([written[i : i + 2 * parts] for i in range(0, len(written), 2 * parts)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text, pa.array(error)], names=["vec_id", "label", "code", "error"])

        return run

    final_schema = f"vec_id {id_kind}, label {label_kind}, code string, error bigint"
    if not count:
        return spark.createDataFrame([], final_schema), books
    share = spark.sparkContext.broadcast
    table = scratch.keep(kept.mapInArrow(begin(share(books)), state_schema()), "codes")
    have = tracked
    for i in range(rounds):
        n, total, reach = _gathered(table, parts, count, wide)
        new = np.where(n[:, :, None] > 0, total // np.maximum(n, 1)[:, :, None], books)
        # Rounded up, so that a bound never falls too little.
        moves = np.ceil(np.sqrt(((new - books).astype(np.float64) ** 2).sum(axis=2)) * (1 + 1e-12)).astype(np.int64)
        books, keep = new, next_tracked(have, reach)
        rows = table.where(F.col("part").isNull()).select("vec_id", "label", "vector", "near", "bounds")
        if i + 1 == rounds:
            out = scratch.keep(rows.mapInArrow(finish(share((books, moves)), have), final_schema), "coded")
        else:
            following = scratch.keep(rows.mapInArrow(again(share((books, moves)), have, keep), state_schema()), "codes")
            have = keep
        scratch.drop(table)
        table = None if i + 1 == rounds else following
    return out, books


def books_digest(books: np.ndarray) -> str:
    """sha256 of all components in decimal by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the error summed over equal labels; rows without a label count together."""
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("_of"), "label_error")
    small = coded.agg(F.approx_count_distinct("label")).first()[0] <= LABELS_BROADCAST
    # A label that many rows share is a hot key of a plain equality join, which Spark splits when it is skewed.
    totals = F.broadcast(totals) if small else totals.hint("merge")
    return coded.join(totals, F.col("label").eqNullSafe(F.col("_of")), "left").drop("_of")
