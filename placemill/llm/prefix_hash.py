"""Document fingerprints from prefix polynomial hashes.

P[i] is the sum of letter(j) * B^j for j < i, modulo a prime. From the array of one
text, the hash of any span is one subtraction, scaled so that it does not depend on
where the span lies: two spans are equal exactly if their hashes are (but for chance
below 2^-60 for two primes), and the longest common extension of two places is found
by binary search over span lengths. A fingerprint keeps the array at a few places,
from both ends, and the smallest hashes of short spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placemill.session import fresh_path

PRIME = np.uint64((1 << 31) - 1)
BASES = (1_000_003, 1_190_494_759)
GRID = 16
SPAN = 24
SKETCH = 24
# About so much text stands between two cuts of the ordered table.
PART_CHARS = 16_000_000
PARTS_MOST = 200_000


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1, for x below 2^63."""
    x = (x & PRIME) + (x >> np.uint64(31))
    x = (x & PRIME) + (x >> np.uint64(31))
    return x - (x >= PRIME) * PRIME


class _Powers:
    """B^i and B^-i modulo the prime, grown as longer texts come."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, int(PRIME) - 2, int(PRIME))
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        while self.up.size <= n:
            k = self.up.size
            self.up = np.concatenate([self.up, _mod(self.up * np.uint64(pow(self.base, k, int(PRIME))))])
            self.down = np.concatenate([self.down, _mod(self.down * np.uint64(pow(self.inverse, k, int(PRIME))))])


_POWERS = [_Powers(b) for b in BASES]


class Prefixes:
    """Prefix arrays of one text, one for each base."""

    def __init__(self, arrays: list[np.ndarray]):
        self.arrays = arrays
        self.size = arrays[0].size - 1

    @classmethod
    def of(cls, text: str) -> Prefixes:
        letters = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        out = []
        for p in _POWERS:
            p.reach(letters.size + 1)
            # Terms stay below 2^31, so sums of up to 2^32 of them fit.
            out.append(np.concatenate([np.zeros(1, np.uint64), _mod(np.cumsum(_mod(letters * p.up[: letters.size])))]))
        return cls(out)

    def spans(self, start, length) -> np.ndarray:
        """Hash of each span text[start : start + length], the same for equal spans anywhere."""
        start, length = np.asarray(start), np.asarray(length)
        parts = []
        for p, a in zip(_POWERS, self.arrays):
            p.reach(self.size + 1)
            parts.append(_mod(_mod(a[start + length] + PRIME - a[start]) * p.down[start]))
        return (parts[0] << np.uint64(31)) | parts[1]

    def first(self, n: int) -> Prefixes:
        return Prefixes([a[: n + 1] for a in self.arrays])

    def then(self, other: Prefixes) -> Prefixes:
        """The arrays of the two texts in a row, without reading either again."""
        out = []
        for p, a, b in zip(_POWERS, self.arrays, other.arrays):
            p.reach(self.size + other.size + 1)
            out.append(np.concatenate([a, _mod(a[-1] + _mod(b[1:] * p.up[self.size]))]))
        return Prefixes(out)


def equal_spans(a: Prefixes, i: int, b: Prefixes, j: int, length: int) -> bool:
    """Whether a's span of ``length`` from i equals b's from j; spans past an end equal nothing."""
    if length < 0 or i + length > a.size or j + length > b.size:
        return False
    return bool(a.spans(i, length) == b.spans(j, length))


def common_extension(a: Prefixes, i: int, b: Prefixes, j: int, backwards: bool = False) -> int:
    """Length of the longest common extension from i in a and j in b: forwards, or of what ends there."""
    low, high = 0, min(i, j) if backwards else min(a.size - i, b.size - j)
    while low < high:
        mid = (low + high + 1) // 2
        at = (i - mid, j - mid) if backwards else (i, j)
        if equal_spans(a, at[0], b, at[1], mid):
            low = mid
        else:
            high = mid - 1
    return low


def smallest_distinct(values: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` smallest distinct values in order, or all if they are fewer; the part looked at widens until it holds them."""
    most = 20 * n
    while values.size > 2 * most:
        found = np.unique(np.partition(values, most)[:most])
        if found.size >= n:
            return found[:n]
        most *= 4
    return np.unique(values)[:n]


def fingerprint(p: Prefixes) -> str:
    """size, step and hash of the whole; hashes of prefixes and of suffixes of 1, 2, ... steps; smallest span hashes.

    The step is the smallest power of two that fits the text at most GRID times.
    """
    n, step = p.size, 1
    while n > GRID * step:
        step *= 2
    marks = np.arange(step, n + 1, step)
    low = np.uint64(0xFFFFFFFF)
    fold = lambda h: (h ^ (h >> np.uint64(29))) & low
    ahead, behind = fold(p.spans(np.zeros(marks.size, np.int64), marks)), fold(p.spans(n - marks, marks))
    length = min(SPAN, n)
    spans = p.spans(np.arange(n - length + 1), np.int64(length))
    mixed = (spans * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    smallest = smallest_distinct(mixed, SKETCH) if n else mixed[:0]
    lists = ["".join("%08x" % v for v in x.tolist()) for x in (ahead, behind, smallest)]
    return ":".join(["%x" % n, "%x" % step, "%016x" % int(p.spans(0, n)), *lists])


def _read(text: str) -> tuple:
    n, step, whole, *lists = text.split(":")
    return int(n, 16), int(step, 16), whole, *([x[i : i + 8] for i in range(0, len(x), 8)] for x in lists)


def _common_steps(a: list[str], step_a: int, b: list[str], step_b: int) -> int:
    """Letters that the two agree in from one end on, by binary search over the marks that both have."""
    step = max(step_a, step_b)
    by_a, by_b = step // step_a, step // step_b
    low, high = 0, min(len(a) // by_a, len(b) // by_b)
    while low < high:
        mid = (low + high + 1) // 2
        if a[mid * by_a - 1] == b[mid * by_b - 1]:
            low = mid
        else:
            high = mid - 1
    return low * step


def likeness(one: str, other: str) -> float:
    """0 to 1 from two fingerprints: 1 for equal texts, else the larger of the share of the longer text that
    common ends cover and the share of common spans that the smallest hashes suggest."""
    if one == other:
        return 1.0
    n_a, step_a, whole_a, head_a, tail_a, few_a = _read(one)
    n_b, step_b, whole_b, head_b, tail_b, few_b = _read(other)
    if not n_a or not n_b:
        return 0.0
    ends = _common_steps(head_a, step_a, head_b, step_b) + _common_steps(tail_a, step_a, tail_b, step_b)
    union = sorted({*few_a, *few_b})[:SKETCH]
    shared = len(set(few_a) & set(few_b) & set(union)) / len(union) if union else 0.0
    return min(0.9999, max(min(ends, n_a, n_b) / max(n_a, n_b), shared))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint): every whole text; a null text counts as empty, rows stay as they are."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                texts = [t.as_py() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([fingerprint(Prefixes.of(t)) for t in texts], pa.string())],
                    names=["doc_id", "n_chars", "fingerprint"],
                )

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(make, f"doc_id {kind}, n_chars bigint, fingerprint string")


def in_order(docs: DataFrame) -> DataFrame:
    """(part, place, extra, doc_id, text): rows dealt into parts in order of (doc_id, hash of the text, row).

    Each part ends with one extra row, the first of the next part (of the first
    part, for the last), so that every row's next row is in its own part. Cuts are
    keys of rows that a first pass over ids and hashes has sorted; one key for some
    megabytes of text reaches the driver, PARTS_MOST at most: beyond that parts grow.
    """
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"),
        F.monotonically_increasing_id().alias("r"), "doc_id", F.coalesce("text", F.lit("")).alias("text"),
    )
    keys = rows.select("k", "h", "r", F.length("text").alias("n"))
    total = keys.agg(F.sum("n")).first()[0] or 0
    count = max(1, min(PARTS_MOST, -(-total // PART_CHARS)))
    path = fresh_path(docs.sparkSession, "cuts")
    ordered = keys.repartitionByRange(count, "k", "h", "r").withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.min(F.struct("k", "h", "r")).alias("least"))
    ordered.write.parquet(path)
    cuts = sorted(tuple(r["least"]) for r in docs.sparkSession.read.parquet(path).collect())
    shared = docs.sparkSession.sparkContext.broadcast(cuts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_right

        cuts = shared.value
        index = {c: i for i, c in enumerate(cuts)}
        for batch in batches:
            who = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            part = [max(0, bisect_right(cuts, w) - 1) for w in who]
            also = [(i, (index[w] - 1) % len(cuts)) for i, w in enumerate(who) if w in index]
            take = pa.array([*range(len(who)), *(i for i, _ in also)], pa.int64())
            columns = [c.take(take) for c in batch.columns]
            parts = pa.array([*part, *(p for _, p in also)], pa.int64())
            extra = pa.array([False] * len(who) + [True] * len(also))
            yield pa.RecordBatch.from_arrays([parts, extra, *columns], names=["part", "extra", "k", "h", "r", "doc_id", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    dealt = rows.mapInArrow(deal, f"part bigint, extra boolean, k bigint, h bigint, r bigint, doc_id {kind}, text string")
    return dealt.repartition(count, "part").sortWithinPartitions("part", "extra", "k", "h", "r").select("part", "extra", "doc_id", "text")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text is the row's with its last half (rounded down) replaced by as
    many letters from the start of the next text, or all it has. Texts follow one
    another by id, then by a hash of the text, then as rows lie; rows without an id
    come first; after the last comes the first, also of a single row. A null text
    counts as empty. Ids must be whole numbers. ``docs`` must read the same each time.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out: list[tuple] = []
            for part, extra, doc, value in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                text = value.as_py()
                arrays = Prefixes.of(text)
                print_ = fingerprint(arrays)
                if held and held[0] == part:
                    _, before, old, old_arrays, old_print = held
                    half = len(old) // 2
                    edited = old[: len(old) - half] + text[:half]
                    new = fingerprint(old_arrays.first(len(old) - half).then(arrays.first(min(half, len(text)))))
                    out.append((before, len(old), edited, old_print, new, likeness(old_print, new), likeness(old_print, print_)))
                held = None if extra else (part, doc, text, arrays, print_)
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    types = [pa.int64() if kind == "bigint" else pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return in_order(docs).mapInArrow(make, f"doc_id {kind}, n_chars bigint, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
