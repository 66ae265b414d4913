"""Importance resampling towards a target distribution, with ranks by parallel sorting by regular sampling.

1. Runs of one to three words are hashed into buckets by crc32. Each task adds up one
   array of bucket counts; the sums give an array of gains, the scaled log ratio of
   the target's share of a bucket to the corpus's share.
2. A text's weight is the sum of its features' gains; Gumbel noise from a hash of its
   id makes the largest scores a draw without replacement.
3. The scores are sorted in parallel. The parts of the written table are sorted where
   they lie, each run gives keys at regular steps, and the sorted keys give splitters.
   Segments between splitters are counted, so their first ranks are prefix sums; only
   segments that the draw reaches are exchanged, merged in their own task and numbered.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placemill.llm.common import ROW, stored

BUCKETS = 10_000
LONGEST_RUN = 3
# A task hashes about so many bytes of text at once; one text may be longer.
CHUNK_BYTES = 1 << 20
# A segment holds about so many rows; the driver sees at most SEGMENTS_MOST ** 2 sampled keys.
SEGMENT_ROWS = 1_000_000
SEGMENTS_MOST = 500
ONES = np.uint32(0xFFFFFFFF)
LONG_WORD = 64


def _crc_table() -> np.ndarray:
    """The register after one zero byte, for each value of its low byte (reflected polynomial EDB88320)."""
    r = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        r = np.where(r & 1, (r >> np.uint32(1)) ^ np.uint32(0xEDB88320), r >> np.uint32(1)).astype(np.uint32)
    return r


_STEP = _crc_table()
_BYTE = np.uint32(255)


def _zeros(tables: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The registers after the zero bytes that ``tables`` stand for: the four bytes of a register act on their own."""
    e = np.uint32(8)
    return tables[0][r & _BYTE] ^ tables[1][(r >> e) & _BYTE] ^ tables[2][(r >> (e + e)) & _BYTE] ^ tables[3][r >> (e + e + e)]


def _powers(bits: int) -> list[np.ndarray]:
    """Tables for 1, 2, 4, ... zero bytes, each from the one before applied twice."""
    value = np.arange(256, dtype=np.uint32)
    single = np.array([_STEP[(value << np.uint32(8 * k)) & _BYTE] ^ ((value << np.uint32(8 * k)) >> np.uint32(8)) for k in range(4)])
    out = [single]
    for _ in range(bits - 1):
        out.append(np.array([_zeros(out[-1], row) for row in out[-1]]))
    return out


_POWERS = _powers(32)


def advance(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRC registers after ``n`` more zero bytes each."""
    r, n = r.copy(), np.asarray(n)
    for bit in range(int(n.max(initial=0)).bit_length()):
        hit = np.flatnonzero((n >> bit) & 1)
        r[hit] = _zeros(_POWERS[bit], r[hit])
    return r


# What a byte of a word stands for, 0 outside words: digits, letters in lower case, all bytes of other scripts.
LETTER = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 0 for b in range(256)], np.uint8)


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(number of words of each text, [(text, crc32) of all runs of 1, of 2, ... words]).

    ``data`` holds the UTF-8 bytes of texts that lie one behind the other from
    ``starts`` to ``ends``. A run's checksum is put together from its words': the
    register moves over as many zero bytes as the next word has and takes that
    word's own register in, so no run is ever written out.
    """
    base, size = int(starts[0]), int(ends[-1] - starts[0])
    letters = LETTER[data[base : base + size]]
    inside = letters != 0
    before, after = np.zeros(size, bool), np.zeros(size, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = starts - base
    before[edges[edges < size]] = False
    after[ends[ends > starts] - base - 1] = False
    begin, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    length = end - begin
    text = np.searchsorted(edges, begin, side="right") - 1

    own = np.zeros(begin.size, np.uint32)
    live, k = np.flatnonzero(length <= LONG_WORD), 0
    while live.size:
        r = own[live]
        own[live] = _STEP[(r ^ letters[begin[live] + k]) & _BYTE] ^ (r >> np.uint32(8))
        k += 1
        live = live[length[live] > k]
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        own[i] = zlib.crc32(letters[begin[i] : end[i]].tobytes()) ^ 0xFFFFFFFF
    long = length > LONG_WORD
    opening = advance(np.full(begin.size, ONES), length)
    own[long] ^= opening[long]

    register = opening ^ own
    spaced = advance(np.full(begin.size, _STEP[32]), length) ^ own
    out = [(text, register ^ ONES)]
    for n in range(2, LONGEST_RUN + 1):
        register = advance(register[:-1], length[n - 1 :] + 1) ^ spaced[n - 1 :]
        one_text = text[n - 1 :] == text[: max(0, text.size - n + 1)]
        out.append((text[n - 1 :][one_text], register[one_text] ^ ONES))
        if not register.size:
            break
    return np.bincount(text, minlength=starts.size), out


def _chunks(column: pa.BinaryArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, past the last, bytes, starts, ends) of some texts at a time."""
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + CHUNK_BYTES, side="right")) - 1)
        yield low, high, data, offsets[low:high], offsets[low + 1 : high + 1]
        low = high


def _bytes(text) -> F.Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def bucket_counts(table: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket. A task sends one row a bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, starts, ends in _chunks(batch.column(0)):
                for _, crc in features(data, starts, ends)[1]:
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    parts = table.select(_bytes(F.col(text)).alias("text")).mapInArrow(count, "bucket bigint, n bigint")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the target's smoothed share of each bucket over the corpus's."""
    s, t, m = corpus.astype(np.float64), target.astype(np.float64), float(corpus.size)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + m) / ((s + 1) * (t.sum() + m)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value.astype(np.float64)
        for batch in batches:
            for low, high, data, starts, ends in _chunks(batch.column(1)):
                words, runs = features(data, starts, ends)
                n, total = np.zeros(high - low, np.int64), np.zeros(high - low)
                for text, crc in runs:
                    n += np.bincount(text, minlength=high - low)
                    # Whole numbers far below 2^53, so these sums are exact.
                    total += np.bincount(text, weights=gain[crc % np.uint32(gain.size)], minlength=high - low)
                columns = [pa.array(x.astype(np.int64)) for x in (words, n, total)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *columns], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select("doc_id", _bytes(F.col("text")).alias("text"))
    return rows.mapInArrow(weigh, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id: F.Column, seed: int) -> F.Column:
    """floor(1000 times a Gumbel number), the same for an id at every run; a null id counts as the empty text."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def _key(score: int, doc_id, row: int) -> tuple:
    """Order of the draw: larger scores, then smaller ids, rows without an id last, then rows as they lie."""
    return (-score, doc_id is None, 0 if doc_id is None else doc_id, row)


def _in_order(*first: str) -> list[F.Column]:
    return [*map(F.col, first), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col(ROW).asc()]


def splitters(scored: DataFrame, rows: int, segments: int) -> list[tuple]:
    """``segments`` - 1 keys, at most, that cut all rows into about equal segments.

    Each part of the table is one run, sorted where it lies; it gives every
    ``step``-th of its keys. No segment holds more than rows / segments plus one step
    of each run.
    """
    step = max(1, rows // segments**2)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            first = (step // 2 - seen) % step
            seen += batch.num_rows
            yield batch.take(pa.array(range(first, batch.num_rows, step), pa.int64()))

    runs = scored.select("score", "doc_id", ROW).sortWithinPartitions(*_in_order())
    keys = sorted(_key(*r) for r in runs.mapInArrow(sample, runs.schema).collect())
    return [keys[len(keys) * i // segments] for i in range(1, segments)] if keys else []


def _dealt(scored: DataFrame, cuts: list[tuple]) -> DataFrame:
    """``scored`` with the segment of each row: the number of splitters up to its key."""
    shared = scored.sparkSession.sparkContext.broadcast(cuts)
    names = scored.columns

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = shared.value
        first = np.array([c[0] for c in cuts], np.int64)
        for batch in batches:
            score, ids, rows = (batch.column(names.index(n)) for n in ("score", "doc_id", ROW))
            at = -score.to_numpy(zero_copy_only=False)
            segment = np.searchsorted(first, at, side="left")
            # Only scores equal to a splitter's need its whole key.
            for i in np.flatnonzero(segment != np.searchsorted(first, at, side="right")).tolist():
                segment[i] = bisect_right(cuts, _key(score[i].as_py(), ids[i].as_py(), rows[i].as_py()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segment.astype(np.int32))], names=[*names, "segment"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scored.schema)
    return scored.mapInArrow(deal, f"{types}, segment int")


def ranked(scored: DataFrame, draw: int, rows: int, segments: int | None = None) -> DataFrame:
    """``scored`` (doc_id, score, _row, ``open``, ...) with ``rank``: 1 to ``draw`` in order of the draw, null beyond it and for rows that are not ``open``.

    ``rows`` is the number of open rows; ``scored`` must read the same each time.
    """
    spark = scored.sparkSession
    if segments is None:
        segments = max(1, min(SEGMENTS_MOST, max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // SEGMENT_ROWS)))
    out = [F.col(n) for n in scored.columns]
    if draw < 1:
        return scored.select(*out, F.lit(None).cast("bigint").alias("rank"))
    cuts = splitters(scored.where("open"), rows, segments)
    dealt = _dealt(scored, cuts)
    sizes = {r["segment"]: r["n"] for r in dealt.where("open").groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = {}, 0
    for s in sorted(sizes):
        if total < draw:
            before[s] = total
        total += sizes[s]
    last = max(before)
    names = scored.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, done = None, 0
        for batch in batches:
            segment = batch.column(len(names)).to_numpy()
            rank = np.zeros(segment.size, np.int64)
            cut = np.flatnonzero(np.diff(segment, prepend=-1)).tolist()
            for low, high in zip(cut, [*cut[1:], segment.size]):
                if segment[low] != current:
                    current, done = int(segment[low]), before[int(segment[low])]
                rank[low:high] = np.arange(done + 1, done + 1 + high - low)
                done += high - low
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(rank, mask=rank > draw)], names=[*names, "rank"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scored.schema)
    reached = dealt.where(F.col("open") & (F.col("segment") <= last)).repartitionById(last + 1, "segment")
    drawn = reached.sortWithinPartitions(*_in_order("segment")).mapInArrow(number, f"{types}, rank bigint")
    rest = dealt.where(~F.col("open") | (F.col("segment") > last)).select(*out, F.lit(None).cast("bigint").alias("rank"))
    return drawn.unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): every row of ``docs``; ``rank`` numbers the drawn ones.

    Of the N texts with at least ``least_words`` words, floor(percent * N / 100) are
    drawn: the highest scores, ties to the smaller id, then to the row that lies
    first; rows without an id come last among equals. Words are runs of digits, of
    letters (A-Z lower-cased) and of any characters beyond ASCII. A null text has no
    words and weight 0; repeated rows are rows of their own with equal scores. Without
    target texts all gains compare with an empty target; an empty table gives no rows.
    Other columns are dropped. ``docs`` must read the same each time.
    """
    gain = gains(bucket_counts(docs, buckets=buckets), bucket_counts(target, buckets=buckets))
    scored = weights(docs, gain).select("*", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), (F.col("n_words") >= least_words).alias("open"))
    scored = stored(scored.select(F.monotonically_increasing_id().alias(ROW), "*"), "scored")
    rows = scored.where("open").count()
    return ranked(scored, percent * rows // 100, rows).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
