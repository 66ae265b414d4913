"""Removal of repeated byte strings by bucket-pointer refinement.

Every start of a string of ``length`` bytes is a suffix that is sorted by its first
``length`` bytes only as far as it must be:

1. The first buckets are those of q-grams. Of the q-grams in a window of ``length``
   bytes the one with the smallest hash, leftmost at ties, stands for the window;
   windows side by side that share it are one node. Equal windows have equal q-grams
   at equal distances, so they are in one bucket, and one node stands for some 35
   starts. Buckets of a single node hold nothing that repeats and go.
2. Within a bucket, nodes whose whole strings agree are settled but for the first:
   what they cover occurs earlier. A bucket that still holds different nodes is
   refined: its nodes are cut into blocks of starts, and a block's bucket is named by
   the bucket identifiers at later offsets within the bytes that its windows share.
   The same step is used again on these buckets, and at last on single starts.
3. The first nodes of each kind alone go on, and what is settled is a list of spans.

An identifier is a hash of the bytes, so a bucket's name is put together from the
names of its q-grams without numbering buckets, and every step is a sum by key and a
join. Texts are moved twice: to the starts still open after the first step, and to
their spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placemill.llm.common import ROW
from placemill.llm.scratch import Scratch

LENGTH = 100
# A task looks at about so many bytes at once; longer texts are cut into pieces that overlap.
CHUNK_BYTES = 1 << 20
NODE = "key bigint, cls bigint, doc_id {kind}, _row bigint, base int, at int, lo int, hi int"
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_MIX = [np.uint64(0x9FB21C651E98DF25), np.uint64(0xFF51AFD7ED558CCD)]


def gram_of(length: int) -> int:
    """Bytes of a q-gram: a third of the string, in words of eight bytes, 32 at most."""
    if length < 8:
        raise ValueError("strings of less than eight bytes")
    return 8 * max(1, min(4, length // 24))


def block_of(length: int) -> int:
    """Starts of a block: about the root of a node's most."""
    return max(1, round((length - gram_of(length) + 1) ** 0.5))


def _mixed(x: np.ndarray, mix: np.uint64) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * mix
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray, q: int, hashes: int = 2) -> tuple[np.ndarray, np.ndarray | None]:
    """Two hashes of the q-gram at each byte of ``data``, or one."""
    n = data.size - q + 1
    words = np.ndarray((data.size - 7,), "<u8", data, strides=(1,))
    out = []
    for mix in _MIX[:hashes]:
        h = np.full(n, mix ^ _ODD[0])
        for k in range(q // 8):
            x = words[8 * k : 8 * k + n] * _ODD[k]
            x ^= x >> np.uint64(32)
            h ^= x
            h = _mixed(h, mix)
        out.append(h)
    return out[0], out[1] if hashes > 1 else None


def name_of(h: np.ndarray, start: np.ndarray, end: np.ndarray, q: int, seed: np.ndarray | int, steps: int) -> np.ndarray:
    """Identifier of the bytes from start to end (``steps`` * q at most), out of the q-grams' at 0, q, 2q, ... and at the end."""
    out = np.zeros(start.size, np.uint64) + np.asarray(seed).astype(np.uint64) * _ODD[1] + (end - start).astype(np.uint64) * _ODD[2]
    for k in range(steps):
        out = _mixed((out ^ h[np.minimum(start + k * q, end - q)]) * _ODD[3], _MIX[0])
    return out


def owners(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest hash, leftmost at ties, among each ``width`` places in a row."""
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(h.size, dtype=np.uint64)
    n, have = h.size - width + 1, 1
    while 2 * have <= width:
        least, have = np.minimum(least[:-have], least[have:]), 2 * have
    rest = width - have
    return (np.minimum(least[:n], least[rest : rest + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def pieces(column: pa.BinaryArray, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, bytes, starts, ends, places of the pieces in their texts): whole texts of about a chunk together, or one piece of a long text."""
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8) if n else None
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + CHUNK_BYTES, side="right")) - 1)
        first, past = int(offsets[low]), int(offsets[high])
        if past - first <= 2 * CHUNK_BYTES:
            yield np.arange(low, high), data[first:past], offsets[low:high] - first, offsets[low + 1 : high + 1] - first, np.zeros(high - low, np.int64)
        else:
            for a in range(0, past - first - overlap, CHUNK_BYTES):
                part = data[first + a : min(past, first + a + CHUNK_BYTES + overlap)]
                yield np.array([low]), part, np.zeros(1, np.int64), np.array([part.size]), np.array([a])
        low = high


def text_nodes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, keys_only: bool = False) -> tuple[np.ndarray, ...]:
    """(text, key, cls, at, lo, hi): the nodes of texts that lie one behind the other.

    lo to hi are the starts, ``at`` the place of their q-gram, all places in ``data``.
    With ``keys_only`` there are no classes.
    """
    q = gram_of(length)
    if data.size < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    h1, h2 = gram_hashes(data, q, 1 if keys_only else 2)
    owner = owners(h1, length - q + 1)
    long = ends - starts >= length
    edge = np.zeros(owner.size + 1, np.int8)
    edge[starts[long]] = 1
    edge[ends[long] - length + 1] = -1
    valid = np.cumsum(edge[:-1], dtype=np.int8) > 0
    first, last = valid.copy(), valid.copy()
    same = owner[1:] == owner[:-1]
    first[1:] &= ~(valid[:-1] & same)
    last[:-1] &= ~(valid[1:] & same)
    lo, hi = np.flatnonzero(first), np.flatnonzero(last)
    at = owner[lo]
    cls = None if keys_only else name_of(h2, lo, hi + length, q, at - lo, -(-(2 * length - q) // q))
    return np.searchsorted(starts, lo, side="right") - 1, h1[at], cls, at, lo, hi


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def first_keys(rows: DataFrame, length: int) -> DataFrame:
    """(key) of each node of whole texts, to be counted."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, starts, ends, _ in pieces(batch.column(0), length - 1):
                keys = _signed(text_nodes(data, starts, ends, length, keys_only=True)[1])
                for a in range(0, len(keys), 100_000):
                    yield pa.RecordBatch.from_arrays([keys.slice(a, 100_000)], names=["key"])

    return rows.select("text").mapInArrow(make, "key bigint")


def first_nodes(rows: DataFrame, length: int) -> DataFrame:
    """The nodes of whole texts. ``rows``: (_row, doc_id, text as bytes)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for which, data, starts, ends, place in pieces(batch.column(2), length - 1):
                text, key, cls, at, lo, hi = text_nodes(data, starts, ends, length)
                if not text.size:
                    continue
                take, shift = pa.array(which[text]), place[text] - starts[text]
                lo_, at_, hi_ = (pa.array((x + shift).astype(np.int32)) for x in (lo, at, hi))
                columns = [_signed(key), _signed(cls), batch.column(1).take(take), batch.column(0).take(take), lo_, at_, lo_, hi_]
                # Spark's memory for a batch of rows is bounded by sending some at a time.
                for a in range(0, text.size, 50_000):
                    yield pa.RecordBatch.from_arrays([c.slice(a, 50_000) for c in columns], names=names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["key", "cls", "doc_id", ROW, "base", "at", "lo", "hi"]
    return rows.select(ROW, "doc_id", "text").mapInArrow(make, NODE.format(kind=kind))


def contexts(rows: DataFrame, nodes: DataFrame, length: int) -> DataFrame:
    """(doc_id, _row, base, at, lo, hi, bytes): the open nodes with the bytes from ``base``, which is ``lo``, to the end of the last window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, found = [], []
            size = 0
            for i, (text, nodes) in enumerate(zip(batch.column(2), batch.column(3))):
                text = text.as_buffer()
                for lo, at, hi in zip(*(nodes.values.field(k).to_pylist() for k in range(3))):
                    take.append(i)
                    found.append((lo, at, lo, hi, text[lo : hi + length].to_pybytes()))
                    size += hi - lo + length
                    if size > CHUNK_BYTES:
                        yield pack(batch, take, found)
                        take, found, size = [], [], 0
            if take:
                yield pack(batch, take, found)

    def pack(batch: pa.RecordBatch, take: list[int], found: list[tuple]) -> pa.RecordBatch:
        which = pa.array(take, pa.int64())
        columns = [pa.array(x, t) for x, t in zip(zip(*found), (*[pa.int32()] * 4, pa.binary()))]
        return pa.RecordBatch.from_arrays([batch.column(1).take(which), batch.column(0).take(which), *columns], names=["doc_id", ROW, "base", "at", "lo", "hi", "bytes"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    asked = nodes.groupBy(ROW).agg(F.collect_list(F.struct("lo", "at", "hi")).alias("nodes"))
    joined = rows.join(asked.hint("merge"), ROW).select(ROW, "doc_id", "text", "nodes")
    return joined.mapInArrow(cut, f"doc_id {kind}, {ROW} bigint, base int, at int, lo int, hi int, bytes binary")


def finer_nodes(held: DataFrame, length: int, width: int) -> DataFrame:
    """Nodes of ``width`` starts at most out of ``held`` (doc_id, _row, base, at, lo, hi, bytes).

    A block's key names the bytes that all windows of a full block share, its class
    all bytes of those it has. Blocks count from the q-gram, so equal windows are in
    blocks of the same number.
    """
    q = gram_of(length)
    most = length - q

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for which, data, starts, _, _ in pieces(batch.column(6), length - 1):
                if not which.size:
                    continue
                h1, h2 = gram_hashes(data, q)
                base, at, lo, hi = (batch.column(k).to_numpy()[which].astype(np.int64) for k in range(2, 6))
                low, high = (at - hi) // width, (at - lo) // width
                n = high - low + 1
                node = np.repeat(np.arange(which.size), n)
                block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[node]
                shift = starts[node] - base[node]
                front, back = at[node] - np.minimum(block * width + width - 1, most), at[node] - block * width
                lo_, hi_ = np.maximum(lo[node], front), np.minimum(hi[node], back)
                key = name_of(h1, shift + back, shift + front + length, q, block, -(-length // q))
                cls = name_of(h2, shift + lo_, shift + hi_ + length, q, at[node] - lo_, -(-(length + width) // q))
                take = pa.array(which[node])
                columns = [_signed(key), _signed(cls), *(batch.column(k).take(take) for k in range(4)), *(pa.array(x.astype(np.int32)) for x in (lo_, hi_))]
                for a in range(0, node.size, 50_000):
                    yield pa.RecordBatch.from_arrays([c.slice(a, 50_000) for c in columns], names=["key", "cls", "doc_id", ROW, "base", "at", "lo", "hi"])

    kind = held.schema["doc_id"].dataType.simpleString()
    return held.select("doc_id", ROW, "base", "at", "lo", "hi", "bytes").mapInArrow(make, NODE.format(kind=kind))


def refine(nodes: DataFrame, keys: DataFrame, scratch: Scratch, go_on: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """(spans, open): starts that are settled as (_row, lo, hi), and the first node of each class in buckets of several classes.

    The first is by id, rows without an id last, then by row as it lies, then by
    place. ``keys`` has the key of each node. Counts and firsts are partial sums before
    they are shuffled; they are written, so that a bucket that many nodes share is a
    hot key of plain equality joins alone, which Spark splits.
    """
    several = scratch.keep(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "several")
    shared = scratch.keep(nodes.join(several, "key", "left_semi"), "buckets")
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", ROW, "lo", "hi", "at", "base")
    classes = scratch.keep(shared.groupBy("key", "cls").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")), "classes")
    repeated = classes.where("n > 1").select("key", "cls", F.col(f"first.{ROW}").alias("first_row"), F.col("first.lo").alias("first_lo"))
    spans = shared.join(repeated, ["key", "cls"]).where((F.col(ROW) != F.col("first_row")) | (F.col("lo") != F.col("first_lo")))
    spans = scratch.keep(spans.select(ROW, "lo", "hi"), "spans")
    opened = None
    if go_on:
        mixed = scratch.keep(classes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "mixed")
        opened = scratch.keep(classes.join(mixed, "key", "left_semi").select("first.doc_id", f"first.{ROW}", "first.base", "first.at", "first.lo", "first.hi"), "open")
        scratch.drop(mixed)
    scratch.drop(several, shared, classes)
    return spans, opened


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, kept, n_bytes, removed): every row without the bytes that a string of ``length`` bytes covers which also starts earlier.

    Texts are UTF-8 bytes; ``kept`` is binary, as a cut may fall inside a letter.
    ``removed`` lists the maximal cut spans in order as (start, end), end exclusive.
    Earlier is a smaller id, or an earlier start in the same text, also an
    overlapping one; of rows with one id, or equal altogether, the one that lies
    first is earlier, and rows without an id come last. Strings never cross texts and
    are judged on the texts as given. A null text counts as empty; texts shorter than
    ``length`` stay whole. An empty table gives no rows; other columns are dropped.
    ``docs`` must read the same each time. Strings are told apart by 128 bits of hashes.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias(ROW), "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    by_node, opened = refine(first_nodes(rows, length), first_keys(rows, length), scratch)
    held = scratch.keep(contexts(rows, opened, length), "contexts")
    finer = finer_nodes(held, length, block_of(length))
    by_block, blocks = refine(finer, finer.select("key"), scratch)
    single = blocks.select(ROW, "base", "at", "lo", "hi").join(held.select("doc_id", ROW, "base", "bytes").hint("merge"), [ROW, "base"])
    finest = finer_nodes(single, length, 1)
    by_start, _ = refine(finest, finest.select("key"), scratch, go_on=False)
    scratch.drop(opened, blocks, held)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = 0
            while low < batch.num_rows:
                kept, sizes, removed, size, high = [], [], [], 0, low
                while high < batch.num_rows and size <= CHUNK_BYTES:
                    text, spans = batch.column(1)[high].as_py(), batch.column(2)[high]
                    gaps = _merged(spans, length) if spans.is_valid else []
                    whole = [text[a:b] for a, b in zip([0, *(b for _, b in gaps)], [*(a for a, _ in gaps), len(text)])]
                    kept.append(b"".join(whole))
                    sizes.append(len(text))
                    removed.append([{"start": a, "end": b} for a, b in gaps])
                    size += len(text)
                    high += 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    names=["doc_id", "kept", "n_bytes", "removed"],
                )
                low = high

    spans = by_node.unionByName(by_block).unionByName(by_start).groupBy(ROW).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = rows.join(spans.hint("merge"), ROW, "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut, f"doc_id {kind}, kept binary, n_bytes bigint, removed array<struct<start:bigint,end:bigint>>")


def _merged(spans: pa.ListScalar, length: int) -> list[tuple[int, int]]:
    """The maximal spans that strings begun at lo to hi cover."""
    lo, hi = (spans.values.field(k).to_numpy().astype(np.int64) for k in range(2))
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate(hi[order] + length)
    new = np.flatnonzero(np.r_[True, lo[1:] > end[:-1]])
    return list(zip(lo[new].tolist(), end[np.r_[new[1:] - 1, lo.size - 1]].tolist()))
