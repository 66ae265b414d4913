"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide.

1. Each text becomes its set of word n-grams (64-bit hashes), a key of the whole
   set and MinHash bands. Band and row counts follow from the target recall.
2. Rows with one key are one class of equal texts; only its smallest row goes on.
3. Band hashes are shuffled; representatives that share one are tied together, and
   tied representatives form candidate groups.
4. Within a group every pair is verified on the full sets, block against block, in
   steps of bounded size. A step returns each representative's number of links and a
   spanning forest, not the pairs, so a large group costs time but never rows.
5. Linked representatives form the near-copy groups.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placemill.llm.common import ROW, packed, stored
from placemill.operators.components import connected_components

WORD = re.compile(r"\w+")
MEMO_MOST = 1_000_000
# A block of a group holds about this many n-grams and texts at most; one text may be longer than that.
BLOCK_GRAMS = 400_000
BLOCK_TEXTS = 400


def choose_bands(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): of those that find a pair at ``threshold`` with probability ``recall``, the most selective.

    A pair of similarity s shares a band with probability 1 - (1 - s^rows)^bands.
    More rows bring fewer chance candidates; bands are as many as the recall needs.
    """
    best = (1, 1)
    for rows in range(1, most + 1):
        hit = threshold**rows
        if hit <= 0:
            break
        bands = 1 if hit >= 1 else int(np.ceil(np.log(max(1e-12, 1 - recall)) / np.log1p(-hit)))
        if bands * rows <= most:
            best = (max(1, bands), rows)
    return best


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_MOST:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _WordHashes()
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def gram_hashes(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams; a text of fewer words has one, of all its words."""
    words = WORD.findall(text.lower()) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(n, h.size)
    out = h[: h.size - size + 1].copy()
    for i in range(1, size):
        out = out * _MULTIPLY + h[i : h.size - size + 1 + i]
    out ^= out >> np.uint64(32)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return np.unique(out)


class Bands:
    """MinHash values of a set, each band's rows folded into one 64-bit hash."""

    def __init__(self, bands: int, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        count = bands * rows
        self.multiply = rng.integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 2**63, count, dtype=np.uint64)
        self.fold = rng.integers(1, 2**63, (1, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shape = (bands, rows)

    def of(self, grams: np.ndarray) -> np.ndarray:
        low = np.full(self.multiply.size, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, grams.size, 1024):
            low = np.minimum(low, (grams[i : i + 1024, None] * self.multiply + self.add).min(axis=0))
        h = ((low.reshape(self.shape) ^ (low.reshape(self.shape) >> np.uint64(31))) * self.fold).sum(axis=1, dtype=np.uint64)
        return (h ^ (h >> np.uint64(33))).view(np.int64)


def signatures(rows: DataFrame, n: int, bands: int, band_rows: int) -> DataFrame:
    """(row, doc_id, set_key, grams, bands): one line for each text; texts without a word have no key and no bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Bands(bands, band_rows)
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                keys, sizes, found = [], [], []
                for text in part.column(2):
                    grams = gram_hashes(text.as_py(), n)
                    sizes.append(grams.size)
                    keys.append(xxhash.xxh3_128_digest(grams.tobytes()) if grams.size else None)
                    found.append(make.of(grams) if grams.size else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                    names=[ROW, "doc_id", "set_key", "grams", "bands"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select(ROW, "doc_id", "text").mapInArrow(sign, f"{ROW} bigint, doc_id {kind}, set_key binary, grams bigint, bands array<bigint>")


def _tied(reps: DataFrame) -> DataFrame:
    """(u, v): each representative with the smallest one that shares a band hash with it."""
    buckets = reps.select(ROW, F.posexplode("bands").alias("band", "h"))
    low = buckets.groupBy("band", "h").agg(F.min(ROW).alias("u"), F.max(ROW).alias("top")).where("u < top").drop("top")
    return buckets.join(low, ["band", "h"]).where(F.col("u") != F.col(ROW)).select("u", F.col(ROW).alias("v")).distinct()


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set in a with every set in b: a sparse product by way of shared n-grams."""
    grams_a, grams_b = np.concatenate(a), np.concatenate(b)
    who_a = np.repeat(np.arange(len(a)), [x.size for x in a])
    who_b = np.repeat(np.arange(len(b)), [x.size for x in b])
    shared = np.intersect1d(grams_a, grams_b)
    out = np.zeros((len(a), len(b)), np.float32)
    for low in range(0, shared.size, 4096):
        part = shared[low : low + 4096]
        dense = []
        for grams, who, count in ((grams_a, who_a, len(a)), (grams_b, who_b, len(b))):
            at = np.searchsorted(part, grams)
            at[at == part.size] = 0
            hit = part[at] == grams
            m = np.zeros((count, part.size), np.float32)
            m[who[hit], at[hit]] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def _forest(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Those of the links that join two trees so far apart: at most one fewer than there are texts."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for u, v in zip(left.tolist(), right.tolist()):
        a, b = root(u), root(v)
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append((u, v))
    return kept


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first ``keys`` columns; the rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = [batch.column(k).to_numpy() for k in range(keys)]
        cuts = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            key = tuple(m[low] for m in marks)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _verify(threshold: float, n: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each pair of blocks: links of each text, weighted by the other class's size, and a forest of links."""
        for group in _groups(batches, 3):
            _, i, j, side, ids, copies = (group.column(k).to_numpy() for k in range(6))
            sets = [gram_hashes(t.as_py(), n) for t in group.column(6)]
            sizes = np.array([x.size for x in sets], np.float64)
            alone = i[0] == j[0]
            a = np.flatnonzero(side == 0)
            b = a if alone else np.flatnonzero(side == 1)
            if not a.size or not b.size:
                continue
            both = _overlaps([sets[x] for x in a], [sets[x] for x in b]).astype(np.float64)
            linked = both >= threshold * (sizes[a][:, None] + sizes[b][None, :] - both) - 1e-9
            at = np.argwhere(np.triu(linked, 1) if alone else linked)
            left, right = a[at[:, 0]], b[at[:, 1]]
            who, back = np.unique(np.r_[ids[left], ids[right]], return_inverse=True)
            links = np.bincount(back, weights=np.r_[copies[right], copies[left]], minlength=who.size).astype(np.int64)
            tree = np.array(_forest(ids[left], ids[right]), dtype=np.int64).reshape(-1, 2)
            none = np.zeros(len(tree), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (np.r_[who, tree[:, 0]], np.r_[who, tree[:, 1]], np.r_[links, none], np.r_[np.bincount(back, minlength=who.size), none])],
                names=["u", "v", "links", "text_links"],
            )

    return check


def link_rows(rows: DataFrame, n: int, threshold: float, recall: float) -> DataFrame:
    """Each row of ``rows`` (row, doc_id, text) with its class, links and whether its group keeps it."""
    bands, band_rows = choose_bands(threshold, recall)
    signed = stored(signatures(rows, n, bands, band_rows), "signatures")
    by_id = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", ROW)
    classes = signed.where("set_key is not null").groupBy("set_key").agg(F.min(by_id).alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = stored(classes.select("set_key", "first", F.col(f"first.{ROW}").alias("rep"), "copies"), "classes")
    reps = stored(signed.join(classes.select(F.col("rep").alias(ROW), "copies"), ROW).select(ROW, "grams", "bands", "copies"), "representatives")
    groups = connected_components(_tied(reps)).withColumnRenamed("node", ROW)
    members = stored(reps.select(ROW, "grams", "copies").join(groups, ROW), "members")
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("texts"), F.sum("grams").alias("total"))
    blocks = sizes.select("component", F.greatest(F.ceil(F.col("texts") / BLOCK_TEXTS), F.ceil(F.col("total") / BLOCK_GRAMS)).cast("bigint").alias("blocks"))
    placed = members.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64(ROW), F.col("blocks")))
    # A merge join at every size: the texts move once, however few rows small tables leave on the other side.
    placed = rows.select(ROW, "text").join(placed.hint("merge"), ROW)
    # Each text goes to the pairs of blocks that its own is part of; to a block with itself once.
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).select(
        "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("bigint").alias("side"), ROW, "copies", "text"
    )
    dealt = pairs.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    found = stored(dealt.mapInArrow(_verify(threshold, n), "u bigint, v bigint, links bigint, text_links bigint"), "links")
    links = found.where("u = v").groupBy("u").agg(F.sum("links").alias("links"), F.sum("text_links").alias("text_links"))
    near = connected_components(found.where("u <> v").select("u", "v"))
    per_class = classes.join(links.withColumnRenamed("u", "rep"), "rep", "left").join(near.withColumnRenamed("node", "rep"), "rep", "left")
    per_class = per_class.withColumn("component", F.coalesce("component", "rep"))
    names = per_class.groupBy("component").agg(F.min("first").alias("keep"))
    per_class = per_class.join(names, "component").drop("component", "rep")
    # A text without words has a key of its own here, so that such rows do not meet in one task.
    key = F.coalesce("set_key", F.concat(F.lit("-"), F.col(ROW).cast("string")).cast("binary"))
    out = signed.select(ROW, "doc_id", key.alias("set_key")).join(per_class, "set_key", "left")
    return out.select(
        ROW, "doc_id", F.coalesce("keep.doc_id", "doc_id").alias("class_id"), F.coalesce("first.doc_id", "doc_id").alias("copy_of"),
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_links"),
        F.coalesce("text_links", F.lit(0)).alias("n_text_links"), (F.coalesce(f"keep.{ROW}", ROW) == F.col(ROW)).alias("keeps"),
    )


def jaccard_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """(doc_id, class_id, copy_of, n_links, n_text_links): every row of ``docs`` with what it is linked to.

    Two texts are linked if the Jaccard similarity of their sets of ``n`` lower-case
    words in a row is at least ``threshold``. ``copy_of`` is the smallest id with
    the same set, ``n_text_links`` counts the classes of equal sets linked to the
    row's own, ``n_links`` all other rows linked to it, copies included, and
    ``class_id`` is the smallest id of the group that links hold together.

    A text without a word, null ones included, is linked to nothing and a class of
    its own. A text of fewer than n words has one n-gram, of all its words. Rows
    with the same id are separate; an id of null names a class only where no row of
    the class has an id. An empty table gives no rows; other columns are dropped.
    ``docs`` must read the same each time, as a stored table does.
    """
    rows = docs.select(F.monotonically_increasing_id().alias(ROW), "doc_id", "text")
    return link_rows(rows, n, threshold, recall).drop(ROW, "keeps")


def keep_one(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """The rows of ``docs`` without those linked, near or far, to a row of smaller id: one row of each group stays."""
    rows = packed(docs)
    gone = link_rows(rows.select(ROW, "whole.doc_id", "whole.text"), n, threshold, recall).where("not keeps").select(ROW)
    return rows.join(gone.hint("merge"), ROW, "left_anti").select("whole.*")
