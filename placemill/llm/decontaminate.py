"""Benchmark decontamination with spaced seeds, in DataFrame functions only.

A mask of ones and zeros is laid over every stretch of words in the test and the
training texts; only words under a one are hashed, so a hit survives substituted
words under the zeros. Hits give an alignment of item and text, and the item's
words are then compared with the text's along it, substitutions and all.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemill.llm.common import ROW, once, packed

# Every alignment with SHARE of an item's words, LEAST or more, has hits of these (``sure_hits``), wherever the others stand.
MASKS = ("111", "1101")
SHARE = 0.6
LEAST = 8
# Test hashes up to this many (about 100 MB as a hash table) are sent to every task; more are joined by a shuffle.
BROADCAST_HASHES = 1_000_000
# Up to this length sure hits are counted out; a longer item has a stretch of half to all of it with its share of equal words.
COUNTED = 500


def words_of(text: Column) -> Column:
    """Lower-case words: runs of letters, digits and marks."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}\p{M}]+"), lambda w: w != "")


def seed_hashes(hashes: Column, mask: str, number: int) -> Column:
    """Hash of the words under the mask's ones at every position it fits, in order."""
    ones = [i for i, m in enumerate(mask) if m == "1"]
    at = lambda p: F.xxhash64(F.lit(number), *[F.get(hashes, p + i) for i in ones])
    last = F.size(hashes) - len(mask)
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), at)).otherwise(F.array().cast("array<bigint>"))


def sure_hits(share: float, least: int, masks: tuple[str, ...], longest: int = COUNTED) -> list[int]:
    """For items of 0, 1, ... words: the fewest hits of any alignment in which ``share`` of the words are equal, ``least`` at least.

    Dynamic programming over the words, by the last words' equality and the number of equal ones.
    """
    span = max(map(len, masks))
    after = np.arange(1 << span)
    hits = sum(((after & int(m, 2)) == int(m, 2)).astype(np.int64) for m in masks)
    never = 1 << 40
    fewest = np.full((1 << (span - 1), longest + 2), never)
    fewest[0, 0] = 0
    out = [0]
    for n in range(1, longest + 1):
        new = np.full_like(fewest, never)
        for w in after:
            old, bit = fewest[w >> 1], w & 1
            to = new[w & ((1 << (span - 1)) - 1)]
            np.minimum(to[bit:], old[: old.size - bit] + hits[w], out=to[bit:])
        fewest = new
        lowest = int(fewest[:, max(least, math.ceil(share * n)) :].min(initial=never))
        out.append(0 if lowest >= never else lowest)
    return out


def _hits_needed(n_words: Column, share: float, least: int, masks: tuple[str, ...]) -> Column:
    """Hits below which no alignment can be an occurrence; one at least, as nothing else is retrieved."""
    sure = [max(1, x) for x in sure_hits(share, least, masks)]
    return F.coalesce(F.get(F.array(*map(F.lit, sure)), n_words), F.lit(min(sure[COUNTED // 2 :])))


def _seeds(rows: DataFrame, keep: list[str], masks: tuple[str, ...]) -> DataFrame:
    """(keep..., pos, seed): one line for each mask and position; ``hashes`` are the word hashes."""
    all_ = F.array(*[seed_hashes(F.col("hashes"), m, i) for i, m in enumerate(masks)])
    by_mask = rows.select(*keep, F.explode(all_).alias("seeds"))
    return by_mask.select(*keep, F.posexplode("seeds").alias("pos", "seed"))


def _matches(doc: Column, item: Column, shift: Column) -> Column:
    """How many of the item's words equal the text's, the item's first word lying at ``shift``."""
    return F.size(F.filter(F.sequence(F.lit(0), F.size(item) - 1), lambda k: F.coalesce(
        F.when(k + shift >= 0, F.get(doc, (k + shift).cast("int")) == F.get(item, k.cast("int"))), F.lit(False))))


def overlaps(docs: DataFrame, tests: DataFrame, share: float = SHARE, least: int = LEAST, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """(row, doc_id, item_id, first_word, n_match, n_words): verified occurrences of test items in texts.

    ``n_match`` of the item's ``n_words`` words stand in the text where the alignment
    puts them; at least ``share`` of them must, and at least ``least`` words. Items of
    fewer than ``least`` words, or shorter than all masks, are not looked for. With
    the default masks no occurrence is missed; with others, or a smaller share, those
    are for which ``sure_hits`` is 0 and no mask happens to fit. Null and empty texts
    and items match nothing; rows with equal ids are separate. Hits of shared seeds
    are counted by alignment, and those with too few for an occurrence dropped,
    before any text moves.
    """
    items = tests.select("item_id", F.transform(words_of(F.coalesce("text", F.lit(""))), lambda w: F.xxhash64(w)).alias("hashes"))
    items = items.where(F.size("hashes") >= max(least, min(map(len, masks)))).withColumn("key", F.xxhash64("item_id", "hashes"))
    rows = once(docs.select(ROW, "text"), "hashes", F.transform(words_of(F.coalesce("text", F.lit(""))), lambda w: F.xxhash64(w)))
    needed = _hits_needed(F.size("hashes"), share, least, masks).alias("needed")
    seeds = _seeds(items.select("key", "hashes", needed).dropDuplicates(["key"]), ["key", "needed"], masks).withColumnRenamed("pos", "item_pos")
    small = seeds.count() <= BROADCAST_HASHES
    seeds = F.broadcast(seeds) if small else seeds
    hits = _seeds(rows.select(ROW, "hashes"), [ROW], masks).join(seeds, "seed")
    counted = hits.groupBy(ROW, "key", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(F.count(F.lit(1)).alias("n"), F.max("needed").alias("needed"))
    aligned = counted.where(F.col("n") >= F.col("needed")).select(ROW, "key", "shift")
    wanted = items.select("key", F.col("item_id"), F.col("hashes").alias("item"))
    wanted = F.broadcast(wanted) if small else wanted
    # Texts meet their alignments as texts: hashes of all words would be twice as much to shuffle.
    found = aligned.join(wanted, "key").join(docs.select(ROW, "doc_id", "text").hint("merge"), ROW)
    found = once(found, "hashes", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w))).drop("text")
    checked = once(found, "n_match", _matches(F.col("hashes"), F.col("item"), F.col("shift")).cast("bigint")).select(
        ROW, "doc_id", "item_id", F.col("shift").cast("bigint").alias("first_word"), "n_match", F.size("item").cast("bigint").alias("n_words")
    )
    return checked.where((F.col("n_match") >= F.ceil(share * F.col("n_words"))) & (F.col("n_match") >= least))


def contamination(docs: DataFrame, tests: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, n_match, n_words, n_places): each text and item once, by its best alignment.

    Options as for ``overlaps``. Rows of ``docs`` with one id count as one text here.
    """
    rows = docs.select(F.monotonically_increasing_id().alias(ROW), "doc_id", "text")
    best = F.max("n_match").alias("n_match")
    return overlaps(rows, tests, **options).groupBy("doc_id", "item_id").agg(best, F.max("n_words").alias("n_words"), F.count(F.lit(1)).alias("n_places"))


def remove_contaminated(docs: DataFrame, tests: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no test item was found; all columns stay. ``docs`` must read the same each time."""
    rows = packed(docs)
    found = overlaps(rows.select(ROW, "whole.doc_id", "whole.text"), tests, **options).select(ROW).distinct()
    return rows.join(found.hint("merge"), ROW, "left_anti").select("whole.*")
