"""Substring deduplication by lines, paragraphs or passages.

Each text is cut into units; a unit is normalised (lower case, single spaces) and
becomes a 128-bit digest. Of all units with one digest the earliest stays, by row
order (id, then place in the text); the others are repeats. Lines and paragraphs are
cut out one by one. Passages are finer: their units are the clauses within lines, and
repeats are cut out where they follow one another for a least number of words, so
that short turns of speech stay and passages inside longer lines go. Spans name
places in the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placemill.llm.common import ROW, once, stored
from placemill.llm.scratch import Scratch

BREAKS = {"line": "\n", "paragraph": "\n\n"}
# Words of consecutive repeated clauses that make a passage, and words of a clause that counts towards them.
PASSAGE_WORDS = 30
CLAUSE_WORDS = 2
_BLANK = "\t\n\v\f\r "
_CLAUSE_END = re.compile(r"(?<=[.!?,;:])[\x09-\x0D\x20]+")
_WORD = re.compile(r"[^\x09-\x0D\x20]+")


def units(rows: DataFrame, unit: str = "line", min_words: int = 1) -> DataFrame:
    """(row, doc_id, pos, start, end, digest): every unit with at least ``min_words`` words.

    ``pos`` counts the text's units from 0; start and end are code points of the
    original text, end exclusive, without the break.
    """
    mark = BREAKS[unit]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                who, pos, starts, ends, digests = [], [], [], [], []
                for k, text in enumerate(part.column(2)):
                    at = 0
                    for i, piece in enumerate(text.as_py().split(mark)):
                        words = piece.split()
                        if len(words) >= max(1, min_words):
                            who.append(k)
                            pos.append(i)
                            starts.append(at)
                            ends.append(at + len(piece))
                            digests.append(xxhash.xxh3_128_digest(" ".join(words).lower().encode()))
                        at += len(piece) + len(mark)
                take = pa.array(who, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), *(pa.array(x, pa.int64()) for x in (pos, starts, ends)), pa.array(digests, pa.binary())],
                    names=[ROW, "doc_id", "pos", "start", "end", "digest"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    filled = rows.select(ROW, "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return filled.mapInArrow(cut, f"{ROW} bigint, doc_id {kind}, pos bigint, start bigint, end bigint, digest binary")


def repeated_units(found: DataFrame) -> DataFrame:
    """Those units that are not the first with their digest. Rows without an id come last, rows with one id as they lie."""
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", ROW, "pos")
    first = found.groupBy("digest").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.select("digest", F.col(f"first.{ROW}").alias("first_row"), F.col("first.pos").alias("first_pos"))
    # A digest that many texts share is one hot key of a plain equality join, which Spark splits when it is skewed.
    return found.join(first, "digest").where((F.col(ROW) != F.col("first_row")) | (F.col("pos") != F.col("first_pos"))).drop("first_row", "first_pos")


def deduplicate(docs: DataFrame, unit: str = "line", min_words: int = 1) -> DataFrame:
    """(doc_id, text, n_units, n_removed, removed): every row with its kept units, joined by the unit's break.

    ``removed`` lists the cut spans in order as (start, end) in the original text.
    ``unit`` is "line" or "paragraph" (set off by an empty line); blank units and
    those of fewer than ``min_words`` words stay. A null text counts as empty; a
    text all of whose units are repeats becomes empty, its row stays. Rows with one
    id, or equal altogether, are separate texts, of which the first keeps the unit.
    Other columns are dropped. ``docs`` must read the same each time.
    """
    rows = docs.select(F.monotonically_increasing_id().alias(ROW), "doc_id", "text")
    repeats = repeated_units(stored(units(rows, unit, min_words), "units"))
    per_row = repeats.groupBy(ROW).agg(F.array_sort(F.collect_list(F.struct("pos", "start", "end"))).alias("cut"))
    pieces = F.split(F.col("text"), re.escape(BREAKS[unit]), -1)
    joined = rows.withColumn("text", F.coalesce("text", F.lit(""))).join(per_row.hint("merge"), ROW, "left")
    joined = once(joined, "pieces", pieces)
    stay = F.array_except(F.sequence(F.lit(0).cast("bigint"), F.size("pieces").cast("bigint") - 1), F.col("cut.pos"))
    kept = F.array_join(F.transform(stay, lambda i: F.get("pieces", i.cast("int"))), BREAKS[unit])
    return joined.select(
        "doc_id", F.when(F.col("cut").isNull(), F.col("text")).otherwise(kept).alias("text"), F.size("pieces").cast("bigint").alias("n_units"),
        F.coalesce(F.size("cut"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce(F.transform("cut", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"))), F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("removed"),
    )


def clauses(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, words) of each clause: it ends with its line, or with a word that ends in one of . ! ? , ; :"""
    at = 0
    for line in text.split("\n"):
        low = len(line) - len(line.lstrip(_BLANK))
        for high, after in [*(m.span() for m in _CLAUSE_END.finditer(line)), (len(line), len(line))]:
            words = _WORD.findall(line[low:high])
            if words:
                yield at + low, at + low + len(line[low:high].rstrip(_BLANK)), words
            low = max(low, after)
        at += len(line) + 1


def clause_units(rows: DataFrame) -> DataFrame:
    """(row, doc_id, pos, start, end, words, digest): every clause of a text, numbered from 0; a null text has none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                who, found = [], []
                for k, text in enumerate(part.column(2)):
                    for pos, (start, end, words) in enumerate(clauses(text.as_py())):
                        who.append(k)
                        found.append((pos, start, end, len(words), xxhash.xxh3_128_digest(" ".join(words).lower().encode())))
                    if len(who) > 20_000:
                        yield packed(part, who, found)
                        who, found = [], []
                if who:
                    yield packed(part, who, found)

    def packed(part: pa.RecordBatch, who: list[int], found: list[tuple]) -> pa.RecordBatch:
        take = pa.array(who, pa.int64())
        columns = [pa.array(x, t) for x, t in zip(zip(*found), (*[pa.int32()] * 4, pa.binary()))]
        return pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), *columns], names=[ROW, "doc_id", "pos", "start", "end", "words", "digest"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    filled = rows.select(ROW, "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return filled.mapInArrow(cut, f"{ROW} bigint, doc_id {kind}, pos int, start int, end int, words int, digest binary")


def passages_of(repeats: DataFrame, least_words: int, clause_words: int) -> DataFrame:
    """(row, start, end): runs of repeated clauses without another between them, of ``least_words`` words or more in clauses of ``clause_words`` or more."""
    by_place = Window.partitionBy(ROW).orderBy("pos")
    runs = repeats.select(ROW, "start", "end", "words", (F.col("pos") - F.row_number().over(by_place)).alias("run"))
    counted = F.sum(F.when(F.col("words") >= clause_words, F.col("words")).otherwise(0))
    spans = runs.groupBy(ROW, "run").agg(counted.alias("words"), F.min("start").alias("start"), F.max("end").alias("end"))
    return spans.where(F.col("words") >= least_words).select(ROW, "start", "end")


def cut_passages(docs: DataFrame, least_words: int = PASSAGE_WORDS, clause_words: int = CLAUSE_WORDS) -> DataFrame:
    """(doc_id, text, n_removed, removed): every row without the passages that stand earlier.

    A passage is a run of clauses each of which stands earlier in some text, with
    ``least_words`` words or more in its clauses of ``clause_words`` words or more
    (shorter ones neither count nor break a run). It is cut from the start of its
    first clause to the end of its last; the white space around it stays. ``removed``
    lists the cut spans in order as (start, end) in code points of the original text.
    Words are set off by ASCII white space. A null text counts as empty. Rows with one
    id, or equal altogether, are separate texts, of which the first as they lie keeps
    the passage; rows without an id come last. An empty table gives no rows. Other
    columns are dropped. ``docs`` must read the same each time.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias(ROW), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = scratch.keep(clause_units(rows), "clauses")
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", ROW, "pos")
    several = found.groupBy("digest").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # Written, so that a clause that many texts share is a hot key of a plain equality join alone, which Spark splits.
    firsts = scratch.keep(several.select("digest", F.col(f"first.{ROW}").alias("first_row"), F.col("first.pos").alias("first_pos")), "firsts")
    later = (F.col(ROW) != F.col("first_row")) | (F.col("pos") != F.col("first_pos"))
    repeats = scratch.keep(found.drop("doc_id").join(firsts, "digest").where(later).select(ROW, "pos", "start", "end", "words"), "repeats")
    scratch.drop(found, firsts)
    per_row = passages_of(repeats, least_words, clause_words).groupBy(ROW).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cut"))
    # Written, so that a task that moves texts holds no windows and sums besides.
    spans = scratch.keep(per_row, "passages")
    scratch.drop(repeats)
    joined = rows.join(spans.hint("merge"), ROW, "left").select("doc_id", "text", "cut")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                texts, removed = [], []
                for text, spans in zip(part.column(1), part.column(2)):
                    text, spans = text.as_py(), spans.as_py() or []
                    edges = [0, *(e for s in spans for e in (s["start"], s["end"])), len(text)]
                    texts.append("".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                    removed.append(spans)
                shape = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(texts, pa.string()), pa.array([len(r) for r in removed], pa.int64()), pa.array(removed, shape)], names=["doc_id", "text", "n_removed", "removed"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(cut, f"doc_id {kind}, text string, n_removed bigint, removed array<struct<start:int,end:int>>")
