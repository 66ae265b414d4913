"""Bounded samples of labelled rows, as the two classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placemill.llm.common import fold


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, label): at most ``most`` labelled rows of the folds that may be learnt from.

    Rows whose crc32(doc_id as text) mod 3 is 1 are left out. A larger set is thinned
    by a hash of the id, which is the same at every run. An id labelled twice takes
    the larger label; rows without a label or an id are not learnt from. The ids,
    ``most`` of them, are broadcast, so texts are not shuffled.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 3) != 1))
    known = known.groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
    n = known.count()
    rank = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30))
    if n > most:
        known = known.where(rank < int((1 << 30) * min(1.0, 1.1 * most / n))).orderBy(rank, "doc_id").limit(most)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
