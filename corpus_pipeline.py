"""The training-data pipeline: quality, near copies, decontamination, personal data, tokens.

Each stage takes (spark, docs, folder) and returns the rows it keeps; all but the
last return the columns of ``documents``. Between stages a table is written to the
shared folder and read again, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from placemill.llm import bpe, decontaminate, near_copies, personal_data, quality
from placemill.llm.common import read, stored
from placemill.llm.queries import word_bpe


def good_texts(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drops the rows that the quality classifier rejects."""
    return quality.keep_good(docs, read(spark, folder, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keeps the row of the smallest id of each group of near copies."""
    return near_copies.keep_one(docs)


def without_tests(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drops the rows that hold a benchmark item."""
    return decontaminate.remove_contaminated(docs, read(spark, folder, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Puts the kind of each span of personal data in its place; all rows stay."""
    return personal_data.redact(docs)


def as_tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, ids, n_tokens) of every row."""
    return bpe.encode_documents(docs, word_bpe())


STAGES = [
    ("quality classifier", good_texts), ("n-gram jaccard join", one_of_each), ("benchmark decontamination", without_tests),
    ("personal data", without_personal_data), ("bpe encoding", as_tokens),
]

# No SQL: the first stage is a trained network. Tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, folder), name.replace(" ", "-"))
    return docs
