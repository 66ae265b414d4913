"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placemill.session import fresh_path

ROW = "_row"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def texts(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """(doc_id, text): the two columns the operators work on; a null text becomes empty, other columns go."""
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text") if text is None else text, F.lit("")).alias("text"))


def packed(docs: DataFrame) -> DataFrame:
    """(row, whole): each row numbered as it lies and put into one struct, so that no helper column can clash with its own.

    The numbers are the same at each reading of a stored table.
    """
    return docs.select(F.monotonically_increasing_id().alias(ROW), F.struct("*").alias("whole"))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row, however often it is used, also inside lambdas and filters.

    Spark puts a plain column's expression wherever the column is used; it does not
    look through a generator, here one of a single element.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: one evaluation, and nothing to recompute when an executor goes."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def count_of_most(table: DataFrame, n: str, most: int) -> int:
    """The smallest threshold t for which at most ``most`` rows have n >= t.

    Read off a histogram of a few hundred steps of n, so no sort and no long list
    reaches the driver.
    """
    steps = table.groupBy(F.floor(F.log2(F.col(n)) * 16).alias("step")).agg(F.count(F.lit(1)).alias("rows"), F.max(n).alias("top")).collect()
    total, threshold = 0, 1 + max((r["top"] for r in steps), default=0)
    by_step = sorted(steps, key=lambda r: -r["step"])
    for i, r in enumerate(by_step):
        total += r["rows"]
        if total > most:
            break
        threshold = 1 + by_step[i + 1]["top"] if i + 1 < len(by_step) else 1
    return threshold
