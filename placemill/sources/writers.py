"""Sinks: corpus, stored results, export manifest, run report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_corpus(df: DataFrame, path: str) -> None:
    """Line-delimited JSON, one record per line."""
    df.write.mode("overwrite").json(path)


def save_results(df: DataFrame, path: str) -> None:
    """Appends result versions, partitioned by month; readers take the newest per id."""
    df.withColumn("month", F.date_format("created_at", "yyyy-MM")).hint("rebalance", "month").write.mode("append").partitionBy("month").parquet(path)


def write_export_manifest(df: DataFrame, path: str) -> None:
    """One folder per country and city; only the partitions in ``df`` are replaced, whole or not at all."""
    (
        df.hint("rebalance", "country_dir", "city_dir")  # large cities are split, small ones packed
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("country_dir", "city_dir").parquet(path)
    )


def write_run_report(lines: DataFrame, path: str) -> None:
    """Report lines in order, as text. ``ord`` orders the lines across the files."""
    lines.repartitionByRange("ord").sortWithinPartitions("ord").select("line").write.mode("overwrite").text(path)
