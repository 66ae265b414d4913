"""Tables that an operator writes on its way and takes away again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from placemill.session import fresh_path

# Spark drops the shuffle files of a query at its end; what the query wrote stands on its own.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Writes tables to the shared folder, so that a lost executor costs one step, and deletes those no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: list[tuple[DataFrame, str]] = []

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        """``df`` written and read back."""
        path, before = fresh_path(self.spark, label), self.spark.conf.get(CLEAN, None)
        self.spark.conf.set(CLEAN, "true")
        try:
            df.write.parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(CLEAN)
            else:
                self.spark.conf.set(CLEAN, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that ``keep`` gave; nothing may read them any more."""
        gone = [path for table, path in self.tables if any(table is t for t in tables)]
        self.tables = [(table, path) for table, path in self.tables if path not in gone]
        for name in gone:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
