"""Structured Streaming jobs: claims, request filtering, latest stages, run counters.

All jobs keep their memory in keyed state. Claims and counters write one folder per
micro-batch, so a replayed batch overwrites itself; counters read only the folder of the
batch before. The others write through the file sink, which takes each batch once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from placemill.streaming.processors import LatestStage, RegionStatus, use_rocksdb

CLAIMS = "place_id bigint, region_ord bigint"


def _table(spark: SparkSession, path: str, shape: str) -> DataFrame:
    """A folder of batches, readable before the first one exists."""
    try:
        return spark.read.schema(shape).option("basePath", path).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], shape)


def _publish(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def first_claims(found: DataFrame) -> DataFrame:
    """(place_id, region_ord) of the places that no earlier micro-batch found, for the smallest region that found them.

    The state of a place is its smallest region and the times of the first and the last
    micro-batch that found it. The time is the same for all rows of a micro-batch and
    for its replay, so a place is claimed only where both are the time of this one; a
    clock that goes back claims nothing twice.
    """
    now = F.current_timestamp()
    use_rocksdb(found.sparkSession)
    seen = found.select("place_id", "region_ord", now.alias("at")).groupBy("place_id").agg(
        F.min("region_ord").alias("region_ord"), F.min("at").alias("first"), F.max("at").alias("last")
    )
    return seen.where((F.col("first") == now) & (F.col("last") == now)).select("place_id", "region_ord")


def resolve_stream(found: DataFrame, claims_path: str, checkpoint: str) -> DataStreamWriter:
    """Each micro-batch claims only places no earlier batch claimed; ``found``: place_id, region_ord.

    The state is kept by Spark's own aggregate, one row per place; claims already
    written are never read again.
    """
    publish = lambda batch, batch_id: _publish(batch, claims_path, batch_id)
    return first_claims(found).writeStream.outputMode("update").foreachBatch(publish).option("checkpointLocation", checkpoint)


def read_claims(spark: SparkSession, claims_path: str) -> DataFrame:
    return _table(spark, claims_path, CLAIMS).select("place_id", "region_ord")


PASSED = "cache_key string, ts timestamp"


def pass_requests(ttl: str):
    """The requests of one key that pass, oldest first; the state is the time of the last one that did."""
    span = pd.Timedelta(ttl) // pd.Timedelta(microseconds=1)

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        passed = []
        for us in np.sort(np.concatenate([f["ts"].astype("datetime64[us]").astype("int64").to_numpy() for f in frames])).tolist():
            if last is None or us - last >= span:
                passed.append(us)
                last = us
        state.update((last,))
        state.setTimeoutTimestamp(max((last + span) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"cache_key": [key[0]] * len(passed), "ts": pd.to_datetime(passed, unit="us")})

    return step


def dedupe_requests(requests: DataFrame, ttl: str = "6 hours") -> DataFrame:
    """A request passes when its key last passed ``ttl`` ago or longer, or never; (cache_key, ts) of those that do.

    The requests of a key are taken in order of time within a micro-batch; one
    that comes a batch late, behind the last passed one, does not pass. A key is
    forgotten once the watermark is ``ttl`` past its last passed request.
    """
    rows = requests.select("cache_key", "ts").withWatermark("ts", ttl)
    return rows.groupBy("cache_key").applyInPandasWithState(pass_requests(ttl), PASSED, "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def newest_in_batch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Only the newest row per id leaves a map task, so a busy id reaches its state as a few rows."""
    for frame in frames:
        yield frame.sort_values(["ts", "ord"]).groupby("id", as_index=False).tail(1)


STAGE = "id string, ts timestamp, ord bigint, stage string"


def latest_stage(progress: DataFrame, delay: str = "10 minutes", clock: str = "event") -> DataFrame:
    """Running newest stage per id (update mode), by ``transformWithState``; a finished id is forgotten a minute after its last update.

    With the clock "event" that minute is event time, so a replay gives the same
    result and a run over what is available comes to an end, and rows older than the
    watermark are dropped. With the clock "processing" it is a time to live, and no
    row is late.
    """
    use_rocksdb(progress.sparkSession)
    slim = progress.select("id", "ts", "ord", "stage").mapInPandas(newest_in_batch, STAGE)
    if clock == "event":
        slim = slim.withWatermark("ts", delay)
    mode = {"event": "EventTime", "processing": "ProcessingTime"}[clock]
    return slim.groupBy("id").transformWithStateInPandas(LatestStage(clock == "event"), STAGE, "Update", mode)


def latest_stage_batch(progress: DataFrame) -> DataFrame:
    """Batch twin: newest stage per id."""
    newest = F.max_by(F.struct("ts", "ord", "stage"), F.struct("ts", "ord")).alias("s")
    return progress.groupBy("id").agg(newest).select("id", "s.ts", "s.ord", "s.stage")


CHANGES = "region_ord bigint, ts timestamp, status string, place_count bigint"
COUNTERS = "total bigint, finished bigint, failed bigint, places bigint, batch_id bigint"


def latest_status(rows: DataFrame) -> DataFrame:
    """Newest status of each region; at one time the last in order of status, then of places."""
    newest = F.max_by(F.struct("ts", "status", "place_count"), F.struct("ts", "status", "place_count")).alias("s")
    return rows.groupBy("region_ord").agg(newest).select("region_ord", "s.*")


def newest_status_in_batch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Only the newest row per region leaves a map task."""
    for frame in frames:
        yield frame.sort_values(["ts", "status", "place_count"]).groupby("region_ord", as_index=False).tail(1)


def status_changes(changes: DataFrame) -> DataFrame:
    """(status, place_count, sign): what a region's new status adds to the totals (1) and its old one takes back (-1)."""
    use_rocksdb(changes.sparkSession)
    slim = changes.select("region_ord", "ts", "status", "place_count").mapInPandas(newest_status_in_batch, CHANGES)
    return slim.groupBy("region_ord").transformWithStateInPandas(RegionStatus(), "status string, place_count bigint, sign int", "Update", "None")


def job_counters(changes: DataFrame, counters_path: str, checkpoint: str) -> DataStreamWriter:
    """Totals after every micro-batch, each region counted once with its newest status.

    ``changes``: region_ord, ts, status, place_count. Regions are keyed state; a
    micro-batch adds up the changes of its own regions and the totals of the batch
    before, one row, so its work does not grow with the regions known.
    """

    def count(batch: DataFrame, batch_id: int) -> None:
        signed = lambda flag: F.sum(F.when(flag, F.col("sign")).otherwise(0))
        moved = batch.agg(
            signed(F.lit(True)).alias("total"), signed(F.col("status").isin("done", "skipped", "failed")).alias("finished"),
            signed(F.col("status") == "failed").alias("failed"), F.sum(F.col("sign") * F.coalesce("place_count", F.lit(0))).alias("places"),
        )
        known = _table(batch.sparkSession, counters_path, COUNTERS).where(F.col("batch_id") == batch_id - 1).drop("batch_id")
        sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in known.columns]
        _publish(known.unionByName(moved).agg(*sums), counters_path, batch_id)

    return status_changes(changes).writeStream.outputMode("update").foreachBatch(count).option("checkpointLocation", checkpoint)


def read_counters(spark: SparkSession, counters_path: str) -> DataFrame:
    """The totals after each micro-batch."""
    return _table(spark, counters_path, COUNTERS)


def run_available(writer: DataStreamWriter) -> None:
    """Work off what is there, then stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
