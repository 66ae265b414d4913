"""Keyed state of the streaming jobs, as stateful processors with typed state, timers and times to live."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FINISHED = ("done", "failed")
FORGET_MS = 60_000
STAGE_STATE = "us bigint, ord bigint, stage string"
STATUS_STATE = "us bigint, status string, place_count bigint"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that these processors need; a stream keeps the one it was started with."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _us(times: pd.Series) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


class LatestStage(StatefulProcessor):
    """The newest (time, ord, stage) of one id.

    A finished id leaves by a timer a minute of event time after its last update, or,
    without event time, by the time to live of the state that finished ids are kept in.
    """

    def __init__(self, by_event_time: bool):
        self.by_event_time = by_event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getValueState("live", STAGE_STATE)
        self.finished = None if self.by_event_time else handle.getValueState("finished", STAGE_STATE, FORGET_MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.live.get() or (self.finished and self.finished.get())
        best = tuple(known) if known else (-1, -1, "")
        for frame in rows:
            best = max([best, *zip(_us(frame["ts"]), frame["ord"].tolist(), frame["stage"].tolist())], key=lambda r: (r[0], r[1]))
        over = best[2] in FINISHED
        if self.by_event_time:
            self.live.update(best)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if over:
                self.handle.registerTimer(max(best[0] // 1000 + FORGET_MS, timerValues.getCurrentWatermarkInMs() + 1))
        else:
            keep, drop = (self.finished, self.live) if over else (self.live, self.finished)
            keep.update(best)
            drop.clear()
        yield pd.DataFrame({"id": [key[0]], "ts": [pd.Timestamp(best[0], unit="us")], "ord": [best[1]], "stage": [best[2]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.live.clear()
        return iter([])

    def close(self) -> None:
        pass


class RegionStatus(StatefulProcessor):
    """The newest status of one region; what changes leaves as the old status taken back and the new one added."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", STATUS_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.last.get()
        old = tuple(known) if known else None
        seen = [(us, status, None if pd.isna(n) else int(n)) for frame in rows for us, status, n in zip(_us(frame["ts"]), frame["status"].tolist(), frame["place_count"].tolist())]
        new = max([*seen, *([old] if old else [])], key=lambda r: (r[0], r[1], -1 if r[2] is None else r[2]))
        if new != old:
            self.last.update(new)
            moved = [(new[1], new[2], 1), *([(old[1], old[2], -1)] if old else [])]
            frame = pd.DataFrame(moved, columns=["status", "place_count", "sign"])
            yield frame.astype({"place_count": "Int64", "sign": "int32"})

    def close(self) -> None:
        pass
