"""Keyed state inside a stream: rolling client counts and request quotas, with timers.

State is held per client in the RocksDB state store, so it survives lost executors. One
client's rows of a micro-batch are ordered in one task; the source's rate limit bounds them.
Where single clients can dominate a stream, `enrichment.start_enrichment` spreads them.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from threatloom.schema import DEDUP_RETENTION_SECONDS, OFFENDER_WINDOW_SECONDS

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )
}
IDLE_MARGIN_SECONDS = 60


def once_within_retention(stream: DataFrame, event_id: str, seconds: int = DEDUP_RETENTION_SECONDS) -> DataFrame:
    """Drop repeats of an id for an hour after its first sight. Goes before any counting."""
    return stream.withWatermark("received_at", f"{seconds} seconds").dropDuplicatesWithinWatermark([event_id])


class _RollingCount(StatefulProcessor):
    """The recent instants of one client, each with its number of events."""

    def __init__(self, window_seconds: int) -> None:
        self.window = window_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "at long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(rows, ignore_index=True).sort_values(["at", "arrival"], kind="stable")
        at = batch["at"].to_numpy()
        known = list(self.recent.get()) if self.recent.exists() else []
        old_at = np.array([row[0] for row in known], dtype=np.int64)
        total = np.r_[0, np.cumsum([row[1] for row in known], dtype=np.int64)]

        def recorded(since: np.ndarray) -> np.ndarray:
            return total[-1] - total[np.searchsorted(old_at, since, "left")]

        place = np.arange(1, len(at) + 1) - np.searchsorted(at, at - self.window, "left")
        late = total[-1] - total[np.searchsorted(old_at, at, "right")]  # recorded, but after this instant
        batch["offenderEventCount"] = place + recorded(at - self.window) - late
        newest = max(at[-1], old_at[-1] if len(old_at) else at[-1])
        every = np.r_[np.repeat(old_at, np.diff(total)), at]
        kept, n = np.unique(every[every >= newest - self.window], return_counts=True)
        self.recent.put(list(zip(kept.tolist(), n.tolist())))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        idle_from = newest // 1000 + self.window // 1000 + IDLE_MARGIN_SECONDS * 1000
        self.handle.registerTimer(int(max(idle_from, timerValues.getCurrentWatermarkInMs() + 1)))
        yield batch[["client", "at", "arrival", "offenderEventCount"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.recent.clear()
        return iter(())

    def close(self) -> None:
        pass


def rolling_count(stream: DataFrame, window_seconds: int = OFFENDER_WINDOW_SECONDS) -> DataFrame:
    """(client, received_at, arrival) -> (client, at, arrival, offenderEventCount).

    `at` is the receipt time in microseconds. The stream needs a watermark on `received_at`, as
    `once_within_retention` sets: it fires the timers that clear idle clients.
    """
    rows = stream.select("client", "received_at", F.unix_micros("received_at").alias("at"), "arrival")
    return rows.groupBy("client").transformWithStateInPandas(
        statefulProcessor=_RollingCount(window_seconds),
        outputStructType="client string, at long, arrival long, offenderEventCount long",
        outputMode="Append",
        timeMode="EventTime",
    )


class _Quota(StatefulProcessor):
    """The open window of one client: its start and the requests so far."""

    def __init__(self, limit: int, window_seconds: int) -> None:
        self.limit, self.span = limit, window_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", "start long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(rows, ignore_index=True).sort_values(["at", "arrival"], kind="stable")
        at = batch["at"].to_numpy()
        start, n = self.window.get() if self.window.exists() else (at[0], 0)
        numbers, done = [], 0
        while done < len(at):
            upto = int(np.searchsorted(at, start + self.span))
            if upto > done:
                numbers.append(n + np.arange(1, upto - done + 1))
                n, done = n + upto - done, upto
            if done < len(at):
                start, n = int(at[done]), 0
        self.window.update((int(start), int(n)))
        batch["request_number"] = np.concatenate(numbers)
        batch["allowed"] = batch["request_number"] <= self.limit
        yield batch[["client", "at", "arrival", "request_number", "allowed"]]

    def close(self) -> None:
        pass


def quota_stream(stream: DataFrame, limit: int, window_seconds: int) -> DataFrame:
    """(client, ts, arrival) -> (client, at, arrival, request_number, allowed); `at` in microseconds."""
    rows = stream.select("client", F.unix_micros("ts").alias("at"), "arrival")
    return rows.groupBy("client").transformWithStateInPandas(
        statefulProcessor=_Quota(limit, window_seconds),
        outputStructType="client string, at long, arrival long, request_number long, allowed boolean",
        outputMode="Append",
        timeMode="None",
    )
