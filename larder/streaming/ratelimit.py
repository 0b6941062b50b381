"""The rate limiter on a stream: one window per client in the state store."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from larder.operators.ratelimit import SEARCH_MAX, WINDOW_S

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DEFAULT_LATENESS = "1 minute"


def use_state_store(spark) -> None:
    """Stateful Python processors need the RocksDB store; an existing choice of it stays."""
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class WindowCounter(StatefulProcessor):
    """Counts a client's events in windows that open at their first event.

    The rows of a client are ordered by time within a micro-batch. An event older than the open
    window counts into it. A timer drops the window once the watermark has passed its end.
    """

    def __init__(self, max_events: int, window_us: int):
        self.max_events, self.window_us = max_events, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "opened long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["us", "event_id"], kind="stable")
        t = batch["us"].to_numpy()
        opened, n = self.window.get() if self.window.exists() else (None, 0)
        starts, counts = np.empty(len(t), np.int64), np.empty(len(t), np.int64)
        i = 0
        while i < len(t):
            if opened is None or t[i] > opened + self.window_us:
                opened, n = int(t[i]), 0
            end = max(int(np.searchsorted(t, opened + self.window_us, side="right")), i + 1)
            starts[i:end], counts[i:end] = opened, n + 1 + np.arange(end - i)
            n, i = n + end - i, end
        self.window.update((int(opened), int(n)))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((int(opened) + self.window_us) // 1000 + 1)
        yield pd.DataFrame(
            {"client": batch["client"].to_numpy(), "event_id": batch["event_id"].to_numpy(), "us": t,
             "window_us": starts, "n_in_window": counts, "limited": counts > self.max_events}
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.window.clear()
        return iter([])

    def close(self) -> None:
        pass


def limit_stream(
    requests: DataFrame, max_events: int = SEARCH_MAX, window_s: int = WINDOW_S, lateness: str = DEFAULT_LATENESS
) -> DataFrame:
    """Streaming (client, event_id, ts) in; the same plus window_start, n_in_window, limited out."""
    use_state_store(requests.sparkSession)
    client = requests.schema["client"].dataType.simpleString()
    timed = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    timed = timed.withColumn("us", F.unix_micros("ts"))
    out = timed.groupBy("client").transformWithStateInPandas(
        statefulProcessor=WindowCounter(max_events, window_s * 1_000_000),
        outputStructType=f"client {client}, event_id long, us long, window_us long, n_in_window long, limited boolean",
        outputMode="append",
        timeMode="eventTime",
    )
    return out.select(
        "client", "event_id", F.timestamp_micros("us").alias("ts"), F.timestamp_micros("window_us").alias("window_start"),
        "n_in_window", "limited",
    )
