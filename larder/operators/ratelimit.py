"""Fixed-window rate limiting per client, from the first event of each window.

A client's window opens at its first event and lasts ``window_s``; an event strictly later than the
end opens the next one. Events beyond ``max_events`` in a window are limited, still count, and do
not extend it. Where the next window opens depends on all earlier ones, so a client is a chain.

The chain is cut into time slices. Pass one computes for every slice, in parallel, what end of window
it hands on for any end it may be handed. Pass two follows these few hand-over rows per client.
Pass three labels the events of every slice, again in parallel. So a client with a third of all
events spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Requests per minute of search and of chat.
SEARCH_MAX, CHAT_MAX, WINDOW_S = 30, 15, 60
SLICE_WINDOWS = 64
NONE = -(1 << 62)


def client_key(forwarded: Column) -> Column:
    """First entry of a forwarded-for header, else 'unknown'."""
    return F.coalesce(F.trim(F.get(F.split(forwarded, ","), F.lit(0))), F.lit("unknown"))


def _whole_groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Regroup sorted Arrow batches so that no (client, slice) group is cut in two."""
    held = None
    for rows in frames:
        if held is not None:
            rows = pd.concat([held, rows], ignore_index=True)
        if not len(rows):
            continue
        last = rows.iloc[-1]
        tail = (rows["client"] == last["client"]).to_numpy() & (rows["slice"] == last["slice"]).to_numpy()
        if not tail.all():
            yield rows[~tail].reset_index(drop=True)
        held = rows[tail]
    if held is not None:
        yield held.reset_index(drop=True)


class _Line:
    """Sorted times of many groups on one number line, far enough apart not to touch."""

    def __init__(self, rows: pd.DataFrame, w: int, width: int):
        client, start = rows["client"], rows["slice"].to_numpy()
        new = np.append(True, (client.to_numpy()[1:] != client.to_numpy()[:-1]) | (start[1:] != start[:-1]))
        self.group = np.cumsum(new) - 1
        self.heads = np.flatnonzero(new)
        self.us = rows["us"].to_numpy()
        self.offset = self.us - start
        self.base = self.group * (width + 4 * w)
        self.x = self.base + self.offset
        after = np.searchsorted(self.x, self.x + w, side="right")
        n = len(self.x)
        same = np.append(self.group, -1)[after] == self.group
        # the first later time beyond the window, n when the group has none
        self.next = np.where(same, after, n)


def _handover(w: int, width: int):
    """For each slice: (before, out_end) rows. An end handed in below ``before`` leaves as ``out_end``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_groups(frames):
            line = _Line(rows, w, width)
            n = len(line.x)
            # pointer doubling: follow the openings to the last one inside the slice
            hop, last = np.append(line.next, n), np.append(np.arange(n), n)
            while (hop[:-1] < n).any():
                reach = hop < n
                last[reach] = last[hop[reach]]
                hop[reach] = hop[hop[reach]]
            out = (line.us + w)[last[:-1]]
            # only ends within the first window width can be handed in; one later time closes the list
            early = line.offset <= w
            closes = np.zeros(n, bool)
            closes[line.heads] = True
            closes[1:] |= early[:-1]
            pick = np.flatnonzero(early | closes)
            g, o = line.group[pick], out[pick]
            # neighbours with the same outcome merge into the later bound
            bound = np.append((g[1:] != g[:-1]) | (o[1:] != o[:-1]), True)
            pick = pick[bound]
            yield pd.DataFrame(
                {"client": rows["client"].to_numpy()[pick], "slice": rows["slice"].to_numpy()[pick],
                 "before": line.us[pick], "out_end": out[pick]}
            )

    return run


def _follow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Carry each client's window end through its slices, in order."""
    client, carry = None, NONE
    for rows in _whole_groups(frames):
        bounds = np.flatnonzero(np.append(True, (rows["client"].to_numpy()[1:] != rows["client"].to_numpy()[:-1])
                                          | (rows["slice"].to_numpy()[1:] != rows["slice"].to_numpy()[:-1])))
        out = []
        for a, b in zip(bounds, np.append(bounds[1:], len(rows))):
            who, start = rows["client"].iat[a], rows["slice"].iat[a]
            if who != client:
                client, carry = who, NONE
            out.append((who, start, carry))
            i = a + int(np.searchsorted(rows["before"].to_numpy()[a:b], carry, side="right"))
            if i < b:
                carry = int(rows["out_end"].iat[i])
        yield pd.DataFrame(out, columns=["client", "slice", "carry"])


def _label(w: int, width: int):
    """Give every event the start of its window, knowing what end its slice was handed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_groups(frames):
            line = _Line(rows, w, width)
            n = len(line.x)
            carry = rows["carry"].to_numpy()
            # the first event after the handed-in end opens the slice's first own window
            ahead = np.clip(carry[line.heads] - rows["slice"].to_numpy()[line.heads], -1, width + w)
            at = np.searchsorted(line.x, line.base[line.heads] + ahead, side="right")
            at = at[np.append(line.group, -1)[at] == np.arange(len(line.heads))]
            opens = np.zeros(n, bool)
            while len(at):
                opens[at] = True
                at = line.next[at]
                at = at[at < n]
            marks = np.flatnonzero(opens)
            slot = np.searchsorted(line.x[marks], line.x, side="right") - 1
            own = (slot >= 0) & (line.group[marks[np.maximum(slot, 0)]] == line.group) if len(marks) else np.zeros(n, bool)
            start = np.where(own, line.us[marks[np.maximum(slot, 0)]] if len(marks) else 0, carry - w)
            yield pd.DataFrame({"client": rows["client"], "event_id": rows["event_id"], "us": line.us, "window_us": start})

    return run


def limit_requests(
    requests: DataFrame, max_events: int = SEARCH_MAX, window_s: int = WINDOW_S, slice_windows: int = SLICE_WINDOWS
) -> DataFrame:
    """Add ``window_start``, ``n_in_window`` and ``limited`` to requests (client, ts, event_id)."""
    w = window_s * 1_000_000
    width = w * slice_windows
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    timed = requests.select("client", "event_id", us.alias("us")).withColumn(
        "slice", F.floor(F.col("us") / width).cast("long") * width
    )
    client = requests.schema["client"].dataType.simpleString()
    key = ["client", "slice"]
    # equal times behave alike, so the hand-over needs them once
    times = timed.select(*key, "us").distinct().repartition(*key).sortWithinPartitions(*key, "us")
    handed = times.mapInPandas(_handover(w, width), f"client {client}, slice long, before long, out_end long")
    by_client = handed.repartition("client").sortWithinPartitions("client", "slice", "before")
    carried = by_client.mapInPandas(_follow, f"client {client}, slice long, carry long")
    ready = timed.join(carried, key).repartition(*key).sortWithinPartitions(*key, "us", "event_id")
    placed = ready.mapInPandas(_label(w, width), f"client {client}, event_id long, us long, window_us long")
    # a window that crosses into the next slice goes on counting there
    in_window = Window.partitionBy("client", "window_us").orderBy("us", "event_id")
    n = F.row_number().over(in_window)
    return placed.select(
        "client",
        "event_id",
        F.timestamp_micros("us").alias("ts"),
        F.timestamp_micros("window_us").alias("window_start"),
        n.alias("n_in_window"),
        (n > max_events).alias("limited"),
    )
