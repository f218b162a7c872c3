"""Streaming forms of bucketing, of count windows and of merged intervals. The batch library has no streams; these are additions.

Rows may come in any order within the watermark's delay. What order matters to is held
in state until the watermark has passed it, and a timer releases it where no more rows
come; so a shuffled stream gives what a table of its rows gives. Rows behind the
watermark are too late and go.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_buckets(stream: DataFrame, interval: str = "6 hours", late: str = "1 hour", ts: str = "time") -> DataFrame:
    """P1 as a tumbling window with a watermark: means are final once the watermark has passed them."""
    return stream.withWatermark(ts, late).groupBy("signal_id", F.window(ts, interval)).agg(F.avg("value").alias("value"), F.count("value").alias("n")).select("signal_id", F.col("window.start").alias("time"), "value", "n")


def _micros(t: pd.Series) -> list[int]:
    return (pd.to_datetime(t).astype("datetime64[us]").astype("int64")).tolist()


def _wait(state: GroupState, micros: int | None) -> None:
    """Wakes the group when the watermark has passed a time, if there is one to wait for."""
    if micros is not None:
        state.setTimeoutTimestamp(max(micros // 1000 + 1, state.getCurrentWatermarkMs() + 1))


def stream_windows(stream: DataFrame, window_size: int, step_size: int, late: str = "1 hour", ts: str = "time") -> DataFrame:
    """W1 over rows (signal_id, time, value) in the order of time, ties by value: (signal_id, first_index, x) as soon as a window is behind the watermark.

    The state of a signal holds under window_size + step_size released values, and the
    rows of the watermark's delay.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, kept, times, values = state.get if state.exists else (0, [], [], [])
        passed = state.getCurrentWatermarkMs() * 1000
        rows = list(zip(times, values, strict=True))
        for pdf in batches:
            rows += [(t, v) for t, v in zip(_micros(pdf[ts]), pdf["value"].tolist(), strict=True) if t >= passed]
        rows.sort()
        ready = bisect.bisect_left(rows, (passed,))
        kept = [*kept, *(v for _, v in rows[:ready])]
        rows, out = rows[ready:], []
        while len(kept) >= window_size:
            out.append((key[0], first, kept[:window_size]))
            kept, first = kept[step_size:], first + step_size
        state.update((first, kept, [t for t, _ in rows], [v for _, v in rows]))
        _wait(state, rows[0][0] if rows else None)
        yield pd.DataFrame(out, columns=["signal_id", "first_index", "x"])

    held = "first bigint, kept array<double>, times array<bigint>, values array<double>"
    return stream.withWatermark(ts, late).groupBy("signal_id").applyInPandasWithState(step, "signal_id string, first_index bigint, x array<double>", held, "append", GroupStateTimeout.EventTimeTimeout)


def stream_intervals(stream: DataFrame, late: str = "1 hour", ts: str = "time") -> DataFrame:
    """I4 over rows (signal_id, time, start, end), time being that of start: merged (signal_id, start, end) in epoch seconds, once no row to come can touch them.

    The state of a signal holds the intervals that end at or after the watermark.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        starts, ends = state.get if state.exists else ([], [])
        passed = state.getCurrentWatermarkMs() * 1000
        rows = list(zip(starts, ends, strict=True))
        for pdf in batches:
            rows += [(a, b) for t, a, b in zip(_micros(pdf[ts]), pdf["start"].tolist(), pdf["end"].tolist(), strict=True) if t >= passed]
        merged: list[list[int]] = []
        for a, b in sorted(rows):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        done = [(key[0], a, b) for a, b in merged if b * 1_000_000 < passed]
        open_ = [x for x in merged if x[1] * 1_000_000 >= passed]
        state.update(([a for a, _ in open_], [b for _, b in open_]))
        _wait(state, min(b for _, b in open_) * 1_000_000 if open_ else None)
        yield pd.DataFrame(done, columns=["signal_id", "start", "end"])

    return stream.withWatermark(ts, late).groupBy("signal_id").applyInPandasWithState(step, "signal_id string, start bigint, end bigint", "starts array<bigint>, ends array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
