"""Streaming extension: count windows by state, and time windows with late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

COUNTED = "stream string, window_no long, log_idx long, event_id long"


def stream_count_windows(lines: DataFrame, size: int) -> DataFrame:
    """Number the lines of each stream across micro-batches; the state of a stream is its line count.

    Lines of one batch are numbered in order of (ts, event_id). A task holds the
    lines of a stream in one batch; bound these at the source (maxFilesPerTrigger).
    """

    def number(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        place = pd.RangeIndex(at, at + len(rows)).to_numpy()
        state.update((at + len(rows),))
        yield pd.DataFrame({"stream": key[0], "window_no": place // size, "log_idx": place % size, "event_id": rows["event_id"].to_numpy()})

    return lines.groupBy("stream").applyInPandasWithState(number, COUNTED, "n long", "append", GroupStateTimeout.NoTimeout)


def stream_window_counts(lines: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Lines of each stream and tumbling window. Windows that end within ``late`` of the last line stay open and are not written."""
    counts = lines.withWatermark("ts", late).groupBy(F.window("ts", length), "stream").agg(F.count(F.lit(1)).alias("lines"))
    return counts.select("stream", F.col("window.start").alias("start"), "lines")


def stream_time_windows(lines: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Lines and distinct users of each stream and tumbling window, final once the watermark has passed.

    Users are counted one by one first, so no state row holds a set of them.
    """
    users = lines.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "stream", "user_id").agg(F.count(F.lit(1)).alias("n"))
    both = users.groupBy(F.window(F.window_time("w"), length), "stream").agg(F.sum("n").alias("lines"), F.count(F.lit(1)).alias("users"))
    return both.select("stream", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "lines", "users")
