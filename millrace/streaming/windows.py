"""Structured Streaming: summaries of event-time windows, with late samples dropped or forwarded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.aggregates import Statistic, stored
from ..operators import windows
from ..sources import summary_table


def closed_windows(stream: DataFrame, time: str, value: str, by: list[str], window: str, lateness: str, slide: str | None = None, statistic: str | Statistic | None = None) -> DataFrame:
    """(window, by, states) in append mode: a window comes out once the watermark passes its end; later samples are dropped.

    States are those of a statistic of functions.aggregates (sum and count as total and n, if none is named). With a
    slide, the stream is grouped by panes of that width, and panes_to_windows makes sliding windows of what comes out.
    """
    t = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    build = stored(statistic).build if statistic else {"total": lambda v, _: F.sum(v), "n": lambda v, _: F.count(v)}
    states = [f(F.col(value), t).alias(name) for name, f in build.items()]
    return stream.withWatermark(time, lateness).groupBy(F.window(time, slide or window).alias("window"), *by).agg(*states)


def panes_to_windows(panes: DataFrame, by: list[str], statistic: str | Statistic, seconds: float, step: float) -> DataFrame:
    """Sliding windows (by, window_start, window_end, states) of the panes that a stream of closed windows wrote."""
    rows = panes.select("*", (F.unix_micros("window.start") / 1e6).alias("window_start")).drop("window")
    return windows.slide(rows, by, statistic, seconds, step)


def append_summaries(rows: DataFrame, by: list[str], statistic: str | Statistic, seconds: float, path: str, agg_id: int, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch's partial window states to a summary table; late samples become further partial rows, which reads merge.

    rows stream (by, t, value). A batch that is run again replaces what it wrote. Runs over what there is and ends.
    """

    def add(batch: DataFrame, number: int) -> None:
        summary_table.append(windows.build(batch, by, statistic, seconds), path, agg_id, number)

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_keys(rows: DataFrame, by: list[str], seconds: float, path: str, agg_id: int, checkpoint: str) -> StreamingQuery:
    """Write the keys of each micro-batch's windows, without repeats, to a summary table: key_sets reads the whole sets.

    rows stream (by, t). A batch that is run again replaces what it wrote.
    """

    def add(batch: DataFrame, number: int) -> None:
        keys = windows.keys(batch, by, seconds)
        summary_table.append(keys.withColumn("window_end", F.col("window_start") + seconds), path, agg_id, number)

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def key_sets(stored_keys: DataFrame, by: list[str]) -> DataFrame:
    """(window_start, by) of what append_keys wrote; windows.key_changes tells what each window adds and removes."""
    return stored_keys.select("window_start", *by).distinct()
