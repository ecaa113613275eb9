"""Tables of window summaries: (agg_id, window_start, window_end, group columns, state columns).

A window may have several partial rows; every read merges them. Tables are
partitioned by agg_id and by the batch that wrote the rows, so a read touches the
files of one aggregation, and a batch that is written again replaces itself.
Window bounds prune row groups by their statistics. Any statistic of
functions.aggregates can be stored; those over keys have row and cell among their
group columns. Retention looks at each aggregation by itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Windows kept per aggregation are this many times the number asked for.
EPOCHS = 4


def append(summaries: DataFrame, path: str, agg_id: int, batch: str | int | None = None) -> None:
    """Add summary rows of one aggregation. A named batch that was written before is replaced, so a retry adds nothing twice."""
    if batch is None:
        batch = str(uuid.uuid4())
    folder = f"{path.rstrip('/')}/agg_id={int(agg_id)}/batch={batch}"
    summaries.sortWithinPartitions("window_start").write.mode("overwrite").parquet(folder)


def read(spark: SparkSession, path: str, agg_id: int) -> DataFrame:
    """The rows of one aggregation; tables of several may hold different statistics."""
    folder = f"{path.rstrip('/')}/agg_id={int(agg_id)}"
    return spark.read.option("basePath", folder).parquet(folder).drop("batch").withColumn("agg_id", F.lit(agg_id))


def in_range(summaries: DataFrame, start: float, end: float) -> DataFrame:
    """Windows that lie within [start, end]."""
    return summaries.filter((F.col("window_start") >= start) & (F.col("window_end") <= end))


def exactly(summaries: DataFrame, start: float, end: float) -> DataFrame:
    """The one window with these bounds."""
    return summaries.filter((F.col("window_start") == start) & (F.col("window_end") == end))


def passthrough(rows: DataFrame) -> DataFrame:
    """Raw samples as summaries of their own instant: start = end = time, total = value."""
    return rows.withColumn("window_start", F.col("t")).withColumn("window_end", F.col("t")).withColumn("total", F.col("value")).drop("t", "value", "ts")


def earliest(summaries: DataFrame) -> DataFrame:
    """The earliest window start per aggregation."""
    return summaries.groupBy("agg_id").agg(F.min("window_start").alias("earliest"))


def keep_latest(summaries: DataFrame, windows: int, epochs: int = EPOCHS) -> DataFrame:
    """Circular buffer: of each aggregation only the latest windows * epochs distinct windows stay."""
    spans = summaries.select("agg_id", "window_start", "window_end").distinct()
    order = Window.partitionBy("agg_id").orderBy(F.col("window_start").desc(), F.col("window_end").desc())
    kept = spans.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= windows * epochs).drop("_at")
    return summaries.join(kept, ["agg_id", "window_start", "window_end"], "left_semi")


def drop_read(summaries: DataFrame, reads: DataFrame, threshold: int, keep: Iterable[int] = ()) -> DataFrame:
    """Read-based retention: windows that reads (agg_id, window_start, window_end, n) lists threshold times or more go.

    Aggregations of keep are exempt: changes of key sets build on each other, so a read one is still needed.
    """
    done = reads.groupBy("agg_id", "window_start", "window_end").agg(F.sum("n").alias("n")).filter((F.col("n") >= threshold) & ~F.col("agg_id").isin(*keep))
    return summaries.join(done, ["agg_id", "window_start", "window_end"], "left_anti")
