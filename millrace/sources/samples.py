"""Samples: rows with label columns, a time in epoch seconds `t` and a double `value`."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TIME_FORMATS = ("timestamp", "unix_seconds", "unix_millis", "rfc3339")


@dataclass(frozen=True)
class Samples:
    """A metric: its samples, its sorted label names and its name."""

    rows: DataFrame
    labels: tuple[str, ...]
    name: str = ""


def seconds(time: Column, kind: str = "timestamp") -> Column:
    """Epoch seconds (double) of a time column in one of TIME_FORMATS."""
    if kind == "unix_seconds":
        return time.cast("double")
    if kind == "unix_millis":
        return time.cast("double") / 1000
    if kind == "rfc3339":
        return F.unix_micros(F.to_timestamp(time)) / 1e6
    if kind == "timestamp":
        return F.unix_micros(time.cast("timestamp")) / 1e6
    raise ValueError(f"time format {kind!r} is not one of {TIME_FORMATS}")


def samples(df: DataFrame, time: str, value: str, labels: list[str] | None = None, name: str = "", time_format: str = "timestamp") -> Samples:
    """Samples of a table. Labels default to its string columns; a missing label is the empty text; null values are no samples."""
    if labels is None:
        labels = [c for c, kind in df.dtypes if kind == "string" and c not in (time, value)]
    labels = sorted(labels)
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in labels]
    rows = df.filter(F.col(value).isNotNull() & F.col(time).isNotNull())
    return Samples(rows.select(*columns, seconds(F.col(time), time_format).alias("t"), F.col(value).cast("double").alias("value"), F.col(time).alias("ts")), tuple(labels), name)


def read_samples(spark: SparkSession, path: str, time: str, value: str, labels: list[str] | None = None, kind: str = "parquet", time_format: str = "timestamp", schema: str | None = None, metric: tuple[str, str] | None = None, **options: str) -> Samples:
    """Samples from Parquet, JSON, ORC or CSV files; metric=(column, name) keeps one metric of a shared table."""
    reader = spark.read.options(**options)
    df = (reader.schema(schema) if schema else reader).format(kind).load(path)
    if metric:
        df = df.filter(F.col(metric[0]) == metric[1])
    return samples(df, time, value, labels, metric[1] if metric else "", time_format)
