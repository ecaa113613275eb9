"""Aggregation over time, across series, and arithmetic between results, at one instant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import DIRECT, EXACT, quantile, spread_quantile
from ..functions.arithmetic import combine
from ..sources.samples import Samples


def aggregate(rows: DataFrame, by: list[str], statistic: str, q: float | None = None) -> DataFrame:
    """(by, value) of rows (t, value): any statistic of the functions package, quantile, or a norm of value frequencies."""
    v, t = F.col("value"), F.col("t") if "t" in rows.columns else F.lit(0.0)
    if statistic == "quantile":
        return rows.groupBy(*by).agg(quantile(v, q).alias("value"))
    if statistic in ("entropy", "l1", "l2"):
        return _frequencies(rows, by, statistic)
    if statistic in DIRECT:
        return rows.groupBy(*by).agg(DIRECT[statistic](v).alias("value"))
    if statistic == "stdvar":
        return rows.groupBy(*by).agg(F.var_pop(v).alias("value"))
    s = EXACT[statistic]
    states = rows.groupBy(*by).agg(*[f(v, t).alias(name) for name, f in s.build.items()])
    return states.select(*by, s.read(None).alias("value")).filter(F.col("value").isNotNull())


def _frequencies(rows: DataFrame, by: list[str], statistic: str) -> DataFrame:
    """Norms and entropy (base 2) of how often each value occurs in a group."""
    counts = rows.groupBy(*by, "value").agg(F.count(F.lit(1)).cast("double").alias("f"))
    if statistic == "l1":
        return counts.groupBy(*by).agg(F.sum("f").alias("value"))
    if statistic == "l2":
        return counts.groupBy(*by).agg(F.sqrt(F.sum(F.col("f") * F.col("f"))).alias("value"))
    sums = counts.groupBy(*by).agg(F.sum("f").alias("n"), F.sum(F.col("f") * F.log2("f")).alias("s"))
    return sums.select(*by, (F.log2("n") - F.col("s") / F.col("n")).alias("value"))


def over_time(m: Samples, statistic: str, end: float, seconds: float, q: float | None = None, offset: float = 0.0) -> DataFrame:
    """Per series: a statistic of the samples in [end - offset - seconds, end - offset)."""
    end -= offset
    return aggregate(m.rows.filter((F.col("t") >= end - seconds) & (F.col("t") < end)), list(m.labels), statistic, q)


def grouping(labels: tuple[str, ...], by: list[str] | None = None, without: list[str] | None = None) -> list[str]:
    """Output labels: those of by, or all but those of without, or none."""
    if without is not None:
        return [x for x in labels if x not in without]
    return sorted(by or [])


def across(rows: DataFrame, labels: tuple[str, ...], statistic: str, by: list[str] | None = None, without: list[str] | None = None, q: float | None = None) -> DataFrame:
    """A statistic across series (rows with value), grouped by, without, or over all labels; quantiles for groups of any size."""
    if statistic == "quantile":
        return spread_quantile(rows, grouping(labels, by, without), q)
    return aggregate(rows, grouping(labels, by, without), statistic, q)


def at_instant(m: Samples, statistic: str, at: float, interval: float, by: list[str] | None = None, without: list[str] | None = None, q: float | None = None) -> DataFrame:
    """A statistic across series of the one interval that ends at the last multiple of interval before or at `at`.

    All samples of the interval count, not only the last of each series.
    """
    end = at // interval * interval
    return across(m.rows.filter((F.col("t") >= end - interval) & (F.col("t") < end)), m.labels, statistic, by, without, q)


def nested(m: Samples, outer: str, inner: str, end: float, seconds: float, by: list[str] | None = None, without: list[str] | None = None, q: float | None = None) -> DataFrame:
    """outer across series of inner over time. Pairs that one aggregation can do are done in one: sum of sums or counts, min of min, max of max."""
    once = {("sum", "sum"): "sum", ("sum", "count"): "count", ("min", "min"): "min", ("max", "max"): "max"}
    if (outer, inner) in once:
        rows = m.rows.filter((F.col("t") >= end - seconds) & (F.col("t") < end))
        return aggregate(rows, grouping(m.labels, by, without), once[outer, inner])
    return across(over_time(m, inner, end, seconds, q), m.labels, outer, by, without, q)


def top(m: Samples, k: int, at: float, interval: float, statistic: str = "sum", q: float | None = None) -> DataFrame:
    """The k series of the largest value of a statistic in the interval before at, with the metric's name; ties by labels."""
    end = at // interval * interval
    found = over_time(m, statistic, end, interval, q)
    return found.orderBy(F.col("value").desc(), *m.labels).limit(k).select(F.lit(m.name).alias("__name__"), *m.labels, "value")


def binary(left: DataFrame, right: DataFrame | float, op: str, on: list[str], reverse: bool = False) -> DataFrame:
    """left op right for equal labels `on` (an instant result, or a range with time among them), or with a scalar.

    Without labels both sides have one row at most.
    """
    if not isinstance(right, DataFrame):
        a, b = F.col("value"), F.lit(float(right))
        return left.withColumn("value", combine(op, b, a) if reverse else combine(op, a, b))
    right = right.select(*[F.col(c).alias(f"_r_{c}") for c in on], F.col("value").alias("_right"))
    if on:
        condition = F.lit(True)
        for c in on:
            condition = condition & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        pairs = left.join(right, condition)
    else:
        pairs = left.withColumn("_one", F.lit(1)).join(right.withColumn("_one", F.lit(1)), "_one")
    return pairs.select(*on, combine(op, F.col("value"), F.col("_right")).alias("value"))
