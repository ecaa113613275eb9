"""Aggregates over the samples of a group, exact and in mergeable form.

A state is a set of named columns. Every statistic of STORED has states that are
built from samples, merged by further aggregation and read out; merging the
states of parts gives what building from all samples gives (for sketches, within
their error).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Statistic:
    """How a statistic is built over (value, time), merged over its states' columns, and read from them (with q, for quantiles)."""

    build: dict[str, Callable[[Column, Column], Column]]
    merge: dict[str, Callable[[str], Column]]
    read: Callable[[float | None], Column]


def _plain(build: dict[str, Callable[[Column, Column], Column]], merge: Callable[[str], Column], read: Callable[[], Column]) -> Statistic:
    """A statistic whose states all merge by one aggregate."""
    return Statistic(build, {name: merge for name in build}, lambda q: read())


#: Buffers of first and last sample are four numbers, so Spark aggregates them by hash.
_ends = {"first_t": lambda v, t: F.min(t), "first": F.min_by, "last_t": lambda v, t: F.max(t), "last": F.max_by}
_merge_ends = {"first_t": F.min, "first": lambda c: F.min_by(c, "first_t"), "last_t": F.max, "last": lambda c: F.max_by(c, "last_t")}


def _per_span(by: Column | None = None) -> Column:
    rise, span = F.col("last") - F.col("first"), F.col("last_t") - F.col("first_t")
    return F.when(span > 0, rise if by is None else rise / F.nullif(by, F.lit(0.0)))


def _moments(name: str) -> Column:
    """Count, mean or squared deviations of all parts together, adding one part at a time about a running mean."""
    parts = F.sort_array(F.collect_list(F.struct(F.col("n").cast("double").alias("n"), "mean", "m2")))

    def add(a: Column, x: Column) -> Column:
        n, apart = a["n"] + x["n"], x["mean"] - a["mean"]
        return F.struct(n.alias("n"), (a["mean"] + apart * x["n"] / n).alias("mean"), (a["m2"] + x["m2"] + apart * apart * a["n"] * x["n"] / n).alias("m2"))

    return F.aggregate(parts, F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2")), add)[name]


#: Times are seconds. increase and rate take the first and last sample by time, without resets or extrapolation; of
#: several samples at one time any may be taken (a series has one). A group of one instant has no rate (null).
EXACT: dict[str, Statistic] = {
    "sum": _plain({"total": lambda v, t: F.sum(v)}, F.sum, lambda: F.col("total")),
    "count": _plain({"n": lambda v, t: F.count(v)}, F.sum, lambda: F.col("n")),
    "avg": _plain({"total": lambda v, t: F.sum(v), "n": lambda v, t: F.count(v)}, F.sum, lambda: F.col("total") / F.col("n")),
    "min": _plain({"least": lambda v, t: F.min(v)}, F.min, lambda: F.col("least")),
    "max": _plain({"most": lambda v, t: F.max(v)}, F.max, lambda: F.col("most")),
    "sum2": _plain({"squares": lambda v, t: F.sum(v * v)}, F.sum, lambda: F.col("squares")),
    "increase": Statistic(_ends, _merge_ends, lambda q: _per_span()),
    "rate": Statistic(_ends, _merge_ends, lambda q: _per_span(F.col("last_t") - F.col("first_t"))),
    "stdvar": Statistic(
        {"n": lambda v, t: F.count(v).cast("double"), "mean": lambda v, t: F.avg(v), "m2": lambda v, t: F.var_pop(v) * F.count(v)},
        {name: lambda c: _moments(c) for name in ("n", "mean", "m2")},
        lambda q: F.col("m2") / F.col("n"),
    ),
}



def kll_statistic(k: int) -> Statistic:
    """Quantiles from KLL sketches of accuracy k (8 to 65535); exact while a group has no more than k samples."""
    build = lambda v, t: F.kll_sketch_agg_double(v, k)
    return Statistic({"kll": build}, {"kll": F.kll_merge_agg_double}, lambda q: F.kll_sketch_get_quantile_double("kll", F.lit(float(q))))


#: Sketches: quantiles of the values, and the number of distinct values.
KLL_K, HLL_BITS = 200, 12
SKETCHED: dict[str, Statistic] = {
    "kll": kll_statistic(KLL_K),
    "hll": Statistic({"hll": lambda v, t: F.hll_sketch_agg(v, HLL_BITS)}, {"hll": F.hll_union_agg}, lambda q: F.hll_sketch_estimate("hll")),
}

#: Sketches over keys: the statistic that each cell of the grid (row, cell) holds; see operators.sketches.cells.
KEYED = {"count_min": "sum", "keyed_kll": "kll"}

#: Every statistic that windows, streams and summary tables can hold.
STORED: dict[str, Statistic] = EXACT | SKETCHED


def stored(statistic: str | Statistic) -> Statistic:
    """A statistic by name, or one made to measure."""
    return STORED[statistic] if isinstance(statistic, str) else statistic


#: Statistics that are computed from all samples at once.
DIRECT: dict[str, Callable[[Column], Column]] = {
    "stddev": F.stddev_pop,
    "distinct": F.count_distinct,
}


def quantile(value: Column, q: float) -> Column:
    """Exact quantile with linear interpolation."""
    if not 0 <= q <= 1:
        raise ValueError("a quantile lies between 0 and 1")
    return F.percentile(value, F.lit(q))


def spread_quantile(rows: DataFrame, by: list[str], q: float, parts: int = 64, splits: DataFrame | None = None, discrete: bool = False) -> DataFrame:
    """(by, value): exact quantiles with linear interpolation for groups of any size; no task holds a group's values.

    Approximate quantiles part each group; counts of the parts tell which of them hold
    the two values around the rank asked for. Only those values are counted, sorted
    (on disk, where they are many) and ranked. splits (by, _splits) are other values to
    part the groups by, and only its groups are answered; the result is exact whatever
    they are. discrete takes the least value that a share q of the group does not exceed.
    """
    if not 0 <= q <= 1:
        raise ValueError("a quantile lies between 0 and 1")
    rows = rows.select(*by, "value").filter(F.col("value").isNotNull())
    if splits is None:
        splits = rows.groupBy(*by).agg(F.percentile_approx("value", [i / parts for i in range(1, parts)], 4 * parts).alias("_splits"))
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by] or [F.lit(True)]
    keep = lambda a: [F.col(f"{a}.{c}") for c in by]
    parted = rows.alias("r").join(F.broadcast(splits.alias("s")) if not by else splits.alias("s"), same("r", "s")).select(*keep("r"), "value", F.size(F.filter("_splits", lambda x: x <= F.col("value"))).alias("_part"))
    counts = parted.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_all", F.sum("_n").over(whole))
    over, under = Decimal(str(q)).as_integer_ratio()
    counts = counts.withColumn("_rank", F.expr(f"greatest((_all * {over} + {under - 1}) div {under}, 1) - 1") if discrete else (F.col("_all") - 1) * F.lit(float(q)))
    held = counts.filter((F.col("_before") <= F.ceil("_rank")) & (F.col("_before") + F.col("_n") > F.floor("_rank"))).select(*by, "_part", "_before", "_rank")
    values = parted.groupBy(*by, "_part", "value").agg(F.count(F.lit(1)).alias("_n")).alias("v").join(held.alias("h"), [*same("v", "h"), F.col("v._part") == F.col("h._part")])
    values = values.select(*keep("v"), F.col("v._part").alias("_part"), "value", "_n", "_before", "_rank")
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*by, "_part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    values = values.withColumn("_upto", upto)
    at = lambda rank: F.max(F.when((F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank), F.col("value")))
    found = values.groupBy(*by).agg(at(F.floor("_rank")).alias("_low"), at(F.ceil("_rank")).alias("_high"), F.max(F.col("_rank") - F.floor("_rank")).alias("_share"))
    return found.select(*by, (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_share")).cast("double").alias("value"))
