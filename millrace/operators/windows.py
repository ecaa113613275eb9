"""Window summaries: built in event-time windows, merged over ranges, read as values.

Sliding windows share panes: samples are aggregated once per pane of the slide's
width, and each pane's state goes to the windows that contain it. Range queries
do the same with the step. Rows are never copied per window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import Statistic, stored
from ..sources.samples import Samples


def window_start(t: Column, seconds: float) -> Column:
    """Start of the epoch-aligned window of a time."""
    return F.floor(t / seconds) * seconds


def build(rows: DataFrame, by: list[str], statistic: str | Statistic, seconds: float) -> DataFrame:
    """(by, window_start, window_end, states) of tumbling windows over samples (t, value)."""
    s = stored(statistic)
    start = window_start(F.col("t"), seconds).cast("double")
    states = rows.groupBy(*by, start.alias("window_start")).agg(*[f(F.col("value"), F.col("t")).alias(n) for n, f in s.build.items()])
    return states.withColumn("window_end", F.col("window_start") + seconds)


def slide(panes: DataFrame, by: list[str], statistic: str | Statistic, seconds: float, step: float) -> DataFrame:
    """Windows of seconds every step from panes of width step; windows start at multiples of step."""
    n = int(seconds // step)
    s = stored(statistic)
    starts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.col("window_start") - i * step)
    states = [c for c in panes.columns if c in s.merge]
    each = panes.select(*by, *states, F.explode(starts).alias("window_start"))
    return merge(each, [*by, "window_start"], statistic).withColumn("window_end", F.col("window_start") + n * step)


def in_windows(rows: DataFrame, seconds: float, step: float | None = None) -> DataFrame:
    """Samples with the window_start of every window of seconds, one each step (seconds, if None), that they lie in."""
    step = step or seconds
    starts = F.transform(F.sequence(F.lit(0), F.lit(int(seconds // step) - 1)), lambda i: (window_start(F.col("t"), step) - i * step).cast("double"))
    return rows.withColumn("window_start", F.explode(starts))


def merge(summaries: DataFrame, by: list[str], statistic: str | Statistic) -> DataFrame:
    """States of the groups `by`, merged from all rows of summaries."""
    return summaries.groupBy(*by).agg(*[f(n).alias(n) for n, f in stored(statistic).merge.items()])


def read(states: DataFrame, keep: list[str], statistic: str | Statistic, q: float | None = None) -> DataFrame:
    """(keep, value) of states; groups without a value (a rate over one instant) are left out. Quantile sketches are asked for q."""
    return states.select(*keep, stored(statistic).read(q).alias("value")).filter(F.col("value").isNotNull())


def subtract(total: DataFrame, part: DataFrame, by: list[str]) -> DataFrame:
    """States of sums and counts without an expired part; groups that the part lacks stay as they are."""
    names = [c for c in total.columns if c in ("total", "n", "squares")]
    part = part.select(*by, *[F.col(c).alias(f"_minus_{c}") for c in names])
    both = total.join(part, by, "left")
    return both.select(*by, *[(F.col(c) - F.coalesce(F.col(f"_minus_{c}"), F.lit(0))).alias(c) for c in names])


def over_steps(m: Samples, statistic: str | Statistic, start: float, end: float, step: float, lookback: float, by: list[str] | None = None, q: float | None = None) -> DataFrame:
    """(by, step_time, value) at start, start + step, ..., end inclusive, each over [step_time - lookback, step_time); empty steps are left out.

    Mergeable statistics (`kll` for quantiles among them) go through panes of the step's
    width where lookback is a multiple of it; exact quantiles give every sample to the
    steps that look back at it.
    """
    by = list(m.labels) if by is None else by
    if statistic != "quantile" and lookback % step == 0:
        return read(step_states(m, statistic, start, end, step, lookback, by), [*by, "step_time"], statistic, q)
    from .series import aggregate

    return aggregate(at_steps(m, start, end, step, lookback), [*by, "step_time"], statistic, q)


def step_states(m: Samples, statistic: str | Statistic, start: float, end: float, step: float, lookback: float, by: list[str]) -> DataFrame:
    """(by, step_time, states) of the steps of over_steps, merged from panes of the step's width; lookback is a multiple of it."""
    rows, steps, first = _steps(m, start, end, step, lookback)
    s = stored(statistic)
    panes = rows.groupBy(*by, first.alias("pane")).agg(*[f(F.col("value"), F.col("t")).alias(n) for n, f in s.build.items()])
    reach = F.sequence(F.greatest(F.col("pane"), F.lit(0)), F.least(F.col("pane") + int(lookback // step) - 1, F.lit(steps)))
    seen = panes.filter((F.col("pane") <= steps) & (F.col("pane") + int(lookback // step) - 1 >= 0))
    states = merge(seen.select(*by, *s.merge, F.explode(reach).alias("k")), [*by, "k"], statistic)
    return states.select(*by, (F.lit(start) + F.col("k") * step).alias("step_time"), *s.merge)


def _steps(m: Samples, start: float, end: float, step: float, lookback: float) -> tuple[DataFrame, int, Column]:
    """Samples that a step looks back at, the last step's number, and the first step after a sample."""
    steps = int((end - start) // step)
    rows = m.rows.filter((F.col("t") >= start - lookback) & (F.col("t") < start + steps * step))
    return rows, steps, F.floor((F.col("t") - start) / step) + 1


def at_steps(m: Samples, start: float, end: float, step: float, lookback: float) -> DataFrame:
    """Samples with the step_time of every step of over_steps that looks back at them."""
    rows, steps, first = _steps(m, start, end, step, lookback)
    last = F.floor((F.col("t") - start + lookback) / step)
    rows = rows.withColumn("k", F.explode(F.sequence(F.greatest(first, F.lit(0)), F.least(last, F.lit(steps))))) if lookback >= step else rows.filter(first <= last).withColumn("k", first)
    return rows.withColumn("step_time", F.lit(start) + F.col("k") * step).drop("k")


def keys(rows: DataFrame, by: list[str], seconds: float) -> DataFrame:
    """The key sets of windows, one row per (window_start, key)."""
    return rows.select(window_start(F.col("t"), seconds).cast("double").alias("window_start"), *by).distinct()


def key_changes(sets: DataFrame, by: list[str], seconds: float) -> DataFrame:
    """(window_start, key, change) against the last window before that has any key: keys `added`, and those `removed` that only it has.

    Windows without samples are no windows: after a gap the sets on both sides of it are compared.
    """
    starts = sets.select("window_start").distinct()
    follows = starts.withColumn("next", F.lead("window_start").over(Window.orderBy("window_start")))
    was = sets.join(F.broadcast(follows), "window_start").filter(F.col("next").isNotNull()).select(F.col("next").alias("window_start"), *by)
    added = sets.join(was, ["window_start", *by], "left_anti").withColumn("change", F.lit("added"))
    removed = was.join(sets, ["window_start", *by], "left_anti").withColumn("change", F.lit("removed"))
    return added.unionByName(removed)


def key_history(changes: DataFrame, by: list[str], until: float) -> DataFrame:
    """The key set that changes up to a window's start leave."""
    last = changes.filter(F.col("window_start") <= until).groupBy(*by).agg(F.max_by("change", "window_start").alias("change"))
    return last.filter("change = 'added'").select(*by)
