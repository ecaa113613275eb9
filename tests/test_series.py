import math

import pytest
from pyspark.sql import functions as F

from millrace.functions.arithmetic import combine
from millrace.operators import matchers, series, sketches, windows
from millrace.plans.matching import Summary, choose
from millrace.sources import summary_table
from millrace.sources.samples import Samples, read_samples, samples


@pytest.fixture(scope="module")
def metric(spark):
    rows = [("a", "x", 1.0, 6.0), ("a", "x", 5.0, 4.0), ("a", "y", 9.0, 2.0), ("b", "x", 10.0, 8.0), ("b", None, 29.0, 3.0), ("b", "x", 29.5, None)]
    df = spark.createDataFrame(rows, "host string, job string, time double, value double")
    return samples(df, "time", "value", ["job", "host"], "m", "unix_seconds")


def values(df, *keys):
    return {tuple(r[k] for k in keys): r["value"] for r in df.collect()}


def test_samples_sort_labels_fill_missing_ones_and_drop_null_values(metric):
    assert metric.labels == ("host", "job")
    assert {(r["host"], r["job"]) for r in metric.rows.collect()} == {("a", "x"), ("a", "y"), ("b", "x"), ("b", "")}
    assert metric.rows.count() == 5


def test_samples_from_files_in_every_time_format(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"name":"m","l":"a","at":"2024-01-01T00:00:10Z","v":1.5}\n{"name":"n","l":"a","at":"2024-01-01T00:00:11Z","v":2}\n')
    m = read_samples(spark, str(tmp_path / "s.json"), "at", "v", ["l"], "json", "rfc3339", "name string, l string, at string, v double", ("name", "m"))
    assert [(r["l"], r["t"], r["value"]) for r in m.rows.collect()] == [("a", 1704067210.0, 1.5)]
    df = spark.createDataFrame([("a", 10_500, 1.0)], "l string, at long, v double")
    assert samples(df, "at", "v", time_format="unix_millis").rows.first()["t"] == 10.5
    with pytest.raises(ValueError):
        samples(df, "at", "v", time_format="days")


def test_over_time_takes_the_half_open_span(metric):
    assert values(series.over_time(metric, "sum", 10, 10), "host", "job") == {("a", "x"): 10.0, ("a", "y"): 2.0}
    assert values(series.over_time(metric, "increase", 10, 10), "host", "job") == {("a", "x"): -2.0}
    assert values(series.over_time(metric, "rate", 10, 10), "host", "job") == {("a", "x"): -0.5}
    assert values(series.over_time(metric, "sum", 12, 10, offset=2), "host", "job") == {("a", "x"): 10.0, ("a", "y"): 2.0}


def test_frequency_statistics(spark):
    m = Samples(spark.createDataFrame([("a", 0.0, v) for v in (1.0, 1.0, 2.0, 3.0)], "l string, t double, value double"), ("l",))
    got = {s: values(series.aggregate(m.rows, ["l"], s), "l")[("a",)] for s in ("entropy", "l1", "l2", "distinct", "sum2", "stdvar")}
    assert got == pytest.approx({"entropy": 1.5, "l1": 4.0, "l2": math.sqrt(6), "distinct": 3, "sum2": 15.0, "stdvar": 0.6875})


def test_spatial_groupings_and_top(metric):
    assert series.at_instant(metric, "sum", 10.5, 10).collect()[0]["value"] == 12.0
    assert values(series.at_instant(metric, "sum", 10.5, 10, without=["job"]), "host") == {("a",): 12.0}
    assert [tuple(r) for r in series.top(metric, 1, 10, 10).collect()] == [("m", "a", "x", 10.0)]


def test_binary_joins_on_labels_and_divides_as_ieee(spark):
    left = spark.createDataFrame([("a", 1.0), ("b", -2.0), ("c", 0.0)], "l string, value double")
    right = spark.createDataFrame([("a", 0.0), ("b", 0.0), ("c", 0.0), ("d", 1.0)], "l string, value double")
    got = values(series.binary(left, right, "/", ["l"]), "l")
    assert got[("a",)] == math.inf and got[("b",)] == -math.inf and math.isnan(got[("c",)]) and len(got) == 3
    assert math.isnan(values(series.binary(left, 0.0, "%", ["l"]), "l")[("a",)])
    assert values(series.binary(left, 2.0, "^", ["l"], reverse=True), "l")[("b",)] == 0.25
    with pytest.raises(ValueError):
        combine(">", F.lit(1), F.lit(2))


@pytest.mark.parametrize("statistic", ["sum", "count", "avg", "min", "max", "sum2", "stdvar", "increase", "rate"])
def test_merged_panes_equal_direct_aggregation(spark, statistic):
    rows = spark.createDataFrame([(k, float(i * 7 % 60), float(i * i % 13)) for i in range(40) for k in "ab"], "l string, t double, value double")
    panes = windows.build(rows, ["l"], statistic, 10)
    merged = windows.read(windows.merge(panes, ["l"], statistic), ["l"], statistic)
    assert values(merged, "l") == pytest.approx(values(series.aggregate(rows, ["l"], statistic), "l"))


def test_windows_align_to_the_epoch_and_slide_over_panes(spark):
    rows = spark.createDataFrame([(15.0, 42.0)], "t double, value double")
    slid = windows.slide(windows.build(rows, [], "sum", 10), [], "sum", 30, 10)
    assert {(r["window_start"], r["window_end"], r["total"]) for r in slid.collect()} == {(-10.0, 20.0, 42.0), (0.0, 30.0, 42.0), (10.0, 40.0, 42.0)}
    t = spark.createDataFrame([(x,) for x in (0.0, 59.999, 60.0, 119.999, 120.0)], "t double")
    assert [r[0] for r in t.select(windows.window_start(F.col("t"), 60)).collect()] == [0, 0, 60, 60, 120]


def test_range_steps_are_inclusive_and_leave_empty_ones_out(metric):
    got = windows.over_steps(metric, "sum", 10, 40, 10, 10, ["host"])
    assert values(got, "host", "step_time") == {("a", 10.0): 12.0, ("b", 20.0): 8.0, ("b", 30.0): 3.0}
    slow = windows.over_steps(metric, "quantile", 10, 40, 10, 20, ["host"], 1.0)
    fast = windows.over_steps(metric, "max", 10, 40, 10, 20, ["host"])
    assert values(slow, "host", "step_time") == values(fast, "host", "step_time")


def test_summary_table_round_trip_and_retention(spark, metric, tmp_path):
    path = str(tmp_path / "table")
    half = [metric.rows.filter("t < 6"), metric.rows.filter("t >= 6")]
    for part in half:
        summary_table.append(windows.build(part, ["host"], "sum", 10), path, 1)
    stored = summary_table.read(spark, path, 1)
    assert stored.count() == 4  # two partial rows for the first window of host a
    got = windows.read(windows.merge(summary_table.in_range(stored, 0, 20), ["host"], "sum"), ["host"], "sum")
    assert values(got, "host") == {("a",): 12.0, ("b",): 8.0}
    assert summary_table.exactly(stored, 20, 30).count() == 1
    assert summary_table.earliest(stored).first()["earliest"] == 0.0
    assert {r["window_start"] for r in summary_table.keep_latest(stored, 1, 1).collect()} == {20.0}
    reads = spark.createDataFrame([(1, 0.0, 10.0, 2), (1, 10.0, 20.0, 1)], "agg_id int, window_start double, window_end double, n int")
    assert {r["window_start"] for r in summary_table.drop_read(stored, reads, 2).collect()} == {10.0, 20.0}


def test_key_changes(spark):
    sets = windows.keys(spark.createDataFrame([(1.0, "a"), (2.0, "b"), (11.0, "b"), (21.0, "b")], "t double, k string"), ["k"], 10)
    got = {(r["window_start"], r["k"], r["change"]) for r in windows.key_changes(sets, ["k"], 10).collect()}
    assert got == {(0.0, "a", "added"), (0.0, "b", "added"), (10.0, "a", "removed")}


def test_count_min_never_underestimates_and_merges(spark):
    rows = spark.createDataFrame([(str(i % 50), float(i % 7 + 1), i % 3) for i in range(500)], "k string, value double, part int")
    sketch = sketches.count_min_merge(sketches.count_min(rows, ["part"], "k", 3, 64), [])
    true = values(rows.groupBy("k").agg(F.sum("value").alias("value")), "k")
    got = values(sketches.count_min_estimate(sketch, rows.select("k").distinct(), [], "k", 3, 64), "k")
    assert all(got[k] >= true[k] for k in true) and got.keys() == true.keys()


def test_matchers_and_their_normal_form(spark):
    df = spark.createDataFrame([("abc",), ("b",), (None,)], "l string")
    count = lambda kind, v: matchers.matching(df, ("l", kind, v)).count()
    assert [count("=", "b"), count("!=", "b"), count("=~", "a.*|b"), count("!~", "b"), count("=", "")] == [1, 2, 2, 2, 1]
    assert matchers.normal_filter(' { b="2" , a="1"}') == 'a="1",b="2"'


def test_choice_of_summaries():
    wide, narrow = Summary(1, "m", "sum", frozenset({"a", "b"}), 60), Summary(2, "m", "sum", frozenset({"a"}), 300)
    ask = lambda labels, seconds, **k: choose([wide, narrow], "m", "sum", frozenset(labels), seconds, **k)
    assert ask("a", 600) == narrow and ask("a", 120) == wide and ask("ab", 600) == wide
    assert ask("c", 600) is None and ask("a", 90) is None
    assert ask("a", 600, matchers=frozenset({("b", "=", "1")})) == wide
    assert choose([Summary(3, "m", "sum", frozenset("a"), 300, slide=60)], "m", "sum", frozenset("a"), 600) is None
    assert choose([wide], "m", "max", frozenset("a"), 60) is None
