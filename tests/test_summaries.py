"""Stored summaries: retention by aggregation, mergeable moments, exact quantiles of large groups, and errors of sketches."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions.aggregates import kll_statistic, quantile, spread_quantile
from millrace.operators import series, sketches, windows
from millrace.plans.matching import Summary, answer
from millrace.sources import summary_table
from millrace.sources.samples import Samples


@pytest.fixture(scope="module")
def kept(spark):
    """Aggregation 1 has 20 windows, 2 has 5 older ones."""
    rows = [(1, float(w), float(w + 1), 1.0) for w in range(10, 30)] + [(2, float(w), float(w + 1), 1.0) for w in range(5)]
    return spark.createDataFrame(rows, "agg_id int, window_start double, window_end double, total double")


def starts(df):
    found = {}
    for r in df.collect():
        found.setdefault(r["agg_id"], set()).add(r["window_start"])
    return found


def test_each_aggregation_keeps_its_latest_windows(kept):
    assert starts(summary_table.keep_latest(kept, 1)) == {1: {26.0, 27.0, 28.0, 29.0}, 2: {1.0, 2.0, 3.0, 4.0}}
    assert starts(summary_table.keep_latest(kept, 2))[2] == {0.0, 1.0, 2.0, 3.0, 4.0}


def test_read_windows_go_by_aggregation_and_exempt_ones_stay(spark, kept):
    reads = spark.createDataFrame([(a, 3.0, 4.0, 2) for a in (1, 2)] + [(1, 11.0, 12.0, 1), (1, 11.0, 12.0, 1), (1, 12.0, 13.0, 1)], "agg_id int, window_start double, window_end double, n int")
    found = starts(summary_table.drop_read(kept, reads, 2))
    assert found == {1: set(map(float, range(10, 30))) - {11.0}, 2: {0.0, 1.0, 2.0, 4.0}}
    assert starts(summary_table.drop_read(kept, reads, 2, keep=[2]))[2] == set(map(float, range(5)))


def test_variance_of_large_values_keeps_its_digits(spark):
    rng = random.Random(1)
    rows = [("a", float(t), 1e9 + rng.random()) for t in range(500)]
    df = spark.createDataFrame(rows, "l string, t double, value double")
    merged = windows.read(windows.merge(windows.build(df, ["l"], "stdvar", 7), ["l"], "stdvar"), ["l"], "stdvar").first()["value"]
    mean = sum(v - 1e9 for *_, v in rows) / 500
    assert merged == pytest.approx(sum((v - 1e9 - mean) ** 2 for *_, v in rows) / 500, rel=1e-6)


def test_rate_aggregates_by_hash(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0)], "l string, t double, value double")
    plan = windows.build(df, ["l"], "rate", 10)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


@pytest.mark.parametrize("by", [[], ["l"]])
@pytest.mark.parametrize("q", [0.0, 0.3, 0.95, 1.0])
def test_quantiles_of_large_groups_are_exact(spark, by, q):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.gauss(0, 1), 7.0, float(rng.randrange(5))])) for _ in range(3000)] + [("one", 1.5), ("none", None)]
    df = spark.createDataFrame(rows, "l string, value double")
    true = {tuple(r[c] for c in by): r["v"] for r in df.filter("value is not null").groupBy(*by).agg(quantile(F.col("value"), q).alias("v")).collect()}
    got = {tuple(r[c] for c in by): r["value"] for r in spread_quantile(df, by, q, parts=16).collect()}
    assert got == pytest.approx(true)


def test_no_rows(spark):
    none = spark.createDataFrame([], "l string, t double, value double")
    assert spread_quantile(none, ["l"], 0.5).count() == 0
    assert windows.read(windows.build(none, ["l"], "kll", 10), ["l"], "kll", 0.5).count() == 0
    assert sketches.heavy_keys(none, [], "l", 3).count() == 0


@pytest.mark.parametrize("k, most", [(200, 0.02), (2048, 0.003)])
def test_rank_errors_of_merged_quantile_sketches(spark, k, most):
    df = spark.range(60_000).select(F.lit("a").alias("l"), (F.col("id") % 100).cast("double").alias("t"), F.xxhash64("id").cast("double").alias("value"))
    s = kll_statistic(k)
    states = windows.merge(windows.build(df, ["l"], s, 10), ["l"], s)
    for q in (0.5, 0.95):
        cut = windows.read(states, ["l"], s, q).first()["value"]
        assert abs(df.filter(F.col("value") <= cut).count() / 60_000 - q) <= most


def test_heavy_keys_of_many_are_found(spark):
    """Zipf-like sums over 20,000 keys: recall of the 20 largest, and estimates never too small, at 3 x 1024 cells."""
    df = spark.range(200_000).select(F.floor(F.pow(F.rand(3), F.lit(4.0)) * 20_000).cast("string").alias("key"), F.lit(1.0).alias("value"))
    df = spark.createDataFrame(df.toArrow().to_pandas())
    true = {r["key"]: r["n"] for r in df.groupBy("key").agg(F.sum("value").alias("n")).collect()}
    got = {r["key"]: r["value"] for r in sketches.heavy_keys(df, [], "key", 20).collect()}
    best = sorted(true, key=lambda x: -true[x])[:20]
    assert len(got) == 20 and len(set(best) & set(got)) >= 18
    assert all(v >= true[x] - 1e-6 for x, v in got.items())


def test_keyed_quantiles_of_many_keys(spark):
    """At 3 x 1024 cells and 2,000 keys: the mean rank error of medians stays small."""
    df = spark.range(100_000).select((F.col("id") % 2000).cast("string").alias("key"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("value"))
    found = sketches.keyed_quantile(sketches.keyed_quantiles(df, "key"), df.select("key").distinct(), "key", 0.5)
    ranks = df.join(found.withColumnRenamed("value", "m"), "key").groupBy("key").agg(F.avg((F.col("value") <= F.col("m")).cast("double")).alias("r"))
    assert found.count() == 2000 and ranks.agg(F.avg(F.abs(F.col("r") - 0.5))).first()[0] < 0.06


def test_questions_go_to_the_summary_that_can_answer(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", 1.0, 2.0), ("a", "y", 12.0, 4.0), ("b", "x", 13.0, 8.0)], "host string, job string, t double, value double")
    m = Samples(rows, ("host", "job"), "m")
    summary_table.append(windows.build(rows.withColumn("value", F.col("value") * 100), ["host"], "avg", 10), f"{tmp_path}/t", 1)  # marked, to tell it from raw rows
    known = [Summary(1, "m", "avg", frozenset({"host"}), 10)]
    ask = lambda *a, **k: {tuple(r)[:-1]: r["value"] for r in answer(spark, f"{tmp_path}/t", m, known, *a, **k).collect()}
    assert ask("sum", ["host"], 20.0, 20) == {("a",): 600.0, ("b",): 800.0}
    assert ask("avg", ["host"], 20.0, 10) == {("a",): 400.0, ("b",): 800.0}
    assert ask("sum", ["host"], 15.0, 15) == {("a",): 6.0, ("b",): 8.0}
    assert ask("sum", ["job"], 20.0, 20) == {("x",): 10.0, ("y",): 4.0}
    assert ask("sum", ["host"], 20.0, 20, matchers=frozenset({("host", "=", "a")})) == {("a",): 600.0}


def test_top_of_any_statistic(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 9.0), ("b", 3.0, 6.0), ("c", 4.0, 1.0)], "host string, t double, value double")
    m = Samples(rows, ("host",), "m")
    assert [r["host"] for r in series.top(m, 2, 10, 10, "avg").collect()] == ["b", "a"]
    assert [r["host"] for r in series.top(m, 1, 10, 10, "quantile", 1.0).collect()] == ["a"]


@pytest.fixture(scope="module")
def skewed(spark):
    """40,000 samples of 2,000 keys, equal sums among them, in two groups."""
    df = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("l"), (F.floor(F.pow(F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000, F.lit(3.0)) * 1000) * 2 + F.col("id") % 2).cast("long").cast("string").alias("key"), F.pmod(F.xxhash64("id"), F.lit(97)).cast("double").alias("value"), (F.col("id") % 50).cast("double").alias("t"))
    return spark.createDataFrame(df.toArrow().to_pandas())


def discrete(df, by, q):
    """The least value that a share q of each group does not exceed."""
    groups: dict = {}
    for r in df.collect():
        groups.setdefault(tuple(r[c] for c in by), []).append(r["value"])
    return {g: sorted(v)[max(1, -(-len(v) * int(q * 100) // 100)) - 1] for g, v in groups.items()}


@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_settled_quantiles_are_exact(spark, skewed, q):
    """Groups a and b have more samples than their sketches hold, few does not."""
    df = skewed.select("l", "t", "value").unionByName(spark.createDataFrame([("few", 1.0, 3.0), ("few", 2.0, 4.0)], "l string, t double, value double"))
    states = windows.merge(windows.build(df, ["l"], kll_statistic(8), 10), ["l"], kll_statistic(8))
    got = {(r["l"],): r["value"] for r in sketches.settled_quantiles(states, df, ["l"], q, 8).collect()}
    assert got == discrete(df, ["l"], q)


def test_settled_quantiles_do_not_rely_on_their_splits(skewed):
    splits = skewed.select("l").distinct().withColumn("_splits", F.array(F.lit(-5.0), F.lit(1e6)))
    assert {(r["l"],): r["value"] for r in spread_quantile(skewed, ["l"], 0.5, splits=splits, discrete=True).collect()} == discrete(skewed, ["l"], 0.5)


def test_settled_windows_and_steps(skewed):
    m, s = Samples(skewed, ("l",), "m"), kll_statistic(8)
    slid = windows.slide(windows.build(skewed, ["l"], s, 10), ["l"], s, 20, 10)
    rows = windows.in_windows(skewed, 20, 10)
    assert {(r["l"], r["window_start"]): r["value"] for r in sketches.settled_quantiles(slid, rows, ["l", "window_start"], 0.5, 8).collect()} == discrete(rows, ["l", "window_start"], 0.5)
    rows = windows.at_steps(m, 20, 40, 10, 20)
    assert {(r["l"], r["step_time"]): r["value"] for r in sketches.settled_quantiles(windows.step_states(m, s, 20, 40, 10, 20, ["l"]), rows, ["l", "step_time"], 0.5, 8).collect()} == discrete(rows, ["l", "step_time"], 0.5)


@pytest.mark.parametrize("weight", ["value", None])
def test_settled_frequencies_and_heavy_keys_are_exact(skewed, weight):
    """64 cells for 2,000 keys: next to no key is alone."""
    add = F.sum(weight) if weight else F.count(F.lit(1)).cast("double")
    true = {(r["l"], r["key"]): r["n"] for r in skewed.groupBy("l", "key").agg(add.alias("n")).collect()}
    grid = sketches.count_min(skewed, ["l"], "key", 2, 64, weight)
    assert {(r["l"], r["key"]): r["value"] for r in sketches.settled_frequencies(grid, skewed, ["l"], "key", 2, 64, weight).collect()} == true
    few = skewed.filter("key like '1%'")
    assert {(r["l"], r["key"]): r["value"] for r in sketches.settled_frequencies(sketches.count_min(few, ["l"], "key", 3, 1 << 12, weight), few, ["l"], "key", 3, 1 << 12, weight).collect()} == {x: n for x, n in true.items() if x[1][0] == "1"}
    best = {g: sorted((-n, k) for (l, k), n in true.items() if l == g)[:7] for g in ("a", "b")}
    got = sketches.heavy_keys(skewed, ["l"], "key", 7, 2, 64, weight, settle=4).collect()
    assert {g: sorted((-r["value"], r["key"]) for r in got if r["l"] == g) for g in best} == best


def test_settled_keyed_quantiles_and_distinct_are_exact(skewed):
    grid = sketches.keyed_quantiles(skewed, "key", 2, 64, 8)
    assert {(r["key"],): r["value"] for r in sketches.settled_keyed_quantiles(grid, skewed, "key", 0.5, 2, 64, 8).collect()} == discrete(skewed, ["key"], 0.5)
    rough = sketches.distinct(skewed, ["l"], "key", 4)
    true = {r["l"]: r["n"] for r in skewed.groupBy("l").agg(F.count_distinct("key").alias("n")).collect()}
    assert {r["l"]: r["value"] for r in sketches.settled_distinct(rough, skewed, ["l"], "key").collect()} == true


def test_answers_from_sketches_are_settled_by_raw_samples(skewed, tmp_path):
    m, path = Samples(skewed, ("l", "key"), "m"), f"{tmp_path}/t"
    summary_table.append(windows.build(skewed, ["l"], "kll", 10), path, 1)
    summary_table.append(windows.build(skewed.withColumn("value", F.col("value").cast("long")), ["l"], "hll", 10), path, 2)
    known = [Summary(i, "m", kind, frozenset({"l"}), 10) for i, kind in ((1, "kll"), (2, "hll"))]
    only = frozenset({("l", "=", "a")})
    rows = skewed.filter("t >= 20 and t < 40 and l = 'a'")
    ask = lambda *a: {(r["l"],): r["value"] for r in answer(skewed.sparkSession, path, m, known, a[0], ["l"], 40.0, 20, a[1], only).collect()}
    assert ask("quantile", 0.95) == discrete(rows, ["l"], 0.95)
    assert ask("distinct", None) == {("a",): rows.select("value").distinct().count()}
