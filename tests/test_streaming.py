"""Late samples: dropped by closed windows, forwarded as further partial rows by appended summaries."""

from pyspark.sql import functions as F

from millrace.operators import windows
from millrace.sources import summary_table
from millrace.streaming.windows import append_keys, append_summaries, closed_windows, key_sets, panes_to_windows

ROWS = [[("a", 1.0, 1.0), ("a", 5.0, 2.0), ("a", 25.0, 4.0)], [("a", 45.0, 8.0)], [("a", 2.0, 16.0), ("a", 65.0, 32.0)]]


def write(spark, folder):
    for i, rows in enumerate(ROWS):
        spark.createDataFrame(rows, "l string, t double, value double").coalesce(1).write.parquet(f"{folder}/in/b{i}")


def stream(spark, folder):
    return spark.readStream.schema("l string, t double, value double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")


def test_late_samples_are_forwarded(spark, tmp_path):
    write(spark, tmp_path)
    append_summaries(stream(spark, tmp_path), ["l"], "sum", 10, f"{tmp_path}/table", 3, f"{tmp_path}/cp").awaitTermination()
    stored = summary_table.read(spark, f"{tmp_path}/table", 3)
    assert stored.filter("window_start = 0").count() == 2
    merged = windows.merge(stored, ["l", "window_start"], "sum")
    assert {(r["window_start"], r["total"]) for r in merged.collect()} == {(0.0, 19.0), (20.0, 4.0), (40.0, 8.0), (60.0, 32.0)}


def test_late_samples_are_dropped_from_closed_windows(spark, tmp_path):
    write(spark, tmp_path)
    rows = stream(spark, tmp_path).withColumn("ts", F.timestamp_seconds("t"))
    out = closed_windows(rows, "ts", "value", ["l"], "10 seconds", "0 seconds")
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {(int(r["s"]), r["total"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").select(F.unix_seconds("window.start").alias("s"), "total", "n").collect()}
    assert got == {(0, 3.0, 2), (20, 4.0, 1), (40, 8.0, 1)}


def test_a_replayed_batch_replaces_itself(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("a", 12.0, 3.0)], "l string, t double, value double")
    for _ in range(2):  # as foreachBatch does after a lost executor or driver
        summary_table.append(windows.build(rows, ["l"], "sum", 10), f"{tmp_path}/t", 1, 0)
    summary_table.append(windows.build(rows, ["l"], "sum", 10), f"{tmp_path}/t", 1, 1)
    summary_table.append(windows.build(rows, ["l"], "max", 10), f"{tmp_path}/t", 2, 0)
    merged = windows.merge(summary_table.read(spark, f"{tmp_path}/t", 1), ["l"], "sum")
    assert merged.first()["total"] == 10.0
    assert windows.merge(summary_table.read(spark, f"{tmp_path}/t", 2), ["l"], "max").first()["most"] == 3.0


def test_quantile_sketches_and_key_changes_from_streams(spark, tmp_path):
    write(spark, tmp_path)
    append_summaries(stream(spark, tmp_path), ["l"], "kll", 10, f"{tmp_path}/table", 4, f"{tmp_path}/cp").awaitTermination()
    states = windows.merge(summary_table.read(spark, f"{tmp_path}/table", 4), ["l"], "kll")
    assert windows.read(states, ["l"], "kll", 0.5).first()["value"] == 4.0
    append_keys(stream(spark, tmp_path), ["l", "value"], 10.0, f"{tmp_path}/keys", 5, f"{tmp_path}/cp2").awaitTermination()
    sets = key_sets(summary_table.read(spark, f"{tmp_path}/keys", 5), ["value"])
    changes = {(r["window_start"], r["value"], r["change"]) for r in windows.key_changes(sets, ["value"], 10.0).collect()}
    assert (20.0, 4.0, "added") in changes and (20.0, 16.0, "removed") in changes and (40.0, 4.0, "removed") in changes
    assert not any(start in (10.0, 30.0) for start, _, _ in changes)


def test_sliding_windows_of_closed_panes(spark, tmp_path):
    write(spark, tmp_path)
    rows = stream(spark, tmp_path).withColumn("ts", F.timestamp_seconds("t"))
    out = closed_windows(rows, "ts", "value", ["l"], "20 seconds", "0 seconds", "10 seconds", "max")
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    states = panes_to_windows(spark.read.parquet(f"{tmp_path}/out"), ["l"], "max", 20, 10)
    assert {(r["window_start"], r["value"]) for r in windows.read(states, ["window_start"], "max").collect()} == {(-10.0, 2.0), (0.0, 2.0), (10.0, 4.0), (20.0, 4.0), (30.0, 8.0), (40.0, 8.0)}
