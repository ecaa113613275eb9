"""Mixing sources to target weights by systematic sampling.

Targets are shares of all words by weight; no source gives over `most` copies of
its own size, and what it cannot give is shared again among the others. Within a
source, documents stand in order of size (then a seeded hash), each with the
same expected number of copies, target / source size. The running sum of expected
copies plus one seeded offset per source crosses integers; a document is taken
once for each integer that it crosses. Ordered by size, each stretch of like
sizes gives its fair share, so the words taken stay near the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column_or_null, cut, id_or_zero, n_words, once_each, row_key

WEIGHTS, MOST, SEED = (5, 2, 1), 3, 42
#: Copies of one row that one task writes out.
PIECE = 64
#: Rank offsets go to executors as a broadcast up to so many rows, and by a shuffle join beyond.
BROADCAST_ROWS = 20_000


def _tag(source: Column) -> Column:
    """A text that tells sources apart, null among them."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weights repeat over the sources by code point, null last.

    In order of cap / weight, a source is capped just if its cap is below its share
    of what the sources before it leave; the largest such share per weight is final.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    w = sources.withColumn("weight", weight.cast("long")).withColumn("cap", most * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    share = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    w = w.withColumn("share", share)
    level = F.max("share").over(everything)
    return w.select("source", "source_size", F.least(F.col("cap").cast("double"), level * F.col("weight")).alias("target"))


def copies(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """rows (source, size, doc_id, ...) with source_size, target and the copies taken of each.

    Ranks come from one range partitioning by (source, size, hash of the id, hash of the
    row): a source of any size spreads over many partitions, also where its ids are null
    or all the same, and only per-partition counts are combined.
    """
    order = [F.col("source").asc_nulls_first(), F.col("size"), F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), *[F.col(c) for c in ("_row",) if c in rows.columns]]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(placed.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    parts = placed.groupBy("source", "_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first"), F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut(parts.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    aims = targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    tag = _tag(F.col("source"))
    offset = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), tag)), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    aims = aims.select(F.col("source").alias("_source"), "source_size", "target", rate.alias("_rate"), offset.alias("_offset"))
    parts = parts.join(aims, F.col("source").eqNullSafe(F.col("_source"))).select("_source", F.col("_part").alias("_in"), "_first", "_before", "source_size", "target", "_rate", "_offset")
    if parts.count() <= BROADCAST_ROWS:
        parts = F.broadcast(parts)
    ranked = placed.join(parts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_part") == F.col("_in")))
    rank = F.col("_at") - F.col("_first") + F.col("_before") + 1
    crossed = F.floor(rank * F.col("_rate") + F.col("_offset")) - F.floor((rank - 1) * F.col("_rate") + F.col("_offset"))
    return ranked.withColumn("copies", F.least(crossed, F.lit(most))).select(*rows.columns, "source_size", "target", "copies")


def _thin(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id"), column_or_null(docs, "source", "string").alias("source"), n_words(F.col("text")).alias("size"), row_key(docs).alias("_row"))


def mix_table(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes) of every row.

    Texts are only counted, never shuffled. A null text has no words; a null source
    is a source of its own; a source without words has target 0 and is not taken.
    The same rows give the same mix, however they are stored. Rows that repeat each
    other may be taken differently. Very long texts count whole; of documents of one
    size those with the lesser hash of id and row come first. An empty table gives no
    rows. Other columns are ignored, whatever their names.
    """
    return copies(_thin(docs), weights, most, seed).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mix itself: docs' columns, every row as often as it is taken.

    Repeats of one row are counted, not moved: they travel as one row with their number
    and are dealt over tasks again, PIECE copies at a time, before they are written out.
    Null, empty and very long texts and an empty table are as in mix_table.
    """
    taken = copies(_thin(docs), weights, most, seed).groupBy("doc_id", "_row").agg(F.sum("copies").alias("copies")).filter("copies > 0")
    taken = taken.select(id_or_zero(F.col("doc_id")).alias("_id"), F.col("_row").alias("_key"), "copies")
    taken = cut(taken)
    out = _repeated(once_each(docs).join(taken.filter(F.col("copies") <= PIECE), ["_id", "_key"]).select("row", "copies"))
    often = taken.filter(F.col("copies") > PIECE)
    if not often.isEmpty():
        pieces = F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(PIECE).cast("long")), lambda i: F.least(F.col("copies") - i, F.lit(PIECE).cast("long")))
        dealt = once_each(docs).join(often, ["_id", "_key"]).select("row", F.explode(pieces).alias("copies"))
        out = out.unionByName(_repeated(dealt.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    return out.select("row.*")


def _repeated(rows: DataFrame) -> DataFrame:
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy")).select("row")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, 3 * source_size AS cap, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight FROM s
), h AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS share
  FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), max(share) OVER () * weight) AS target,
         CAST('0x' || substr(md5('42|' || coalesce('s' || source, 'n')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM h
), r AS (
  SELECT doc_id, size, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY size, md5('42|' || coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(least(floor(k * rate + u) - floor((k - 1) * rate + u), 3) AS BIGINT) * size AS taken
FROM r
"""
