"""Global shuffle into shards in two passes, and writing the shards.

Pass one scatters rows into buckets that fit in memory, by a seeded hash of the
row. Pass two permutes each bucket on its own (Fisher-Yates, seeded by bucket)
and numbers its rows after all earlier buckets. Position p goes to shard p mod n
at slot p div n, so shards differ by at most one row (the law `rows`) and slots
have no gaps. Rows are placed by what they hold, not by where they were read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, row_key

SEED = 42
#: Most bytes of text in a bucket, and the least number of buckets.
BUCKET_BYTES, BUCKETS = 32 << 20, 64


def size(text: Column) -> Column:
    """UTF-8 bytes of a text plus one; a null text has no bytes."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _permuted(shards: int, seed: int, schema: pa.Schema):
    def run(key, rows: pa.Table, starts: pa.Table) -> pa.Table:
        bucket, part = key[0].as_py(), key[1].as_py()
        rows = rows.take(pa.compute.sort_indices(rows, sort_keys=[("_key", "ascending")]))
        rows = rows.take(np.random.Generator(np.random.PCG64([seed, bucket, part])).permutation(rows.num_rows))
        at = starts.column("_start")[0].as_py() + np.arange(rows.num_rows, dtype=np.int64)
        return pa.table({"row": rows.column("row"), "shard": pa.array((at % shards).astype(np.int32)), "slot": pa.array(at // shards)})

    return run


def shuffled(docs: DataFrame, shards: int = 8, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, buckets: int = BUCKETS) -> DataFrame:
    """Every row once, as (row struct of docs' columns, shard int, slot long).

    docs is read three times: for its total size, for bucket counts, and to scatter
    it; its texts are shuffled once. A bucket that repeats of one row overfill is
    dealt over several parts; only then the scattered rows are first written to the
    checkpoint folder. Null and very long texts, null ids and repeated rows are rows
    like any other; an empty table gives no rows.
    """
    total = docs.agg(F.sum(size(F.col("text")))).first()[0] or 0
    n = max(buckets, math.ceil(total / bucket_bytes))
    keyed = docs.select(F.struct("*").alias("row"), size(F.col("text")).alias("_size"), row_key(docs).alias("_key"))
    keyed = keyed.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), "_key"), F.lit(n)))
    sizes = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("bytes"))
    full = sizes.filter((F.col("bytes") > 4 * bucket_bytes) & (F.col("n") > 1)).select("_bucket", F.ceil(F.col("bytes") / bucket_bytes).alias("parts"))
    if full.isEmpty():
        keyed = keyed.withColumn("_part", F.lit(0).cast("long"))
    else:
        keyed = keyed.withColumn("_dealt", F.monotonically_increasing_id()).join(full, "_bucket", "left")
        keyed = cut(keyed.withColumn("_part", F.pmod("_dealt", F.coalesce("parts", F.lit(1)))).drop("_dealt", "parts"))
    counts = keyed.groupBy("_bucket", "_part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_bucket", "_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_bucket", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    out = keyed.select("row").schema.add("shard", "integer").add("slot", "long")
    dealt = lambda df: df.repartition(n, "_bucket", "_part").groupBy("_bucket", "_part")  # noqa: E731  as many partitions as buckets, so tasks stay small
    return dealt(keyed).cogroup(dealt(starts)).applyInArrow(_permuted(shards, seed, out), out)


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = SEED) -> None:
    """Write the shuffled rows as Parquet, one folder `shard=k` each, in slot order within a file.

    Rows of docs with null, empty or very long texts and repeated rows are written like
    any other; an empty table writes none. docs may not have columns shard or _slot.
    """
    rows = shuffled(docs, shards, seed).select("row.*", F.col("shard").alias("shard"), F.col("slot").alias("_slot"))
    rows.sortWithinPartitions("shard", "_slot").write.partitionBy("shard").parquet(path)


def shard_table(docs: DataFrame, shards: int = 8, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law (`rows`), shard, slot and grown_shard (null under this law) of every row."""
    rows = shuffled(docs, shards, seed)
    text = F.col("row.text")
    return rows.select(
        F.col("row.doc_id").alias("doc_id"),
        size(text).alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
