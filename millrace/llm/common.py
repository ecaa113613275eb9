"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that ends a word, everywhere in this subpackage: 0x20 and 0x09 to 0x0D.
#: bytes.split() without arguments splits on just these six bytes.
SPACE = "\\x20\\x09-\\x0D"

#: Arrow batches handed to Python hold at most this many rows and about this many bytes.
ARROW_ROWS, ARROW_BYTES = 1000, 16 << 20


def bounded_arrow(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limits, so that long texts cannot fill a Python worker."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = int(str(spark.conf.get(key)).rstrip("bB"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the cluster's checkpoint folder and go on from the written copy.

    The folder comes from spark.checkpoint.dir; only on one machine, as in local tests,
    where that is unset, a temporary folder is named here.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", "")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="millrace-"))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


def as_rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[list, ...]]:
    """The named columns of each batch as Python lists."""
    for b in batches:
        yield tuple(b.column(b.schema.get_field_index(n)).to_pylist() for n in names)


def n_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def row_key(df: DataFrame) -> Column:
    """A 64-bit hash of the whole row: rows with one key are repeats of each other."""
    parts = [F.map_entries(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`") for f in df.schema.fields]
    return F.xxhash64(*[x for p in parts for x in (p.isNull(), p)])


def once_each(df: DataFrame) -> DataFrame:
    """(row, _id, _key): df without repeats of whole rows, each as one struct, with its doc_id (0 for null) and row hash.

    Repeats are combined before the shuffle, so one row that makes up a third of
    the table costs no more than any other. A join on (_id, _key) needs no further
    shuffle of the rows; the hash tells a null id from 0.
    """
    return df.select(F.struct("*").alias("row"), id_or_zero(F.col("doc_id")).alias("_id"), row_key(df).alias("_key")).dropDuplicates(["_id", "_key"])


def id_or_zero(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(0).cast("long"))


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of df, whatever their names hold."""
    return [F.col(f"`{c}`") for c in df.columns]


def unused_name(df: DataFrame, name: str) -> str:
    """name, with underscores added until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the graph with edges (a, b): rows (node, root), root the least node.

    Large-star and small-star rounds alternate until the edges are disjoint stars, each
    node with one edge to its root or with edges of its own leaves only.
    Each round only keeps minima per node and one row per edge; a node with very
    many edges meets its minimum in a plain shuffle join, which Spark can split.
    Nodes may have any orderable type; nodes without edges are not returned.
    """
    edges = cut(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    up = (F.col("b") < F.col("a")).cast("long")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m"), (F.sum(up) + F.max(1 - up)).alias("ties")).select("a", F.least("a", "m").alias("m"), "ties"))
        if (least.agg(F.max("ties")).first()[0] or 1) == 1:
            break
        large = cut(both.filter("b > a").join(least.drop("ties"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct())
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a")
        edges = cut(small.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
