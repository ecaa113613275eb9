"""SimHash near-duplicates: pivot distance tables over 64-bit fingerprints.

Each text gets one fingerprint: a bit is 1 if it is set in over half of the
XXH64 hashes of the text's 3-word shingles. Texts link if their fingerprints
differ in at most `distance` bits, and links are followed to components.

Links are looked for among distinct fingerprints, so copies cost nothing:

1. Every fingerprint x gets its Hamming distances to fixed references: to zero, to
   32 references that have the two bits of one band each, and to PIVOTS spread ones.
   d(x, 0) - d(x, band) is twice the number of x's bits in the band, less two. So two
   fingerprints within 2 bits agree on these differences for all but two bands at
   most, hence on at least three of five groups of bands.
2. Fingerprints that agree on some three groups of columns of this table meet, by an
   equi-join on the distances. No bit has been compared so far.
3. A pair that met is discarded if any of its distances to the references differs by
   more than `distance` (the triangle inequality).
4. Survivors are verified by counting differing bits.

A meeting point with over GROUP fingerprints (a large family of near copies) is
not compared pair by pair. Two fingerprints are within 2 bits just if some point
is within 1 bit of both, so each member goes to the 65 points around it, where
at most 65 distinct fingerprints can meet; they are tied to the least of them.
That is exact and linear in the family's size. No pair is lost in either way.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_arrow, components, cut, id_or_zero, once_each, row_key

SHINGLE, SEED, DISTANCE = 3, 42, 2
#: Above so many fingerprints at one meeting point, they meet around single-bit changes instead.
GROUP = 64
#: Number of spread references; of references of one band each, and of the groups of these that pairs meet by.
PIVOTS, BANDS, GROUPS = 16, 32, 5
#: Shingles are counted in pieces of this many, so that one very long text needs little memory.
PIECE = 1 << 15


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def spread_references(n: int = PIVOTS) -> list[int]:
    """n fixed pseudo-random fingerprints, the hashes of 1 to n."""
    return [_signed(xxhash.xxh64_intdigest(str(i).encode(), SEED)) for i in range(1, n + 1)]


def references() -> list[int]:
    """Zero, the bits of each band, and the spread references."""
    width = 64 // BANDS
    return [0, *[_signed(((1 << width) - 1) << (width * b)) for b in range(BANDS)], *spread_references()]


def pivot_table(fp: Column) -> Column:
    """The distances of a fingerprint to all references."""
    return F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(r))).cast("byte") for r in references()])


def meeting_points(pivots: Column) -> Column:
    """(mask, key) for each choice of three groups of bands: the distances to zero less those to the bands, packed."""
    own = [sum((pivots[0] - pivots[1 + b] + 2).cast("long") * 3**k for k, b in enumerate(range(g, BANDS, GROUPS))) for g in range(GROUPS)]
    size = 3 ** (-(-BANDS // GROUPS)) * 2
    chosen = list(combinations(range(GROUPS), 3))
    return F.array(*[F.struct(F.lit(i).cast("byte").alias("mask"), (own[a] + size * (own[b] + size * own[c])).alias("key")) for i, (a, b, c) in enumerate(chosen)])


def fingerprint(text: bytes | None) -> int:
    """Signed 64-bit fingerprint of a UTF-8 text; 0 without words or for null."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, PIECE):
        part = words[at : at + PIECE + SHINGLE - 1]
        shingles = zip(part, part[1:], part[2:]) if len(part) >= SHINGLE else [part]
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in shingles], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int32)
    return _signed(sum(1 << int(i) for i in np.flatnonzero(2 * ones > n)))


def fingerprints(docs: DataFrame, *keep: Column) -> DataFrame:
    """(doc_id, *keep, fp) of every row; the texts themselves go no further."""
    bounded_arrow(docs.sparkSession)
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, F.col("text").cast("binary").alias("text"))
    fields = [f for f in thin.schema.fields if f.name != "text"]

    def run(batches):
        for b in batches:
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            fps = pa.array([fingerprint(t) for t in b.column(b.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*cols, fps], names=[*[f.name for f in fields], "fp"])

    return thin.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", fp long")


def links(nodes: DataFrame, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """Edges (a, b) between the `node`s of distinct fingerprints `fp`, that connect all pairs within distance bits.

    Pairs that meet in small groups are all returned; in large groups enough of them to connect the rest.
    """
    if distance != 2:
        raise ValueError("large groups are exact for a distance of 2 bits only")
    x = F.col("fp")
    keyed = nodes.withColumn("pivots", pivot_table(x)).select("node", "fp", F.explode(meeting_points(F.col("pivots"))).alias("meet")).select("node", "fp", "meet.*")
    sizes = cut(keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    met = cut(keyed.join(sizes, ["mask", "key"]))

    small = met.filter(F.col("n") <= group).withColumn("pivots", pivot_table(x)).groupBy("mask", "key").agg(F.sort_array(F.collect_list(F.struct("fp", "pivots", "node"))).alias("g"))
    near = lambda p, q: F.forall(F.zip_with(p.pivots, q.pivots, lambda u, v: F.abs(u - v) <= distance), lambda ok: ok)
    verified = lambda p, q: F.bit_count(p.fp.bitwiseXOR(q.fp)) <= distance
    partners = lambda p: F.transform(F.filter("g", lambda q: (q.fp > p.fp) & near(p, q) & verified(p, q)), lambda q: F.struct(p.node.alias("a"), q.node.alias("b")))
    pairs = small.select(F.explode(F.flatten(F.transform("g", partners))).alias("e")).select("e.*")

    large = met.filter(F.col("n") > group).select("node", "fp").distinct()
    points = F.concat(F.array(x), F.array(*[x.bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)]))
    around = large.select("node", F.explode(points).alias("point")).groupBy("point").agg(F.collect_set("node").alias("g")).filter(F.size("g") > 1)
    ties = around.select(F.array_min("g").alias("a"), F.explode("g").alias("b")).filter("a != b")
    return pairs.unionByName(ties).distinct()


def classes(fps: DataFrame, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """(fp, node, root) of every distinct fingerprint; node and root are (absent, id, fp) of the smallest doc_id."""
    node = F.struct(F.col("id").isNull().alias("absent"), F.col("id"), F.col("fp"))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("id")).select("fp", node.alias("node")))
    found = components(links(nodes, distance, group))
    return cut(nodes.join(found, "node", "left").select("fp", "node", F.coalesce("root", "node").alias("root")))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null and word-less texts have fingerprint zero and link like any other. A null
    doc_id sorts after all others: component_id is null only if all ids in the
    component are. Repeated rows give repeated rows. Other columns are ignored; an
    empty table gives an empty result.
    """
    fps = cut(fingerprints(docs))
    roots = classes(fps, distance).select("fp", F.col("root.id").alias("component_id"))
    return fps.join(roots, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """docs with one row left of each component: that of the smallest doc_id, repeats of it dropped.

    Only ids, row hashes and fingerprints are shuffled to decide; the texts move once.
    """
    fps = cut(fingerprints(docs, row_key(docs).alias("_row")))
    first = fps.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id"), F.col("_row"))).alias("first"))
    kept = classes(fps, distance).filter("node = root").join(first, "fp").select(id_or_zero(F.col("first.doc_id")).alias("_id"), F.col("first._row").alias("_key"))
    return once_each(docs).join(kept, ["_id", "_key"], "left_semi").select("row.*")
