"""SimHash near-dedup as the pipeline uses it: documents whose sets of five-word shingles overlap by 0.8 or more.

Documents with equal sets are one node. Nodes meet in two ways:

1. fingerprints of the five-word shingles within 2 of 64 bits, found by the pivot distance
   tables of simhash.links; nodes of a fingerprint meet at it, with those of all that such
   links tie to it, so that any two nodes within 2 bits meet;
2. since an overlap of 0.8 turns about 10 of 64 bits, where distances to pivots (whose
   spread is 4 bits) discard next to nothing: by agreement on one of BANDS bands of ROWS
   least hashes each. A pair that overlaps by 0.8 does so with probability
   1 - (1 - 0.8^4)^16 = 0.9998, closer pairs more often.

Every pair that meets is verified by the shingles that both hold, and verified pairs are
followed to components. At a meeting point of over GROUP nodes (a large family of near
copies) each node is first compared with the least ones under LEADERS orders only, which
is linear in the family's size. What components remain apart at such a point are then
compared in full: every node outside of the point's largest component with all nodes of
other components. So every pair that meets is linked, compared, or in one component already.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import bounded_arrow, components, cut, id_or_zero, once_each, row_key

SHINGLE, SEED, OVERLAP_PERCENT = 5, 42, 80
BANDS, ROWS = 16, 4
GROUP, LEADERS = 64, 4
#: Shingles are hashed in pieces of this many, so that one very long text needs little memory.
PIECE = 1 << 13
#: Edges of one node that share a copy of its shingles while they are verified.
SHARE = 256
#: Where components remain apart at a meeting point, its nodes are compared part by part: about so many nodes a part, and hashes of their shingles.
PART, PART_HASHES = 384, 1 << 20
_factors = np.array([xxhash.xxh64_intdigest(str(i).encode(), SEED) | 1 for i in range(BANDS * ROWS)], np.uint64)


def shingles(text: bytes | None) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles, in order; of all words where there are fewer; none without words."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - SHINGLE + 1)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + SHINGLE]), SEED) for i in range(n)), np.uint64, n))


def bands(hashes: np.ndarray) -> list[int]:
    """One key per band, from the least products of the hashes with fixed odd numbers."""
    if not len(hashes):
        return []
    least = np.full(len(_factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), PIECE):
        least = np.minimum(least, (_factors[:, None] * hashes[None, at : at + PIECE]).min(1))
    return [xxhash.xxh64_intdigest(b.tobytes(), SEED) - (1 << 63) for b in least.reshape(BANDS, ROWS)]


def fingerprint(hashes: np.ndarray) -> int:
    """Signed 64 bits, each 1 if it is set in over half of the hashes; 0 without any."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), PIECE):
        ones += np.unpackbits(hashes[at : at + PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, _row, node, fp, bands, held) of every row: a hash of its shingles, its fingerprint and band keys, and 32 bits of each shingle's hash."""
    bounded_arrow(docs.sparkSession)
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("_row"), F.col("text").cast("binary").alias("text"))

    def run(batches):
        for b in batches:
            sets = [shingles(t) for t in b.column(2).to_pylist()]
            nodes = [xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63) for s in sets]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            held = np.concatenate([*sets, np.zeros(0, np.uint64)]).astype(np.uint32).view(np.int32)
            columns = [b.column(0), b.column(1), pa.array(nodes, pa.int64()), pa.array([fingerprint(s) for s in sets], pa.int64()), pa.array([bands(s) for s in sets], pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(ends), pa.array(held))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "_row", "node", "fp", "bands", "held"])

    return thin.mapInArrow(run, "doc_id long, _row long, node long, fp long, bands array<long>, held array<int>")


def meetings(nodes: DataFrame) -> DataFrame:
    """(band, key, node, n, leaders): the nodes (node, fp, bands) at each point where n > 1 of them meet, and its leaders; band BANDS is that of fingerprints."""
    first = cut(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    near = simhash.links(first.select(F.col("first").alias("node"), "fp")).select(F.col("b").alias("first"), F.col("a").alias("key"))
    stars = near.unionByName(first.select("first", F.col("first").alias("key")))
    alike = cut(nodes.join(first, "fp").join(stars, "first").select("node", F.lit(BANDS).alias("band"), "key"))
    keyed = nodes.select("node", F.posexplode("bands").alias("band", "key")).unionByName(alike)
    order = lambda i: F.struct(F.xxhash64("node", F.lit(i)), "node")
    leaders = F.array(*[F.min(order(i))["node"] for i in range(LEADERS)])
    sizes = cut(keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), leaders.alias("leaders")).filter("n > 1"))
    return cut(keyed.join(sizes, ["band", "key"]))


def candidates(met: DataFrame, group: int = GROUP) -> DataFrame:
    """Distinct (a, b) that meet: all pairs of points of at most group nodes, pairs with a leader of larger ones."""
    small = met.filter(F.col("n") <= group).groupBy("band", "key").agg(F.collect_list("node").alias("g"))
    pairs = small.select(F.explode("g").alias("a"), "g").select("a", F.explode("g").alias("b")).filter("a > b")
    led = met.filter(F.col("n") > group).select(F.col("node").alias("a"), F.explode("leaders").alias("b")).filter("a != b")
    return cut(pairs.unionByName(led.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))).distinct())


def enough(a: Column, b: Column) -> Column:
    """Whether two sets of shingles overlap by OVERLAP_PERCENT or more."""
    common = F.size(F.array_intersect(a, b))
    return 100 * common.cast("long") >= OVERLAP_PERCENT * (F.size(a) + F.size(b) - common).cast("long")


def verified(edges: DataFrame, held: DataFrame) -> DataFrame:
    """The edges (a, b) whose shingles, held by (node, held), overlap enough."""
    shares = edges.groupBy(F.col("b").alias("node")).agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("shares"))
    of_b = held.join(shares, "node").select(F.col("node").alias("b"), F.col("held").alias("held_b"), "shares", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    dealt = edges.join(shares.withColumnRenamed("node", "b"), "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("shares")).cast("int").alias("share"))
    both = dealt.join(of_b.drop("shares"), ["b", "share"]).join(held.select(F.col("node").alias("a"), F.col("held").alias("held_a")), "a")
    return both.filter(enough(F.col("held_a"), F.col("held_b"))).select("a", "b")


def still_apart(met: DataFrame, found: DataFrame, held: DataFrame) -> DataFrame:
    """(at, node, root, outer, parts, outer_parts) of the points (band, key, node) where components found (node, root) differ.

    outer tells nodes outside of the point's largest component; parts and outer_parts are the numbers of parts of all and of outer nodes.
    """
    size = held.select("node", F.size("held").cast("long").alias("size"))
    rooted = met.select(F.xxhash64("band", "key").alias("at"), "band", "key", "node").join(size, "node").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = rooted.groupBy("band", "key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    main = F.max_by(F.struct("root", "n", "size"), F.struct("n", "root")).alias("main")
    points = sizes.groupBy("band", "key").agg(main, F.sum("n").alias("all"), F.sum("size").alias("hashes")).filter(F.col("all") > F.col("main.n"))
    parts = lambda n, hashes: F.ceil(F.greatest(n / PART, hashes / PART_HASHES)).cast("int")
    whole, outer = parts(F.col("all"), F.col("hashes")), parts(F.col("all") - F.col("main.n"), F.col("hashes") - F.col("main.size"))
    return rooted.join(points, ["band", "key"]).select("at", "node", "root", (F.col("root") != F.col("main.root")).alias("outer"), whole.alias("parts"), outer.alias("outer_parts"))


def full_links(apart: DataFrame, held: DataFrame) -> DataFrame:
    """Links between different components, as their roots (a, b), at each point of still_apart: all outer nodes against all nodes, each pair at one point only.

    Each part of a point's nodes meets each part of its outer nodes as one row, so no join is left that is worth splitting.
    """
    points = F.collect_list("at").alias("points")
    told = apart.join(apart.groupBy("node").agg(points).join(held, "node"), "node")
    node = F.struct("node", "root", "outer", "points", F.size("held").alias("size"), "held")
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cell = ["at", "part", "outer_part"]
    xs = told.select("at", part("parts").alias("part"), each("outer_parts").alias("outer_part"), node.alias("x")).groupBy(*cell).agg(F.collect_list("x").alias("xs"))
    ys = told.filter("outer").select("at", each("parts").alias("part"), part("outer_parts").alias("outer_part"), node.alias("y")).groupBy(*cell).agg(F.collect_list("y").alias("ys"))
    x = F.col("x")
    alike = lambda y: (100 * x["size"] >= OVERLAP_PERCENT * y["size"]) & (100 * y["size"] >= OVERLAP_PERCENT * x["size"])
    once = lambda y: (~x["outer"] | (x["node"] > y["node"])) & (F.array_min(F.array_intersect(x["points"], y["points"])) == F.col("at"))
    partners = F.filter("ys", lambda y: (x["root"] != y["root"]) & alike(y) & once(y) & enough(x["held"], y["held"]))
    return xs.join(ys, cell).select("at", F.explode("xs").alias("x"), "ys").select(x["root"].alias("a"), F.explode(F.transform(partners, lambda y: y["root"])).alias("b"))


def linked(nodes: DataFrame, rows: DataFrame, group: int = GROUP) -> DataFrame:
    """Components (node, root) of nodes (node, fp, bands) that meet and whose shingles, held by rows (node, held), overlap enough."""
    met = meetings(nodes.select("node", "fp", "bands"))
    edges = candidates(met, group)
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    held = cut(rows.groupBy("node").agg(F.first("held").alias("held")).join(ends, "node", "left_semi"))
    found = components(verified(edges, held))
    apart = cut(still_apart(met.filter(F.col("n") > group), found, held))
    if apart.isEmpty():
        return found
    joined = components(full_links(apart, held))
    moved = found.join(joined.select(F.col("node").alias("root"), F.col("root").alias("over")), "root", "left")
    return moved.select("node", F.coalesce("over", "root").alias("root")).unionByName(joined)


def keep_representatives(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """docs with one row left of each component of near copies: that of the smallest doc_id, repeats of it dropped.

    Null and word-less texts are copies of each other. A null doc_id sorts after all others.
    Whole texts count, however long; an overlap of just 0.8 links; an empty table gives no
    rows. Columns of any name pass through unchanged.
    """
    rows = cut(sketches(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id"), F.col("_row"))).alias("first")
    nodes = cut(rows.groupBy("node").agg(first, F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    found = linked(nodes, rows, group)
    least = nodes.select("node", "first").join(found, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    kept = least.select(id_or_zero(F.col("first.doc_id")).alias("_id"), F.col("first._row").alias("_key"))
    return once_each(docs).join(kept, ["_id", "_key"], "left_semi").select("row.*")
