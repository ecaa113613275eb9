"""Embedding near-duplicates: exact pairs over a cosine threshold by a cover tree and dual traversal.

Vectors of one label (and dimension) are compared as points of the unit sphere,
where cosine >= c means distance <= sqrt(2 - 2c). Equal vectors are one point
with a count.

The top of each label's cover tree is laid over a bounded sample: nested levels of
centres, radius 2, 1, 1/2, ..., each centre of a level within that level's radius of
one above. All points then go to their nearest centre at its foot, and what a node
covers is measured over all points, so pruning is exact whatever the sample held.
Below, the points of a foot (those of a foot with over LEAF parted into rings by
distance to the centre, and into blocks of about LEAF) get a tree of their own each, over all of them: radii go on
being halved down to half the link distance.

The traversal goes down pairs of nodes from (root, root) and drops a pair as soon as
the distance of the centres exceeds both covering radii by more than the link
distance: first over the top, which leaves pairs of blocks, then in each pair of
blocks over their trees. Only vectors of the small nodes whose pairs remain at the
bottom are compared. Each point gets the number of its links and a tie to its cluster
in the pair of blocks: results stay linear in the points, also where a third of them
lie close together.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_arrow, components, cut

THRESHOLD = 0.98
#: Points that a foot of the top, and a block of one, should hold; most feet of a label's top; points sampled for each.
LEAF, LEAVES, PER_LEAF = 4096, 2048, 4
#: Width of a ring around a leaf's centre, and points of a label that one task assigns.
RING, ASSIGN = 0.3, 8192
SLACK = 1e-9
#: Distances in single precision may be wrong by so much; vectors compared at a time.
COARSE, TOGETHER = 4e-3, 1 << 16


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows at length one, in double precision, also where squares would over- or underflow."""
    x = np.asarray(vectors, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Lists of one length, without nulls, as the rows of a matrix."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (a @ b.T)))


def cover_tree(points: np.ndarray, leaves: int) -> tuple[list[int], list[list[int]]]:
    """(chosen points, paths): a nested cover of radius 2, 1, 1/2, ... with at most `leaves` centres.

    paths[k] holds, per level from the root down, the place among the chosen
    points of the centre above (or at) centre k.
    """
    chosen, paths, radius = [0], [[0]], 2.0
    while len(chosen) < min(leaves, len(points)) and radius > 1 / 64:
        radius /= 2
        d = _apart(points, points[chosen])
        near, home = d.min(1), d.argmin(1)
        for p in paths:
            p.append(-1)
        for i in range(len(points)):
            if near[i] > radius and len(chosen) < leaves:
                near = np.minimum(near, _apart(points, points[[i]])[:, 0])
                chosen.append(i)
                paths.append([*paths[home[i]][:-1], -1])
        for k in range(len(chosen)):
            paths[k][-1] = k
    return chosen, paths


def surviving_pairs(centres: np.ndarray, paths: np.ndarray, radii: np.ndarray, reach: float) -> list[tuple[int, int]]:
    """Pairs of leaves (a <= b) that may hold points within reach, by descending pairs of nodes from the root."""
    apart = _apart(centres, centres)
    depth = paths.shape[1]
    members = [{int(n): np.flatnonzero(paths[:, level] == n) for n in np.unique(paths[:, level])} for level in range(depth)]
    covers = [{n: float((apart[n, m] + radii[m]).max()) for n, m in level.items()} for level in members]
    children = [{n: sorted({int(c) for c in paths[m, level + 1]}) for n, m in members[level].items()} for level in range(depth - 1)]
    pairs = [(a, b) for a in covers[0] for b in covers[0] if a <= b]
    for level in range(depth):
        pairs = [(a, b) for a, b in pairs if apart[a, b] - covers[level][a] - covers[level][b] <= reach]
        if level + 1 < depth:
            pairs = sorted({(min(c, d), max(c, d)) for a, b in pairs for c in children[level][a] for d in children[level][b]})
    return pairs


def _usable() -> Column:
    """Whether a row takes part: label not null; the vector finite, without nulls and not zero."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col("label").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _trees(points: DataFrame, sizes: DataFrame) -> DataFrame:
    """(label, dim, leaf, path, centre) of every label's tree, from a sample of at most PER_LEAF points a leaf, by hash."""
    near_one = F.pmod(F.col("node.key"), F.lit(1 << 20)) / (1 << 20)
    sample = points.join(sizes, ["label", "dim"]).filter(near_one < PER_LEAF * F.col("leaves") / F.col("points")).select("label", "dim", "leaves", "node", "embedding")
    first = points.groupBy("label", "dim").agg(F.min_by(F.struct("node", "embedding"), "node").alias("first")).join(sizes, ["label", "dim"])
    sample = sample.unionByName(first.select("label", "dim", "leaves", "first.*"))
    schema = T.StructType([points.schema["label"], points.schema["dim"], T.StructField("leaf", T.IntegerType()), T.StructField("path", T.ArrayType(T.IntegerType())), T.StructField("centre", T.ArrayType(T.DoubleType()))])

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key")
        x = units(np.stack(rows["embedding"].to_numpy()))
        chosen, paths = cover_tree(x, int(rows["leaves"].iloc[0]))
        return pd.DataFrame({"label": [key[0]] * len(chosen), "dim": key[1], "leaf": range(len(chosen)), "path": paths, "centre": list(x[chosen])})

    return sample.select("label", "dim", "leaves", F.col("node.key").alias("key"), "embedding").groupBy("label", "dim").applyInPandas(build, schema)


def _assigned(points: DataFrame, sizes: DataFrame, trees: DataFrame) -> DataFrame:
    """points with the nearest leaf and the distance to its centre; large labels are dealt over many tasks."""
    tasks = F.ceil(F.col("points") / ASSIGN).cast("int")
    rows = points.join(sizes, ["label", "dim"]).withColumn("task", F.pmod(F.col("node.key"), tasks).cast("int")).drop("points", "leaves")
    shared = trees.join(sizes, ["label", "dim"]).select("label", "dim", "leaf", "centre", F.explode(F.sequence(F.lit(0), tasks - 1)).alias("task"))
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != "task"], T.StructField("leaf", T.IntegerType()), T.StructField("dist", T.DoubleType())])

    def nearest(rows: pa.Table, centres: pa.Table) -> pa.Table:
        x = units(_matrix(rows.column("embedding").combine_chunks()))
        d = _apart(x, _matrix(centres.column("centre").combine_chunks()))
        best = d.argmin(1)
        rows = rows.drop_columns(["task"])
        return rows.append_column("leaf", pa.array(centres.column("leaf").to_numpy()[best].astype(np.int32))).append_column("dist", pa.array(d[np.arange(len(best)), best]))

    by = ["label", "dim", "task"]

    def run(rows: pa.Table, centres: pa.Table) -> pa.Table:
        return nearest(rows, centres) if rows.num_rows else pa.Table.from_batches([], schema=_arrow(schema))

    return rows.groupBy(*by).cogroup(shared.groupBy(*by)).applyInArrow(run, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _ring_pairs(rings: DataFrame, trees: DataFrame, reach: float) -> DataFrame:
    """(label, dim, leaf_a, ring_a, leaf_b, ring_b) that the dual traversal of each label leaves to compare."""
    named = rings.join(trees, ["label", "dim", "leaf"]).select("label", "dim", "leaf", "ring", "nearest", "farthest", "path", "centre")
    schema = T.StructType([rings.schema["label"], rings.schema["dim"], *[T.StructField(c, T.IntegerType()) for c in ("leaf_a", "ring_a", "leaf_b", "ring_b")]])

    def traverse(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        leaves = rows.drop_duplicates("leaf").sort_values("leaf")
        place = {leaf: i for i, leaf in enumerate(leaves["leaf"])}
        centres = np.stack(leaves["centre"].to_numpy())
        names = {n: i for i, n in enumerate(leaves["leaf"])}
        paths = np.stack(leaves["path"].to_numpy())
        # centres above that hold no point of their own are named by the first leaf below them
        for level in range(paths.shape[1]):
            for n in np.unique(paths[:, level]):
                below = paths[:, level] == n
                paths[below, level] = -1 - names.get(n, int(np.flatnonzero(below)[0]))
        radii = rows.groupby("leaf")["farthest"].max().reindex(leaves["leaf"]).to_numpy()
        held: dict[int, list] = {}
        for r in rows.itertuples():
            held.setdefault(place[r.leaf], []).append((r.leaf, r.ring, r.nearest, r.farthest))
        out = []
        for a, b in surviving_pairs(centres, -1 - paths, radii, reach):
            gap = float(_apart(centres[[a]], centres[[b]])[0, 0])
            for i, x in enumerate(held[a]):
                for j, y in enumerate(held[b]):
                    if a == b and (j < i or max(x[2], y[2]) - min(x[3], y[3]) > reach) or a != b and gap - x[3] - y[3] > reach:
                        continue
                    out.append((key[0], key[1], x[0], x[1], y[0], y[1]))
        return pd.DataFrame(out, columns=["label", "dim", "leaf_a", "ring_a", "leaf_b", "ring_b"])

    return named.groupBy("label", "dim").applyInPandas(traverse, schema)


def block_tree(points: np.ndarray, least: float) -> np.ndarray:
    """Levels of a cover tree over all points, one row each with the centre that every point is under.

    Radii are halved from 2 down to least; centres of a level stay centres below, and
    all points under one centre are under one centre above.
    """
    x = points.astype(np.float32)
    apart = np.sqrt(np.maximum(0, 2 - 2 * (x @ x.T)))
    home, radius = np.zeros(len(x), np.int32), 2.0
    levels = [home]
    while radius > least:
        radius = max(radius / 2, least)
        home = home.copy()
        order = np.argsort(levels[-1], kind="stable")
        for members in np.split(order, np.flatnonzero(np.diff(levels[-1][order])) + 1):
            near = apart[levels[-1][members[0]], members]
            while len(near) and near.max() > radius:
                far = members[near.argmax()]
                own = apart[far, members]
                home[members[own < near]] = far
                near = np.minimum(near, own)
        levels.append(home)
    return np.stack(levels)


class Nodes:
    """One level of a block's tree: its centres, what they cover, the place of the node above, and its points."""

    def __init__(self, points: np.ndarray, home: np.ndarray, above: np.ndarray | None):
        self.centres, self.of = np.unique(home, return_inverse=True)
        gap = np.linalg.norm(points - points[home], axis=1)
        self.radius = np.zeros(len(self.centres))
        np.maximum.at(self.radius, self.of, gap)
        self.above = np.zeros(len(self.centres), np.int64) if above is None else np.searchsorted(np.unique(above), above[self.centres])


def dual_links(u: np.ndarray, tree_u: np.ndarray, v: np.ndarray, tree_v: np.ndarray, threshold: float, reach: float) -> tuple[np.ndarray, int, int]:
    """(linked, node pairs visited, vector pairs compared) of two blocks, by descending their trees together."""
    alive, visited = np.ones((1, 1), bool), 0
    a = b = None
    for level in range(max(len(tree_u), len(tree_v))):
        row = [t[min(level, len(t) - 1)] for t in (tree_u, tree_v)]
        up = [t[min(level - 1, len(t) - 1)] if level else None for t in (tree_u, tree_v)]
        a, b = Nodes(u, row[0], up[0]), Nodes(v, row[1], up[1])
        alive = alive[np.ix_(a.above, b.above)]
        visited += int(alive.sum())
        c, d = u[a.centres].astype(np.float32), v[b.centres].astype(np.float32)
        if 20 * alive.sum() < alive.size:  # few pairs are left: no whole matrix of distances
            i, j = np.nonzero(alive)
            for at in range(0, len(i), TOGETHER):
                p, q = i[at : at + TOGETHER], j[at : at + TOGETHER]
                alive[p, q] = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", c[p], d[q]))) <= a.radius[p] + b.radius[q] + (reach + COARSE)
        else:
            alive &= np.sqrt(np.maximum(0, 2 - 2 * (c @ d.T))) <= (a.radius[:, None] + b.radius[None, :] + (reach + COARSE)).astype(np.float32)
    linked, compared = np.zeros((len(u), len(v)), bool), 0
    of_a, of_b = (np.split(np.argsort(x.of, kind="stable"), np.cumsum(np.bincount(x.of))[:-1]) for x in (a, b))
    size_a, size_b = np.bincount(a.of), np.bincount(b.of)
    i, j = np.nonzero(alive)
    large = size_a[i] * size_b[j] > 64
    for p, q in zip(i[large], j[large]):
        linked[np.ix_(of_a[p], of_b[q])] = u[of_a[p]] @ v[of_b[q]].T >= threshold
        compared += len(of_a[p]) * len(of_b[q])
    small = alive.copy()
    small[i[large], j[large]] = False
    x, y = np.nonzero(small[np.ix_(a.of, b.of)]) if small.any() else (i[:0], j[:0])
    for at in range(0, len(x), TOGETHER):
        p, q = x[at : at + TOGETHER], y[at : at + TOGETHER]
        linked[p, q] = np.einsum("ij,ij->i", u[p], v[q]) >= threshold
    return linked, visited, compared + len(x)


def _compare(linked: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """For rows and columns of a link matrix: the least row (or rows + column) of their cluster, by spreading least names."""
    n, m = linked.shape
    a, b = np.arange(n, dtype=np.int32), np.arange(n, n + m, dtype=np.int32)
    if same:
        b = a
    none = np.int32(n + m)
    while True:
        new_b = np.minimum(b, np.where(linked, a[:, None], none).min(0))
        new_a = np.minimum(a, np.where(linked, new_b[None, :], none).min(1))
        if same:
            new_a = new_b = np.minimum(new_a, new_b)
        if (new_a == a).all() and (new_b == b).all():
            return a, b
        a, b = new_a, new_b


def _planted(blocks: DataFrame, least: float) -> DataFrame:
    """blocks (block, rows) with the levels of a tree over each block's points."""
    schema = T.StructType([*blocks.schema.fields, T.StructField("tree", T.ArrayType(T.ArrayType(T.IntegerType())))])

    def run(batches):
        for batch in batches:
            trees = []
            for i in range(batch.num_rows):
                trees.append(list(block_tree(units(_matrix(batch.column("rows")[i].values.field("embedding"))), least)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(trees, pa.list_(pa.list_(pa.int32())))], names=[*batch.schema.names, "tree"])

    return blocks.mapInArrow(run, schema)


def links(points: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, links, tie) of points (label, dim, node, n, embedding): links to other points' vectors, and a node of the same cluster.

    One row per point and block pair in which it has a link.
    """
    bounded_arrow(points.sparkSession)
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    sizes = points.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("points"))
    sizes = cut(sizes.withColumn("leaves", F.least(F.lit(LEAVES), F.ceil(F.col("points") / LEAF)).cast("int")))
    trees = cut(_trees(points, sizes))
    placed = cut(_assigned(points, sizes, trees))
    held = placed.groupBy("label", "dim", "leaf").agg(F.count(F.lit(1)).alias("held"))
    placed = placed.join(held, ["label", "dim", "leaf"]).withColumn("ring", F.when(F.col("held") > LEAF, F.floor(F.col("dist") / RING)).otherwise(0).cast("int"))
    spot = ["label", "dim", "leaf", "ring"]
    rings = placed.groupBy(*spot).agg(F.count(F.lit(1)).alias("rows"), F.min("dist").alias("nearest"), F.max("dist").alias("farthest"))
    rings = cut(rings.withColumn("chunks", F.ceil(F.col("rows") / LEAF).cast("int")))
    block = F.concat_ws(":", *[F.col(c).cast("string") for c in spot], F.col("chunk").cast("string"))
    blocks = placed.join(rings.select(*spot, "chunks"), spot).withColumn("chunk", F.pmod(F.col("node.key"), F.col("chunks")))
    blocks = cut(_planted(blocks.groupBy(block.alias("block")).agg(F.collect_list(F.struct("node", "n", "embedding")).alias("rows")), reach / 2))

    pairs = _ring_pairs(rings, trees, reach)
    for side in "ab":
        own = rings.select("label", "dim", F.col("leaf").alias(f"leaf_{side}"), F.col("ring").alias(f"ring_{side}"), F.col("chunks").alias(f"chunks_{side}"))
        pairs = pairs.join(own, ["label", "dim", f"leaf_{side}", f"ring_{side}"])
    pairs = pairs.withColumn("chunk_a", F.explode(F.sequence(F.lit(0), F.col("chunks_a") - 1))).withColumn("chunk_b", F.explode(F.sequence(F.lit(0), F.col("chunks_b") - 1)))
    name = lambda s: F.concat_ws(":", *[F.col(c).cast("string") for c in ("label", "dim", f"leaf_{s}", f"ring_{s}", f"chunk_{s}")])
    same_ring = (F.col("leaf_a") == F.col("leaf_b")) & (F.col("ring_a") == F.col("ring_b"))
    pairs = pairs.filter(~same_ring | (F.col("chunk_a") <= F.col("chunk_b"))).select(name("a").alias("a"), name("b").alias("b"))
    side = lambda s: blocks.select(F.col("block").alias(s), F.struct("rows", "tree").alias(f"rows_{s}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b")

    node = points.schema["node"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                a, b, x, y = (batch.column(c)[i] for c in ("a", "b", "rows_a", "rows_b"))
                same = a.as_py() == b.as_py()
                (nodes_x, times_x, u), (nodes_y, times_y, v) = ((s.field("node"), s.field("n").to_numpy(), units(_matrix(s.field("embedding")))) for s in (x["rows"].values, y["rows"].values))
                linked, _, _ = dual_links(u, _matrix(x["tree"].values), v, _matrix(y["tree"].values), threshold, reach)
                if same:
                    np.fill_diagonal(linked, False)
                some_x, some_y = (np.flatnonzero(linked.any(axis)) for axis in (1, 0))
                if not len(some_x):
                    continue
                linked = linked[np.ix_(some_x, some_y)]
                nodes_x, times_x, nodes_y, times_y = nodes_x.take(pa.array(some_x)), times_x[some_x], nodes_y.take(pa.array(some_y)), times_y[some_y]
                head_x, head_y = _compare(linked, same)
                nodes = nodes_x if same else pa.concat_arrays([nodes_x, nodes_y])
                sums = linked @ times_y if same else np.concatenate([linked @ times_y, times_x @ linked])
                heads = head_x if same else np.concatenate([head_x, head_y])
                hit = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays([nodes.take(pa.array(hit)), pa.array(sums[hit].astype(np.int64)), nodes.take(pa.array(heads[hit]))], names=["node", "links", "tie"])

    return pairs.select("a", "b", "rows_a", "rows_b").mapInArrow(run, f"node {node}, links long, tie {node}")


def embedding_table(emb: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Vectors link if their labels are equal and not null and their cosine is at least
    threshold. Vectors that are null, zero, or hold null or non-finite components have
    no links, and so have vectors of different lengths to each other. Null ids come
    after all others: component_id is null only where all ids are. Repeated rows link
    like other equal vectors; other columns are ignored.
    """
    rows = emb.filter(_usable()).select("vec_id", "label", "embedding")
    node = F.struct(F.col("id").isNull().alias("absent"), F.col("id"), F.col("key"))
    points = rows.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n")).withColumn("key", F.xxhash64("label", "embedding"))
    points = cut(points.select("label", F.size("embedding").alias("dim"), node.alias("node"), "n", "embedding"))
    found = cut(links(points, threshold))
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("tie").alias("b")))
    done = points.join(sums, "node", "left").join(roots, "node", "left")
    done = cut(done.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node")["id"].alias("component_id")))
    out = rows.join(done, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = emb.filter(~_usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
