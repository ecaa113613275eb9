"""Toxicity by nearest labelled examples.

Up to EXAMPLES labelled documents of each class, in hash order, are the examples.
Every text is a TF-IDF vector over all its words and their beginnings, hashed to
AXES axes: weight (1 + ln tf) * idf of the axis, document frequencies over all
documents. Each axis is further weighted by its relevance, the smoothed share of
the toxic class among the examples that have it (1 to 2, cubed): plain TF-IDF lets
the many accidental words of a text outweigh the few that matter. No axis is left
out, and the cosines are those of the weighted vectors.

The K examples of highest cosine are found exactly with a block-max inverted
index: like examples stand in blocks, each axis has its largest weight per block,
and a block is visited only if the bound that these give it can reach the K-th
cosine found so far. Votes are weighted by distance and by class, then calibrated
on votes among the examples themselves, each judged without itself.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_rows, bounded_arrow, cut

#: Documented bounds: examples per class, axes of the vector space, neighbours, examples per block of the index.
EXAMPLES, AXES, K, BLOCK = 1500, 1 << 20, 15, 128
#: Labelled ids are drawn by this factor more than EXAMPLES, since near copies among them go.
DRAWN = 2
#: Lengths of the beginnings of words that have axes of their own.
BEGINNINGS = (4, 6)
#: Examples' worth of even evidence added to each axis' share of the toxic class, and the power of its relevance.
EVEN, POWER = 20, 3
#: Blocks visited first, example vectors that like examples are gathered around, and words that a worker remembers.
FIRST, SEEDS, REMEMBERED = 4, 24, 400_000
#: Texts whose dense axes are multiplied together; the share of the examples beyond which an axis is dense, and the number up to which it is scarce.
TOGETHER, DENSE, SCARCE = 64, 10, 8
SEED = 42
_words = re.compile(r"[^\W\d_]+").findall


def axes_of(word: str) -> tuple[int, ...]:
    """Axes of the word itself and of its proper beginnings, marked by ^."""
    terms = [word, *[f"^{word[:k]}" for k in BEGINNINGS if len(word) > k]]
    return tuple(xxhash.xxh3_64_intdigest(x.encode(), SEED) % AXES for x in terms)


def held_out(doc_id: Column, parts: int = 5, part: int = 0) -> Column:
    """Whether crc32 of the id's text leaves `part`; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def drawn(labels: DataFrame, each: int) -> DataFrame:
    """(doc_id, toxic) of at most `each` labelled ids per class, in hash order; an id with any label 1 is toxic."""
    one = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    part = lambda y: one.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each)
    return part(0).unionByName(part(1))


def family(text: str) -> int:
    """A hash of the four least hashes of a text's 3-word shingles, which most near copies of it share."""
    words = text.lower().encode().split()
    shingles = zip(words, words[1:], words[2:]) if len(words) > 2 else [words]
    least = sorted({xxhash.xxh3_64_intdigest(b" ".join(s)) for s in shingles})[:4]
    return xxhash.xxh3_64_intdigest(repr(least).encode()) - (1 << 63)


class Counts:
    """Counts of axes in texts, with the axes of words remembered from batch to batch."""

    def __init__(self) -> None:
        self.memory: dict[str, tuple[int, ...]] = {}

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ends, axes, counts): row i of texts has axes[ends[i]:ends[i + 1]], in order, that often."""
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        lists = [_words(t.lower()) if t else [] for t in texts]
        coded = pa.array([w for x in lists for w in x], pa.string()).dictionary_encode()
        own = []
        for w in coded.dictionary.to_pylist():
            if (found := self.memory.get(w)) is None:
                found = self.memory[w] = axes_of(w)
            own.append(found)
        n = max(1, len(own))
        rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        pairs, times = np.unique(rows * n + coded.indices.to_numpy(), return_counts=True)
        sizes = np.array([len(x) for x in own], np.int64)
        flat = np.array([a for x in own for a in x], np.int64)
        first = np.cumsum(sizes) - sizes
        word, row = pairs % n, pairs // n
        if not len(pairs):
            return np.zeros(len(lists) + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        reach = sizes[word]
        take = np.arange(reach.sum()) + np.repeat(first[word] - (np.cumsum(reach) - reach), reach)
        keys = np.repeat(row, reach) * AXES + flat[take]
        order = np.argsort(keys)
        keys = keys[order]
        starts = np.flatnonzero(np.diff(keys, prepend=-1))
        keys, counts = keys[starts], np.add.reduceat(np.repeat(times, reach)[order], starts)
        return np.searchsorted(keys, np.arange(len(lists) + 1) * AXES), keys % AXES, counts


def example_counts(docs: DataFrame, chosen: DataFrame, each: int = EXAMPLES) -> list[tuple]:
    """(doc_id, toxic, axes, counts), the last two as arrays, of at most `each` examples per class, one of each family of near copies of a class.

    Of several rows with one id the text of the least hash counts.
    """

    def run(batches):
        counter = Counts()
        for ids, toxic, texts in as_rows(batches, "doc_id", "toxic", "text"):
            ends, axes, counts = counter.of(texts)
            lists = [pa.array([x[i:j].astype("<i4").tobytes() for i, j in zip(ends, ends[1:])], pa.binary()) for x in (axes, counts)]
            families = pa.array([family(t or "") for t in texts], pa.int64())
            texts = pa.array([xxhash.xxh3_64_intdigest((t or "").encode()) - (1 << 63) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(toxic, pa.int32()), families, texts, *lists], names=["doc_id", "toxic", "family", "text", "axes", "counts"])

    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    found = found.mapInArrow(run, "doc_id long, toxic int, family long, text long, axes binary, counts binary")
    one = found.groupBy("doc_id").agg(F.min_by(F.struct("*"), F.struct("text", "axes")).alias("r")).select("r.*")
    one = cut(one.groupBy("toxic", "family").agg(F.min_by(F.struct("doc_id", "axes", "counts"), "doc_id").alias("r")).select("toxic", "r.*"))
    part = lambda y: one.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each)
    rows = part(0).unionByName(part(1)).select("doc_id", "toxic", "axes", "counts").toArrow().to_pydict()
    return [(i, y, np.frombuffer(a, "<i4"), np.frombuffer(c, "<i4")) for i, y, a, c in zip(*rows.values())]


def packed(axes: np.ndarray, counts: np.ndarray) -> bytes:
    """Axes in order, as gaps, and their counts, compressed."""
    return zlib.compress(np.concatenate([np.diff(axes, prepend=0), counts]).astype("<i4").tobytes(), 1) if len(axes) else b""


def unpacked(held: bytes) -> tuple[np.ndarray, np.ndarray]:
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.frombuffer(zlib.decompress(held), "<i4").reshape(2, -1)
    return np.cumsum(both[0], dtype=np.int64), both[1]


def text_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, held) of every row: the packed counts of axes in its whole text."""
    bounded_arrow(docs.sparkSession)

    def run(batches):
        counter = Counts()
        for b in batches:
            ends, axes, counts = counter.of(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([packed(axes[i:j], counts[i:j]) for i, j in zip(ends, ends[1:])], pa.binary())], names=["doc_id", "held"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held binary")


def document_frequencies(counted: DataFrame) -> tuple[int, np.ndarray]:
    """The number of rows of text_counts, and in how many of them each axis occurs."""

    def run(batches):
        held, rows = np.zeros(AXES + 1, np.int64), 0
        for b in batches:
            rows += b.num_rows
            axes = [unpacked(x)[0] for x in b.column(0).to_pylist()]
            held[:AXES] += np.bincount(np.concatenate([np.zeros(0, np.int64), *axes]), minlength=AXES)
        held[AXES] = rows
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(held[at], pa.int64())], names=["axis", "n"])

    found = counted.select("held").mapInArrow(run, "axis int, n long").groupBy("axis").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(AXES + 1)
    df[found.column("axis").to_numpy()] = found.column("n").to_numpy()
    return int(df[AXES]), df[:AXES]


class BlockMaxIndex:
    """Exact nearest examples by cosine: postings in blocks, and the largest weight per axis and block.

    Axes that over a DENSE-th of the examples have keep one weight for every example
    instead, and those that at most SCARCE have plain postings; what these two kinds
    add to a cosine is known exactly before bounds are taken. Weights are of single
    precision, and a bound must be short of the K-th cosine by more than its error.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_axes: int, block: int = BLOCK):
        self.size, self.block = len(vectors), block
        self.n_blocks = max(1, math.ceil(self.size / block))
        doc = np.repeat(np.arange(self.size, dtype=np.int32), [len(a) for a, _ in vectors])
        axis = np.concatenate([np.zeros(0, np.int64), *[a for a, _ in vectors]]).astype(np.int64)
        weight = np.concatenate([np.zeros(0), *[w for _, w in vectors]]).astype(np.float32)
        order = np.lexsort((doc, axis))
        doc, axis, weight = doc[order], axis[order], weight[order]
        n = np.bincount(axis, minlength=n_axes)
        self.kind = np.where(n > self.size // DENSE, 0, np.where(n <= SCARCE, 2, 1)).astype(np.int8)
        self.row = np.zeros(n_axes, np.int32)
        for k in range(3):
            self.row[self.kind == k] = np.arange((self.kind == k).sum())
        dense, middle, scarce = (self.kind[axis] == k for k in range(3))
        row = self.row[axis]
        self.dense = np.zeros(((self.kind == 0).sum(), self.n_blocks * block), np.float32)
        self.dense[row[dense], doc[dense]] = weight[dense]
        self.scarce = doc[scarce], weight[scarce], np.concatenate([[0], np.cumsum(n[self.kind == 2])]).astype(np.int32)
        self.doc, self.weight, row = doc[middle], weight[middle], row[middle]
        n_middle = int((self.kind == 1).sum())
        self.most = np.zeros((n_middle, self.n_blocks), np.float32)
        np.maximum.at(self.most, (row, self.doc // block), self.weight)
        self.ends = np.zeros(n_middle * self.n_blocks + 1, np.int32)
        np.cumsum(np.bincount(row.astype(np.int64) * self.n_blocks + self.doc // block, minlength=n_middle * self.n_blocks), out=self.ends[1:])

    def known(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What dense and scarce axes add to the cosines of some vectors, one row each with one column per example."""
        held = np.zeros((len(vectors), len(self.dense)))
        for i, (axes, weights) in enumerate(vectors):
            dense = self.kind[axes] == 0
            held[i, self.row[axes[dense]]] = weights[dense]
        sums = held @ self.dense
        doc, weight, ends = self.scarce
        for i, (axes, weights) in enumerate(vectors):
            scarce = self.kind[axes] == 2
            row = self.row[axes[scarce]]
            take, sizes = _ranges(ends[row].astype(np.int64), ends[row + 1] - ends[row])
            sums[i] += np.bincount(doc[take], weight[take] * np.repeat(weights[scarce], sizes), minlength=sums.shape[1])
        return sums

    def cosines(self, rows: np.ndarray, weights: np.ndarray, blocks: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of all examples in some blocks, from the axes between dense and scarce and what is known."""
        cells = (rows[:, None] * self.n_blocks + blocks[None, :]).ravel()
        take, sizes = _ranges(self.ends[cells].astype(np.int64), self.ends[cells + 1] - self.ends[cells])
        sums = np.bincount(self.doc[take], self.weight[take] * np.repeat(np.repeat(weights, len(blocks)), sizes), minlength=len(known))
        examples = (blocks[:, None] * self.block + np.arange(self.block)[None, :]).ravel()
        return examples, sums[examples] + known[examples]

    def nearest(self, axes: np.ndarray, weights: np.ndarray, k: int, without: int = -1, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest with a positive cosine; equal cosines in example order."""
        axes = np.asarray(axes, np.int64)
        known = self.known([(axes, weights)])[0] if known is None else known
        middle = self.kind[axes] == 1
        rows, weights = self.row[axes[middle]].astype(np.int64), weights[middle]
        bounds = known.reshape(self.n_blocks, self.block).max(1) + weights @ self.most[rows]
        order = np.argsort(-bounds, kind="stable")
        docs, scores = np.zeros(0, np.int64), np.zeros(0)
        for blocks in (order[:FIRST], order[FIRST:]):
            least = scores[-1] - 1e-6 if len(scores) == k else 0.0
            blocks = blocks[(bounds[blocks] > 0) & (bounds[blocks] >= least)]
            if not len(blocks):
                break
            found, sums = self.cosines(rows, weights, np.sort(blocks), known)
            keep = (sums > 0) & (found != without)
            docs, scores = np.concatenate([docs, found[keep]]), np.concatenate([scores, sums[keep]])
            near = np.flatnonzero(scores >= np.partition(scores, -k)[-k]) if len(scores) > k else np.arange(len(scores))
            best = near[np.lexsort((docs[near], -scores[near]))[:k]]
            docs, scores = docs[best], scores[best]
        return docs, scores


def _ranges(first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges that begin at first, and the ranges' sizes."""
    return np.arange(sizes.sum()) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes), sizes


def fit_platt(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic curve with slightly smoothed targets, by Newton steps."""
    targets = np.where(labels > 0, 0.99, 0.01)
    x, beta = np.stack([votes, np.ones_like(votes)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weights * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weights * (targets - p)) - 1e-6 * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


class Model:
    """Examples, their index, the weights of axes and classes, and the calibration."""

    def __init__(self, total: int, df: np.ndarray, rows: list[tuple], classes: dict[int, int], k: int = K):
        rows = sorted(rows, key=lambda r: (r[1], r[0]))
        rows = [(i, y, np.asarray(a, np.int64), np.asarray(c, float)) for i, y, a, c in rows]
        self.k = k
        self.weight = (np.log((1 + total) / (1 + df)) * self.relevance(rows)).astype(np.float32)
        held = np.unique(np.concatenate([np.zeros(0, np.int64), *[r[2] for r in rows]]))
        self.place = np.full(AXES, -1, np.int32)
        self.place[held] = np.arange(len(held))
        vectors = [self.unit(r[2], r[3]) for r in rows]
        order = self.gathered(vectors, len(held))
        rows, vectors = [rows[i] for i in order], [vectors[i] for i in order]
        self.ids, self.labels = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float)
        self.index = BlockMaxIndex(vectors, len(held))
        taken = Counter(r[1] for r in rows)
        share = np.array([classes.get(r[1], 0) / taken[r[1]] for r in rows])  # documents of its class that an example stands for
        self.weights = share / (share.mean() or 1.0) if len(rows) else share
        bare = np.array([not len(a) for a, _ in vectors], bool)
        rate = lambda m, even: float(((self.labels * self.weights)[m].sum() + 0.01 * even) / (self.weights[m].sum() + even)) if len(rows) else 0.0
        self.bare, self.prior = rate(bare, 1.0), rate(~bare, 1e-9)
        full = np.flatnonzero(~bare)
        votes = np.array([v for v, _, _ in self.votes([vectors[i] for i in full], full.tolist())])
        y = self.labels[full]
        self.curve = fit_platt(votes, y, self.weights[full]) if len(full) and 0 < y.sum() < len(y) else (4.0, -2.0)

    @staticmethod
    def relevance(rows: list[tuple]) -> np.ndarray:
        """Per axis, how far the toxic class outweighs the other among the examples with it (1: even or less; 2: it alone), to POWER."""
        shares = []
        for y in (1, 0):
            own = [r[2] for r in rows if r[1] == y]
            shares.append(np.bincount(np.concatenate([np.zeros(0, np.int64), *own]), minlength=AXES) / max(1, len(own)))
        even = EVEN / max(1, len(rows))
        return np.maximum(1.0, 2 * (shares[0] + even) / (shares[0] + shares[1] + 2 * even)) ** POWER

    def gathered(self, vectors: list[tuple], n_axes: int) -> list[int]:
        """An order of the examples in which those nearest to the same seed stand together."""
        if len(vectors) <= SEEDS:
            return list(range(len(vectors)))
        index = BlockMaxIndex(vectors, n_axes, len(vectors))
        cosines = np.zeros((SEEDS, index.n_blocks * index.block))
        for s, at in enumerate(np.linspace(0, len(vectors) - 1, SEEDS).astype(int)):
            axes, weights = vectors[at]
            middle = index.kind[axes] == 1
            found, sums = index.cosines(index.row[axes[middle]].astype(np.int64), weights[middle], np.arange(index.n_blocks), index.known([vectors[at]])[0])
            cosines[s, found] = sums
        return np.argsort(cosines[:, : len(vectors)].argmax(0), kind="stable").tolist()

    def unit(self, axes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and weights of a text's vector among the axes of the examples; its length is one over all axes."""
        w = (1 + np.log(counts)) * self.weight[axes]
        place = self.place[axes]
        return place[place >= 0], w[place >= 0] / (np.linalg.norm(w) or 1.0)

    def votes(self, vectors: list[tuple], own: list[int] | None = None) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Share of toxic votes, the nearest examples and their cosines for some vectors, without the examples that they are themselves."""
        out = []
        for at in range(0, len(vectors), TOGETHER):
            part = vectors[at : at + TOGETHER]
            for i, (v, known) in enumerate(zip(part, self.index.known(part)), at):
                docs, cosines = self.index.nearest(*v, self.k, own[i] if own else -1, known)
                cosines = cosines.round(9)  # sums may differ in their last digits with what is multiplied together
                w = self.weights[docs] / (1.05 - np.minimum(cosines, 1.0))
                out.append((float((w * self.labels[docs]).sum() / w.sum()) if len(docs) else self.prior, docs, cosines))
        return out

    def scores(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Calibrated scores of (axes, counts) with the ids and cosines of the nearest examples; a text without words has the rate of such examples."""
        found = iter(self.votes([self.unit(*t) for t in texts if len(t[0])]))
        out = []
        for axes, _ in texts:
            if not len(axes):
                out.append((min(1.0, max(0.0, self.bare)), np.zeros(0, np.int64), np.zeros(0)))
                continue
            vote, docs, cosines = next(found)
            out.append((float(1 / (1 + np.exp(-np.clip(self.curve[0] * vote + self.curve[1], -30, 30)))), self.ids[docs], cosines))
        return out


def train(docs: DataFrame, labels: DataFrame, each: int = EXAMPLES) -> tuple[Model, DataFrame]:
    """The model, and the counts of every row of docs, from labels that may be learned from and document frequencies of all docs."""
    bounded_arrow(docs.sparkSession)
    rows = example_counts(docs, cut(drawn(labels, DRAWN * each)), each)
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    classes = {y: n for y, n in known.groupBy("toxic").agg(F.count_distinct("doc_id")).collect()}
    counted = cut(text_counts(docs))
    return Model(*document_frequencies(counted), rows, classes), counted


def scored(counted: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted and the evidence (example ids and cosines) of every row of counts."""
    shared = counted.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            found = shared.value.scores([unpacked(x) for x in b.column(1).to_pylist()])
            offsets = pa.array(np.cumsum([0, *[len(f[1]) for f in found]]), pa.int32())
            evidence = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, kind), *[f[k] for f in found]]))) for k, kind in ((1, np.int64), (2, np.float64))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found], pa.float64()), *evidence], names=["doc_id", "score", "evidence", "cosines"])

    out = counted.select("doc_id", "held").mapInArrow(run, "doc_id long, score double, evidence array<long>, cosines array<double>")
    return out.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "cosines")


def toxicity_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence and cosines of every row.

    Labels are learned only from ids that are not held out. Null and empty texts
    have no words and get the rate of label 1 among examples without words; without
    labels of both classes every score is that rate or 0, or the curve's at an even
    vote. Whole texts count, however long; equal cosines go in example order; repeated
    rows give repeated rows; an empty table gives none. Other columns are ignored,
    whatever their names.
    """
    docs = docs.select("doc_id", "text")
    model, counted = train(docs, labels.filter(~held_out(F.col("doc_id"))))
    return scored(counted, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence", "cosines")
