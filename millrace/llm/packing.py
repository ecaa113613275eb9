"""Packing token ids into rows of fixed length, best fit decreasing.

Documents are cut into pieces of at most `length` ids without loss. Pieces are
placed from the longest to the shortest, each in the fullest row that still has
room for it. A segment tree over capacities finds that row's capacity in
logarithmic time. Packed rows are rows of an id matrix: each carries `length` ids as
one binary (int32, little endian), of which the first n_tokens are real and the rest
PAD; as many position ids, which start anew with every segment; the cumulative
lengths of its segments; and the documents and offsets the segments come from.

Each task packs what it reads, WINDOW ids at a time, so nothing is shuffled and
memory is bounded; at most the rows of one window's end stay partly filled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_arrow
from .pieces import token_ids

LENGTH, WINDOW = 2048, 1 << 21
#: What fills ids, and positions, after the last segment of a row.
PAD = 0
SCHEMA = "row_key string, n_tokens int, ids binary, cu_seqlens array<int>, positions binary, doc_ids array<long>, starts array<long>"


class Capacities:
    """Open rows by free room, with the least room that is enough found in a segment tree."""

    def __init__(self, length: int):
        self.leaves = 1 << max(1, length.bit_length())
        self.counts = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def _add(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.counts[i] += by
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of an open row with the least room >= need, no longer open; None if there is none."""
        i = need + self.leaves
        if not self.counts[i]:
            while i > 1 and (i & 1 or not self.counts[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i *= 2
                if not self.counts[i]:
                    i += 1
        room = i - self.leaves
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of piece numbers; every piece (1 to length long) is in one row, and no row is longer than length."""
    rows: list[list[int]] = []
    open_ = Capacities(length)
    for piece in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = open_.take(sizes[piece])
        if found is None:
            found = length, len(rows)
            rows.append([])
        room, row = found
        rows[row].append(piece)
        if room > sizes[piece]:
            open_.put(room - sizes[piece], row)
    return rows


def _rows_of(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as binaries of one length."""
    width = matrix.shape[1] * matrix.itemsize
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(matrix))])


def _packed(pieces: list[tuple], length: int, name: str, pad: int = PAD):
    """Record batches of packed rows; pieces are (doc_id, start in document, ids)."""
    rows = best_fit([len(p[2]) for p in pieces], length)
    most = max(1, min(512, (64 << 20) // (8 * length)))
    steps = np.arange(length, dtype="<i4")
    for at in range(0, len(rows), most):
        part = rows[at : at + most]
        ids, positions = np.full((len(part), length), pad, "<i4"), np.full((len(part), length), PAD, "<i4")
        ends = []
        for k, row in enumerate(part):
            n, cu = 0, [0]
            for i in row:
                held = pieces[i][2]
                ids[k, n : n + len(held)] = held
                positions[k, n : n + len(held)] = steps[: len(held)]
                n += len(held)
                cu.append(n)
            ends.append(cu)
        columns = [
            pa.array([f"{name}-{k}" for k in range(at, at + len(part))], pa.string()),
            pa.array([cu[-1] for cu in ends], pa.int32()),
            _rows_of(ids),
            pa.array(ends, pa.list_(pa.int32())),
            _rows_of(positions),
            *[pa.array([[pieces[i][c] for i in row] for row in part], pa.list_(pa.int64())) for c in (0, 1)],
        ]
        yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in SCHEMA.split(", ")])


def _windows(docs_ids, length: int, window: int, name: str):
    pieces, held, n = [], 0, 0
    for doc, ids in docs_ids:
        for start in range(0, len(ids), length):
            pieces.append((doc, start, ids[start : start + length]))
        held += len(ids)
        if held >= window:
            yield from _packed(pieces, length, f"{name}-{n}")
            pieces, held, n = [], 0, n + 1
    yield from _packed(pieces, length, f"{name}-{n}")


def packed_documents(docs: DataFrame, model: str, end_id: int | None = 2, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """Packed rows of all documents' ids, each document closed by end_id.

    row_key names the task, its window and the row in it: reading the same files in
    the same splits again gives the same rows, other splits pack the same documents
    into other rows. A null or empty text is its end_id alone, or nothing if that is
    None. A very long text is cut into pieces and loses nothing. Repeated rows are
    packed as often as they occur; null ids are carried as null. An empty table gives
    no rows. Other columns are ignored, whatever their names.
    """
    bounded_arrow(docs.sparkSession)
    end = np.array([] if end_id is None else [end_id], np.int32)

    def run(batches):
        from pyspark import TaskContext

        given = ((d, np.concatenate([ids, end])) for b in batches for d, ids in zip(b.column(0).to_pylist(), token_ids(model, b.column(1).to_pylist())))
        yield from _windows(given, length, window, str(TaskContext.get().partitionId()))

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return thin.mapInArrow(run, SCHEMA)


def packed_ids(tokens: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """The same for documents that are ids already: (doc_id, ids array<int>); null ids arrays are empty."""
    bounded_arrow(tokens.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        given = ((d, np.asarray(ids or [], np.int32)) for b in batches for d, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        yield from _windows(given, length, window, str(TaskContext.get().partitionId()))

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, SCHEMA)


def write_packed(rows: DataFrame, path: str) -> None:
    """Write packed rows as Parquet, whose binaries hold one row of each matrix; no rows give a table without rows."""
    rows.write.parquet(path)


def matrices(rows: pa.Table, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The id matrix and the position matrix of packed rows read back as Arrow, one row each of `length` columns."""
    of = lambda name: np.frombuffer(b"".join(rows.column(name).to_pylist()), "<i4").reshape(-1, length)
    return of("ids"), of("positions")
