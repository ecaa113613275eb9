"""SentencePiece encoding and decoding that keeps the place of every piece in the source.

A text is first normalised through the model's compiled character map: at each
position the longest prefix that the map's double-array trie knows is replaced,
else one character is copied. Each normalised character remembers the source
byte it came from. Byte-pair merges then cut the normalised text into pieces,
and every piece is projected back to its byte span [begin, end) of the source.

No piece of a supported model has a space mark after another character, nor a
character that only stands alone, inside it. Merges therefore never cross such
places, and the chunks between them are encoded once and remembered.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_arrow

MARK = "▁"
#: Chunks remembered per Python worker, and the longest chunk worth remembering.
REMEMBER, REMEMBER_LENGTH = 800_000, 48
#: The same where whole encodings are handed on, and about how many bytes of texts are encoded at a time there.
REMEMBER_FEW, SLICE = 60_000, 1 << 19
#: Kinds of pieces in a model file (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class CharacterMap:
    """Longest-prefix replacement by a compiled character map: a double-array trie and its replacement strings."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.strings = blob[4 + size :]

    def longest(self, source: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes consumed, replacement) of the longest known prefix of source[at:]."""
        units, found, unit = self.units, None, self.units[0]
        node = self._child_base(0, unit)
        for i in range(at, len(source)):
            c = source[i]
            node ^= c
            if node >= len(units) or (units[node] & 0x800000FF) != c:
                break
            unit = units[node]
            leaf = bool(unit >> 8 & 1)
            node = self._child_base(node, unit)
            if leaf:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        return found and (found[0], self.strings[found[1] : self.strings.index(b"\0", found[1])])

    @staticmethod
    def _child_base(node: int, unit: int) -> int:
        return node ^ ((unit >> 10) << ((unit & 0x200) >> 6))


class PieceCodec:
    """Encoder and decoder of one byte-fallback BPE model."""

    def __init__(self, path: str, remember: int = REMEMBER):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = {p.type for p in model.pieces}
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or model.trainer_spec.treat_whitespace_as_suffix or kinds & {USER_DEFINED, UNUSED}:
            raise ValueError(f"{path}: only BPE models with byte fallback and without user-defined pieces are supported")
        spec = model.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.pieces = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.cost = {p.piece: -p.score for p in model.pieces if p.type == NORMAL}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError(f"{path}: pieces with inner space marks are not supported")
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in joined)
        self.chunks = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]" if alone else "")).findall
        self.memory: dict[str, tuple[bytes, bytes, str]] = {}
        self.remember = remember

    # Normalisation

    def normalise(self, source: bytes) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its characters, and its end, the source byte where it begins."""
        if not source:
            return "", np.zeros(1, np.int64)
        if self.map is None and not self.squeeze:
            text, octets = source.decode(), np.frombuffer(source, np.uint8)
            starts = np.append(np.flatnonzero((octets & 0xC0) != 0x80), len(source))
            text = text.replace(" ", MARK) if self.escape else text
            return (MARK + text, np.append(0, starts)) if self.prefix else (text, starts)
        return self._normalise_mapped(source)

    def _normalise_mapped(self, source: bytes) -> tuple[str, np.ndarray]:
        space = MARK if self.escape else " "
        out: list[str] = []
        starts: list[int] = []
        at, length, blank = 0, len(source), self.squeeze
        while at < length:
            used, text = self._next(source, at)
            if self.squeeze and blank:
                text = text.lstrip(" ")
            for c in text:
                out.append(space if c == " " else c)
                starts.append(at)
            blank = text.endswith(" ") if text else blank
            at += used
        while self.squeeze and out and out[-1] == space:
            length = starts[-1]
            out.pop()
            starts.pop()
        if not out:
            return "", np.array([length], np.int64)
        if self.prefix:
            out.insert(0, space)
            starts.insert(0, starts[0])
        return "".join(out), np.array([*starts, length], np.int64)

    def _next(self, source: bytes, at: int) -> tuple[int, str]:
        if self.map and (found := self.map.longest(source, at)):
            return found[0], found[1].decode()
        first = source[at]
        used = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return used, source[at : at + used].decode()

    # Merging

    def merge(self, chunk: str) -> list[str]:
        """Pieces of a chunk: the adjacent pair of least cost joins first, the left one among equals."""
        parts, cost, none = list(chunk), self.cost.get, float("inf")
        if len(parts) > 2 * REMEMBER_LENGTH:
            return self._merge_long(parts)
        costs = [cost(a + b, none) for a, b in zip(parts, parts[1:])]
        while costs and (least := min(costs)) < none:
            i = costs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i:
                costs[i - 1] = cost(parts[i - 1] + parts[i], none)
            if i < len(costs):
                costs[i] = cost(parts[i] + parts[i + 1], none)
        return parts

    def _merge_long(self, parts: list) -> list[str]:
        """The same with a heap, for chunks where a scan after each join would be slow."""
        cost, n = self.cost.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, str, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (c := cost(whole := parts[i] + parts[j])) is not None:
                heap.append((c, i, whole, j)) if not ready else heapq.heappush(heap, (c, i, whole, j))

        ready = False
        for i in range(n - 1):
            offer(i, i + 1)
        heapq.heapify(heap)
        ready = True
        while heap:
            _, i, whole, j = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != whole:
                continue
            parts[i], parts[j] = whole, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p is not None]

    def _chunk(self, chunk: str) -> tuple[bytes, bytes, str]:
        """Ids, characters per id (both as int32 bytes) and decoded text of a chunk."""
        ids, widths = [], []
        for p in self.merge(chunk):
            if p in self.ids:
                ids.append(self.ids[p])
                widths.append(len(p))
            else:  # its bytes; the last one stands for the character
                octets = p.encode()
                ids += [self.byte_ids[b] for b in octets]
                widths += [0] * (len(octets) - 1) + [1]
        found = np.array(ids, np.int32).tobytes(), np.array(widths, np.int32).tobytes(), self._decoded(ids)
        if len(chunk) <= REMEMBER_LENGTH:
            if len(self.memory) >= self.remember:
                self.memory.clear()
            self.memory[chunk] = found
        return found

    # Texts

    def encode(self, source: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
        """Ids, begin and end bytes in the source of each id, and the text that the ids decode to."""
        text, starts = self.normalise(source)
        known = self.memory.get
        parts = [known(c) or self._chunk(c) for c in self.chunks(text)]
        ids = np.frombuffer(b"".join([p[0] for p in parts]), np.int32)
        ends = np.cumsum(np.frombuffer(b"".join([p[1] for p in parts]), np.int32), dtype=np.int64)
        decoded = "".join([p[2] for p in parts])
        begins = np.append(0, ends[:-1]) if len(ends) else ends
        return ids, starts[begins], starts[ends], self._without_prefix(decoded)

    def _decoded(self, ids: list[int]) -> str:
        out, octets = [], bytearray()
        for i in ids:
            if self.kinds[i] == BYTE:
                octets.append(int(self.pieces[i][3:5], 16))
                continue
            out.append(_valid(octets))
            octets.clear()
            if self.kinds[i] == NORMAL:
                out.append(self.pieces[i].replace(MARK, " "))
            elif self.kinds[i] == UNKNOWN:
                out.append(" ⁇ ")
        return "".join([*out, _valid(octets)])

    def _without_prefix(self, text: str) -> str:
        if self.squeeze:
            return text.lstrip(" ")
        return text[1:] if self.prefix and text[:1] == " " else text

    def decode(self, ids: list[int]) -> str:
        """The text of any ids; bytes that are no UTF-8 become U+FFFD one by one."""
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        text = self._decoded(ids)
        return self._without_prefix(text) if first is not None and self.pieces[first].startswith(MARK) else text


def _valid(octets: bytearray) -> str:
    if not octets:
        return ""
    out, at = [], 0
    while at < len(octets):
        first = octets[at]
        size = 1 if first < 0x80 else 2 if 0xC2 <= first < 0xE0 else 3 if 0xE0 <= first < 0xF0 else 4 if 0xF0 <= first < 0xF5 else 0
        try:
            out.append(bytes(octets[at : at + size]).decode() if size else "�")
            at += size or 1
        except UnicodeDecodeError:
            out.append("�")
            at += 1
    return "".join(out)


class Batches:
    """Encodes batches of texts at once, for models whose character map is empty.

    Words (the text between two spaces, after its space mark) are told apart by
    Arrow; those not seen before are merged side by side, one join per word and
    round; ids, spans and decoded texts of the batch are then gathered.
    """

    SYMBOLS = 1 << 21  # above every piece id plus code point

    def __init__(self, codec: PieceCodec):
        self.codec, size = codec, len(codec.pieces)
        symbol = lambda p: codec.ids[p] if p in codec.ids else size + ord(p) if len(p) == 1 else None
        halves = ((symbol(p[:k]), symbol(p[k:]), i, codec.cost[p]) for p, i in codec.ids.items() for k in range(1, len(p)))
        kinds = [("key", np.int64), ("joined", np.int32), ("cost", np.float32)]
        pairs = np.fromiter(((a * self.SYMBOLS + b, i, c) for a, b, i, c in halves if a is not None and b is not None), kinds)
        pairs.sort(order="key")
        self.keys, self.joined, self.costs = (pairs[n].copy() for n, _ in kinds)
        self.of_point = np.arange(0x110000, dtype=np.int32) + size
        for p, i in codec.ids.items():
            if len(p) == 1:
                self.of_point[ord(p)] = i
        self.widths = np.array([len(p) if k == NORMAL else 0 for p, k in zip(codec.pieces, codec.kinds)], np.int64)
        raw = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() if k == NORMAL else b"" for p, k in zip(codec.pieces, codec.kinds)]
        self.raw = pa.array(raw, pa.large_binary())
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.sizes, self.ids, self.chars = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a.astype(np.int64) * self.SYMBOLS + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.costs[at], np.float32(np.inf)), self.joined[at]

    def _merge(self, words: list[str]) -> list[np.ndarray]:
        """Symbols of words of like length, after all joins; -1 fills the rows up."""
        length = max(map(len, words)) + 1
        points = np.full((len(words), length + 1), -1, np.int32)
        flat = self.of_point[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        sizes = np.array([len(w) for w in words])
        points[:, 0] = self.of_point[ord(MARK)]
        points[:, 1:][np.arange(length)[None, :] < sizes[:, None]] = flat
        costs, joined = self._pairs(points[:, :-1], points[:, 1:])
        rows, cols = np.arange(len(words)), np.arange(length)
        while len(rows):
            best = costs[rows].argmin(1)
            open_ = costs[rows, best] < np.inf
            rows, best = rows[open_], best[open_]
            if not len(rows):
                break
            points[rows, best] = joined[rows, best]
            at = best[:, None]
            points[rows[:, None], cols] = points[rows[:, None], cols + (cols > at)]
            points[rows, length] = -1
            shift = np.minimum(cols + (cols >= at), length - 1)
            costs[rows[:, None], cols], joined[rows[:, None], cols] = costs[rows[:, None], shift], joined[rows[:, None], shift]
            costs[rows, length - 1] = np.inf
            for left, on in ((best, slice(None)), (best - 1, best > 0)):
                r, k = rows[on], left[on]
                costs[r, k], joined[r, k] = self._pairs(points[r, k], points[r, k + 1])
        return points

    def _learn(self, words: list[str]) -> None:
        size, out = len(self.codec.pieces), []
        for at in range(0, len(words), 4096):
            points = self._merge(words[at : at + 4096])
            held = points >= 0
            counts, flat = held.sum(1), points[held]
            ids, chars = np.minimum(flat, size - 1), self.widths[np.minimum(flat, size - 1)]
            if (odd := np.flatnonzero(flat >= size)).size:  # characters without a piece become their bytes
                octets = [chr(x - size).encode() for x in flat[odd]]
                times = np.ones(len(flat), np.int64)
                times[odd] = [len(o) for o in octets]
                counts = np.add.reduceat(times, np.append(0, np.cumsum(counts)[:-1]))
                ends = np.cumsum(times)
                ids, chars = np.repeat(ids, times), np.repeat(chars, times)
                for k, o in zip(odd, octets):
                    ids[ends[k] - len(o) : ends[k]] = [self.codec.byte_ids[b] for b in o]
                    chars[ends[k] - len(o) : ends[k]] = [0] * (len(o) - 1) + [1]
            out.append((counts.astype(np.int32), ids.astype(np.int32), chars.astype(np.int32)))
        first = len(self.sizes)
        self.known.update(zip(words, range(first, first + len(words))))
        self.sizes, self.ids, self.chars = (np.concatenate([old, *new]) for old, new in zip((self.sizes, self.ids, self.chars), zip(*out)))

    def ids_of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row offsets and ids of all rows, and the place of each id among those of remembered words."""
        column = pa.array(texts, pa.large_binary()).cast(pa.large_string())
        lists = pc.split_pattern(column, " ")
        coded = lists.flatten().dictionary_encode()
        words, which = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        if len(self.known) + len(words) > self.codec.remember:
            self.forget()
        new = [w for w in words if w not in self.known]
        if new:
            self._learn(sorted(new, key=len))
        place = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[which]
        sizes, firsts = self.sizes[place], (np.cumsum(self.sizes, dtype=np.int64) - self.sizes)[place]
        done = np.cumsum(sizes, dtype=np.int64)
        take = np.arange(done[-1] if len(done) else 0) + np.repeat(firsts - (done - sizes), sizes)
        return np.append(0, done)[lists.offsets.to_numpy()], self.ids[take], take

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Row offsets, ids, begins and ends of all rows, and the decoded texts (without their first space)."""
        offsets, ids, take = self.ids_of(texts)
        chars = self.chars[take]
        source = np.frombuffer(b"".join(texts), np.uint8)
        places = np.append(np.flatnonzero((source & 0xC0) != 0x80), len(source))
        lengths = np.array([len(t) for t in texts], np.int64)
        bases = np.cumsum(lengths) - lengths
        rows = np.repeat(np.arange(len(texts)), np.diff(offsets))
        total = np.cumsum(chars, dtype=np.int64)
        in_row = total - np.append(0, total)[offsets[:-1]][rows]
        ends = places[np.searchsorted(places, bases)[rows] + in_row - 1] - bases[rows]
        begins = np.append(0, ends[:-1])
        begins[offsets[:-1][np.diff(offsets) > 0]] = 0
        return offsets, ids, begins, ends, [x[1:] for x in joined(self.raw, ids, offsets)]

    def plain(self, text: bytes) -> bool:
        """Whether the batch way takes this text: single spaces between its words, no mark in it, no very long word."""
        return bool(text) and b"  " not in text and text[:1] != b" " and text[-1:] != b" " and MARK.encode() not in text and len(max(text.split(b" "), key=len)) <= REMEMBER_LENGTH


def joined(strings: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """For every row offsets[i] to offsets[i + 1]: the strings of its ids, one after the other."""
    _, ends, data = strings.take(pa.array(ids)).buffers()
    cuts = np.frombuffer(ends, np.int64)[offsets].tolist() if len(ids) else [0] * len(offsets)
    data = memoryview(data or b"")
    return [bytes(data[a:b]) for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=4)
def codec(path: str, remember: int = REMEMBER) -> tuple[PieceCodec, Batches | None]:
    """One codec per model and Python worker, and its batch form where it has one."""
    c = PieceCodec(path, remember)
    return c, Batches(c) if c.map is None and not c.squeeze and c.prefix and c.escape else None


def slices(batch: pa.RecordBatch, most: int = SLICE):
    """Parts of a batch (doc_id, text) with about `most` bytes of texts each; a longer text is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def _encoded(path: str, texts: list[bytes | None], remember: int = REMEMBER) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray], list[bytes]]:
    """Per text: ids, begins, ends, and the decoded text in UTF-8."""
    single, batches = codec(path, remember)
    texts = [t or b"" for t in texts]
    fast = [i for i, t in enumerate(texts) if batches and batches.plain(t)]
    out: list = [None] * len(texts)
    if fast:
        offsets, ids, begins, ends, decoded = batches.encode([texts[i] for i in fast])
        for k, i in enumerate(fast):
            row = slice(offsets[k], offsets[k + 1])
            out[i] = ids[row], begins[row], ends[row], decoded[k]
    for i, t in enumerate(texts):
        if out[i] is None:
            *spans, text = single.encode(t)
            out[i] = *spans, text.encode()
    return tuple(list(x) for x in zip(*out)) if out else ([], [], [], [])


def token_ids(path: str, texts: list[bytes | None]) -> list[np.ndarray]:
    """The ids alone of every text, for callers without use for spans and decoded texts; a null text is empty."""
    single, batches = codec(path)
    texts = [t or b"" for t in texts]
    fast = [i for i, t in enumerate(texts) if batches and batches.plain(t)]
    out: list = [None] * len(texts)
    if fast:
        offsets, ids, _ = batches.ids_of([texts[i] for i in fast])
        for i, a, b in zip(fast, offsets, offsets[1:]):
            out[i] = ids[a:b]
    return [single.encode(t)[0] if found is None else found for t, found in zip(texts, out)]


def _lists(rows: list[np.ndarray]) -> pa.Array:
    """Numpy rows as one Arrow list column, without Python numbers."""
    offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *rows]).astype(np.int32)))


def encode(docs: DataFrame, model: str) -> DataFrame:
    """One row per document: doc_id, ids, begins, ends (array<int>, byte spans of the text) and decoded.

    A null text is empty: no ids, decoded to the empty text. Other columns are
    ignored; repeated rows give repeated rows. Nothing is shuffled; whole texts
    are encoded, whatever their length. Workers take texts in slices and remember
    few words, so that they stay small beside an executor that other stages filled.
    """
    bounded_arrow(docs.sparkSession)

    def run(batches):
        for b in (part for whole in batches for part in slices(whole)):
            *spans, decoded = _encoded(model, b.column(1).to_pylist(), REMEMBER_FEW)
            arrays = [_lists(x) for x in spans]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays, pa.array(decoded, pa.binary()).cast(pa.string())], names=["doc_id", "ids", "begins", "ends", "decoded"])

    return _thin(docs).mapInArrow(run, "doc_id long, ids array<int>, begins array<int>, ends array<int>, decoded string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and spans_sha256 of every document's encoding.

    The same encoding as encode(), digested where it is made: decimal ids joined by
    commas, the decoded text, and the end bytes as 64-bit little-endian numbers; all
    in lower-case hex. Null texts count as empty.
    """
    bounded_arrow(docs.sparkSession)

    def sha(parts) -> pa.Array:
        return pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string())

    def run(batches):
        for b in batches:
            ids, _, ends, decoded = _encoded(model, b.column(1).to_pylist())
            sizes = np.array([len(x) for x in ids], np.int64)
            digits = pa.array([b"%d," % i for i in range(len(codec(model)[0].pieces))], pa.large_binary())
            lists = joined(digits, np.concatenate([np.zeros(0, np.int32), *ids]), np.append(0, np.cumsum(sizes)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), sha(x[:-1] for x in lists), sha(decoded), sha(x.astype("<i8").tobytes() for x in ends)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    return _thin(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")


def _thin(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
