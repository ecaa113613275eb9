import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("sentencepiece")
import sentencepiece  # noqa: E402

from millrace.llm import packing, pieces  # noqa: E402
from millrace.llm.queries import piece_model  # noqa: E402

ALPHABET = ["a", "the", " ", "  ", "\n", "▁", "é", "漢", "😀", "<s>", "<0x0A>", "\t", "Th", "ing", "\x00", "⁇", "é"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


def texts(n=300):
    rng = random.Random(5)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, 30))) for _ in range(n)] + ["a" * 500, " " * 90, "thething" * 50, "plain words and more of them"]


def test_ids_spans_and_text_equal_the_library(library):
    one, _ = pieces.codec(piece_model())
    batch = list(zip(*pieces._encoded(piece_model(), [t.encode() for t in texts()])))
    for t, got in zip(texts(), batch):
        want = library.encode(t, return_type="proto") if t else None
        ids, begins, ends, text = one.encode(t.encode())
        assert ids.tolist() == got[0].tolist() == library.encode(t)
        assert text == got[3].decode() == library.decode(ids.tolist()) == one.decode(ids.tolist())
        assert begins.tolist() == got[1].tolist() and ends.tolist() == got[2].tolist()
        if want:
            place = [len(t[:i].encode()) for i in range(len(t) + 1)]
            spans = [(p.begin, p.end) for p in want.pieces]
            assert spans in ([*zip(begins.tolist(), ends.tolist())], [*zip([place.index(b) for b in begins], [place.index(e) for e in ends])])


def test_decode_of_any_ids(library):
    one, _ = pieces.codec(piece_model())
    rng = random.Random(3)
    for _ in range(300):
        ids = [rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(3, 259) for _ in range(rng.randint(0, 12))]
        assert one.decode(ids) == library.decode(ids)


def test_character_map_takes_longest_prefixes_and_keeps_places(library):
    rule = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.NormalizerSpec()
    spec.ParseFromString(rule.serialized_normalizer_spec())
    mapped = pieces.PieceCodec(piece_model())
    mapped.map, mapped.prefix, mapped.squeeze, mapped.escape = pieces.CharacterMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
    for t in ["ﬁne  ＡＢＣ １２３", "㍿ ½ ", "  é á x", "한글 ①", "​zero width", "", "   "]:
        got, starts = mapped.normalise(t.encode())
        assert got.replace("▁", " ") == rule.normalize(t).replace("▁", " ")
        assert len(starts) == len(got) + 1 and all(np.diff(starts) >= 0) and starts[-1] <= len(t.encode())
    mapped.prefix = False
    assert mapped.normalise("ﬁx".encode())[1].tolist() == [0, 0, 3, 4]


def test_digests_of_every_row(edge, nothing, library):
    got = [tuple(r)[:4] for r in pieces.digests(edge, piece_model()).collect()]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in edge.select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "")
        want.append((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert pieces.digests(nothing, piece_model()).count() == 0


def test_encode_gives_spans_of_the_source(edge):
    for r in pieces.encode(edge.filter("doc_id = 8"), piece_model()).collect():
        source = "ünï cödé 漢字 😀 ▁ ".encode()
        assert b"".join(source[b:e] for b, e in zip(r["begins"], r["ends"])) == source


def test_best_fit_fills_the_fullest_row_with_room():
    rng = random.Random(1)
    for length in (7, 64):
        sizes = [rng.randint(1, length) for _ in range(200)]
        free: list[int] = []
        for n in sorted(sizes, reverse=True):
            room = min((f for f in free if f >= n), default=None)
            if room is None:
                free.append(length - n)
            else:
                free[free.index(room)] -= n
        rows = packing.best_fit(sizes, length)
        assert sorted(i for r in rows for i in r) == list(range(200))
        assert sorted(length - sum(sizes[i] for i in r) for r in rows) == sorted(free)


def test_packed_rows_give_every_document_back(spark, edge, nothing):
    rows = packing.packed_documents(edge, piece_model(), 2, length=256, window=4000).collect()
    parts: dict = {}
    for r in rows:
        ids, places, cuts = np.frombuffer(r["ids"], "<i4"), np.frombuffer(r["positions"], "<i4"), r["cu_seqlens"]
        assert cuts[0] == 0 and cuts[-1] == r["n_tokens"] <= 256 == len(ids) == len(places)
        assert not ids[cuts[-1] :].any() and not places[cuts[-1] :].any()
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            assert places[a:b].tolist() == list(range(b - a))
            parts.setdefault((r["doc_ids"][k], r["starts"][k]), []).append(ids[a:b].tolist())
    one, _ = pieces.codec(piece_model())
    want: dict = {}
    for r in edge.select("doc_id", "text").collect():
        ids = [*one.encode((r["text"] or "").encode())[0].tolist(), 2]
        for s in range(0, len(ids), 256):
            want.setdefault((r["doc_id"], s), []).append(ids[s : s + 256])
    assert {k: sorted(v) for k, v in parts.items()} == {k: sorted(v) for k, v in want.items()}
    assert packing.packed_documents(nothing, piece_model()).count() == 0
    some = spark.createDataFrame([(1, [5, 6, 7]), (2, None)], "doc_id long, ids array<int>")
    assert [r["doc_ids"] for r in packing.packed_ids(some, 2).collect()] == [[1], [1]]


def test_matrices_read_back(spark, edge, tmp_path):
    rows = packing.packed_documents(edge, piece_model(), 2, length=128)
    packing.write_packed(rows, f"{tmp_path}/packed")
    table = spark.read.parquet(f"{tmp_path}/packed").toArrow()
    ids, positions = packing.matrices(table, 128)
    assert ids.shape == positions.shape == (table.num_rows, 128)
    for row, place, cuts in zip(ids, positions, table.column("cu_seqlens").to_pylist()):
        assert all(place[a:b].tolist() == list(range(b - a)) for a, b in zip(cuts, cuts[1:]))
        assert all(row[b - 1] == 2 for a, b in zip(cuts, cuts[1:]) if b - a < 128)
