import random

import xxhash

from millrace.llm import simhash


def by_hand(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes)) if words else 0


def brute(rows):
    fps = [by_hand(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                up[find(i)] = find(j)
    groups: dict = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    least = {g: min((d for d in ds if d is not None), default=None) for g, ds in groups.items()}
    return [(d, f"{fps[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows)]


def test_fingerprints_in_pieces(monkeypatch):
    text = " ".join(str(i % 37) for i in range(500))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "PIECE", 7)
    assert simhash.fingerprint(text.encode()) == whole == simhash._signed(by_hand(text))


def test_components_equal_brute_force(edge, nothing):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    got = [tuple(r) for r in simhash.near_duplicates(edge).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    assert simhash.near_duplicates(nothing).count() == 0


def test_small_and_large_groups_connect_the_same_pairs(spark):
    rng = random.Random(2)
    fps = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(40):
            base ^= 1 << rng.randrange(64) if rng.random() < 0.7 else (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            fps.add(base)
    fps = sorted(simhash._signed(x) for x in fps)
    nodes = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "node long, fp long")
    near = {(i, j) for i in range(len(fps)) for j in range(i) if ((fps[i] ^ fps[j]) & (1 << 64) - 1).bit_count() <= 2}
    found = {(max(r), min(r)) for r in map(tuple, simhash.links(nodes).collect())}
    assert found == near

    def parts(edges):
        up = list(range(len(fps)))

        def find(i):
            while up[i] != i:
                i = up[i]
            return i

        for a, b in edges:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
        return [find(i) for i in range(len(fps))]

    large = [tuple(r) for r in simhash.links(nodes, group=1).collect()]
    assert parts(large) == parts(near)
    roots = dict(map(tuple, simhash.components(simhash.links(nodes)).collect()))
    assert [roots.get(i, i) for i in range(len(fps))] == parts(near)


def test_one_row_of_each_component_stays(edge, nothing):
    kept = simhash.keep_representatives(edge)
    assert kept.schema == edge.schema
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    components = {(c, f) if c is None else c for _, f, c in brute(rows)}
    assert len(components) == kept.count()
    assert {r["doc_id"] for r in kept.collect()} == {c if not isinstance(c, tuple) else None for c in components}
    assert simhash.keep_representatives(nothing).count() == 0
