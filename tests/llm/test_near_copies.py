"""Near copies of the pipeline against all pairs in plain Python."""

import random

import pytest

from millrace.llm import near_copies
from millrace.llm.common import components, cut

from .test_simhash import brute


def sets(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_changed_words_are_near_copies(spark):
    rng = random.Random(4)
    texts = []
    for i in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(100)]
        texts.append(base)
        for changes in (1, 1, 2, 4, 9):
            w = list(base)
            for at in rng.sample(range(100), changes):
                w[at] = "changed"
            texts.append(w)
    texts = [" ".join(w) for w in texts]
    up = list(range(len(texts)))

    def find(i):
        return i if up[i] == i else find(up[i])

    shingles = [sets(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if 10 * len(shingles[i] & shingles[j]) >= 8 * len(shingles[i] | shingles[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    want = {i for i in range(len(texts)) if find(i) == i}
    assert 40 < len(want) < 200
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in near_copies.keep_representatives(docs).collect()} == want


def test_large_families_are_led(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(150):
        w = list(base)
        w[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate([*texts, "another text"])), "doc_id long, text string")
    assert {r["doc_id"] for r in near_copies.keep_representatives(docs).collect()} == {0, 150}


def test_edges_of_near_copies(edge, nothing):
    kept = near_copies.keep_representatives(edge)
    assert kept.schema == edge.schema
    assert kept.count() == len({(c, f) if c is None else c for _, f, c in brute([(r["doc_id"], r["text"]) for r in edge.collect()])})
    assert near_copies.keep_representatives(nothing).count() == 0


def test_pairs_at_a_large_meeting_point_are_linked_without_its_leaders(spark):
    """100 nodes meet in two bands; each overlaps with one other only, mostly none of the leaders."""
    rng = random.Random(6)
    ids = rng.sample(range(1 << 40), 100)
    nodes = [(n, rng.randrange(-(1 << 63), 1 << 63), [7, 8]) for n in ids]
    rows = [(n, [1000 * (i // 2) + j + 10 * (i % 2) for j in range(100)]) for i, n in enumerate(ids)]
    found = near_copies.linked(spark.createDataFrame(nodes, "node long, fp long, bands array<long>"), spark.createDataFrame(rows, "node long, held array<int>"))
    assert {(r["node"], r["root"]) for r in found.collect() if r["node"] != r["root"]} == {(max(p), min(p)) for p in zip(ids[::2], ids[1::2])}


def test_large_meeting_points_lose_nothing_against_all_pairs(spark):
    rng = random.Random(7)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(100)]
        for _ in range(12):
            base = list(base)
            for at in rng.sample(range(100), rng.choice((1, 2, 4))):
                base[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(base))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = [{r["doc_id"] for r in near_copies.keep_representatives(docs, group).collect()} for group in (1, 64)]
    assert kept[0] == kept[1] and 12 <= len(kept[0]) < len(texts)


def tasks_of(spark, name, work):
    """What work returns, and the number of tasks of its jobs."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        found = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    seen = spark.sparkContext.statusTracker()
    stages = {s for j in seen.getJobIdsForGroup(name) for s in seen.getJobInfo(j).stageIds}
    return found, sum(i.numTasks for i in map(seen.getStageInfo, stages) if i)


def test_stars_are_components_without_further_rounds(spark):
    edges = spark.createDataFrame([(i, i % 5) for i in range(5, 60)], "a long, b long").coalesce(1)
    got, tasks = tasks_of(spark, "stars", lambda: components(edges).collect())
    assert {(r["node"], r["root"]) for r in got} == {(i, i % 5) for i in range(5, 60)}
    assert tasks < 30  # no large-star or small-star round


def test_components_of_chains_cliques_and_crossing_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 100 + j) for i in range(9) for j in range(i)] + [(200 + i, 250 + i % 7) for i in range(50)] + [(250 + i, 300) for i in range(7)]
    want = {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 109)} | {i: 200 for i in [*range(201, 257), 300]}
    assert {(r["node"], r["root"]) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == set(want.items())
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


@pytest.mark.parametrize("part", [7, 384])
def test_large_meeting_points_are_compared_part_by_part(spark, monkeypatch, part):
    """500 nodes meet in two bands, in pairs that overlap: each pair is found once, whatever the parts."""
    monkeypatch.setattr(near_copies, "PART", part)
    ids = random.Random(8).sample(range(1 << 40), 500)
    met = spark.createDataFrame([(n, b, 7) for n in ids for b in (0, 1)], "node long, band int, key long")
    held = spark.createDataFrame([(n, [1000 * (i // 2) + j + 10 * (i % 2) for j in range(100)]) for i, n in enumerate(ids)], "node long, held array<int>")
    none = spark.createDataFrame([], "node long, root long")
    got = near_copies.full_links(cut(near_copies.still_apart(met, none, held)), held).collect()
    assert sorted((max(r), min(r)) for r in got) == sorted((max(p), min(p)) for p in zip(ids[::2], ids[1::2]))
