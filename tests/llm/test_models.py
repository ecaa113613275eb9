"""Toxicity, language identification and embedding near-duplicates, against brute force and held-out rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import embed_dedup, langid, quality, toxicity


def test_block_max_search_is_exact():
    rng = np.random.default_rng(3)
    vectors = []
    for _ in range(300):
        terms = sorted(rng.choice(40, rng.integers(1, 8), replace=False).tolist())
        w = rng.random(len(terms))
        vectors.append((np.array(terms), w / np.linalg.norm(w)))
    dense = np.zeros((300, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    index = toxicity.BlockMaxIndex(vectors, 40, block=16)
    for i, (t, w) in enumerate(vectors):
        scores = dense @ dense[i]
        scores[i] = -1
        best = [j for j in np.lexsort((np.arange(300), -scores.round(12)))[:7] if scores[j] > 0]
        docs, cosines = index.nearest(t, w, 7, without=i)
        assert cosines == pytest.approx(scores[best]) and cosines == pytest.approx(scores[docs])


@pytest.fixture(scope="module")
def toxic(spark):
    rng = np.random.default_rng(5)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(400)]
    docs, labels = [], []
    for i in range(800):
        w = rng.choice(words, 40).tolist()
        bad = i % 4 == 0
        if bad:
            w[:3] = rng.choice(["vilest", "meanest", "cruel"], 3).tolist()
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_documents_are_judged_right(toxic):
    docs, labels = toxic
    rows = toxicity.toxicity_table(docs, labels).collect()
    assert len(rows) == 800
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held]) > 0.97
    assert not {i for r in rows for i in r["evidence"] or []} & {r["doc_id"] for r in held}


def test_labels_of_held_out_documents_do_not_matter(toxic):
    docs, labels = toxic
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    first, again = ({r["doc_id"]: r["score"] for r in toxicity.toxicity_table(docs, x).collect()} for x in (labels, turned))
    assert first == again


def test_evidence_equals_brute_force(toxic):
    docs, labels = toxic
    docs, labels = docs.filter("doc_id < 200"), labels.filter("doc_id < 200")
    texts, marks = dict(map(tuple, docs.collect())), {r["doc_id"]: r["toxic"] for r in labels.collect()}
    counts = {}
    for i, t in texts.items():
        counts[i] = {}
        for w in t.split():
            for a in toxicity.axes_of(w):
                counts[i][a] = counts[i].get(a, 0) + 1
    learned = [i for i in texts if zlib.crc32(str(i).encode()) % 5]
    weight = {}
    for a in {a for c in counts.values() for a in c}:
        with_a = [np.mean([a in counts[i] for i in learned if marks[i] == y]) for y in (1, 0)]
        even = toxicity.EVEN / len(learned)
        share = 2 * (with_a[0] + even) / (sum(with_a) + 2 * even)
        weight[a] = np.log((1 + len(texts)) / (1 + sum(a in c for c in counts.values()))) * max(1, share) ** toxicity.POWER
    places = {a: n for n, a in enumerate(weight)}
    dense = np.zeros((len(texts), len(places)))
    for i, c in counts.items():
        for a, n in c.items():
            dense[i, places[a]] = (1 + np.log(n)) * weight[a]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    for r in toxicity.toxicity_table(docs, labels).collect():
        cosines = dense[learned] @ dense[r["doc_id"]]
        assert r["cosines"] == pytest.approx(np.sort(cosines)[::-1][: toxicity.K])
        assert [cosines[learned.index(i)] for i in r["evidence"]] == pytest.approx(r["cosines"])


def test_unlike_neutral_documents_have_unlike_evidence(toxic):
    rows = toxicity.toxicity_table(*toxic).filter("predicted = 0").collect()
    assert len({tuple(r["evidence"]) for r in rows}) > 0.95 * len(rows)


def test_several_texts_of_one_labelled_id(spark, toxic):
    docs, labels = toxic
    more = docs.unionByName(docs.filter("doc_id < 40").select("doc_id", F.reverse("text").alias("text")))
    first, again = (sorted(map(str, toxicity.toxicity_table(x, labels).collect())) for x in (more, more.repartition(5)))
    assert first == again


def test_toxicity_edges(spark, edge, nothing, no_labels, toxic):
    assert toxicity.toxicity_table(edge, no_labels).count() == edge.count()
    assert toxicity.toxicity_table(nothing, toxic[1]).count() == 0
    both = edge.select("doc_id", "text").unionByName(toxic[0].withColumn("doc_id", F.col("doc_id") + 100))
    shifted = toxic[1].withColumn("doc_id", F.col("doc_id") + 100).unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None), (8, 1, 1)], "doc_id long, quality int, toxic int"))
    rows = toxicity.toxicity_table(both, shifted).filter("doc_id < 100 or doc_id is null").collect()
    assert len(rows) == edge.count() and all(0 <= r["score"] <= 1 for r in rows)


@pytest.fixture(scope="module")
def tongues(spark):
    rng = np.random.default_rng(2)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["schn", "ei", "ber", "ung"], "cc": ["ño", "ci", "ja", "que"]}
    rows = []
    for i in range(300):
        lang = list(parts)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(parts[lang], rng.integers(1, 4))) for _ in range(12)), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_languages(tongues):
    rows = langid.language_table(tongues).collect()
    truth = {r["doc_id"]: r["lang"] for r in tongues.collect()}
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert all(r["lang_pred"] == truth[r["doc_id"]] and 0 < r["score"] <= 1 for r in held)


def test_unseen_words_fall_back_to_ever_shorter_grams():
    m = langid.LanguageModel([("known", ["x", "y"], [9, 1])], [("^ab", ["x"], [5]), ("zz", ["y"], [5]), ("q", ["y"], [5])], {"x": 1, "y": 1})
    best = lambda w: m.langs[int(m.word(w).argmax())]
    assert [best(w) for w in ("known", "abzz", "czz", "q")] == ["x", "x", "y", "y"]
    assert m.word("漢").tolist() == [0.0, 0.0]


def test_words_are_letters_with_their_marks():
    assert langid.words_of("Straße ½² Ⅷ ① x2y_z हिन्दी E\u0301a 漢字 𐐨") == ["straße", "x", "y", "z", "हिन्दी", "e\u0301a", "漢字", "𐐨"]
    assert langid.words_of("½ ² ① Ⅷ 12 \u0301 _") == langid.words_of(None) == []
    assert langid.words_of("a½b µ²") == ["a", "b", "µ".lower()]


def test_what_the_model_keeps_is_bounded_and_has_all_counts(tongues):
    counts = langid.word_counts(tongues)
    kept = langid.most_frequent(counts, 60)
    everything: dict = {}
    for r in counts.collect():
        everything.setdefault(r["word"], {})[r["lang"]] = r["n"]
    assert 0 < len(kept) <= 60
    assert all(dict(zip(langs, ns)) == everything[w] for w, langs, ns in kept)


@pytest.mark.parametrize("cells", [0, langid.CELLS])
def test_language_scores_equal_brute_force(tongues, monkeypatch, cells):
    monkeypatch.setattr(langid, "CELLS", cells)
    rows = {r["doc_id"]: r for r in tongues.collect()}
    learned = [r for r in rows.values() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    langs = sorted({r["lang"] for r in learned})
    words, grams = ({x: {} for x in langs} for _ in range(2))
    for r in learned:
        for w in r["text"].split():
            words[r["lang"]][w] = words[r["lang"]].get(w, 0) + 1
            for k in range(1, 5):
                for i in range(len(w) + 3 - k):
                    g = f"^{w}$"[i : i + k]
                    grams[r["lang"]][g] = grams[r["lang"]].get(g, 0) + 1

    def logs(table, x):
        size = len({w for t in table.values() for w in t})
        return np.array([np.log((table[y].get(x, 0) + 0.5) / (sum(table[y].values()) + 0.5 * size)) for y in langs])

    def word(w):
        if any(w in t for t in words.values()):
            return logs(words, w)
        for k in range(4, 0, -1):
            known = [g for i in range(len(w) + 3 - k) if any((g := f"^{w}$"[i : i + k]) in t for t in grams.values())]
            if known:
                return np.mean([logs(grams, g) for g in known], 0)
        return np.zeros(len(langs))

    prior = np.log([sum(r["lang"] == x for r in learned) for x in langs])
    for r in langid.language_table(tongues).collect():
        text = rows[r["doc_id"]]["text"].split()
        scores = sum(map(word, text)) + prior
        p = np.exp((scores - scores.max()) / np.sqrt(len(text)))
        assert r["lang_pred"] == langs[int(scores.argmax())] and r["score"] == pytest.approx(p.max() / p.sum(), rel=1e-4)


def test_numerals_are_no_language(spark, tongues):
    odd = spark.createDataFrame([(1000, "½ ² ① Ⅷ 42", "aa"), (1001, "", None), (1002, None, "aa")], "doc_id long, text string, lang string")
    got = langid.language_table(tongues.unionByName(odd)).filter("doc_id >= 1000").collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)} and len(got) == 3


def test_language_edges(edge, nothing, tongues):
    rows = langid.language_table(edge).collect()
    assert len(rows) == edge.count()
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in (1, 2, 3) or r["doc_id"] is None and r["score"] == 0) for r in rows)
    assert langid.language_table(nothing).count() == 0
    assert langid.predicted(edge, langid.LanguageModel([], [], {})).filter("lang_pred <> 'und'").count() == 0


def brute(rows, threshold=0.98):
    ok = [r[1] is not None and r[2] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    up, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.float32(rows[k][1]).astype(float) for k in (i, j))
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    up[find(i)] = find(j)
    groups: dict = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    least = [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(rows))]
    return [(r[0], n, c, r[0] == c) for r, n, c in zip(rows, links, least)]


@pytest.mark.parametrize("leaf", [8, 512])
def test_embedding_links_equal_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(embed_dedup, "LEAF", leaf)
    monkeypatch.setattr(embed_dedup, "ASSIGN", 2 * leaf)
    rng = np.random.default_rng(1)
    rows = []
    for i in range(200):
        near = np.random.default_rng(rng.integers(0, 20)).normal(size=8) + rng.normal(size=8) * rng.choice([0, 0.02, 0.1, 0.5])
        rows.append((i if i % 50 else None, [float(np.float32(x)) for x in near], int(rng.integers(0, 3)) if i % 37 else None))
    rows += [(1000, None, 1), (1001, [0.0] * 8, 1), (1002, [float("nan")] * 8, 1), (1003, [None] + [1.0] * 7, 1), (1004, [1.0, 2.0], 1), (1005, [2.0, 4.0], 1), (1005, [2.0, 4.0], 1), (1006, [], 1), (1007, [float("inf"), 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n", F.lit("clash")).withColumn("node", F.lit(1))
    got = [tuple(r) for r in embed_dedup.embedding_table(df).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


@pytest.mark.parametrize("kind", ["spread", "clustered"])
def test_trees_leave_few_vectors_to_compare(kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1200, 64))
    if kind == "clustered":
        x = x[rng.integers(0, 40, 1200)] + rng.normal(size=(1200, 64)) * 0.1
    u = embed_dedup.units(x)
    reach = np.sqrt(0.04) + embed_dedup.SLACK
    tree = embed_dedup.block_tree(u, reach / 2)
    for k, (above, home) in enumerate(zip(tree, tree[1:])):
        assert set(above) <= set(home) and (above[home] == above).all()
        assert np.linalg.norm(u - u[home], axis=1).max() <= max(2.0 / 2 ** (k + 1), reach / 2) + embed_dedup.COARSE
    linked, visited, compared = embed_dedup.dual_links(u, tree, u, tree, 0.98, reach)
    assert (linked == (u @ u.T >= 0.98)).all()
    assert compared < 0.05 * len(u) ** 2 and visited < 3 * len(u) ** 2


def test_no_embeddings(spark):
    assert embed_dedup.embedding_table(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_cover_tree_levels_are_nested_and_cover():
    x = embed_dedup.units(np.random.default_rng(7).normal(size=(120, 3)))
    chosen, paths = embed_dedup.cover_tree(x, 40)
    assert len(chosen) == len(set(chosen)) == 40
    for level in range(1, len(paths[0])):
        radius = 2.0 / 2**level
        for k, p in enumerate(paths):
            assert np.linalg.norm(x[chosen[p[level]]] - x[chosen[p[level - 1]]]) <= 2 * radius + 1e-9
            if level == len(p) - 1:
                assert p[level] == k


def test_trusted_ids_meet_texts_not_tokens(spark):
    """Tokens are several times as large as their text, so they are made after the shuffle; the join is one for all sizes."""
    docs = spark.createDataFrame([(1, "a good text"), (2, "bad"), (None, "a"), (1, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    counts = quality.cell_counts(docs, labels)
    plan = counts._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "Broadcast" not in plan
    assert "_q_tokens" in plan and "_q_tokens" not in plan[plan.index("ShuffledHashJoin") :]
    rows = counts.collect()
    assert (sum(r["n"] for r in rows), sum(r["good"] for r in rows)) == (7, 5)
