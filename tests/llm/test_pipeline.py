"""The pipeline against its stages done by hand on a small corpus."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import pieces, quality, secret_scan
from millrace.llm.queries import piece_model

from .test_rows import aims
from .test_simhash import brute


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    rng = np.random.default_rng(9)
    words = [f"{a}{b}" for a in ("tor", "mel", "vin", "sak") for b in ("an", "el", "os", "ut", "ig", "ra", "mo")]
    rows = []
    for i in range(120):
        w = rng.choice(words, 70).tolist()
        if i % 10 == 3:
            w[5] = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
        if i % 8 == 7:
            w = [f"{x}$$$" for x in w]
        text = " ".join(w) if i % 6 != 4 else rows[i - 4][1]
        rows.append((i, text if i != 50 else None, "en", "abc"[int(rng.integers(0, 3))], len(text)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 8 != 7), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_pipeline_equals_its_stages_by_hand(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = {r["doc_id"] for r in quality.quality_table(docs, labels).filter("kept").collect()}
    rows = {r["doc_id"]: r for r in docs.collect() if r["doc_id"] in good}
    assert not {i for i in good if i % 8 == 7} and len(good) > 80
    first = {i for i, _, c in brute([(i, r["text"]) for i, r in rows.items()]) if i == c}
    assert len(first) < len(good)
    texts = {i: secret_scan.redact(rows[i]["text"], secret_scan.scan(rows[i]["text"])) for i in first}
    assert any("[SECRET]" in t for t in texts.values())

    out = corpus_pipeline.run(spark, sf_dir)
    got = out.collect()
    one, _ = pieces.codec(piece_model())
    taken: dict = {}
    for r in got:
        assert one.decode(r["ids"]) == texts[r["doc_id"]] and r["n_tokens"] == len(r["ids"])
        s = rows[r["doc_id"]]["source"]
        taken[s] = taken.get(s, 0) + len(texts[r["doc_id"]].split())
    sizes: dict = {}
    for i, t in texts.items():
        sizes[rows[i]["source"]] = sizes.get(rows[i]["source"], 0) + len(t.split())
    assert {s: taken[s] for s in sizes} == pytest.approx(aims(sizes), abs=80)


def test_stages_keep_the_columns_of_documents(spark, sf_dir, edge, nothing):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, edge, sf_dir).schema.simpleString() == edge.schema.simpleString()
        assert stage(spark, nothing, sf_dir).count() == 0
        assert stage(spark, docs, sf_dir).columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, edge.select("*", F.lit(1).alias("ids")), sf_dir).count() == edge.count()
