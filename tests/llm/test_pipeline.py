"""Each stage of the pipeline on its own input, held against brute force or against its operator's promise."""

import hashlib

import pytest

import corpus_pipeline
from tests.llm.helpers import edge_texts, frame, prose, rows, similar
from triloom.llm import pii

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    good = [prose(30 + i, i) for i in range(80)]
    bad = [" ".join(w.upper() + "!!" for w in prose(60, 500 + i).split()) for i in range(40)]
    texts = edge_texts() + good + bad + [good[3], good[4] + " more", "mail me at ann@mail.example.org now " + good[5]]
    docs = frame(spark, rows(texts)).select(*COLUMNS)
    docs.coalesce(2).write.parquet(str(path / "documents.parquet"))
    n = len(edge_texts())
    labels = [(n + i, int(i < 80), 0) for i in range(120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    n = len(edge_texts())
    one = steps["quality classifier"](spark, docs, folder)
    assert one.columns == COLUMNS
    kept = {r["doc_id"] for r in one.collect()}
    assert len(kept & set(range(n, n + 80))) >= 78 and len(kept & set(range(n + 80, n + 120))) <= 2
    two = steps["n-gram Jaccard join"](spark, docs, folder)
    assert two.columns == COLUMNS and sorted(r["doc_id"] for r in two.collect()) == sorted(set(similar(texts, 5, 80, 100).values()))
    three = steps["PII"](spark, docs, folder)
    assert three.columns == COLUMNS and three.dtypes == docs.dtypes
    for r in three.collect():
        old = texts[r["doc_id"]]
        assert (r["text"] is None) == (old is None) and (r["text"] == old or pii.base_spans(old))
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"])) and not pii.base_spans(r["text"] or "")
    four = steps["mixing sources to target weights"](spark, docs, folder)
    assert four.columns == COLUMNS and set(r["text"] for r in four.collect()) <= set(texts.values())
    five = steps["SentencePiece encoding"](spark, docs, folder)
    assert {r["doc_id"]: r["decoded_sha256"] for r in five.collect()} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in texts.items()}


def test_run_applies_all_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder).collect()
    n = len(edge_texts())
    assert out and all(r["lossless"] for r in out)
    assert not {r["doc_id"] for r in out} & {n + 120}  # a copy of a document with a smaller id
    again = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r["doc_id"], r["decoded_sha256"], tuple(r["pieces"])) for r in out) == sorted((r["doc_id"], r["decoded_sha256"], tuple(r["pieces"])) for r in again)


def test_empty_documents(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
