import random
import zlib

import numpy as np

from tests.llm.helpers import edge_texts, frame, prose, rows
from triloom.llm import quality_cnn


def corpus():
    rng = random.Random(1)
    good = [prose(rng.randint(20, 300), i) for i in range(150)]
    bad = [" ".join(w.upper() + "!!" for w in prose(rng.randint(20, 300), 1000 + i).split()) for i in range(100)]
    return good + bad + edge_texts(), [1] * 150 + [0] * 100


def test_held_out_accuracy(spark):
    texts, quality = corpus()
    docs = frame(spark, rows(texts))
    labels = spark.createDataFrame([(i, q, 0) for i, q in enumerate(quality)] + [(3, None, 0), (None, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    net = quality_cnn.fit(docs, labels)
    got = {r["doc_id"]: r for r in quality_cnn.score(docs, net).collect()}
    assert len(got) == len(texts) and all(0 <= r["score"] <= 1 for r in got.values())
    held = [i for i in range(len(quality)) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert [got[i]["held_out"] for i in held] == [True] * len(held)
    assert np.mean([got[i]["predicted"] == quality[i] for i in held]) > 0.95
    assert got[250]["score"] == got[251]["score"]  # null and empty
    assert got[257]["score"] == got[258]["score"] == got[259]["score"]  # equal texts
    kept = quality_cnn.keep_good(docs, net)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"]}


def test_no_labels_and_empty(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = frame(spark, rows(["a text", None]))
    net = quality_cnn.fit(docs, none)
    assert net is None and [r["score"] for r in quality_cnn.score(docs, net).collect()] == [0.5, 0.5]
    assert quality_cnn.score(frame(spark, []), net).count() == 0


def test_batching_and_pieces_do_not_matter():
    rng = np.random.default_rng(0)
    dims = 2 * quality_cnn.BLOCK * quality_cnn._VECTORS.shape[1]
    net = quality_cnn.Network(rng.normal(0, 0.1, (dims, 8)).astype(np.float32), rng.normal(0, 0.1, 8).astype(np.float32), rng.normal(0, 1, 16), 0.1)
    texts = [prose(n, n).encode() for n in (0, 1, 50, 400, 2000)] + [b"x" * 504, b"x" * 505, b"x" * 512]
    whole = net.scores(texts)
    assert np.allclose(whole, [net.scores([t])[0] for t in texts], atol=1e-5)
    assert np.allclose(whole, net.scores(texts, piece=128), atol=1e-5)


def test_whole_document_counts():
    rng = np.random.default_rng(0)
    dims = 2 * quality_cnn.BLOCK * quality_cnn._VECTORS.shape[1]
    net = quality_cnn.Network(rng.normal(0, 0.3, (dims, 8)).astype(np.float32), np.zeros(8, np.float32), np.ones(16), 0.0)
    a = b"plain text " * 2000
    assert net.scores([a])[0] != net.scores([a + b"THE END!!!!!!!!!!!"])[0]


def test_training_sees_whole_texts(spark, monkeypatch):
    texts = [prose(4000, 1), prose(30, 2), "", "x" * 504]
    seen = {}
    monkeypatch.setattr(quality_cnn, "train", lambda chunks, of, label: seen.update(chunks=chunks, of=of))
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5][:4]
    docs = frame(spark, [(i, *r[1:]) for i, r in zip(ids, rows(texts), strict=True)])
    quality_cnn.fit(docs, spark.createDataFrame([(i, 1) for i in ids], "doc_id long, quality int"))
    for k, t in enumerate(texts):
        own = seen["chunks"][seen["of"] == k]
        raw = t.encode()
        assert len(own) == (len(raw) + 8) // 512 + 1  # as many as scoring pools over
        assert own[:, :-1].tobytes().rstrip(b"\0") == raw
