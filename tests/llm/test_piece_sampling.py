import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import edge_texts, frame, rows
from triloom.llm import piece_sampling


@pytest.fixture(scope="module")
def pieces():
    return piece_sampling.pieces()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=5))
def test_decoding_is_lossless(texts):
    p = piece_sampling.pieces()
    ids, cuts = piece_sampling.sample(texts, piece_sampling.row_keys(list(range(len(texts)))), p)
    assert [p.decode(ids[a:b].tolist()).decode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)] == texts


def test_batches_do_not_matter(pieces):
    texts = ["one text here", "another  one\n", "one text here"]
    keys = piece_sampling.row_keys([1, 2, 1])
    ids, cuts = piece_sampling.sample(texts, keys, pieces, 7)
    assert ids[cuts[0] : cuts[1]].tolist() == ids[cuts[2] : cuts[3]].tolist()
    for i, t in enumerate(texts):
        assert piece_sampling.sample([t], keys[i : i + 1], pieces, 7)[0].tolist() == ids[cuts[i] : cuts[i + 1]].tolist()
    assert piece_sampling.sample(texts * 30, np.arange(90, dtype=np.uint64), pieces, 8)[0].tolist() != piece_sampling.sample(texts * 30, np.arange(90, dtype=np.uint64), pieces, 9)[0].tolist()


def test_distribution_against_all_segmentations(pieces):
    weight = {pieces.bytes_of[i]: w for i, w in zip(pieces.ids.tolist(), pieces.weights.tolist(), strict=True)}

    def ways(text):
        if not text:
            yield (), 0.0
        for n in range(1, len(text) + 1):
            if (b := text[:n].encode()) in weight:
                for rest, w in ways(text[n:]):
                    yield (b, *rest), w + weight[b]

    every = dict(ways(" there"))
    norm = sum(np.exp(w) for w in every.values())
    n = 20_000
    ids, cuts = piece_sampling.sample(["there"] * n, piece_sampling.row_keys(list(range(n))), pieces)
    seen = Counter(tuple(pieces.bytes_of[i] for i in ids[cuts[j] : cuts[j + 1]]) for j in range(n))
    assert set(seen) <= set(every)
    for way, w in every.items():
        p = np.exp(w) / norm
        assert abs(seen[way] / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-4


def test_table(spark):
    texts = edge_texts()
    df = frame(spark, rows(texts) + rows(texts)[3:5])
    encoded = piece_sampling.encode(df)
    out = {r["doc_id"]: r for r in encoded.collect()}
    for i, t in enumerate(texts):
        assert out[i]["lossless"] and out[i]["n_pieces"] == len(out[i]["pieces"]) and out[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert out[0]["pieces"] == [] and out[1]["pieces"] == []
    back = {r["doc_id"]: r["text"] for r in piece_sampling.decode(encoded).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    assert piece_sampling.encode(frame(spark, [])).count() == 0
