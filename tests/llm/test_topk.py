import numpy as np
import pytest

from triloom.llm import topk


def brute(rows, k):
    out = []
    for q, own in {(i, tuple(v)) for i, v in rows if i % 50 == 0}:
        v = np.floor(256 * np.array(own, np.float64)).astype(np.int64)
        found = []
        for i, other in rows:
            if i != q:
                w = np.floor(256 * np.array(other, np.float64)).astype(np.int64)
                n = min(len(v), len(w))
                found.append((-int(v[:n] @ w[:n]), i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard", [8192, 70])
def test_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "GROUP", 3 if shard == 70 else 4096)
    rng = np.random.default_rng(2)
    vectors = {i: rng.normal(0, 0.2, 8).astype(np.float32).astype(float).tolist() for i in range(400)}
    for i in range(100, 160):
        vectors[i] = vectors[100]  # many ties
    vectors[7] = vectors[7][:5]
    vectors[8] = []
    rows = [(i, v) for i, v in vectors.items()] + [(1000, None), (1050, [None] * 8), (1100, [float("nan")] * 8), (1150, [float("inf")] * 8), (None, [0.1] * 8)]
    again = [(0, vectors[0]), (1, vectors[1]), (50, vectors[3]), (51, vectors[50])]  # a repeated row, and ids with two vectors
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + again], "vec_id long, embedding array<double>, score string")
    got = sorted(tuple(r) for r in topk.search(df).collect())
    assert got == brute([*vectors.items(), *again], 5)


def test_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.search(spark.createDataFrame([], schema)).count() == 0
    assert topk.search(spark.createDataFrame([(0, [0.5])], schema)).count() == 0
    got = topk.search(spark.createDataFrame([(0, [0.5]), (1, [-0.5])], schema)).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, -128 * 128)]


def test_large_values_stay_exact():
    a = np.array([[3_000_000_001, 1]])
    assert topk._dot(a, a).tolist() == [[3_000_000_001**2 + 1]]
