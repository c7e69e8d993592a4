import random

import numpy as np
import pytest

from tests.llm.helpers import edge_texts, frame, prose, rows, shingles, similar
from triloom.llm import jaccard_join
from triloom.llm.components import components


def corpus(seed: int, n: int) -> list:
    """Clusters of copies with random edits, so that many pairs lie near the threshold."""
    rng, out = random.Random(seed), []
    while len(out) < n:
        base = prose(rng.choice([3, 8, 15, 40, 120]), rng.random()).split(" ")
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.randint(0, 1 + len(w) // 40)):
                i = rng.randrange(len(w))
                w[i : i + rng.randint(0, 2)] = [rng.choice(["new", "other", "w" + str(rng.random())])]
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80)])
def test_against_brute_force(spark, k, num, monkeypatch):
    texts = edge_texts() + corpus(k, 120)
    for crowd, sets in ((32, 4096), (3, 4)):  # the second forces crowded regions and distributed rounds
        monkeypatch.setattr(jaccard_join, "CROWD", crowd)
        monkeypatch.setattr(jaccard_join, "SETS", sets)
        out = {r["doc_id"]: r for r in jaccard_join.similar_documents(frame(spark, rows(texts)), k, num, 100).collect()}
        want = similar(dict(enumerate(texts)), k, num, 100)
        assert {i: r["component_id"] for i, r in out.items()} == want
        assert {i: r["n_links"] for i, r in out.items()} == links(texts, k, num)
        assert {i: r["n_shingles"] for i, r in out.items()} == {i: len(shingles(t, k)) for i, t in enumerate(texts)}


def links(texts: list, k: int, num: int) -> dict:
    sets = [shingles(t, k) for t in texts]
    return {i: sum(j != i and bool(x) and bool(y) and 100 * len(x & y) >= num * len(x | y) for j, y in enumerate(sets)) for i, x in enumerate(sets)}


def test_least_shingles_find_what_buckets_cannot_prove(spark, monkeypatch):
    texts = corpus(9, 60)
    keys = jaccard_join.Grids.keys

    def without_buckets(self, s):
        return [x for x in keys(self, s)[0] if x[0] == self.TINY], self.differ(len(s)) > 0

    monkeypatch.setattr(jaccard_join.Grids, "keys", without_buckets)
    out = jaccard_join.similar_documents(frame(spark, rows(texts)), 4, 85, 100).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == similar(dict(enumerate(texts)), 4, 85, 100)
    assert {r["doc_id"]: r["n_links"] for r in out} == links(texts, 4, 85)


def test_cells_blocks_and_counts(spark, monkeypatch):
    """Dense groups and groups of a common passage, as one unit: divided by pivots and blocks, with and without counting."""
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(9):
        base = rng.integers(0, 1 << 62, 60, dtype=np.uint64)
        sets += [np.unique(np.concatenate([base[rng.random(60) > 0.06], rng.integers(0, 1 << 62, 2, dtype=np.uint64)])) for _ in range(12)]
    shared = rng.integers(0, 1 << 62, 30, dtype=np.uint64)
    sets += [np.concatenate([shared, rng.integers(0, 1 << 62, 30, dtype=np.uint64)]) for _ in range(30)]
    n = len(sets)
    weight = rng.integers(1, 4, n)
    near = np.array([[i != j and 100 * len(np.intersect1d(x, y)) >= 85 * len(np.union1d(x, y)) for j, y in enumerate(sets)] for i, x in enumerate(sets)])
    data = [(7, i, bytearray(np.sort(x).tobytes()), int(weight[i]), True, 0, None) for i, x in enumerate(sets)]
    cells = spark.createDataFrame(data, jaccard_join._SETS)
    groups = {r["node"]: r["label"] for r in components(spark.createDataFrame([(int(i), int(j)) for i, j in zip(*near.nonzero(), strict=True)], "a long, b long")).collect()}
    for most in (1000, 20, 5):
        monkeypatch.setattr(jaccard_join, "SETS", most)
        for counting in (True, False):
            found = jaccard_join.join_units(cells, 85, 100, counting).cache()
            got = {r["node"]: r["label"] for r in components(found, "k", "head").collect()}
            assert got == groups
            if counting:
                count = {r[0]: r[1] for r in found.groupBy("k").agg({"links": "sum"}).collect()}
                assert [count[i] for i in range(n)] == (near * weight).sum(1).tolist()


def test_sets_on_disk_and_shuffles_of_texts_are_bounded(spark, monkeypatch):
    """Where all documents are candidates, their sets are never all on disk; the rest is one shuffle of the texts."""
    import os

    texts = {}
    for i in range(120):  # near copies, and a group whose members have half of their words in common
        texts[i], texts[1000 + i] = prose(120, i), prose(120, i) + " more"
        texts[2000 + i] = prose(60, 5000) + " " + prose(25, 6000 + i)
    want = similar(texts, 5, 80, 100)
    monkeypatch.setattr(jaccard_join, "SETS", 24)
    monkeypatch.setattr(jaccard_join, "ROOM", 1 << 10, raising=False)
    folders, live, inner = [], [], jaccard_join.materialize

    def watched(df):
        out = inner(df)
        if "set" in out.columns:
            folders.extend({f.rsplit("/", 1)[0].removeprefix("file://") for f in out.inputFiles()})
            live.append(sum(os.path.getsize(f"{x}/{f}") for x in set(folders) if os.path.isdir(x) for f in os.listdir(x)))
        return out

    monkeypatch.setattr(jaccard_join, "materialize", watched)
    docs = frame(spark, [(i, t, "en", "s", 1, 1, "x", "y") for i, t in texts.items()]).repartition(2)
    kept = jaccard_join.keep_one(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    every = 8 * sum(len(shingles(t, 5)) for t in texts.values())
    assert live and max(live) < every and not any(os.path.isdir(x) for x in folders)
    # of all shuffles of the final plan, those that carry whole rows
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange" in line and "hashpartitioning(p#" in line for line in plan.splitlines()) <= 2 and "hashpartitioning(doc_id#" not in plan


def test_keep_one_keeps_columns_and_one_of_each(spark):
    texts = edge_texts()
    data = rows(texts) + rows(texts)[3:4]  # a repeated row
    out = jaccard_join.keep_one(frame(spark, data), 5, 80, 100)
    assert out.columns == frame(spark, data).columns
    kept = sorted(r["doc_id"] for r in out.collect())
    want = similar(dict(enumerate(texts)), 5, 80, 100)
    assert kept == sorted(set(want.values()))
    assert jaccard_join.keep_one(frame(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in list(root)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one_with_null_ids_and_an_id_with_two_texts(spark):
    a, b, c, d, e = (prose(40, 900 + i) for i in range(5))
    ids = [(None, a), (None, a), (None, b), (None, ""), (None, None), (5, c), (6, c), (6, d), (7, e), (None, e), (8, ""), (8, "")]
    data = [(i, *r[1:]) for (i, t), r in zip(ids, rows([t for _, t in ids]), strict=True)]
    got = [(r["doc_id"], r["text"]) for r in jaccard_join.keep_one(frame(spark, data)).collect()]
    want = [(None, a), (None, b), (None, ""), (None, None), (5, c), (6, d), (7, e), (8, "")]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_keep_one_keeps_rows_without_words_and_id(spark):
    text = " ".join(f"w{i}" for i in range(40))
    data = [(1, text, "a"), (2, text, "a"), (None, "", "a"), (None, "", "a"), (None, " \t", "b"), (3, None, "b"), (1, text, "a")]
    out = jaccard_join.keep_one(spark.createDataFrame(data, "doc_id long, text string, source string"))
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(str(x) for x in [data[0], *data[2:6]])
