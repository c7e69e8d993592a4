import hashlib
import re

import duckdb
import pytest

from tests.llm.helpers import edge_texts, frame, prose, rows
from triloom.llm import mixing


def fill(sizes: dict) -> dict:
    """Targets by sharing again and again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 2 * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize("seed", [0, 1])
def test_report(spark, seed):
    texts = edge_texts() + [prose(10 + i % 50, i) for i in range(300)]
    names = [[None, "a", "b", "é", "Z", "hot", "hot", "hot"][(i * (seed + 3)) % 8] for i in range(len(texts))]
    data = rows(texts, names)
    got = {r["doc_id"]: r for r in mixing.mix_report(frame(spark, data)).collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
    totals = {}
    for i, s in enumerate(names):
        totals[s] = totals.get(s, 0) + size[i]
    want = fill(totals)
    for i, s in enumerate(names):
        r = got[i]
        assert (r["size"], r["source_size"]) == (size[i], totals[s]) and abs(r["target"] - want[s]) < 1e-6
        rate = min(2.0, want[s] / totals[s]) if totals[s] else 1.0
        chance = int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) / 2**52
        assert r["taken"] == size[i] * (int(rate) + (chance < rate - int(rate)))
    mixed = mixing.mix(frame(spark, data))
    assert mixed.columns == frame(spark, data).columns
    by = {}
    for r in mixed.collect():
        by[r["doc_id"]] = by.get(r["doc_id"], 0) + 1
    assert all(by.get(i, 0) * size[i] == got[i]["taken"] for i in got) and max(by.values()) <= 2


def test_sql_agrees(spark):
    data = rows([prose(i % 40, i) for i in range(200)], [f"s{i % 7 if i % 3 else 0}" for i in range(200)])
    con = duckdb.connect()
    con.execute("CREATE TABLE d (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO d VALUES (?, ?, ?)", [(r[0], r[1], r[3]) for r in data])
    want = sorted(con.execute(mixing.SQL.replace("{docs}", "d")).fetchall())
    assert sorted(tuple(r) for r in mixing.mix_report(frame(spark, data)).collect()) == want


def test_empty(spark):
    assert mixing.mix_report(frame(spark, [])).count() == 0 and mixing.mix(frame(spark, [])).count() == 0
    one = mixing.mix_report(frame(spark, rows([None, ""]))).collect()
    assert [(r["size"], r["taken"], r["target"]) for r in one] == [(0, 0, 0.0)] * 2
