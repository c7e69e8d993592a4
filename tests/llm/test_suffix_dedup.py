import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import edge_texts, frame, prose, rows
from triloom.llm import suffix_dedup


def brute(texts: list, length: int) -> list:
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def mixed(seed: int) -> list:
    """Texts made of a few blocks, so that repeats begin and end everywhere."""
    rng = random.Random(seed)
    blocks = [prose(60, i) for i in range(5)] + ["ab" * 150, "=" * 260, "é" * 130]
    out = []
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(1, 4)):
            b = rng.choice(blocks)
            a = rng.randrange(len(b))
            parts.append(b[a : a + rng.randint(50, 400)])
            if rng.random() < 0.5:
                parts.append(prose(rng.randint(1, 20), rng.random()))
        out.append("".join(parts))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    texts = edge_texts() + mixed(seed)
    out = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.repeats(frame(spark, rows(texts))).collect()}
    assert [out[i] for i in range(len(texts))] == brute(texts, 200)


def test_repeated_rows_and_empty_table(spark):
    data = rows([prose(100, 1), "short"])
    out = suffix_dedup.repeats(frame(spark, data + data)).collect()
    assert all(r["n_removed"] == (r["n_bytes"] if r["doc_id"] == 0 else 0) for r in out) and len(out) == 4
    assert suffix_dedup.repeats(frame(spark, [])).count() == 0


def test_remove_repeats_keeps_columns(spark):
    texts = [None, "own " + prose(20, 3), "A" + prose(90, 4), "B" + prose(90, 4)]
    df = frame(spark, rows(texts))
    out = suffix_dedup.remove_repeats(df)
    assert out.columns == df.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[0] is None and got[1] == texts[1] and got[2] == "A" and got[3] == "B"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=6), st.integers(8, 14))
def test_order_and_repeats_of_a_shard(pieces, length):
    raw = [p.encode() for p in pieces]
    data = np.frombuffer(b"".join(raw), np.uint8)
    size = np.array([len(b) for b in raw])
    start = np.cumsum(size) - size
    ends = np.repeat(start + size, size)
    places = np.array([s + i for s, n in zip(start, size, strict=True) for i in range(n - length + 1)], np.int64)
    if not len(places):
        return
    tails = [data[p : ends[p]].tobytes() for p in places]
    order = suffix_dedup.text_order(data, ends, places, 200, modulus=4)
    assert [tails[i] for i in order] == sorted(tails)
    seen = Counter(t[:length] for t in tails)
    assert suffix_dedup.repeated(data, ends, places, length).tolist() == [seen[t[:length]] > 1 for t in tails]
