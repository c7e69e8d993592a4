"""Small document tables with all the edge cases, and brute-force versions to hold operators against."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, _mix_size string, score string"


def rows(texts, sources=None):
    """Rows of documents with extra columns whose names clash with those that operators make."""
    return [(i, t, "en", (sources[i] if sources else f"s{i % 3}"), None if t is None else len(t), 7, "x", "y") for i, t in enumerate(texts)]


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdeéfghilmnorstu") for _ in range(rng.randint(1, 8))) for _ in range(n))


def edge_texts() -> list:
    """Null, empty, blank, short, repeated and long texts; near copies and shared passages."""
    base = prose(300, 1).split(" ")
    near = [" ".join(base[: 20 * i] + ["CHANGED"] + base[20 * i + 1 :]) for i in range(1, 6)]
    far = [" ".join(w if j % 9 else w + "x" for j, w in enumerate(base))]
    passage = prose(80, 2)
    return [None, "", "   \n\t ", "word", "two words", "two words", "Four words are here", *[" ".join(base)] * 3, *near, *far, passage, prose(40, 3) + " " + passage + " " + prose(30, 4), passage + prose(10, 5), "a" * 700, "a" * 450, prose(4000, 6), "漢字 " * 100, "x" + "▁ y z", "\x1c\x1d odd \x85 spaces"]


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def similar(texts: dict, k: int, num: int, den: int) -> dict:
    """The smallest id reachable by links, for each id."""
    sets = {i: shingles(t, k) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and den * len(sets[x] & sets[y]) >= num * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
