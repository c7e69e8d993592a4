import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import edge_texts, frame, prose, rows
from triloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+".replace(r"[\x20-]", "[ -]"))
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(x):
    return re.sub("[^0-9]", "", x)


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "@", ".", "-", "b.c", "x@y.z", "1", "12", "255", "256", ".", " ", "+", "+1 (555) 123-4567", "4111111111111111", "4111 1111 1111 1111", "(", ")", "%", "é", "٣", "0", "00001"]), max_size=30).map("".join))
def test_base_spans(text):
    assert pii.base_spans(text) == brute(text)


@pytest.mark.parametrize("text", ["1" * 200_000, "a" * 200_000 + "@", "a@" * 50_000, "1." * 50_000, "1 " * 50_000, "+1(" * 50_000])
def test_long_texts_take_linear_time(text):
    pii.base_spans(text)


def corpus():
    common = prose(40, 1)
    texts = edge_texts() + [f"{common} secretproject Zanzibar77 contact bob@corp.example.com please {prose(30, 10 + i)}" for i in range(4)]
    texts += [f"{prose(30, 50 + i)} please contact {common}" for i in range(40)]
    return [*texts, "call +1 (555) 123-4567 or 10.0.0.1 é 4111 1111 1111 1111"]


def test_report(spark):
    texts = corpus()
    out = {r["doc_id"]: r for r in pii.report(frame(spark, rows(texts) + rows(texts)[1:3])).collect()}
    for i, t in enumerate(texts):
        want = brute(t or "")
        told = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        r = out[i]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == j for _, k, _ in want) for j in range(4)]
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert set(told.split(",")) <= set(r["spans"].split(","))
        if not want:
            assert r["spans"] == ""
    i = next(i for i, t in enumerate(texts) if t and "bob@" in t)
    hidden = {texts[i][int(a) : int(b)] for k, a, b in (x.split(":") for x in out[i]["spans"].split(",")) if k in ("removed", "generalised")}
    assert {"secretproject", "Zanzibar77"} <= hidden and not hidden & {"please", "contact"}
    assert pii.report(frame(spark, [])).count() == 0


def test_disclosure_against_counting(spark):
    texts = corpus()
    import math
    from collections import Counter

    from tests.llm.helpers import LOWER, WORD

    total, near, size = Counter(), Counter(), Counter()
    for t in texts:
        t = t or ""
        words = [(m.start(), m.end(), m[0].translate(LOWER)) for m in WORD.finditer(t)]
        total.update(w for _, _, w in words)
        spans = brute(t)
        covered = {i for i, (a, b, _) in enumerate(words) if any(a < y and b > x for x, _, y in spans)}
        by = {}
        for x, k, y in spans:
            inside = [i for i, (a, b, _) in enumerate(words) if a < y and b > x]
            lo, hi = inside[0], inside[-1] + 1
            by.setdefault((k, t[x:y].lower()), set()).update([*range(max(0, lo - pii.WINDOW), lo), *range(hi, min(len(words), hi + pii.WINDOW))])
        for e, idx in by.items():
            for i in idx - covered:
                near[e, words[i][2]] += 1
                size[e] += 1
    n = sum(total.values())
    told = {(e, w) for (e, w), c in near.items() if 1 + math.log((c - pii.DISCOUNT) / total[w]) / math.log(n / size[e]) >= pii.GENERALISE}
    found = set()
    for r in pii.report(frame(spark, rows(texts))).collect():
        t = texts[r["doc_id"]] or ""
        found |= {t[int(a) : int(b)].translate(LOWER) for k, a, b in (x.split(":") for x in r["spans"].split(",") if x) if k in ("removed", "generalised")}
    assert found == {w for _, w in told}


def test_sanitise(spark):
    texts = corpus()
    df = frame(spark, rows(texts))
    out = pii.sanitise(df)
    assert out.columns == df.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[0] is None and len(got) == len(texts)
    assert got[len(texts) - 1].endswith("<phone> or <ip> é <card>")
    i = next(i for i, t in enumerate(texts) if t and "bob@" in t)
    assert "<email>" in got[i] and "secretproject" not in got[i] and "please" in got[i]
    assert all(got[i] == t for i, t in enumerate(texts) if t and not brute(t))
