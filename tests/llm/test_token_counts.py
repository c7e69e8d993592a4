from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import edge_texts, frame, rows
from triloom.llm import token_counts

PARTS = st.sampled_from([" ", "  ", "a", "bc", "'s", "'", "re", "'re", "12", "\n", "\t", ".", "!?", "é", "漢", "👍", "'ll", " x"])
TEXTS = st.lists(PARTS, max_size=150).map("".join)


@settings(max_examples=120, deadline=None)
@given(TEXTS, st.lists(st.tuples(st.integers(-3, 200), st.integers(-3, 60), st.lists(PARTS, max_size=40).map("".join)), max_size=5))
def test_edits_against_counting_again(text, edits):
    c = token_counts.counter()
    tree = token_counts.Tree(text, c)
    for start, n, new in edits:
        tree.edit(start, start + n, new)
        a = max(0, min(start, len(text)))
        b = max(a, min(start + n, len(text)))
        text = text[:a] + new + text[b:]
        pieces = c.split(text)
        assert tree.text() == text
        assert (tree.chars[1], tree.pre[1], tree.sums[1]) == (len(text), len(pieces), len(c._encode(text)))


def test_only_the_region_is_encoded_again():
    c = token_counts.counter()
    tree = token_counts.Tree("some words here " * 2000, c)
    tree.encoded = 0
    tree.edit(16_000, 16_004, "other")
    assert 0 < tree.encoded < 1000


def test_table(spark):
    texts = edge_texts()
    df = frame(spark, rows(texts))
    c = token_counts.counter()
    out = {r["doc_id"]: r for r in token_counts.counts(df, token_counts.sample_edits()).collect()}
    for i, t in enumerate(texts):
        assert out[i]["n_tokens"] == len(c._encode(t or "")) and out[i]["n_chars"] == len(t or "")
        x = t or ""
        n = len(x)
        for a, b, new in ((n // 4, n // 4, "Don't  split 123abc"), (n // 2, n // 2 + 7, ""), (3 * n // 4, 3 * n // 4 + 3, "\n\n  é")):
            a, b = min(a, len(x)), min(b, len(x))
            x = x[:a] + new + x[b:]
        assert out[i]["n_tokens_edited"] == len(c._encode(x)), t
    assert token_counts.counts(frame(spark, [])).count() == 0


def test_edits_from_a_table(spark):
    df = frame(spark, rows(["hello world", "untouched"]))
    edits = spark.createDataFrame([(0, 5, 5, " big", 2), (0, 0, 5, "goodbye cruel", 1), (0, None, None, None, 3)], "doc_id long, start int, end int, text string, seq int")
    out = {r["doc_id"]: r for r in token_counts.counts(df, edits).collect()}
    assert out[0]["n_edits"] == 3 and out[0]["n_chars_edited"] == len("goodb bigye cruel world") and out[1]["n_edits"] == 0
