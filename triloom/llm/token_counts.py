"""Edit-aware token counts: a segment tree over each document's pre-tokens.

The vocabulary's pattern splits a text into pre-tokens, which are encoded one by one. A tree's leaves hold runs
of LEAF pre-tokens; its inner nodes hold sums of characters, pre-tokens and tokens. An edit is located by the
character sums. Splitting starts again at the last leaf border that the edit can't touch (the pattern looks at
most two characters past a match) and goes on until a new border past the edit falls on an old leaf border;
from there on nothing changes. Only those leaves are encoded again and only the sums above them change. A tree with a
leaf that has grown too much is built again from its counts; leaves that have emptied go then, too. ``trees`` keeps
the trees of a table, and ``edited`` brings them up to date with a table of edits.

Null text counts as empty (no tokens); very long texts only make deeper trees; edits out of range are clamped
to the text and a null replacement deletes; edits of a document apply one after the other; repeated rows get
equal rows; an empty table gives an empty result; only the id, the text and the edits are read; bytes that are no UTF-8
count as U+FFFD.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, valid_text, whole_text

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern of that public vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 32
_LOOK = 2  # characters past a match that may decide where it ends
_KEPT = 300_000  # pre-tokens whose counts are kept, about 150 bytes each


class Counter(dict):
    """Tokens of a pre-token, encoded on first sight."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._pattern = regex.compile(pattern)
        self.split = self._pattern.findall

    def __missing__(self, piece: str) -> int:
        if len(self) >= _KEPT:
            self.clear()
        n = self[piece] = len(self._encode(piece))
        return n

    def match(self, text: str, at: int) -> int:
        return self._pattern.match(text, at).end()


@lru_cache(2)
def counter(path: str = VOCABULARY, pattern: str = PATTERN) -> Counter:
    return Counter(path, pattern)


class Tree:
    """Sums over runs of pre-tokens. Node 1 is the root, nodes 2i and 2i + 1 are below node i."""

    def __init__(self, text: str, tokens: Counter):
        self.tokens, self.encoded = tokens, 0
        self._build(self._leaves(text))

    def _leaves(self, text: str) -> list[tuple[str, int, int]]:
        """(text, pre-tokens, tokens) of each run; encodes them."""
        pieces = self.tokens.split(text)
        counts = list(map(self.tokens.__getitem__, pieces))
        self.encoded += len(text)
        return [("".join(pieces[i : i + LEAF]), len(pieces[i : i + LEAF]), sum(counts[i : i + LEAF])) for i in range(0, len(pieces), LEAF)]

    def _build(self, leaves: list[tuple[str, int, int]]) -> None:
        n = self.width = 1 << max(0, len(leaves) - 1).bit_length()
        self.leaf = leaves + [("", 0, 0)] * (n - len(leaves))
        self.chars = [0] * n + [len(x[0]) for x in self.leaf]
        self.pre = [0] * n + [x[1] for x in self.leaf]
        self.sums = [0] * n + [x[2] for x in self.leaf]
        for a in (self.chars, self.pre, self.sums):
            for i in range(n - 1, 0, -1):
                a[i] = a[2 * i] + a[2 * i + 1]

    @classmethod
    def kept(cls, leaves: list[tuple[str, int, int]], tokens: Counter) -> Tree:
        """The tree of kept leaves; encodes nothing."""
        tree = cls.__new__(cls)
        tree.tokens, tree.encoded = tokens, 0
        tree._build(leaves)
        return tree

    def leaves(self) -> list[tuple[str, int, int]]:
        return [x for x in self.leaf if x[0]]

    def text(self) -> str:
        return "".join(x[0] for x in self.leaf)

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character at (the last one if none does) and the characters before it."""
        i = 1
        before = 0
        while i < self.width:
            i *= 2
            if at >= before + self.chars[i] and self.chars[i + 1]:
                before += self.chars[i]
                i += 1
        return i - self.width, before

    def _set(self, k: int, leaf: tuple[str, int, int]) -> None:
        self.leaf[k] = leaf
        i = k + self.width
        self.chars[i], self.pre[i], self.sums[i] = len(leaf[0]), leaf[1], leaf[2]
        while i > 1:
            i //= 2
            for a in (self.chars, self.pre, self.sums):
                a[i] = a[2 * i] + a[2 * i + 1]

    def edit(self, start: int, end: int, new: str) -> None:
        """Put new in place of text[start:end]."""
        start = max(0, min(start, self.chars[1]))
        end = max(start, min(end, self.chars[1]))
        first, before = self._find(max(0, start - _LOOK))
        last, last_before = self._find(max(start, end - 1)) if end > start else self._find(start)
        last = max(last, first)
        old = "".join(x[0] for x in self.leaf[first : last + 1])
        text = old[: start - before] + new + old[end - before :]
        safe = start - before + len(new)  # nothing of the old text stands before this place
        # where the leaves after the edited ones begin, in the new text
        border = len(text)
        at, pieces = 0, []
        nxt = last + 1
        while True:
            while nxt < self.width and not self.leaf[nxt][0]:
                nxt += 1
            # a match near the end may look past it: show it the next leaf
            ahead = text + (self.leaf[nxt][0] if nxt < self.width else "")
            while at < border:
                e = self.tokens.match(ahead, at)
                if e > border:
                    break
                pieces.append(ahead[at:e])
                at = e
            if nxt >= self.width or (at == border and border >= safe and self._steady(nxt, ahead, border)):
                break
            text, border, nxt = ahead, len(ahead), nxt + 1
            if at < border and pieces:  # the last match may have been cut short by what it couldn't see
                at -= len(pieces.pop())
        counts = list(map(self.tokens.__getitem__, pieces))
        self.encoded += sum(map(len, pieces))
        self._set(first, ("".join(pieces), len(pieces), sum(counts)))
        for k in range(first + 1, min(nxt, self.width)):
            if self.leaf[k][0]:
                self._set(k, ("", 0, 0))
        if len(pieces) > 8 * LEAF:
            self._rebuild(first, pieces, counts)

    def _steady(self, nxt: int, ahead: str, border: int) -> bool:
        """Whether the last match was shown enough of what follows: a leaf shorter than the look-ahead hides some."""
        return len(ahead) - border >= _LOOK or not any(x[0] for x in self.leaf[nxt + 1 :])

    def _rebuild(self, k: int, pieces: list[str], counts: list[int]) -> None:
        """Spread a leaf that has grown over several; counts are known, so nothing is encoded."""
        own = [("".join(pieces[i : i + LEAF]), len(pieces[i : i + LEAF]), sum(counts[i : i + LEAF])) for i in range(0, len(pieces), LEAF)]
        self._build([x for x in [*self.leaf[:k], *own, *self.leaf[k + 1 :]] if x[0]])


EDITS = "array<struct<start:int,end:int,text:string>>"


def counts(docs: DataFrame, edits: Column | DataFrame | None = None, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_chars, n_pretokens, n_tokens and, after the edits, their new values and the characters encoded again.

    edits: an expression over docs' columns that gives EDITS, or a table (doc_id, start, end, text, seq) whose rows
    apply in the order of seq (nulls and ties by start, end, text).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = F.lit(None).cast(EDITS)
    if isinstance(edits, DataFrame):
        listed = edits.groupBy(F.col("doc_id").alias("_edit_id")).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("seq", F.lit(0)).alias("seq"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("text").cast("string").alias("text")))).alias("_edits"))
        docs = docs.join(listed, docs["doc_id"].eqNullSafe(listed["_edit_id"]), "left")
        own = F.transform("_edits", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text")))
    elif edits is not None:
        own = edits.cast(EDITS)
    names = ["doc_id", "n_chars", "n_pretokens", "n_tokens", "n_edits", "n_chars_edited", "n_pretokens_edited", "n_tokens_edited", "chars_reencoded"]

    def run(parts):
        tokens = counter(vocabulary, pattern)
        for part in parts:
            rows = []
            for text, todo in zip(part.column(1), part.column(2), strict=True):
                tree = Tree(text.as_py(), tokens)
                row = [tree.chars[1], tree.pre[1], tree.sums[1]]
                todo, tree.encoded = todo.as_py() or [], 0
                for x in todo:
                    if x is not None:
                        tree.edit(x["start"] or 0, x["end"] or 0, x["text"] or "")
                rows.append((*row, len(todo), tree.chars[1], tree.pre[1], tree.sums[1], tree.encoded))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in columns)], names)

    return bounded_batches(docs).select("doc_id", valid_text().alias("text"), own.alias("edits")).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{x} long" for x in names[1:]))


_LEAVES = pa.list_(pa.struct([("text", pa.string()), ("pre", pa.int64()), ("tokens", pa.int64())]))
_TREE = "leaves array<struct<text:string,pre:long,tokens:long>>, n_chars long, n_pretokens long, n_tokens long, chars_encoded long"


def _tree_rows(ids: pa.Array, trees: list[Tree]) -> pa.RecordBatch:
    leaves = pa.array([[dict(zip(("text", "pre", "tokens"), x, strict=True)) for x in t.leaves()] for t in trees], _LEAVES)
    sums = [pa.array([x[1] for x in (getattr(t, a) for t in trees)], pa.int64()) for a in ("chars", "pre", "sums")]
    return pa.RecordBatch.from_arrays([ids, leaves, *sums, pa.array([t.encoded for t in trees], pa.int64())], ["doc_id", *(x.split()[0] for x in ("leaves", "n_chars", "n_pretokens", "n_tokens", "chars_encoded"))])


def trees(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """doc_id, leaves (what a tree is built from) and the root's sums, to be kept as a table."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(parts):
        tokens = counter(vocabulary, pattern)
        for part in parts:
            yield _tree_rows(part.column(0), [Tree(t.as_py(), tokens) for t in part.column(1)])

    return bounded_batches(docs).select("doc_id", valid_text().alias("text")).mapInArrow(run, f"doc_id {kind}, {_TREE}")


def edited(kept: DataFrame, edits: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """Kept trees after a table of edits (as ``counts`` takes it); chars_encoded says how little was encoded again."""
    kind = kept.schema["doc_id"].dataType.simpleString()
    one = F.struct(F.coalesce("seq", F.lit(0)).alias("seq"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("text").cast("string").alias("text"))
    listed = edits.groupBy(F.col("doc_id").alias("of")).agg(F.sort_array(F.collect_list(one)).alias("edits"))

    def run(parts):
        tokens = counter(vocabulary, pattern)
        for part in parts:
            out = []
            for leaves, todo in zip(part.column(1), part.column(2), strict=True):
                tree = Tree.kept([(x["text"], x["pre"], x["tokens"]) for x in leaves.as_py()], tokens)
                for x in todo.as_py() or []:
                    tree.edit(x["start"] or 0, x["end"] or 0, x["text"] or "")
                out.append(tree)
            yield _tree_rows(part.column(0), out)

    both = bounded_batches(kept).join(listed, F.col("doc_id").eqNullSafe(F.col("of")), "left").select("doc_id", "leaves", "edits")
    return both.mapInArrow(run, f"doc_id {kind}, {_TREE}")


def sample_edits() -> Column:
    """Three edits for each text: an insertion, a deletion that joins words, and a replacement with blanks."""
    n = F.length(whole_text())

    def one(a, b, text):
        return F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(text).alias("text"))

    return F.array(one(n / 4, n / 4, "Don't  split 123abc"), one(n / 2, n / 2 + 7, ""), one(3 * n / 4, 3 * n / 4 + 3, "\n\n  é"))
