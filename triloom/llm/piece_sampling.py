"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

The lattice of a text has an edge for each piece that matches at a place (and byte pieces for characters that
no piece holds). Forward filtering sums the weights of all ways to each place; backward sampling then draws the
pieces from the end, each in proportion to its share of that sum, so that whole segmentations come with
probability in proportion to the product of their pieces' weights.

No piece has a blank after another character, so the lattice of a text is a chain of the lattices of its
blank-led units, and filtering each distinct unit of a batch once is exact. Draws hash the seed, the row's key,
the unit's number in its text and the step: runs agree however rows are batched.

A unigram model's piece weighs exp(alpha * score). A BPE model has ranks, not probabilities: its piece weighs
(rank + 2.7) ** -alpha, a Zipf law. Nothing is trained.

Null text counts as empty and has no pieces; very long texts and units without blanks work (filtering takes a
numpy step a character there); equal keys and texts get equal pieces; an empty table gives an empty result;
only the key and the text are read. U+2581 in a text is spelled in bytes, so it doesn't turn into a blank.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import _BASE, _inverse_powers, _powers, batches, bounded_batches, mix64, valid_text

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_SLOT = np.uint64((1 << 20) - 1)  # the bits of a hash that choose its slot


class Pieces:
    """A model's pieces with their weights, looked up by hash, and their bytes for decoding."""

    def __init__(self, path: str, alpha: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes_of, self.byte_ids, names, ids, weights = [b""] * n, np.full(256, sp.unk_id(), np.int64), [], [], []
        scores = np.array([sp.get_score(i) for i in range(n)])
        ranked = scores.min() < -1000  # ranks of merges, not log probabilities
        for i in range(n):
            name = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(name[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(name[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                name = name.replace("▁", " ")
                if " " in name.lstrip(" "):
                    raise ValueError(f"piece {i} has a blank inside: units wouldn't be independent")
                self.bytes_of[i] = name.encode()
                names.append(name)
                ids.append(i)
                weights.append(-alpha * np.log(2.7 - scores[i]) if ranked else alpha * scores[i])
        if (self.byte_ids == sp.unk_id()).any():
            raise ValueError("the model has no byte pieces: decoding couldn't be lossless")
        self.longest = max(map(len, names))
        self.rare = min(weights) - 10.0  # log weight of a character in bytes
        hashes = np.zeros(len(names), np.uint64)
        lengths = np.array([len(x) for x in names])
        for length in np.unique(lengths):
            of = np.flatnonzero(lengths == length)
            code = np.stack([np.frombuffer(names[i].encode("utf-32-le"), np.uint32) for i in of])
            hashes[of] = _finish((mix64(code.astype(np.uint64)) * _powers(int(length), _BASE)).sum(1, dtype=np.uint64), length)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces share a hash")
        order = np.argsort(hashes & _SLOT)
        self.hashes, self.ids, self.weights = hashes[order], np.array(ids)[order], np.array(weights)[order]
        slot, first, many = np.unique(self.hashes & _SLOT, return_index=True, return_counts=True)
        self.most = int(many.max(initial=1))  # pieces of a slot
        self.first = np.full(int(_SLOT) + 1, -1, np.int32)
        self.first[slot.astype(np.int64)] = first

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces', and the pieces' places in ids and weights."""
        at = self.first[(h & _SLOT).astype(np.int64)]
        may = np.flatnonzero(at >= 0)
        at, h = at[may], h[may]
        ok = self.hashes[at] == h
        for _ in range(1, self.most):  # the slot's next piece, or one of another slot, which has another hash
            rest = np.flatnonzero(~ok)
            at[rest] = np.minimum(at[rest] + 1, len(self.hashes) - 1)
            ok[rest] = self.hashes[at[rest]] == h[rest]
        return may[ok], at[ok]

    def decode(self, ids: list[int]) -> bytes:
        """The text of ids, as UTF-8: the first piece's leading blank was put there by encode."""
        return b"".join(map(self.bytes_of.__getitem__, ids))[1:]


@lru_cache(4)
def pieces(path: str = MODEL, alpha: float = 1.0) -> Pieces:
    return Pieces(path, alpha)


def _finish(sums: np.ndarray, length) -> np.ndarray:
    return mix64(sums + np.uint64(int(length) * 0xD1B54A32D192ED03 & (1 << 64) - 1))


def _prefix(code: np.ndarray) -> np.ndarray:
    out = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(mix64(code.astype(np.uint64)) * _powers(len(code), _BASE), out=out[1:])
    return out


def _lattice(code: np.ndarray, starts: np.ndarray, p: Pieces):
    """Edges of the units' lattices. For each node (place j of unit k is starts[k] + k + j) its first edge; for each edge,
    those of a node together and long ones first, where it comes from, its piece and the node's cumulative probability."""
    unit = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))
    end = starts[1:].astype(np.int32)[unit]
    prefix = _prefix(code)
    s = np.arange(len(code), dtype=np.int32)
    inverse = _inverse_powers(s)
    begin, size, piece, weight = [], [], [], []
    single = np.zeros(len(code), bool)
    for length in range(1, p.longest + 1):
        if length > 1:
            s = s[s + length <= end[s]]
        if not len(s):
            break
        ok, where = p.find(_finish((prefix[s + length] - prefix[s]) * inverse[s], length))
        if length == 1:
            single[ok] = True
        begin.append(s[ok])
        size.append(np.full(len(ok), length, np.int32))
        piece.append(p.ids[where].astype(np.int32))
        weight.append(p.weights[where])
    spelled = np.flatnonzero(~single).astype(np.int32)
    begin.append(spelled)
    size.append(np.ones(len(spelled), np.int32))
    piece.append(-code[spelled].astype(np.int32) - 1)
    weight.append(np.full(len(spelled), p.rare))
    begin, size, piece, weight = map(np.concatenate, (begin, size, piece, weight))
    depth = begin + size - starts.astype(np.int32)[unit[begin]]
    begin += unit[begin]
    # forward filtering, all units at once, by place in the unit
    order = np.argsort(depth.astype(np.int64) << 40 | (begin + size).astype(np.int64) << 8 | 255 - size)
    begin, piece, weight, depth = begin[order], piece[order], weight[order], depth[order]
    to = begin + size[order]
    head = np.diff(to, prepend=-1) != 0
    first = np.flatnonzero(head)
    sizes = np.diff(np.append(first, len(to)))
    node_of = np.cumsum(head) - 1
    level = np.flatnonzero(np.diff(depth[first], prepend=0, append=np.iinfo(np.int32).max))
    total, share = np.zeros(len(code) + len(starts)), np.empty(len(to))
    for i, j in zip(level[:-1].tolist(), level[1:].tolist(), strict=True):
        a, b = int(first[i]), int(first[j]) if j < len(first) else len(to)
        heads, group = first[i:j] - a, node_of[a:b] - i
        x = total[begin[a:b]] + weight[a:b]
        top = np.maximum.reduceat(x, heads)
        x -= top[group]
        np.exp(x, out=x)
        sums = np.add.reduceat(x, heads)
        total[to[first[i:j]]] = top + np.log(sums)
        x /= sums[group]
        share[a:b] = x
    run = np.cumsum(share)
    run -= np.repeat(run[first] - share[first], sizes)
    run[first + sizes - 1] = np.inf
    edge = np.zeros(len(total), np.int32)
    edge[to[first]] = first
    return edge, begin, piece, run


def sample(texts: list[str], keys: np.ndarray, p: Pieces, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and where each text's begin. keys: a 64-bit key for each text."""
    size = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    if not first[-1]:
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    code = np.frombuffer("".join([" " + t if t else "" for t in texts]).encode("utf-32-le"), np.uint32)
    blank = code == 32
    begin = blank.copy()
    begin[1:] &= ~blank[:-1]
    begin[first[:-1][size > 0]] = True
    begin = np.flatnonzero(begin)
    end = np.append(begin[1:], len(code))
    prefix = _prefix(code)
    h = mix64((prefix[end] - prefix[begin]) * _inverse_powers(begin) + (end - begin).astype(np.uint64))
    _, example, unit = np.unique(h, return_index=True, return_inverse=True)
    length = end[example] - begin[example]
    starts = np.concatenate([[0], np.cumsum(length)])
    own = code[np.repeat(begin[example] - starts[:-1], length) + np.arange(starts[-1])]
    edge, e_from, e_piece, run = _lattice(own, starts, p)
    of = np.searchsorted(first, begin, "right") - 1
    number = np.arange(len(begin)) - np.searchsorted(begin, first)[of]
    salt = mix64(keys.astype(np.uint64)[of] + np.uint64(seed * 0x9FB21C651E98DF25 & (1 << 64) - 1)) ^ mix64(number.astype(np.uint64) + np.uint64(1))
    base = starts[:-1] + np.arange(len(starts) - 1)
    root, node = base[unit], base[unit] + length[unit]
    alive = np.arange(len(begin))
    steps, count = [], np.zeros(len(begin), np.int64)
    while len(alive):  # backward sampling, one piece of each unit a step
        u = (mix64(salt[alive] + np.uint64(len(steps) * int(_BASE) & (1 << 64) - 1)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        e = edge[node[alive]]
        more = np.flatnonzero(u >= run[e])
        while len(more):  # few go past the first edges
            e[more] += 1
            more = more[u[more] >= run[e[more]]]
        steps.append((alive, e_piece[e]))
        count[alive] += 1
        node[alive] = e_from[e]
        alive = alive[e_from[e] > root[alive]]
    offset = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(offset[-1], np.int64)
    for k, (units, piece) in enumerate(steps):
        out[offset[units + 1] - 1 - k] = piece
    cuts = offset[np.searchsorted(begin, first)]
    return _spell(out, cuts, p)


def _spell(out: np.ndarray, cuts: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Replace negated characters by the pieces of their bytes."""
    at = np.flatnonzero(out < 0)
    if not len(at):
        return out.astype(np.int32), cuts
    code = -out[at] - 1
    width = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
    many = np.ones(len(out), np.int64)
    many[at] = width
    place = np.concatenate([[0], np.cumsum(many)])
    full = np.repeat(out, many)
    for w in range(1, 5):
        for b in range(w):
            x = code[width == w] >> (6 * (w - 1 - b))
            value = (x & 0x7F if w == 1 else x | (0xF0 << (4 - w)) & 0xFF if b == 0 else x & 0x3F | 0x80).astype(np.int64)
            full[place[at[width == w]] + b] = p.byte_ids[value]
    return full.astype(np.int32), place[cuts]


def row_keys(ids: list) -> np.ndarray:
    """A 64-bit key of each row's id, of any type."""
    return np.array([int.from_bytes(hashlib.blake2b(repr(x).encode(), digest_size=8).digest(), "little") for x in ids], np.uint64)


def encode(docs: DataFrame, model: str = MODEL, alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """doc_id, n_pieces, pieces, decoded_sha256 (of the text that decoding gives back) and lossless."""

    def run(parts):
        p = pieces(model, alpha)
        for part in parts:
            raw = [t.as_buffer().to_pybytes() for t in part.column(1)]
            keys = row_keys(part.column(0).to_pylist())
            for a, b in batches(raw, 2 << 20):
                ids, cuts = sample([t.decode() for t in raw[a:b]], keys[a:b], p, seed)
                flat, digest, same = ids.tolist(), [], []
                for i in range(b - a):
                    text = p.decode(flat[cuts[i] : cuts[i + 1]])
                    digest.append(hashlib.sha256(text).hexdigest())
                    same.append(text == raw[a + i])
                yield pa.RecordBatch.from_arrays([part.column(0).slice(a, b - a), pa.array(np.diff(cuts)), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids)), pa.array(digest, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "pieces", "decoded_sha256", "lossless"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return bounded_batches(docs).select("doc_id", valid_text().cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, n_pieces long, pieces array<int>, decoded_sha256 string, lossless boolean")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """encoded with a column text in place of pieces."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def text(lists):
        import pandas as pd

        p = pieces(model, 1.0)
        return pd.Series([None if x is None else p.decode(list(x)).decode() for x in lists], dtype=object)

    return encoded.withColumn("text", text("pieces")).drop("pieces")
