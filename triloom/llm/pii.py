"""Personal data: base patterns, and information-theoretic sanitisation of the terms around them.

Base spans are e-mail addresses, IPv4 addresses, payment cards and phone numbers. Every distinct value is a
protected entity. The words within ``WINDOW`` words of its mentions are its context, and corpus counts tell
how strongly a word gives the entity away:

    disclosure(e, t) = PMI(e; t) / IC(e) = 1 + log((n_et - DISCOUNT) / n_t) / log(T / m_e)

with n_et the occurrences of t in the contexts of e, n_t those in the corpus, m_e the words of all contexts of
e and T all words. It is 1 for a word that never occurs elsewhere and near or below 0 for a word that says
nothing; the discount is the smoothing that lets a word seen once with e count for less than one seen often. Words are
generalised from ``GENERALISE`` on and removed from ``REMOVE`` on. Base spans always stay.

Null text counts as empty and has no spans; very long texts are scanned in linear time; of two spans at one
place both are told; repeated rows get equal rows; an empty table gives an empty result; only doc_id and text
are read, and ``sanitise`` keeps all other columns, whatever their names. Bytes that are no UTF-8 count as U+FFFD.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, as_row, batches, bounded_batches, bucket_of, by_bucket, joined, materialize, partitions_for, prefix_hash, slice_hash, unpacked, valid_text, whole_text, word_spans

KINDS = ("email", "ip", "card", "phone", "generalised", "removed")
WINDOW, DISCOUNT, GENERALISE, REMOVE = 6, 0.5, 0.8, 0.95

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_ANY_DIGIT = re.compile(r"[0-9]")


def emails(text: str):
    """Found from each @: the local part is what stands before it, back to the last match at most."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", m.end() if m else at + 1)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all base spans, in that order."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _ANY_DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.groups())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = _NOT_DIGIT.sub("", m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


def tell(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_COUNT = np.dtype([("t", "<u8"), ("n", "<i8")])  # n = 0: only asks for t's count
_NEAR = "array<struct<e:long,t:long,a:int,b:int>>"
_NEAR_PA = pa.list_(pa.struct([("e", pa.int64()), ("t", pa.int64()), ("a", pa.int32()), ("b", pa.int32())]))


def _context(text: str, spans, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray, window: int) -> list[dict]:
    """The words around each entity of a text: entity, word, and where it stands (code points)."""
    raw = text.encode()
    first, last = begin, end
    if len(raw) != len(text):
        chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
        first, last = chars[begin], chars[end]
    taken = np.zeros(len(first), bool)
    around: dict[int, set[int]] = {}
    for a, k, b in spans:
        lo, hi = int(np.searchsorted(last, a, "right")), int(np.searchsorted(first, b, "left"))
        taken[lo:hi] = True
        e = xxhash.xxh64_intdigest(f"{k}:{text[a:b].lower()}") - (1 << 63)
        around.setdefault(e, set()).update(range(max(0, lo - window), lo), range(hi, min(len(first), hi + window)))
    signed = hashes.view(np.int64)
    return [{"e": e, "t": int(signed[i]), "a": int(first[i]), "b": int(last[i])} for e, near in around.items() for i in sorted(near) if not taken[i]]


def scan(docs: DataFrame, window: int = WINDOW, buckets: int = 64) -> DataFrame:
    """One pass over the texts: a row per document with its base spans and context words, and rows with
    word counts by bucket (bucket is null in the former)."""
    names = ["doc_id", "k", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "near", "bucket", "counts"]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(parts):
        for part in parts:
            strings = part.column(2).to_pylist()
            spans = [base_spans(t) for t in strings]
            near: list = [None] * len(strings)
            raw = [t.encode() for t in strings]
            words, asked = [np.zeros(0, np.uint64)], []
            for lo, hi in batches(raw, 1 << 20):
                data, starts = joined(raw[lo:hi])
                begin, end, of = word_spans(data, starts)
                h = slice_hash(prefix_hash(_LOWER[data]), begin, end)
                at = np.searchsorted(of, np.arange(hi - lo + 1))
                for i in range(lo, hi):
                    if spans[i]:
                        a, b = at[i - lo], at[i - lo + 1]
                        near[i] = _context(strings[i], spans[i], begin[a:b] - starts[i - lo], end[a:b] - starts[i - lo], h[a:b], window)
                        asked += [x["t"] for x in near[i]]
                words.append(h)
            t, n = np.unique(np.concatenate(words), return_counts=True)
            ask = np.unique(np.array(asked, np.int64).view(np.uint64))
            records = np.zeros(len(t) + len(ask), _COUNT)
            records["t"], records["n"][: len(t)] = np.concatenate([t, ask]), n
            packed = list(by_bucket(bucket_of(records["t"], buckets), records))
            counts = np.array([[sum(k == x for _, k, _ in s) for x in range(4)] for s in spans], np.int64).reshape(-1, 4)
            told = [tell(s) for s in spans]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), *(pa.array(counts[:, j]) for j in range(4)), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in told], pa.string()), pa.array(told, pa.string()), pa.array(near, _NEAR_PA), pa.nulls(len(strings), pa.int32()), pa.nulls(len(strings), pa.binary())], names)
            n = len(packed)
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(n, part.column(0).type), pa.nulls(n, pa.int64()), *(pa.nulls(n, pa.int64()) for _ in range(4)), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, _NEAR_PA), pa.array([b for b, _ in packed], pa.int32()), pa.array([x for _, x in packed], pa.binary())], names)

    text = valid_text()
    return bounded_batches(docs).select("doc_id", key_of("doc_id", text).alias("k"), text.alias("text")).mapInArrow(run, f"doc_id {kind}, k long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, near {_NEAR}, bucket int, counts binary")


def key_of(doc_id: str, text):
    """Rows of equal id and text share it; they also share their spans."""
    return F.xxhash64(text, F.col(doc_id))


def _totals(table: pa.Table) -> pa.Table:
    """n_t of the words that some context asks for, and under null the number of all words."""
    x = unpacked(table, "counts", _COUNT)
    t, inverse = np.unique(x["t"], return_inverse=True)
    n = np.bincount(inverse, x["n"], len(t)).astype(np.int64)
    asked = np.zeros(len(t), bool)
    asked[inverse[x["n"] == 0]] = True
    return pa.table({"t": pa.array([*t[asked].view(np.int64).tolist(), None], pa.int64()), "n": pa.array([*n[asked].tolist(), int(n.sum())], pa.int64())})


def term_spans(found: DataFrame, discount: float = DISCOUNT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """doc_id, k and the array ``terms`` of (start, kind number, end): the words to generalise or remove."""
    # few words are asked for: a small table, which also gives the number of all words
    totals = materialize(found.where("bucket IS NOT NULL").select("bucket", "counts").groupBy("bucket").applyInArrow(_totals, "t long, n long"))
    everything = totals.where("t IS NULL").agg(F.coalesce(F.sum("n"), F.lit(1)).alias("n")).first()["n"]
    near = found.where("bucket IS NULL AND size(near) > 0").dropDuplicates(["doc_id", "k"]).select("doc_id", "k", F.explode("near").alias("x")).select("doc_id", "k", "x.*")
    # counted over all rows, repeated ones too
    pairs = found.where("bucket IS NULL").select(F.explode("near").alias("x")).groupBy("x.e", "x.t").agg(F.count("*").alias("n_et"))
    size = pairs.groupBy("e").agg(F.sum("n_et").alias("m_e"))
    told = pairs.join(size, "e").join(totals.where("t IS NOT NULL"), "t")
    ratio = 1 + F.log((F.col("n_et") - discount) / F.col("n")) / F.log(F.greatest(F.lit(float(everything)) / F.col("m_e"), F.lit(1.0000001)))
    told = told.withColumn("ratio", ratio).where(F.col("ratio") >= generalise)
    told = told.select("e", "t", F.when(F.col("ratio") >= remove, 5).otherwise(4).alias("kind"))
    spans = near.join(told, ["e", "t"]).groupBy("doc_id", "k", "a", "b").agg(F.max("kind").alias("kind"))
    return spans.groupBy("doc_id", "k").agg(F.sort_array(F.collect_list(F.struct("a", "kind", "b"))).alias("terms"))


def _with_terms(found: DataFrame, **options) -> DataFrame:
    terms = term_spans(found, **options).select(F.col("doc_id").alias("_id"), F.col("k").alias("_k"), "terms")
    rows = found.where("bucket IS NULL")
    return rows.join(terms, rows["doc_id"].eqNullSafe(terms["_id"]) & (rows["k"] == terms["_k"]), "left")


def _scanned(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    total = docs.agg(F.coalesce(F.sum(F.octet_length(whole_text())), F.lit(0))).first()[0]
    buckets = partitions_for(docs.sparkSession, total, 4 << 20)
    return materialize(scan(docs, window, buckets))


def report(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """doc_id, the base counts, base_sha256 and all spans of each document."""
    base = F.transform(F.filter(F.split("base", ","), lambda s: s != ""), lambda s: F.struct(F.split(s, ":")[1].cast("int").alias("a"), (F.array_position(F.array(*map(F.lit, KINDS)), F.split(s, ":")[0]) - 1).cast("int").alias("kind"), F.split(s, ":")[2].cast("int").alias("b")))
    merged = F.sort_array(F.concat(base, F.coalesce("terms", F.array().cast("array<struct<a:int,kind:int,b:int>>"))))
    spans = F.array_join(F.transform(merged, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["a"], x["b"])), ",")
    out = _with_terms(_scanned(docs, window), **options)
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.when(F.col("terms").isNull(), F.col("base")).otherwise(spans).alias("spans"))


def rewrite(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with base spans and generalised words replaced by what they are, and removed words left out."""
    out, at = [], 0
    for a, k, b in sorted(spans):
        if a < at:  # a part of what is replaced already
            at = max(at, b)
            continue
        word = text[a:b]
        general = "<number>" if _ANY_DIGIT.search(word) else "<name>" if word[:1].isupper() else "<word>"
        out += [text[at:a], general if k == 4 else "" if k == 5 else f"<{KINDS[k]}>"]
        at = b
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """docs with the text rewritten; its other columns as they are. A null text stays null."""
    terms = term_spans(_scanned(docs, window), **options).select(F.col("doc_id").alias("id"), F.col("k").alias("key"), "terms")

    @F.pandas_udf("string")
    def rewritten(text, terms):
        import pandas as pd

        return pd.Series([None if t is None else rewrite(t, base_spans(t) + ([(x["a"], x["kind"], x["b"]) for x in more] if more is not None else [])) for t, more in zip(text, terms, strict=True)], dtype=object)

    rows = bounded_batches(docs).select(as_row(docs).alias("row"), F.col("doc_id").alias("doc_id"), key_of("doc_id", valid_text()).alias("k"), F.when(F.col("text").isNotNull(), valid_text()).alias("text"))
    out = rows.join(terms, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("k") == F.col("key")), "left").withColumn("new", rewritten("text", "terms"))
    return out.select(*[(F.col("new") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])
