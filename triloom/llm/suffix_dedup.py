"""Removing repeated passages exactly, by prefix-free parsing.

Every byte that a repeated string of LENGTH bytes covers goes. Two levels of rolling-hash triggers find them:

1. Over the corpus. A 32-byte window triggers where its rolling hash is the least within some LENGTH-byte string
   (the leftmost of equal ones), so each such string holds its own trigger and equal strings hold equal ones at
   equal places. Strings of one trigger follow each other and form a run. Runs meet by their trigger's content: a
   run whose whole text occurs twice is repeated as a whole, a run whose trigger occurs once isn't at all. Equal
   runs of a batch are told before they travel.
2. Within shards of the runs that are left (a repeat begins or ends in them). The shard's text is cut into phrases
   at 8-byte triggers; overlapping by 8 bytes, no phrase suffix is a proper prefix of another. The sorted
   suffixes of the dictionary of distinct phrases and the suffix array of the parse (by prefix doubling over phrase
   ranks) combine into the order of all places, in which equal strings stand side by side; neighbours are compared
   byte by byte.

Null text counts as empty; texts shorter than LENGTH bytes lose nothing; long texts are rows like others; repeated
rows repeat each other's strings and lose them all; an empty table gives an empty result; only doc_id and text are
read, and ``remove_repeats`` keeps all other columns. Runs are told apart by 128-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, as_row, batches, bounded_batches, bucket_of, by_bucket, joined, materialize, mix64, partitions_for, prefix_hash, slice_hash, unpacked, whole_text

LENGTH = 200
WINDOW = 32
_RUN = np.dtype([("key", "<u8"), ("same", "<u8"), ("k", "<i8"), ("lo", "<i4"), ("hi", "<i4"), ("how", "<i4")])
#: how: seen once so far, seen at least twice, repeated as a whole (only to be passed on)
_ONCE, _TWICE, _WHOLE = 1, 2, 3
_ASK = np.dtype([("k", "<i8"), ("lo", "<i4"), ("hi", "<i4"), ("key", "<u8")])
_FOUND = np.dtype([("k", "<i8"), ("lo", "<i4"), ("hi", "<i4")])
_STEP = [np.uint64(pow(0xD6E8FEB86659FD93, 1 << i, 1 << 64)) for i in range(5)]


def _window_hashes(data: np.ndarray, doublings: int) -> np.ndarray:
    """A hash of each window of 2**doublings bytes."""
    h = _BYTE[data]
    for i in range(doublings):
        w = 1 << i
        h = h[:-w] * _STEP[i] + h[w:] if len(h) > w else h[:0]
    return mix64(h)


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of each w neighbours, from running minima of blocks."""
    n = len(x) - w + 1
    blocks = -(-len(x) // w)
    full = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    full[: len(x)] = x
    full = full.reshape(blocks, w)
    ahead = np.minimum.accumulate(full, 1).reshape(-1)
    back = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def runs(texts: list[bytes], keys: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """All runs of texts: strings that start at lo to hi have the same trigger."""
    out = []
    for a, b in batches(texts, 1 << 19):
        data, starts = joined(texts[a:b])
        if len(data) < length:
            continue
        h = _window_hashes(data, 5)
        at = np.arange(len(h), dtype=np.uint64)
        low = np.uint64((1 << max(1, int(len(h)).bit_length())) - 1)
        trigger = (_sliding_least(h & ~low | at, length - WINDOW + 1) & low).astype(np.int64)
        of = np.repeat(np.arange(b - a), np.diff(starts))[: len(trigger)]
        ok = np.flatnonzero(np.arange(len(trigger)) + length <= starts[of + 1])
        if not len(ok):
            continue
        t, of = trigger[ok], of[ok]
        head = np.flatnonzero((np.diff(t, prepend=-1) != 0) | (np.diff(of, prepend=-1) != 0))
        last = np.append(head[1:], len(ok)) - 1
        lo, hi, t, of = ok[head], ok[last], t[head], of[head]
        x = np.empty(len(lo), _RUN)
        x["key"] = h[t]
        x["same"] = slice_hash(prefix_hash(data), lo, hi + length) + mix64((t - lo).astype(np.uint64))
        x["k"], x["lo"], x["hi"], x["how"] = keys[a:b][of], lo - starts[of], hi - starts[of], _ONCE
        out.append(x)
    return np.concatenate(out) if out else np.zeros(0, _RUN)


def _columns(records: np.ndarray) -> bytes:
    """Records column by column, which compresses better."""
    return b"".join(np.ascontiguousarray(records[name]).tobytes() for name in records.dtype.names)


def _records(table: pa.Table, column: str, dtype: np.dtype) -> np.ndarray:
    out = []
    for chunk in table.column(column).chunks:
        for x in chunk:
            if x.is_valid and (raw := x.as_buffer()):
                n, at = len(raw) // dtype.itemsize, 0
                part = np.empty(n, dtype)
                for name in dtype.names:
                    part[name] = np.frombuffer(raw, dtype[name], n, at)
                    at += n * dtype[name].itemsize
                out.append(part)
    return np.concatenate(out) if out else np.zeros(0, dtype)


def _groups(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by key and content; the number of each one's (key, content) group and the groups' first places."""
    x = x[np.lexsort((x["same"], x["key"]))]
    new = np.ones(len(x), bool)
    new[1:] = (x["key"][1:] != x["key"][:-1]) | (x["same"][1:] != x["same"][:-1])
    return x, np.cumsum(new) - 1, np.flatnonzero(new)


def _told(x: np.ndarray) -> np.ndarray:
    """Runs that equal each other are repeated as a whole; one of each travels on."""
    if not len(x):
        return x
    x, group, first = _groups(x)
    many = np.diff(np.append(first, len(x))) > 1
    whole = x[many[group]].copy()
    whole["how"] = _WHOLE
    one = x[first].copy()
    one["how"][many] = _TWICE
    return np.concatenate([one, whole])


def corpus_runs(docs: DataFrame, buckets: int, length: int) -> DataFrame:
    """(bucket, rows): all runs, packed by bucket of their trigger's content."""

    def run(parts):
        for part in parts:
            x = _told(runs([t.as_buffer().to_pybytes() for t in part.column(1)], part.column(0).to_numpy(), length))
            # rows that are only passed on may go anywhere
            # triggers are least hashes, so their high bits are alike: mixed first
            where = bucket_of(mix64(np.where(x["how"] == _WHOLE, x["k"].view(np.uint64) if len(x) else x["key"], x["key"])), buckets)
            order = np.argsort(where, kind="stable")
            x, where = x[order], where[order]
            cut = np.flatnonzero(np.diff(where, prepend=-1))
            packed = [(int(where[a]), _columns(x[a:b])) for a, b in zip(cut.tolist(), np.append(cut[1:], len(x)).tolist(), strict=True)] if len(x) else []
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in packed], pa.int32()), pa.array([r for _, r in packed], pa.binary())], ["bucket", "rows"])

    return docs.mapInArrow(run, "bucket int, rows binary")


def _shard_of(k: np.ndarray, n: int) -> np.ndarray:
    return bucket_of(mix64(np.ascontiguousarray(k).view(np.uint64)), n)


def _judge(shards: int):
    """Runs of a bucket: repeated as a whole, left to be looked at (key set), or alone (dropped)."""

    def judge(table: pa.Table) -> pa.Table:
        x = _records(table, "rows", _RUN)
        passed, x = x[x["how"] == _WHOLE], x[x["how"] != _WHOLE]
        whole, ask = [passed], np.zeros(0, _ASK)
        if len(x):
            x, group, first = _groups(x)
            times = np.add.reduceat(x["how"].astype(np.int64), first)
            trigger = np.cumsum(np.diff(x["key"][first], prepend=x["key"][:1] ^ np.uint64(1)) != 0) - 1
            several = np.bincount(trigger) > 1
            repeated = times > 1
            whole.append(x[repeated[group]])
            # of a repeated content one run stands for all
            look = several[trigger][group] & (~repeated[group] | (np.arange(len(x)) == first[group]))
            ask = np.zeros(int(look.sum()), _ASK)
            for name in _ASK.names:
                ask[name] = x[name][look]
        found = np.concatenate(whole)
        done = np.zeros(len(found), _FOUND)
        for name in _FOUND.names:
            done[name] = found[name]
        rows = [(b, r, None) for b, r in by_bucket(_shard_of(done["k"], shards), done)] + [(b, None, r) for b, r in by_bucket(_shard_of(ask["k"], shards), ask)]
        return pa.table({"shard": pa.array([r[0] for r in rows], pa.int32()), "found": pa.array([r[1] for r in rows], pa.binary()), "ask": pa.array([r[2] for r in rows], pa.binary())})

    judge.__annotations__ = {"table": pa.Table, "return": pa.Table}
    return judge


def _by_row(table: pa.Table) -> tuple[np.ndarray, list]:
    return table["k"].to_numpy(), [t for chunk in table["text"].chunks for t in chunk]


def _contexts(buckets: int, length: int):
    """The texts of the runs that are asked for, by bucket of their trigger."""

    def contexts(docs: pa.Table, asked: pa.Table) -> pa.Table:
        ask = unpacked(asked, "ask", _ASK)
        rows = []
        if len(ask) and docs.num_rows:
            k, texts = _by_row(docs)
            _, one = np.unique(k, return_index=True)
            ask = ask[np.argsort(ask["k"], kind="stable")]
            first, last = np.searchsorted(ask["k"], k[one], "left"), np.searchsorted(ask["k"], k[one], "right")
            where = bucket_of(mix64(ask["key"]), buckets)
            parts: dict[int, tuple[list, list]] = {}
            for i, a, b in zip(one.tolist(), first.tolist(), last.tolist(), strict=True):
                if b > a:
                    text = texts[i].as_buffer().to_pybytes()
                    for j, bucket, lo, hi in zip(range(a, b), where[a:b].tolist(), ask["lo"][a:b].tolist(), ask["hi"][a:b].tolist(), strict=True):
                        x = parts.setdefault(bucket, ([], []))
                        x[0].append(j)
                        x[1].append(text[lo : hi + length])
            for bucket, (js, strings) in parts.items():
                done = np.zeros(len(js), _FOUND)
                for name in _FOUND.names:
                    done[name] = ask[name][js]
                rows.append((bucket, done.tobytes(), b"".join(strings)))
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "runs": pa.array([r[1] for r in rows], pa.binary()), "text": pa.array([r[2] for r in rows], pa.binary())})

    contexts.__annotations__ = {"docs": pa.Table, "asked": pa.Table, "return": pa.Table}
    return contexts


# --- prefix-free parsing of a shard -------------------------------------------------------------------


def _ranks(data: bytes, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The rank from 1 of each data[start:end] among the distinct ones, which are sorted as strings."""
    _, one, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    strings = [data[a:b] for a, b in zip(start[one].tolist(), end[one].tolist(), strict=True)]
    rank = np.empty(len(strings), np.int64)
    rank[sorted(range(len(strings)), key=strings.__getitem__)] = np.arange(1, len(strings) + 1)
    return rank[inverse]


def text_order(data: np.ndarray, ends: np.ndarray, places: np.ndarray, length: int, modulus: int = 16) -> np.ndarray:
    """places in the order of what follows them, up to the end of their piece (an end comes before any byte), as far
    as length bytes decide. ends: for each byte its piece's end."""
    raw, prefix, w = data.tobytes(), prefix_hash(data), 8
    h = _window_hashes(data, 3)
    trigger = np.flatnonzero(h % np.uint64(modulus) == 0)
    trigger = trigger[trigger + w <= ends[trigger]]
    # the parse: a phrase from each trigger to the end of the next one's window, or to the end of the piece
    following = np.append(trigger[1:], len(data)) + w
    inside = following <= ends[trigger] if len(trigger) else np.zeros(0, bool)
    stop = np.where(inside, following, ends[trigger]) if len(trigger) else following[:0]
    rank = _ranks(raw, trigger, stop, slice_hash(prefix, trigger, stop)) if len(trigger) else np.zeros(0, np.int64)
    # suffix array of the parse by prefix doubling; a piece's last phrase has nothing (0) behind it
    left = np.zeros(len(trigger), np.int64)  # phrases after this one in its piece
    if len(trigger):
        closing = np.flatnonzero(~inside)
        left = closing[np.searchsorted(closing, np.arange(len(trigger)))] - np.arange(len(trigger))
    span = 1
    while span < length and len(rank) and rank.max() < len(rank):
        more = np.flatnonzero(left >= span)
        behind = np.zeros(len(rank), np.int64)
        behind[more] = rank[more + span]
        _, new = np.unique(rank * (int(rank.max()) + 1) + behind, return_inverse=True)
        rank, span = new + 1, span * 2
    # the dictionary: what is left of a place's phrase, through the first trigger window from there on
    nxt = np.searchsorted(trigger, places)
    has = nxt < len(trigger)
    stop = ends[places].copy()
    if len(trigger):
        has &= np.where(has, trigger[np.minimum(nxt, len(trigger) - 1)] + w, len(data) + 1) <= stop
        stop[has] = trigger[nxt[has]] + w
    suffix = _ranks(raw, places, stop, slice_hash(prefix, places, stop))
    tail = np.zeros(len(places), np.int64)
    tail[has] = rank[nxt[has]]
    return np.lexsort((tail, suffix))


def repeated(data: np.ndarray, ends: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """Which of places start a string of length bytes that another of them starts, too."""
    out = np.zeros(len(places), bool)
    if len(places) < 2:
        return out
    order = text_order(data, ends, places, length)
    words = -(-length // 8)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    view = np.ndarray((len(data),), np.uint64, padded, 0, (1,))  # 8 bytes from each place on
    at = np.minimum(np.arange(words) * 8, length - 8)
    p = places[order]
    same = view[p[1:]] == view[p[:-1]]
    todo = np.flatnonzero(same)
    for a in range(0, len(todo), 50_000):
        x = todo[a : a + 50_000]
        same[x] = (view[p[x + 1][:, None] + at] == view[p[x][:, None] + at]).all(1)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _resolve(shards: int, length: int):
    def resolve(table: pa.Table) -> pa.Table:
        run = unpacked(table, "runs", _FOUND)
        data = unpacked(table, "text", np.uint8)
        size = run["hi"].astype(np.int64) - run["lo"] + length
        start = np.cumsum(size) - size
        ends = np.repeat(start + size, size)
        many = size - length + 1
        places = np.repeat(start - (np.cumsum(many) - many), many) + np.arange(many.sum())
        hit = repeated(data, ends, places, length)
        # neighbouring hits of a run as one
        of = np.repeat(np.arange(len(run)), many)[hit]
        at = places[hit] - start[of] + run["lo"][of]
        head = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(at, prepend=-2) != 1))
        last = np.append(head[1:], len(at)) - 1
        done = np.zeros(len(head), _FOUND)
        if len(head):
            done["k"], done["lo"], done["hi"] = run["k"][of[head]], at[head], at[last]
        rows = list(by_bucket(_shard_of(done["k"], shards), done))
        return pa.table({"shard": pa.array([b for b, _ in rows], pa.int32()), "found": pa.array([r for _, r in rows], pa.binary())})

    resolve.__annotations__ = {"table": pa.Table, "return": pa.Table}
    return resolve


# --- the operator -------------------------------------------------------------------------------------


def _keyed(docs: DataFrame, shards: int) -> DataFrame:
    """k tells rows apart by id and text; rows that share it share their repeats."""
    text = whole_text()
    k = F.xxhash64(text, F.col("doc_id"))
    # the same shard as _shard_of gives
    return bounded_batches(docs).select("doc_id", k.alias("k"), text.cast("binary").alias("text")).withColumn("shard", _jvm_shard(shards))


def _jvm_shard(shards: int):
    @F.pandas_udf("int")
    def shard(k):
        import pandas as pd

        return pd.Series(_shard_of(k.to_numpy(), shards).astype(np.int32))

    return shard("k")


def spans_of(found: np.ndarray, length: int) -> np.ndarray:
    """(start, end) of the bytes that strings starting at found's places cover, merged."""
    if not len(found):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(found["lo"], kind="stable")
    lo, hi = found["lo"][order].astype(np.int64), np.maximum.accumulate(found["hi"][order].astype(np.int64) + length)
    head = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
    return np.stack([lo[head], np.append(hi[head[1:] - 1], hi[-1])], 1)


def _cut(length: int, with_text: bool):
    def cut(docs: pa.Table, found: pa.Table) -> pa.Table:
        x = unpacked(found, "found", _FOUND)
        x = x[np.argsort(x["k"], kind="stable")]
        k, texts = _by_row(docs)
        first, last = np.searchsorted(x["k"], k, "left"), np.searchsorted(x["k"], k, "right")
        rows = []
        for t, a, b in zip(texts, first.tolist(), last.tolist(), strict=True):
            text = t.as_buffer().to_pybytes()
            spans = spans_of(x[a:b], length).tolist()
            kept, at = [], 0
            for lo, hi in spans:
                kept.append(text[at:lo])
                at = hi
            left = b"".join([*kept, text[at:]])
            rows.append((len(text), len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left.decode(errors="replace") if with_text else None))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        out = {"doc_id": docs["doc_id"], "k": docs["k"], "n_bytes": pa.array(columns[0], pa.int64()), "n_removed": pa.array(columns[1], pa.int64()), "n_spans": pa.array(columns[2], pa.int64()), "kept_sha256": pa.array(columns[3], pa.string())}
        if with_text:
            out["kept"] = pa.array(columns[4], pa.string())
        return pa.table(out)

    cut.__annotations__ = {"docs": pa.Table, "found": pa.Table, "return": pa.Table}
    return cut


def repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """doc_id, k, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept text, for each row."""
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.octet_length(whole_text())), F.lit(0))).first()[0]
    shards = partitions_for(spark, total, 16 << 20)
    keyed = _keyed(docs, shards)
    judged = materialize(corpus_runs(keyed.select("k", "text"), shards, length).groupBy("bucket").applyInArrow(_judge(shards), "shard int, found binary, ask binary"))
    asked = judged.where("ask IS NOT NULL").select("shard", "ask").groupBy("shard")
    contexts = keyed.select("shard", "k", "text").groupBy("shard").cogroup(asked).applyInArrow(_contexts(4 * shards, length), "bucket int, runs binary, text binary")
    resolved = materialize(contexts.groupBy("bucket").applyInArrow(_resolve(shards, length), "shard int, found binary"))
    found = judged.where("found IS NOT NULL").select("shard", "found").unionByName(resolved).groupBy("shard")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text
    return keyed.groupBy("shard").cogroup(found).applyInArrow(_cut(length, with_text), schema)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with repeated strings cut out of the text (broken characters become U+FFFD); a null text stays null."""
    kept = repeats(docs, length, True).select(F.col("doc_id").alias("id"), F.col("k").alias("key"), "kept").dropDuplicates(["id", "key"])
    rows = docs.select(as_row(docs).alias("row"), F.col("doc_id").alias("doc_id"), F.xxhash64(whole_text(), F.col("doc_id")).alias("k"), F.col("text").isNull().alias("none"))
    out = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("k") == F.col("key")), "left")
    return out.select(*[(F.when(~F.col("none"), F.col("kept")) if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])


#: DuckDB SQL for repeats(documents) without k.
SQL = r"""
WITH n AS (SELECT doc_id, encode(coalesce(text, '')) AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
win AS (SELECT doc_id, i, md5_number(t[i + 1:i + 200]) AS g FROM (SELECT doc_id, t, unnest(range(0, n - 199)) AS i FROM n)),
hot AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM win JOIN hot USING (g)),
runs AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM hit),
spans AS (SELECT doc_id, r, min(i) AS a, max(i) + 200 AS b FROM runs GROUP BY doc_id, r),
cuts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS c FROM spans),
parts AS (SELECT doc_id, string_agg(hex(t[c + 1:a]), '' ORDER BY a) AS kept, max(b) AS last, sum(b - a) AS gone, count(*) AS k FROM cuts JOIN n USING (doc_id) GROUP BY doc_id)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(k, 0) AS BIGINT) AS n_spans, sha256(CASE WHEN k IS NULL THEN t ELSE unhex(concat(kept, hex(t[last + 1:]))) END) AS kept_sha256 FROM n LEFT JOIN parts ON parts.doc_id = n.doc_id
"""
