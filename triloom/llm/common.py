"""Small helpers that the operators share: table reading, shared-folder tables, word hashing."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import shared_dir

#: The characters that separate words: blank, and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffle files of the write go when it ends; nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more, as what was made of them is written."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of texts that a Python worker gets at once; with rows alone as the bound, long texts make batches large.
BATCH_BYTES = 8 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches are bounded in bytes (a bound that the session has chosen stays)."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH) == "67108864b":  # the default
        conf.set(_BATCH, f"{BATCH_BYTES}b")
    return df


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def partitions_for(spark: SparkSession, total_bytes: int, per_partition: int) -> int:
    """Partitions that hold per_partition bytes each, never fewer than the session asks for."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total_bytes) // per_partition), 1)


def whole_text(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def valid_text(column: str = "text"):
    """The whole text, with U+FFFD for each stretch of bytes that is no UTF-8."""
    return F.make_valid_utf8(whole_text(column))


def as_row(docs: DataFrame):
    """All columns of docs as one, so that no name of theirs meets a working column's."""
    return F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns])


def fold_of(doc_id, folds: int) -> int:
    """crc32 of the id's decimal text, modulo folds; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


# --- words and their 64-bit hashes, vectorised over all texts of a batch -----------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def _powers(n: int, factor: np.uint64) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def prefix_hash(data: np.ndarray, step: int = 1 << 22) -> np.ndarray:
    """H[i] = sum of byte value j times BASE**j over j < i, modulo 2**64."""
    out = np.zeros(len(data) + 1, np.uint64)
    power = _powers(min(step, len(data)), _BASE)
    scale = np.uint64(1)
    for a in range(0, len(data), step):
        part = _BYTE[data[a : a + step]]
        part *= power[: len(part)]
        np.cumsum(part * scale, out=out[a + 1 : a + 1 + len(part)])
        out[a + 1 : a + 1 + len(part)] += out[a]
        scale = np.multiply(np.multiply(scale, power[-1:]), _BASE)[0]  # as arrays: these wrap in silence
    return out


def slice_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of data[start:end] that doesn't depend on where it stands."""
    inverse = _inverse_powers(start)
    return mix64((prefix[end] - prefix[start]) * inverse + (end - start).astype(np.uint64))


def _inverse_powers(at: np.ndarray) -> np.ndarray:
    """BASE**-at from two short tables."""
    low, high = _TABLES
    at = at.astype(np.int64)
    return low[at & 0xFFFF] * high[at >> 16]


_TABLES = (_powers(1 << 16, _INVERSE), _powers(1 << 15, np.uint64(pow(int(_INVERSE), 1 << 16, 1 << 64))))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, and where each begins (with the end as last)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return np.frombuffer(b"".join(texts), np.uint8), starts


def word_spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word of each text."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edge[::2], edge[1::2]
    # a text may end within a run of word bytes that the next text continues
    cut = np.unique(starts[1:-1])
    cut = cut[(cut > 0) & (cut < len(data))]
    cut = cut[inside[cut] & inside[cut + 1]] if len(cut) else cut
    if len(cut):
        begin, end = np.sort(np.concatenate([begin, cut])), np.sort(np.concatenate([end, cut]))
    return begin, end, np.searchsorted(starts, begin, "right") - 1


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each lower-cased (A-Z) word, and its text's number."""
    data, starts = joined(texts)
    begin, end, of = word_spans(data, starts)
    return slice_hash(prefix_hash(_LOWER[data]), begin, end), of


def batches(texts: list[bytes], limit: int = 8 << 20):
    """Ranges of texts with about limit bytes each; one long text makes a range of its own."""
    a = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


# --- arrays that travel by hash bucket ----------------------------------------------------------------


def by_bucket(bucket: np.ndarray, records: np.ndarray):
    """(bucket, bytes of its records) for each bucket that has any; records keep their order within one."""
    if not len(records):
        return
    order = np.argsort(bucket, kind="stable")
    sorted_bucket = bucket[order]
    cut = np.flatnonzero(np.diff(sorted_bucket)) + 1
    first = np.concatenate([[0], cut])
    last = np.concatenate([cut, [len(order)]])
    records = records[order]
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        yield int(sorted_bucket[a]), records[a:b].tobytes()


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """A bucket in 0..n-1 from the high bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def unpacked(table, column: str, dtype) -> np.ndarray:
    """The records of all rows of a binary column of an Arrow table."""
    parts = [np.frombuffer(x.as_buffer(), dtype) for chunk in table.column(column).chunks for x in chunk if x.is_valid]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)
