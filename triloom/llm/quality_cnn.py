"""Quality classifier: a byte-level convolutional network in numpy.

Windows of 16 bytes, 8 apart, run over the whole document. Each byte becomes a fixed vector (its class and
a random code), learned filters are applied to each window, rectified and max-pooled over chunks of 64
windows; the chunks' maxima are combined by mean and maximum into one logistic probability. Neighbouring
windows, and so neighbouring chunks, overlap by 8 bytes.

Fitting takes at most ``rows`` labelled rows (by hash of the id, so reruns agree), as many of them as hold at most
``most`` bytes; fitting and scoring cover whole texts, so both pool over the same chunks.

Null and empty texts get the score of an empty chunk; rows with a null label or null id teach nothing; if an
id has several labels, their mean decides (a tie is 1); without any labels the score is 0.5; repeated rows get
equal scores; an empty table gives an empty result; only doc_id and text are read, so extra columns can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, bounded_batches, fold_of, whole_text

BLOCK, CHUNK = 8, 64  # bytes a block, blocks a chunk
ROWS, BYTES = 3000, 64 << 20
PIECE = 256  # chunks whose windows training holds at once


def _byte_vectors(random_dims: int = 6, seed: int = 9) -> np.ndarray:
    b = np.arange(256)
    kinds = [(b >= 97) & (b <= 122), (b >= 65) & (b <= 90), (b >= 48) & (b <= 57), (b == 32) | ((b >= 9) & (b <= 13)), (b > 32) & (b < 127) & ~np.isin(b, [*range(48, 58), *range(65, 91), *range(97, 123)]), b >= 128]
    table = np.concatenate([np.stack(kinds, 1).astype(np.float32), np.random.default_rng(seed).normal(0, 0.5, (256, random_dims)).astype(np.float32)], 1)
    table[0] = 0  # padding
    return table


_VECTORS = _byte_vectors()


@dataclass
class Network:
    """Filters (two blocks' vectors each), their biases, and the weights of pooled features."""

    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float

    def pool(self, blocks: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """Rectified maxima of each filter over each chunk; blocks: bytes (n, 8) and one more block at the end."""
        x = _VECTORS[blocks].reshape(len(blocks), -1)
        half = x.shape[1]
        # a product for each chunk, so that a chunk's result doesn't depend on where it stands
        z = x[:-1].reshape(-1, CHUNK, half) @ self.filters[:half]
        z += x[1:].reshape(-1, CHUNK, half) @ self.filters[half:]
        z += self.bias
        z[~valid.reshape(-1, CHUNK)] = 0
        return np.maximum(z.max(1), 0)

    def scores(self, texts: list[bytes], piece: int = 1 << 15) -> np.ndarray:
        counts = np.array([(len(t) + BLOCK) // (BLOCK * CHUNK) + 1 for t in texts], np.int64)
        starts = np.concatenate([[0], np.cumsum(counts)])
        data = np.zeros((int(starts[-1]) * CHUNK + 1) * BLOCK, np.uint8)
        for a, t in zip((starts[:-1] * BLOCK * CHUNK).tolist(), texts, strict=True):
            data[a : a + len(t)] = np.frombuffer(t, np.uint8)
        blocks = data.reshape(-1, BLOCK)
        valid = np.ones(len(blocks) - 1, bool)
        valid[starts[1:] * CHUNK - 1] = False  # a window across two texts
        pooled = np.concatenate([self.pool(blocks[a : min(a + piece, len(blocks) - 1) + 1], valid[a : a + piece]) for a in range(0, len(valid), piece)])
        return self.combine(np.add.reduceat(pooled, starts[:-1]) / counts[:, None], np.maximum.reduceat(pooled, starts[:-1]))

    def combine(self, mean: np.ndarray, top: np.ndarray) -> np.ndarray:
        logit = (np.concatenate([mean, top], 1).astype(np.float64) * self.out).sum(1) + self.out_bias
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _windows(chunks: np.ndarray) -> np.ndarray:
    """The vectors of each window (n, 64, two blocks)."""
    x = _VECTORS[chunks].reshape(len(chunks), CHUNK + 1, -1)
    return np.concatenate([x[:, :-1], x[:, 1:]], 2)


def train(chunks: np.ndarray, of: np.ndarray, label: np.ndarray, filters: int = 32, epochs: int = 10, step: int = 48, seed: int = 1) -> Network | None:
    """Fit by Adam. chunks: bytes (n, 65, 8), of: row of each chunk (ascending), label: 0 or 1 by row."""
    if not len(label):
        return None
    rng = np.random.default_rng(seed)
    half = BLOCK * _VECTORS.shape[1]
    p = [rng.normal(0, 0.15, (2 * half, filters)).astype(np.float32), np.zeros(filters, np.float32), np.zeros(2 * filters), np.array([np.log((label.mean() + 1e-2) / (1 - label.mean() + 1e-2))])]
    m, v, t = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    first = np.searchsorted(of, np.arange(len(label) + 1))
    for epoch in range(epochs):
        order = rng.permutation(len(label))
        for a in range(0, len(order), step):
            rows = order[a : a + step]
            n = first[rows + 1] - first[rows]
            take = np.concatenate([np.arange(first[r], first[r + 1]) for r in rows])
            at = np.concatenate([[0], np.cumsum(n)])[:-1]
            pieces = [slice(i, i + PIECE) for i in range(0, len(take), PIECE)]
            best, pooled = np.empty((len(take), filters), np.int64), np.empty((len(take), filters), np.float32)
            for i in pieces:
                z = (_windows(chunks[take[i]]).reshape(-1, 2 * half) @ p[0]).reshape(-1, CHUNK, filters) + p[1]
                best[i] = z.argmax(1)
                pooled[i] = np.maximum(np.take_along_axis(z, best[i][:, None], 1)[:, 0], 0)
            mean, top = np.add.reduceat(pooled, at) / n[:, None], np.maximum.reduceat(pooled, at)
            feature = np.concatenate([mean, top], 1)
            prob = 1 / (1 + np.exp(-np.clip(feature @ p[2] + p[3], -30, 30)))
            d = (prob - label[rows]) / len(rows)
            df = d[:, None] * p[2]
            row = np.repeat(np.arange(len(rows)), n)
            dz = (df[:, :filters] / n[:, None])[row] + df[:, filters:][row] * (pooled == top[row])
            dz = (dz * (pooled > 0)).astype(np.float32)
            by_filter = sum(np.einsum("cf,cfw->wf", dz[i], _windows(chunks[take[i]])[np.arange(len(take[i]))[:, None], best[i]], optimize=True) for i in pieces)
            grads = [by_filter, dz.sum(0), feature.T @ d + 1e-4 * p[2], np.array([d.sum()])]
            t += 1
            rate = 0.01 * (1 - epoch / epochs) + 0.0005
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                p[k] = p[k] - (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(p[k].dtype)
    return Network(p[0], p[1], p[2], float(p[3][0]))


def all_chunks(text: bytes) -> np.ndarray:
    """The chunks of a text that scoring pools over, as bytes (n, 65, 8)."""
    total = (len(text) + BLOCK) // (BLOCK * CHUNK) + 1
    data = np.zeros((total * CHUNK + 1) * BLOCK, np.uint8)
    data[: len(text)] = np.frombuffer(text, np.uint8)
    blocks = data.reshape(-1, BLOCK)
    return np.stack([blocks[k * CHUNK : (k + 1) * CHUNK + 1] for k in range(total)])


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, most: int = BYTES, folds: int = 5) -> Network | None:
    """Learn labels.quality from at most ``rows`` rows outside the held-out fold, with their whole texts."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"), folds))
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    label = dict(sample.select("doc_id", "quality").collect())
    if not label:
        return None
    kind = docs.schema["doc_id"].dataType.simpleString()

    def texts_of(ids: list) -> DataFrame:
        wanted = docs.sparkSession.createDataFrame([(k,) for k in ids], f"doc_id {kind}")
        return bounded_batches(docs).select("doc_id", whole_text().cast("binary").alias("text")).join(F.broadcast(wanted), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))  # at most ``rows`` ids; repeated ids: one text, the same each time

    size = dict(texts_of(list(label)).select("doc_id", F.length("text")).collect())
    ids, total = [], 0
    for k in label:
        total += size.get(k, 0)
        if total > most and ids:
            break
        if k in size:
            ids.append(k)
    found = {r["doc_id"]: bytes(r["text"]) for r in texts_of(ids).collect()} if ids else {}
    keys = sorted(found)
    if not keys:
        return None
    parts = [all_chunks(found[k]) for k in keys]
    return train(np.concatenate(parts), np.repeat(np.arange(len(keys)), [len(x) for x in parts]), np.array([label[k] for k in keys], np.float64))


def score(docs: DataFrame, network: Network | None, threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""

    def run(parts):
        for part in parts:
            texts = [t.as_buffer().to_pybytes() for t in part.column(1)]
            out = np.full(len(texts), 0.5)
            if network is not None:
                for a, b in batches(texts, 1 << 20):
                    out[a:b] = network.scores(texts[a:b])
            held = [fold_of(k, folds) == 0 for k in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held, pa.bool_()), pa.array(out), pa.array((out >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return bounded_batches(docs).select("doc_id", whole_text().cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, network: Network | None, threshold: float = 0.3) -> DataFrame:
    """docs without the rows whose score is below threshold; all columns stay as they are."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def quality(text):
        texts = [b"" if t is None else t for t in text]
        out = np.full(len(texts), 0.5)
        if network is not None:
            for a, b in batches(texts, 1 << 20):
                out[a:b] = network.scores(texts[a:b])
        import pandas as pd

        return pd.Series(out)

    return bounded_batches(docs).where(quality(whole_text().cast("binary")) >= threshold)
