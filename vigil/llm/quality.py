"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer
network with temperature-calibrated probabilities.

Random indexing runs over the whole corpus: every token (runs of letters and digits, runs of
other signs; ASCII letters lower-cased) falls into one of ``VOCABULARY`` buckets by hash, each
bucket has a fixed sparse ternary index vector, and a token's vector is the sum of the index
vectors around all its occurrences.  Each task sums its part; the sums of the tasks meet in
Spark, block by block.  The table of vectors has a fixed size, whatever the input.

A document is the mean and spread of its tokens' vectors and a few pooled counts.  The network
learns from at most ``TRAIN_ROWS`` labelled rows (those that come first in a hash order); a
fifth of them only sets the temperature.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import U64, _LOWER, blocks, first_by_hash, mix64, prepare, range_hash, table, text_or_empty, utf8, written

VOCABULARY = 1 << 14
DIMS = 32
NONZERO = 4
REACH = 2
BLOCK = 256
TRAIN_ROWS = 20_000
KEEP = 0.7
_CLASS = np.full(256, 1, dtype=np.uint8)  # letters, digits and non-ASCII bytes
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
for _c in range(33, 127):
    if not chr(_c).isalnum():
        _CLASS[_c] = 2


def index_vectors() -> np.ndarray:
    """Fixed ternary vectors: ``NONZERO`` entries of +1 or -1 for each bucket."""
    out = np.zeros((VOCABULARY, DIMS), dtype=np.int8)
    for j in range(NONZERO):
        h = mix64(np.arange(VOCABULARY, dtype=np.uint64) * U64(NONZERO) + U64(j + 1))
        out[np.arange(VOCABULARY), (h % U64(DIMS)).astype(np.int64)] += np.where(h >> U64(63), 1, -1).astype(np.int8)
    return out


def tokens(data: np.ndarray, off: np.ndarray):
    """For pieces of the batch: (buckets, lengths, classes, row of each token), rows counted from 0."""
    for a, b, d0, d1 in blocks(data, off):
        piece = _LOWER[data[a:b]]
        if not len(piece):
            continue
        cls = _CLASS[piece]
        edge = np.zeros(len(piece) + 1, dtype=bool)
        cuts = np.clip(off[d0:d1 + 1] - a, 0, b - a)
        edge[cuts] = True
        change = np.ones(len(piece) + 1, dtype=bool)
        change[1:-1] = (cls[1:] != cls[:-1]) | edge[1:-1]
        at = np.flatnonzero(change)
        starts, ends = at[:-1], at[1:]
        keep = cls[starts] > 0
        starts, ends = starts[keep], ends[keep]
        if len(starts):
            h = range_hash(piece, starts, ends) >> U64(64 - VOCABULARY.bit_length() + 1)
            yield h.astype(np.uint16), ends - starts, cls[starts], d0 + np.searchsorted(cuts, starts, side="right") - 1


def _context_sums(docs: DataFrame) -> DataFrame:
    def run(batches):
        index = index_vectors()
        total = np.zeros((VOCABULARY, DIMS), dtype=np.int64)
        for batch in batches:
            for ids, _, _, row in tokens(*utf8(batch.column(0))):
                for lo in range(0, len(ids), 1 << 17):
                    w, r = ids[lo:lo + (1 << 17)], row[lo:lo + (1 << 17)]
                    around = np.zeros((len(w), DIMS), dtype=np.int8)
                    vec = index[w]
                    for d in range(1, REACH + 1):
                        if len(w) > d:
                            same = (r[d:] == r[:-d])[:, None]
                            around[:-d] += vec[d:] * same
                            around[d:] += vec[:-d] * same
                    order = np.argsort(w, kind="stable")
                    ws = w[order]
                    cuts = np.flatnonzero(np.concatenate(([True], ws[1:] != ws[:-1])))
                    total[ws[cuts]] += np.add.reduceat(around[order], cuts, axis=0, dtype=np.int32)
        for b in range(0, VOCABULARY, BLOCK):
            part = total[b:b + BLOCK].astype(np.int32 if np.abs(total).max() < 1 << 30 else np.int64)
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b // BLOCK], pa.int32()), pa.array([part.itemsize], pa.int32()),
                     pa.array([part.tobytes()], pa.binary())], names=["block", "width", "sums"])
    return docs.select(text_or_empty().alias("text")).mapInArrow(run, "block int, width int, sums binary")


def _add_blocks(parts: DataFrame) -> DataFrame:
    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, width, raw in zip(*(c.to_pylist() for c in batch.columns)):
                part = np.frombuffer(raw, np.int32 if width == 4 else np.int64)
                total[block] = total[block] + part if block in total else part.astype(np.int64)
        for block, part in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([8], pa.int32()), pa.array([part.tobytes()], pa.binary())],
                names=["block", "width", "sums"])
    return parts.repartition("block").mapInArrow(run, "block int, width int, sums binary")


def word_vectors(docs: DataFrame) -> np.ndarray:
    """[VOCABULARY, DIMS] unit vectors learnt from all texts."""
    prepare(docs.sparkSession)
    out = np.zeros((VOCABULARY, DIMS))
    for row in _add_blocks(_context_sums(docs)).collect():  # VOCABULARY / BLOCK rows
        out[row.block * BLOCK:(row.block + 1) * BLOCK] = np.frombuffer(bytes(row.sums), np.int64).reshape(BLOCK, DIMS)
    out = np.sign(out) * np.log1p(np.abs(out))
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(data: np.ndarray, off: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """[documents, 2 * DIMS + 8] features; zeros for an empty text."""
    n = len(off) - 1
    total = np.zeros((n, 2 * DIMS + 8))
    for ids, length, cls, row in tokens(data, off):
        for lo in range(0, len(ids), 1 << 16):
            w, ln, c, r = (x[lo:lo + (1 << 16)] for x in (ids, length, cls, row))
            v = vectors[w]
            other = np.zeros((len(w), 8), dtype=np.float32)
            other[:, 0] = 1
            other[:, 1] = c == 2
            other[:, 2] = ln
            other[:, 3] = ln * (c == 2)
            other[:, 7] = np.square(ln)
            if len(w) > 1:
                same = r[1:] == r[:-1]
                other[1:, 4] = same & (w[1:] == w[:-1])
                other[1:, 5] = np.einsum("ij,ij->i", v[1:], v[:-1]) * same
                other[1:, 6] = same & (c[1:] == 2) & (c[:-1] == 1)
            cuts = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
            total[r[cuts]] += np.hstack([np.add.reduceat(x, cuts, axis=0) for x in (v, v * v, other)])
    count = np.maximum(total[:, 2 * DIMS:2 * DIMS + 1], 1)
    out = total / count
    out[:, DIMS:2 * DIMS] = np.sqrt(np.maximum(out[:, DIMS:2 * DIMS] - out[:, :DIMS] ** 2, 0))
    out[:, 2 * DIMS] = np.log1p(total[:, 2 * DIMS])
    out[:, 2 * DIMS + 7] = np.log1p(out[:, 2 * DIMS + 7])
    return out.astype(np.float32)


def document_features(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """(doc_id, features: float32 array as bytes)."""
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                f = pooled(*utf8(part.column(1)), vectors)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in f], pa.binary())],
                                                 names=["doc_id", "features"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(
        run, "doc_id long, features binary")


class Network:
    """Two layers (tanh, then one logit) trained by Adam, and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (0.0, 1.0)
        self.t, self.flat = 1.0, None
        if len(y) < 20 or y.min() == y.max():  # nothing to learn from: the base rate with one pseudo-row of each label
            self.flat = float((y.sum() + 1) / (len(y) + 2))
            return
        z = (x - self.mean) / self.scale
        fold = rng.permutation(len(y))
        held, fold = fold[:len(y) // 5], fold[len(y) // 5:]
        self.p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden),
                  rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0
        for epoch in range(epochs):
            rate = 0.005 * (1 - epoch / epochs) + 1e-4
            for rows in np.array_split(rng.permutation(fold), max(1, len(fold) // 128)):
                a = np.tanh(z[rows] @ self.p[0] + self.p[1])
                e = (1 / (1 + np.exp(-(a @ self.p[2] + self.p[3]))) - y[rows]) / len(rows)
                back = np.outer(e, self.p[2]) * (1 - a * a)
                grads = [z[rows].T @ back + 1e-4 * self.p[0], back.sum(0), a.T @ e + 1e-4 * self.p[2], e.sum(keepdims=True)]
                step += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.p[i] -= rate * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
        logit = self.logits(x[held])
        loss = lambda t: np.mean(np.logaddexp(0, np.where(y[held] == 1, -logit, logit) / t))
        self.t = min(np.geomspace(0.25, 8, 61), key=loss)

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(x), self.flat)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.t, -500, 500)))


def training_rows(features: DataFrame, labels: DataFrame, label: str, usable, limit: int):
    """At most ``limit`` labelled rows as (features, labels): the first in a hash order."""
    known = labels.filter(F.col(label).isNotNull() & usable).select(
        F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("_label"))
    labelled = features.join(known, F.col("doc_id") == F.col("_id")).select("doc_id", "_label", "features")
    rows = first_by_hash(labelled, "doc_id", limit).collect()
    x = np.stack([np.frombuffer(bytes(r.features), np.float32) for r in rows]) if rows else np.zeros((0, 1), np.float32)
    return x.astype(np.float64), np.array([r._label for r in rows], dtype=np.float64)


def remainder(column, n: int):
    """crc32 of the id's decimal text modulo n (null for a null id)."""
    return F.crc32(column.cast("string").cast("binary")) % n


def classify_quality(docs: DataFrame, labels: DataFrame, usable, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, score) of every document; ``usable`` is the condition on ``labels`` that marks
    the rows to learn from.

    Null and empty texts get the score of a text without words.  Null labels and labels of
    unknown documents are not used; without labels of both kinds all documents get the base
    rate.  Repeated rows are scored alike; ties and other columns have no influence; an empty
    table gives no rows.
    """
    features = written(document_features(docs, word_vectors(docs)), "quality")
    model = Network(*training_rows(features, labels, "quality", usable, train_rows))

    def run(batches):
        for batch in batches:
            raw = batch.column(1).to_pylist()
            x = np.stack([np.frombuffer(r, np.float32) for r in raw]).astype(np.float64) if raw else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])
    return features.mapInArrow(run, "doc_id long, score double")


def op2_quality(spark, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    held = remainder(F.col("doc_id"), 4) == 2
    scored = classify_quality(table(spark, sf_dir, "documents"), labels, remainder(F.col("doc_id"), 4) != 2)
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score",
                         F.when(F.col("score") >= KEEP, 1).otherwise(0).alias("predicted"))
