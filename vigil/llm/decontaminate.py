"""Benchmark decontamination by latent semantic retrieval.

Passages (``PASSAGE`` words every ``STRIDE`` words, over whole texts) are TF-IDF vectors over
hashed words.  A distributed randomised SVD gives their latent space: the tasks add up
``A' (A W)`` for a random ``W``, block by block, that is one power step from ``W``, and a QR of the
small sum is the basis (the range of the singular vectors; their values are not needed).  Each
passage is compared by cosine with all passages of the benchmark (a stated query set, in
blocks), unless less than ``GATE`` of its squared TF-IDF length lies on words of the benchmark;
a passage over ``COSINE`` that has ``SHARED`` of its words in the item makes its (document, item)
a candidate.  The three bounds follow from the share of an item's words that a paraphrase keeps,
with a margin for passages that keep fewer, so that acceptance is left to the check.  Candidates are
checked on the words around the passage: the longest common subsequence with the item must
cover ``COVER`` of the item's words, or, for a paraphrase, ``PARAPHRASE`` of them while the
item's last ``ANSWER`` words, its answer, appear in order within the text found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import U64, mix64, prepare, table, text_or_empty, utf8, words, written

VOCABULARY = 1 << 14
RANK = 64
PASSAGE, STRIDE = 16, 4
ITEM_STRIDE = 4
KNOWN_BITS = 22
COVER, PARAPHRASE, ANSWER = 0.8, 0.6, 3
COSINE, GATE, SHARED = PARAPHRASE - 0.05, PARAPHRASE - 0.2, PARAPHRASE - 0.25
BLOCK = 256


def buckets(h: np.ndarray) -> np.ndarray:
    return (h >> U64(64 - VOCABULARY.bit_length() + 1)).astype(np.int64)


def passages(counts: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, number of words) of the passages of consecutive texts; the last
    passage of a text ends with its last word."""
    more = np.maximum(counts - PASSAGE, 0)
    number = np.where(counts > 0, 1 + -(-more // stride), 0)
    doc = np.repeat(np.arange(len(counts)), number)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
    start = np.minimum(k * stride, more[doc])
    return doc, start + (np.cumsum(counts) - counts)[doc], np.minimum(counts, PASSAGE)[doc]


def _grid(first: np.ndarray, length: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    at = first[:, None] + np.arange(PASSAGE)
    inside = np.arange(PASSAGE) < length[:, None]
    return np.minimum(at, max(total - 1, 0)), inside


def _weights(ids: np.ndarray, inside: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = idf[ids] * inside
    return w / np.maximum(np.sqrt(np.square(w).sum(1, keepdims=True)), 1e-9)


def _sum_blocks(parts: DataFrame) -> DataFrame:
    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(*(c.to_pylist() for c in batch.columns)):
                part = np.frombuffer(raw, np.float64)
                total[block] = total[block] + part if block in total else part
        for block, part in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part.tobytes()], pa.binary())],
                                             names=["block", "sums"])
    return parts.repartition("block").mapInArrow(run, "block int, sums binary")


def _summed(docs: DataFrame, width: int, add) -> np.ndarray:
    """[VOCABULARY, width] sums over all texts; ``add(total, hashes, counts)`` handles a batch."""
    def run(batches):
        total = np.zeros((VOCABULARY, width))
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                add(total, *words(*utf8(batch.slice(lo, 512).column(0))))
        for b in range(0, VOCABULARY, BLOCK):
            if total[b:b + BLOCK].any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b // BLOCK], pa.int32()), pa.array([total[b:b + BLOCK].tobytes()], pa.binary())],
                    names=["block", "sums"])
    parts = docs.select(text_or_empty().alias("text")).mapInArrow(run, "block int, sums binary")
    out = np.zeros((VOCABULARY, width))
    for row in _sum_blocks(parts).collect():  # VOCABULARY / BLOCK rows
        out[row.block * BLOCK:(row.block + 1) * BLOCK] = np.frombuffer(bytes(row.sums)).reshape(BLOCK, width)
    return out


def inverse_frequency(docs: DataFrame) -> np.ndarray:
    """Squared IDF (common words count for little) over all passage-sized pieces: words
    counted, each ``PASSAGE`` words a piece."""
    def add(total, h, counts):
        total[:, 0] += np.bincount(buckets(h), minlength=VOCABULARY)
    n = _summed(docs, 1, add)[:, 0]
    pieces = max(1.0, n.sum() / PASSAGE)
    return np.square(np.log((pieces + 1) / (np.minimum(n, pieces) + 0.5)).clip(0)).astype(np.float32)


def latent_basis(docs: DataFrame, idf: np.ndarray) -> np.ndarray:
    """[VOCABULARY, RANK] orthonormal basis of a randomised SVD of all passages without overlap, so
    that every word of every text takes part (the last passage of a text may repeat some)."""
    rng = np.random.default_rng(17)
    # the last row stands for no word, behind the end of a short passage
    weight = np.append(idf, np.float32(0))
    random = rng.standard_normal((VOCABULARY, RANK), dtype=np.float32) * idf[:, None]
    random = np.concatenate((random, np.zeros((1, RANK), np.float32)))

    def add(total, h, counts):
        ids = buckets(h)
        _, first, length = passages(counts, PASSAGE)
        for lo in range(0, len(first), 8192):
            at, inside = _grid(first[lo:lo + 8192], length[lo:lo + 8192], len(ids))
            g = np.ascontiguousarray(np.where(inside, ids[at], VOCABULARY).T)
            # a weight is idf / norm: the sum first, then the norm once a passage and idf once a word
            z, row = np.zeros((g.shape[1], RANK), np.float32), np.empty((g.shape[1], RANK), np.float32)
            square = np.zeros(g.shape[1])
            for words_at in g:
                z += np.take(random, words_at, axis=0, out=row, mode="clip")
                square += np.square(weight[words_at], dtype=np.float64)
            z = np.ascontiguousarray((z / np.maximum(square, 1e-18)[:, None]).T)
            flat = g.ravel()
            for r in range(RANK):
                total[:, r] += idf * np.bincount(flat, np.tile(z[r], PASSAGE), VOCABULARY + 1)[:VOCABULARY]
    y = _summed(docs, RANK, add)
    q, _ = np.linalg.qr(y)
    return q.astype(np.float32)


class Retrieval:
    """The benchmark's passages in the latent space; picklable."""

    def __init__(self, items: list[tuple[int, str]], idf: np.ndarray, basis: np.ndarray):
        self.idf, self.basis = idf, basis
        col = pa.array([t or "" for _, t in items], pa.string())
        h, counts = words(*utf8(col))
        self.ids = np.array([i for i, _ in items], dtype=np.int64)
        self.words = np.split(h, np.cumsum(counts)[:-1]) if len(items) else []
        self.known = np.unique(h >> U64(64 - KNOWN_BITS)).astype(np.int64)
        #: names of the pairs of an item and a word of it
        self.held = np.unique(self._pairs(np.repeat(np.arange(len(items)), counts), h))
        owner, first, length = passages(counts, ITEM_STRIDE)
        self.owner = owner
        self.latent = self.project(buckets(h), first, length) if len(h) else np.zeros((0, RANK), np.float32)

    @staticmethod
    def _pairs(item: np.ndarray, word: np.ndarray) -> np.ndarray:
        return mix64(word ^ mix64(item.astype(np.uint64) + U64(0x9E37)))

    def _sharing(self, h: np.ndarray, first: np.ndarray, length: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Whether the passage has ``SHARED`` of its words in the item."""
        at, inside = _grid(first, length, len(h))
        names = self._pairs(np.broadcast_to(item[:, None], at.shape), h[at])
        place = np.minimum(np.searchsorted(self.held, names), len(self.held) - 1)
        return ((self.held[place] == names) & inside).sum(1) >= SHARED * length

    def project(self, ids, first, length) -> np.ndarray:
        at, inside = _grid(first, length, len(ids))
        g = ids[at]
        z = np.matmul(_weights(g, inside, self.idf)[:, None, :], self.basis[g])[:, 0]
        return (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def candidates(self, h: np.ndarray, counts: np.ndarray):
        """Yield (document, first word, item) over the cosine threshold, one a passage and item."""
        if not len(h) or not len(self.owner):
            return
        ids = buckets(h)
        known = np.zeros(1 << KNOWN_BITS, dtype=bool)
        known[self.known] = True
        square = np.square(self.idf[ids], dtype=np.float64)
        doc, first, length = passages(counts)
        whole, part = (np.concatenate(([0.0], np.cumsum(x)))
                       for x in (square, square * known[(h >> U64(64 - KNOWN_BITS)).astype(np.int64)]))
        near = part[first + length] - part[first] >= GATE * (whole[first + length] - whole[first])
        doc, first, length = doc[near], first[near], length[near]
        for lo in range(0, len(doc), 2048):
            z = self.project(ids, first[lo:lo + 2048], length[lo:lo + 2048])
            for b in range(0, len(self.owner), 4096):
                r, c = np.nonzero(z @ self.latent[b:b + 4096].T >= COSINE)
                pair = np.sort((r << 32) | self.owner[b + c])
                pair = pair[np.concatenate(([True], pair[1:] != pair[:-1]))] if len(pair) else pair
                i, j = lo + (pair >> 32), pair & 0xFFFFFFFF
                near = self._sharing(h, first[i], length[i], j)
                yield from zip(doc[i[near]].tolist(), first[i[near]].tolist(), j[near].tolist())

    def check(self, text: np.ndarray, at: int, item: int):
        """(words of the item in the longest common subsequence, answer found) around word ``at``."""
        own = self.words[item]
        near = text[max(0, at - len(own)):at + PASSAGE + len(own)]
        common = len(np.intersect1d(near, own))
        if common < PARAPHRASE * len(np.unique(own)):
            return 0, False
        lengths = np.zeros(len(own) + 1, dtype=np.int32)
        for w in near:  # one row of the table a word, vectorised over the item
            take = np.concatenate(([0], lengths[:-1] + (own == w)))
            lengths = np.maximum.accumulate(np.maximum(lengths, take))
        tail = own[-ANSWER:]
        k = 0
        for w in near:
            if k < len(tail) and w == tail[k]:
                k += 1
        return int(lengths[-1]), k == len(tail)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, lcs, item_words, answer) of each document and benchmark item found in it.

    benchmark is the stated query set and is held by every task; it must stay small (its size
    is checked against ``MAX_ITEMS``).  Null and empty texts and items match nothing; repeated
    rows of ``docs`` give repeated rows; repeated items are separate items; an empty table
    gives no rows; other columns are ignored.
    """
    prepare(docs.sparkSession)
    found = benchmark.select(F.col("item_id").cast("long"), text_or_empty().alias("text")).filter("item_id is not null")
    items = sorted((r[0], r[1]) for r in found.limit(MAX_ITEMS + 1).collect())
    if len(items) > MAX_ITEMS:
        raise ValueError(f"more than {MAX_ITEMS} benchmark items: call matches() for parts of the benchmark")
    idf = inverse_frequency(docs)
    search = Retrieval(items, idf, latent_basis(docs, idf))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                h, counts = words(*utf8(part.column(1)))
                begin = np.concatenate(([0], np.cumsum(counts)))
                best: dict[tuple[int, int], tuple[int, bool]] = {}
                for d, at, item in search.candidates(h, counts):
                    size = len(search.words[item])
                    if best.get((d, item), (0, False))[0] == size:
                        continue
                    hit = search.check(h[begin[d]:begin[d + 1]], at - begin[d], item)
                    if hit[0] >= COVER * size or (hit[1] and hit[0] >= PARAPHRASE * size):
                        best[d, item] = max(best.get((d, item), hit), hit)
                keys = sorted(best)
                ids = part.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[d] for d, _ in keys], pa.int64()), pa.array([search.ids[i] for _, i in keys], pa.int64()),
                     pa.array([best[k][0] for k in keys], pa.int64()),
                     pa.array([len(search.words[i]) for _, i in keys], pa.int64()),
                     pa.array([best[k][1] for k in keys], pa.bool_())],
                    names=["doc_id", "item_id", "lcs", "item_words", "answer"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(
        run, "doc_id long, item_id long, lcs long, item_words long, answer boolean")


#: items that a task holds at once
MAX_ITEMS = 20_000


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a benchmark item, columns as given (a null doc_id stays)."""
    hits = written(matches(docs, benchmark).select("doc_id").distinct(), "leaks")
    return docs.join(hits.withColumnRenamed("doc_id", "_leak"), F.col("doc_id").cast("long") == F.col("_leak"), "left_anti")


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    """The (document, item) pairs found: every row is a leak."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
