"""Ranked lexical search by hashed max-sketches.

The index has one row a document: its distinct terms with their counts and a sketch, the terms
hashed on ``COORDINATES`` places with the largest count that falls on each.  A term's impact
grows with its count, so a query's weights looked up in the sketch give an upper bound of its
score.  A batch of documents is bounded for a block of queries at once (one product of matrices);
then each query's documents are scored exactly in descending order of their bounds until the
bound falls below the k-th best score so far.  Each task keeps its k best documents a query, and
those meet in a ranking.

All scores are integers: bounds are sums of integers under 2**53 in doubles, and exact.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import prepare, table, text_or_empty, utf8, written

#: places of a sketch (a power of two)
COORDINATES = 4096
#: queries searched together, and their terms at most (the last query may go over it)
BLOCK_ITEMS, BLOCK_TERMS = 512, 200_000
#: documents bounded together
DOCUMENTS = 256
#: bytes of a text that are counted at once
PIECE = 1 << 20
#: parts of a ranking before its last step
PARTS = 32
TOP = 20
# every byte outside [0-9A-Za-z] and the multi-byte characters separates terms; A-Z become lower case
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or bytes([b]).isalnum() else 32 for b in range(256))


def term_counts(text: bytes) -> Counter:
    """Occurrences of each term of a text, counted piece by piece."""
    folded = text.translate(_FOLD)
    if len(folded) <= PIECE:
        return Counter(folded.split())
    counts: Counter = Counter()
    at = 0
    while at < len(folded):
        end = at + PIECE
        cut = folded.find(b" ", end) if end < len(folded) else -1
        cut = len(folded) if cut < 0 else cut
        counts.update(folded[at:cut].split())
        at = cut
    return counts


def coordinate(term: bytes) -> int:
    return zlib.crc32(term) & (COORDINATES - 1)


def build_index(docs: DataFrame) -> DataFrame:
    """(doc_id, n, places, peaks, terms, counts): number of terms, the sketch as places (two bytes
    each) and the largest count on each (eight bytes each), and the distinct terms, joined by
    blanks, with their counts (eight bytes each).  Documents without a term (null and empty texts
    among them) are not indexed."""
    prepare(docs.sparkSession)
    names = ["doc_id", "n", "places", "peaks", "terms", "counts"]

    def packed(values, lengths):
        """One binary value a document from its consecutive numbers."""
        ends = np.concatenate(([0], np.cumsum(lengths))) * values.dtype.itemsize
        return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, DOCUMENTS):
                part = batch.slice(lo, DOCUMENTS)
                ids, n, sizes, terms, counts, joined = [], [], [], [], [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    c = term_counts(text)
                    if c:
                        ids.append(doc_id)
                        n.append(sum(c.values()))
                        sizes.append(len(c))
                        terms.extend(c)
                        counts.extend(c.values())
                        joined.append(b" ".join(c))
                if not ids:
                    continue
                counts = np.array(counts, dtype=np.int64)
                at = np.repeat(np.arange(len(ids)), sizes) * COORDINATES + np.array([coordinate(t) for t in terms])
                order = np.argsort(at, kind="stable")
                first = np.flatnonzero(np.diff(at[order], prepend=-1))
                own = at[order][first]
                used = np.bincount(own // COORDINATES, minlength=len(ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), packed((own % COORDINATES).astype(np.uint16), used),
                     packed(np.maximum.reduceat(counts[order], first), used), pa.array(joined, pa.binary()), packed(counts, sizes)],
                    names=names)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, n long, places binary, peaks binary, terms binary, counts binary")


class Queries:
    """A block of queries against the statistics of one index (plain arrays, sent to the tasks)."""

    def __init__(self, terms: list[Counter], found: dict[bytes, int], documents: int, length: int):
        self.documents, self.length = documents, length
        self.number = {t: i for i, t in enumerate(sorted(found))}
        weight = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for t, df in found.items()}
        known = [sorted(t for t in q if t in found) for q in terms]
        #: query after query, the numbers of its terms and their weights times repeats
        self.flat = np.array([self.number[t] for k in known for t in k], dtype=np.int64)
        self.flat_weights = np.array([weight[t] * q[t] for k, q in zip(known, terms) for t in k], dtype=np.int64)
        self.ends = np.cumsum([0, *map(len, known)])
        self.places = np.unique([coordinate(t) for t in found]).astype(np.int64)
        self.on = np.full(COORDINATES, -1)
        self.on[self.places] = np.arange(len(self.places))
        self.weights = np.zeros((len(self.places), len(terms)))
        own = np.repeat(np.arange(len(terms)), np.diff(self.ends))
        on = self.on[np.array([coordinate(t) for k in known for t in k], dtype=np.int64)]
        np.add.at(self.weights, (on, own), self.flat_weights)

    def impact(self, counts: np.ndarray, n) -> np.ndarray:
        """What a document of n terms gives for a term that it holds so often."""
        m = 75 + (25 * n * self.documents) // self.length
        return (1_000_000_000 * counts) // (1000 * counts + 12 * m)

    def bounds(self, n: np.ndarray, sizes: np.ndarray, places: np.ndarray, peaks: np.ndarray) -> np.ndarray:
        """[documents, queries] upper bounds of the scores, from sketches one after another."""
        row, at = np.repeat(np.arange(len(n)), sizes), self.on[places]
        use = at >= 0
        sketch = np.zeros((len(n), len(self.places)))
        sketch[row[use], at[use]] = self.impact(peaks[use], n[row[use]])
        return sketch @ self.weights

    def scores(self, terms: list[bytes], counts: np.ndarray, n: int) -> np.ndarray:
        """Exact scores of one document for all queries."""
        held = [(self.number[t], i) for i, t in enumerate(terms) if t in self.number]
        impacts = np.zeros(len(self.number), dtype=np.int64)
        if held:
            at, i = np.array(held).T
            impacts[at] = self.impact(counts[i], n)
        sums = np.concatenate(([0], np.cumsum(impacts[self.flat] * self.flat_weights)))
        return sums[self.ends[1:]] - sums[self.ends[:-1]]


def _best(batches, queries: Queries, top: int):
    """The best documents a query of one task: (query, doc_id, score) as Arrow batches."""
    heaps: list[list[tuple]] = [[] for _ in queries.ends[1:]]  # (score, -doc_id or null last): the worst first
    floor = np.ones(len(heaps))  # the score a document has to reach: 1, then that of the worst kept
    rank = lambda d: (0, 0) if d is None else (1, -d)

    def offer(exact: np.ndarray, doc_id, wanted: np.ndarray) -> None:
        for j in wanted:
            entry = (int(exact[j]), rank(doc_id))
            if entry[0] > 0:
                if len(heaps[j]) < top:
                    heapq.heappush(heaps[j], entry)
                elif entry > heaps[j][0]:
                    heapq.heapreplace(heaps[j], entry)
                if len(heaps[j]) == top:
                    floor[j] = heaps[j][0][0]

    for batch in batches:
        for lo in range(0, batch.num_rows, DOCUMENTS):
            part = batch.slice(lo, DOCUMENTS)
            ids, n = part.column(0).to_pylist(), part.column(1).to_numpy()
            (places, off), (peaks, _) = (utf8(part.column(i)) for i in (2, 3))
            bound = queries.bounds(n, np.diff(off) // 2, places.view(np.uint16), peaks.view(np.int64))
            # the highest bounds of each query first, so that the floors rise; then what still reaches them
            rank_of = np.argsort(np.argsort(-bound, axis=0, kind="stable"), axis=0, kind="stable")
            done = np.zeros(bound.shape, dtype=bool)
            for step in (max(1, top // 4), top, len(n)):
                todo = (rank_of < step) & (bound >= floor) & ~done
                for d in np.flatnonzero(todo.any(1)):
                    wanted = np.flatnonzero((bound[d] >= floor) & ~done[d])
                    if len(wanted):
                        d = int(d)
                        exact = queries.scores(part.column(4)[d].as_py().split(b" "), np.frombuffer(part.column(5)[d].as_py(), np.int64), int(n[d]))
                        offer(exact, ids[d], wanted)
                        done[d] = True
    rows = [(j, None if r == (0, 0) else -r[1], s) for j, heap in enumerate(heaps) for s, r in heap]
    columns = zip(*rows) if rows else [()] * 3
    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64()))],
                                     names=["query", "doc_id", "score"])


def _ranked(found: DataFrame, keys: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _blocks(items: DataFrame):
    """The queries in blocks [(item_id, text)]: only one block is on the driver at a time."""
    block, size = [], 0
    for item_id, text in items.orderBy("item_id", "text").toLocalIterator():
        q = term_counts(text.encode())
        block.append((item_id, q))
        size += len(q)
        if len(block) == BLOCK_ITEMS or size >= BLOCK_TERMS:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(index: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` documents of each query: item_id, rank, doc_id, score.

    Equal scores go by ascending doc_id (null last); documents that score 0 are not found.
    Equal (item_id, text) rows are one query; with one item_id on several texts, each text is a
    query of its own under that id.  Null texts find nothing.  Repeated documents are ranked each.
    """
    spark = index.sparkSession
    stats = index.agg(F.count("*"), F.sum("n")).first()
    own = items.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text")).distinct()
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in _blocks(own) if stats[0] else ():
        vocabulary = sorted({t for _, q in block for t in q})
        asked = spark.createDataFrame([(t.decode("utf-8", "replace"),) for t in vocabulary], "term string")
        held = index.select(F.explode(F.split(F.col("terms").cast("string"), " ")).alias("term")).join(F.broadcast(asked), "term")  # a block's terms
        found = {r[0].encode(): r[1] for r in held.groupBy("term").agg(F.count("*")).collect()}
        queries = Queries([q for _, q in block], found, stats[0], stats[1])
        best = index.mapInArrow(lambda batches, q=queries: _best(batches, q, top), "query int, doc_id long, score long")
        best = _ranked(best.withColumn("part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(PARTS))), ["query", "part"], top)
        names = spark.createDataFrame([(j, item_id) for j, (item_id, _) in enumerate(block)], "query int, item_id long")
        ranks = _ranked(best, ["query"], top).join(F.broadcast(names), "query")  # a block's queries
        out = out.unionByName(written(ranks.select("item_id", "rank", "doc_id", "score"), "search-ranks"))
    return out


def op11_search(spark, sf_dir: str) -> DataFrame:
    """The 20 best documents of each benchmark item; nulls, ties and repeats as in ``search``,
    very long texts are counted in pieces, other columns are ignored, empty tables find nothing."""
    index = written(build_index(table(spark, sf_dir, "documents")), "search-index")
    return search(index, table(spark, sf_dir, "benchmark"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
ORACLE_SQL = f"""
with d as (select row_number() over () as r, doc_id, translate(coalesce(text, ''), {_LOWER}) as x from documents),
o as (select r, doc_id, unnest(regexp_extract_all(x, '{_TERM}')) as term from d),
f as (select r, doc_id, term, count(*) as tf from o group by all),
l as (select r, sum(tf)::bigint as n from f group by 1),
c as (select count(*) as docs, sum(n)::bigint as len from l),
w as (select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from f, c group by 1),
q as (select item_id, term, count(*) as qtf from (
        select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '{_TERM}')) as term from benchmark) group by all),
s as (select q.item_id, f.r, f.doc_id,
             sum(q.qtf * w.w * ((1000000000 * f.tf) // (1000 * f.tf + 12 * (75 + (25 * l.n * c.docs) // c.len))))::bigint as score
      from q join f on f.term = q.term join w on w.term = f.term join l on l.r = f.r, c group by all)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score
from s where score > 0 qualify rank <= {TOP}
"""
