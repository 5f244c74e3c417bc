"""Exact substring dedup by merged Burrows-Wheeler transforms.

Every byte covered by a ``LENGTH``-byte string that also starts anywhere else is removed.

1. Equal texts become one text with a weight, in a bucketed table.
2. A window (``LENGTH`` bytes from a start) is named by the smallest hash of its ``GRAM``-byte
   grams, so equal windows meet under one key.  Keys whose gram occurs once in the corpus have
   no repeated window; the rest is cut into pieces, runs of starts under one key.
3. Equal pieces become one with a weight.  The different pieces of a key are strings of one
   collection: shards of it get their suffix order and transform, the shards' transforms are
   merged by refining the interleave, eight bytes a round, until blocks of equal prefixes have
   ``LENGTH`` bytes; a block of total weight two or more is a repeated interval.  Suffixes are
   sorted within a shard only.
4. A key with more bytes of different pieces than ``MERGE_BYTES`` is dealt out anew by finer
   keys that are functions of the window too: the distance of the gram from the start in steps
   of ``WIDTHS``, and the bytes all windows of that step share; the last step is the window
   itself, whose pieces are all equal.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import (U64, forget, mix64, prepare, range_hash, scratch_path, table, text_or_empty, utf8,
                              written)

LENGTH, GRAM = 200, 32
RUN = 256
EDGE = 80
STEP = 8
WIDTHS = (32, 4, 1)
MERGE_BYTES, SHARD_BYTES = 1 << 21, 1 << 19
CHUNK = 1 << 20
_OTHER = np.random.default_rng(3).permutation(256).astype(np.uint8)
_PIECE = "tid long, tid2 long, start long, n int, w long, key long, h1 long, h2 long, self boolean, seg binary"


def sliding(values: np.ndarray, width: int, best, fill) -> np.ndarray:
    """best (minimum or maximum) of every ``width`` neighbours, by prefixes and suffixes of blocks."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, values.dtype)
    full = np.full(-(-len(values) // width) * width, fill, dtype=values.dtype)
    full[:len(values)] = values
    grid = full.reshape(-1, width)
    left = best.accumulate(grid, axis=1).ravel()
    right = best.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(right[:n], left[width - 1:width - 1 + n])


def gram_hashes(data: np.ndarray) -> np.ndarray:
    at = np.arange(max(0, len(data) - GRAM + 1))
    return range_hash(data, at, at + GRAM)


def scan(data: np.ndarray, off: np.ndarray):
    """(gram hashes, key of each start, whether a window starts there, selected gram positions)."""
    h = gram_hashes(data)
    span = LENGTH - GRAM + 1
    key = sliding(h, span, np.minimum, ~U64(0))
    ok = np.zeros(len(key), dtype=bool)
    change = np.zeros(len(data) + 1, dtype=np.int64)
    long = np.diff(off) >= LENGTH
    np.add.at(change, off[:-1][long], 1)
    np.add.at(change, off[1:][long] - LENGTH + 1, -1)
    ok[:] = np.cumsum(change)[:len(key)] > 0
    known = np.where(ok, key, U64(0))
    padded = np.concatenate((np.zeros(span - 1, np.uint64), known, np.zeros(max(0, len(h) - len(key)), np.uint64)))
    top = sliding(padded, span, np.maximum, U64(0))[:len(h)]
    return h, key, ok, np.flatnonzero((h == top) & (top > 0)) if len(h) else np.zeros(0, np.int64)


def _pieces_of_batch(batch):
    """(row, first byte of the row's part, data, offsets) of parts of about CHUNK bytes; a long text is
    taken in parts that overlap by LENGTH - 1 bytes, so that each window lies in exactly one."""
    data, off = utf8(batch)
    row, n = 0, len(off) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(off, off[row] + CHUNK, side="right")) - 1)
        if end > row + 1 or off[row + 1] - off[row] <= 2 * CHUNK:
            yield np.arange(row, end), np.zeros(end - row, np.int64), data[off[row]:off[end]], off[row:end + 1] - off[row]
        else:
            size = int(off[row + 1] - off[row])
            for a in range(0, max(1, size - LENGTH + 1), CHUNK):
                part = data[off[row] + a:off[row] + min(size, a + CHUNK + LENGTH - 1)]
                yield np.array([row]), np.array([a]), part, np.array([0, len(part)])
        row = end


def _runs(key: np.ndarray, ok: np.ndarray, off: np.ndarray):
    """Start, length of the runs of starts under one key, at most RUN long, and their row."""
    n = len(key)
    cut = np.ones(n, dtype=bool)
    cut[1:] = (key[1:] != key[:-1]) | (ok[1:] != ok[:-1])
    cut[off[:-1][off[:-1] < n]] = True
    first = np.flatnonzero(cut)
    if not len(first):
        return first, first, first
    size = np.diff(np.append(first, n))
    parts = -(-size // RUN)
    start = np.repeat(first, parts) + RUN * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    stop = np.append(start[1:], n)
    use = ok[start]
    start, length = start[use], (stop - start)[use]
    return start, length, np.searchsorted(off, start, side="right") - 1


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def selected_grams(texts: DataFrame) -> DataFrame:
    """(tid, key, w) of every gram that names some window."""
    def run(batches):
        for batch in batches:
            tid, w = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for rows, _, data, off in _pieces_of_batch(batch.column(2)):
                h, _, _, at = scan(data, off)
                r = rows[np.searchsorted(off, at, side="right") - 1]
                yield pa.RecordBatch.from_arrays([pa.array(tid[r]), pa.array(_signed(h[at])), pa.array(w[r])],
                                                 names=["tid", "key", "w"])
    return texts.select("tid", "w", "text").mapInArrow(run, "tid long, key long, w long")


def _piece_batch(tid, tid2, start, n, w, key, self_, data, a) -> pa.RecordBatch:
    end = a + n + LENGTH - 1
    h1, h2 = range_hash(data, a, end), range_hash(_OTHER[data], a, end)
    raw = data.tobytes()
    seg = pa.array([raw[i:j] for i, j in zip(a.tolist(), end.tolist())], pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(tid), pa.array(tid2), pa.array(start), pa.array(n.astype(np.int32)), pa.array(w), pa.array(key),
         pa.array(_signed(h1)), pa.array(_signed(h2)), pa.array(self_), seg],
        names=["tid", "tid2", "start", "n", "w", "key", "h1", "h2", "self", "seg"])


def cut_pieces(texts: DataFrame) -> DataFrame:
    """The pieces under the wanted ``keys`` of each text."""
    def run(batches):
        for batch in batches:
            tid, tid2, w = (batch.column(i).to_numpy() for i in range(3))
            wanted = batch.column(4)
            for rows, at, data, off in _pieces_of_batch(batch.column(3)):
                h, key, ok, sel = scan(data, off)
                start, n, row = _runs(key, ok, off)
                name = lambda k, r: mix64(k + mix64(r.astype(np.uint64) + U64(1)))
                lists = [wanted[int(r)].values.to_numpy().view(np.uint64) for r in rows]
                keep = np.isin(name(key[start], row), name(np.concatenate(lists), np.repeat(np.arange(len(rows)), [len(x) for x in lists])))
                start, n, row = start[keep], n[keep], row[keep]
                if not len(start):
                    continue
                seen, often = np.unique(name(h[sel], np.searchsorted(off, sel, side="right") - 1), return_counts=True)
                twice = np.isin(name(key[start], row), seen[often > 1])
                own = rows[row]
                yield _piece_batch(tid[own], tid2[own], start - off[row] + at[row], n, w[own], _signed(key[start]), twice, data, start)
    return texts.select("tid", "tid2", "w", "text", "keys").mapInArrow(run, _PIECE)


def finer_pieces(pieces: DataFrame, width: int) -> DataFrame:
    """The pieces cut and named by the distance of the gram from the start, in steps of ``width``."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                tid, tid2, start, n, w, key = (batch.column(c)[i].as_py() for c in range(6))
                data = np.frombuffer(batch.column(9)[i].as_py(), np.uint8)
                gram = np.flatnonzero(_signed(gram_hashes(data)) == batch.column(10)[i].as_py())
                p = np.arange(n)
                a = gram[np.searchsorted(gram, p)]
                r = (a - p) // width
                cut = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (r[1:] != r[:-1]))))
                size = np.diff(np.append(cut, n))
                lo, hi = a[cut] - r[cut] * width, a[cut] + LENGTH - (r[cut] * width + width - 1)
                core = range_hash(data, np.maximum(lo, 0), np.minimum(hi, len(data)))
                fine = mix64(core + mix64(r[cut].astype(np.uint64) + U64(key & (2**64 - 1))))
                one = np.ones(len(cut), dtype=np.int64)
                yield _piece_batch(tid * one, tid2 * one, start + cut, size, w * one, _signed(fine),
                                   np.full(len(cut), width > 1 and len(gram) > 1), data, cut)
    return pieces.mapInArrow(run, _PIECE)


def _order(symbol: np.ndarray, largest: int) -> np.ndarray:
    """Stable order of non-negative integers, by radix."""
    order = np.argsort((symbol & 0xFFFF).astype(np.uint16), kind="stable")
    if largest > 0xFFFF:
        order = order[np.argsort((symbol >> 16).astype(np.uint16)[order], kind="stable")]
    return order


class Shard:
    """Suffix order and transform (the STEP bytes before each suffix) of some strings.

    Suffixes shorter than STEP come first, each different from all others."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        size = np.diff(off) + 1  # one more suffix a string, the empty one
        string = np.repeat(np.arange(len(size)), size)
        begin = np.cumsum(size) - size
        inside = np.arange(size.sum()) - begin[string]
        left = size[string] - 1 - inside
        padded = np.concatenate((data, np.zeros(STEP, np.uint8)))
        at = off[string] + inside
        gram = np.zeros(len(at), dtype=np.uint64)
        for i in range(STEP):
            gram = (gram << U64(8)) | padded[np.minimum(at + i, len(padded) - 1)]
        self.short = left < STEP
        self.symbols, code = np.unique(gram[~self.short], return_inverse=True)
        shorts = int(self.short.sum())
        rank = np.empty(len(at), dtype=np.int64)
        rank[self.short] = np.arange(shorts)
        rank[~self.short] = code + shorts
        reach = STEP
        while True:
            following = np.where(left >= reach, rank[np.minimum(np.arange(len(at)) + reach, len(at) - 1)], 0)
            pair = rank * (len(at) + 1) + following
            order = np.argsort(pair, kind="stable")
            sorted_ = pair[order]
            new = np.empty_like(rank)
            new[order] = np.cumsum(np.concatenate(([0], (sorted_[1:] != sorted_[:-1]).astype(np.int64))))
            rank, reach = new, reach * 2
            if len(order) == 0 or rank[order[-1]] == len(order) - 1:
                break
        self.suffixes, self.string, self.inside, self.shorts = order, string, inside, shorts
        before = inside[order] >= STEP
        self.gram = np.where(before, gram[np.maximum(order - STEP, 0)], U64(0))
        self.before = before


def merged_blocks(shards: list[Shard]) -> tuple[np.ndarray, np.ndarray]:
    """(shard of each merged suffix, its block of equal LENGTH-byte prefixes)."""
    alphabet = np.unique(np.concatenate([s.symbols for s in shards]))
    codes = [np.where(s.before, np.searchsorted(alphabet, s.gram) + 1, 0) for s in shards]
    z = np.repeat(np.arange(len(shards), dtype=np.uint16), [len(s.suffixes) for s in shards])
    shorts = np.repeat(np.arange(len(shards), dtype=np.uint16), [s.shorts for s in shards])
    n, m = len(z), len(shorts)
    block = np.zeros(n, dtype=np.int64)
    symbol = np.empty(n, dtype=np.int64)
    for _ in range(LENGTH // STEP):
        for i, c in enumerate(codes):
            symbol[z == i] = c
        order = _order(symbol, len(alphabet))[n - (n - m):]  # those without bytes before them come first
        s, b = symbol[order], block[order]
        new = np.ones(n, dtype=bool)
        new[m + 1:] = (s[1:] != s[:-1]) | (b[1:] != b[:-1])
        z = np.concatenate((shorts, z[order]))
        block = np.cumsum(new)
    return z, block


def repeated_starts(segs: list[bytes], n: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
    """For each string, which of its first ``n`` starts have a LENGTH-byte string that occurs again
    (total weight two or more) among all those starts.

    A string of weight two has repeats only.  Of the others, starts whose first and last EDGE
    bytes no other start shares have none; the transforms decide the rest."""
    n, w = np.asarray(n), np.asarray(w)
    size = np.array([len(s) for s in segs])
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(segs)), n)
    first = np.cumsum(n) - n
    start = np.arange(len(owner)) - first[owner]
    at = begin[owner] + start
    data = np.frombuffer(b"".join(segs), np.uint8)
    edges = range_hash(data, at, at + EDGE) * U64(3) + range_hash(data, at + LENGTH - EDGE, at + LENGTH)
    _, same, count = np.unique(edges, return_inverse=True, return_counts=True)
    open_ = (count >= 2) & (np.bincount(same, weights=w[owner] == 1, minlength=len(count)) > 0)
    open_ = open_[same]
    mark = w[owner] >= 2
    if open_.any():
        some = np.flatnonzero(open_)
        of, k = np.unique(owner[some], return_index=True)
        lo, hi = start[some[k]], start[some[np.append(k[1:], len(some)) - 1]]
        cut = [segs[i][a:b + LENGTH] for i, a, b in zip(of.tolist(), lo.tolist(), hi.tolist())]
        for i, a, found in zip(of.tolist(), lo.tolist(), _merged_starts(cut, hi - lo + 1, w[of])):
            mark[first[i] + a:first[i] + a + len(found)] |= found
    return np.split(mark, np.cumsum(n)[:-1])


def _merged_starts(segs: list[bytes], n: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
    size = np.array([len(s) for s in segs])
    cuts = np.flatnonzero(np.diff(np.concatenate(([-1], np.cumsum(size) // SHARD_BYTES))) > 0)
    cuts = np.unique(np.concatenate(([0], cuts, [len(segs)])))
    shards = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        shards.append(Shard(np.frombuffer(b"".join(segs[a:b]), np.uint8), np.concatenate(([0], np.cumsum(size[a:b])))))
    z, block = merged_blocks(shards)
    owner, start = np.empty(len(z), dtype=np.int64), np.empty(len(z), dtype=np.int64)
    for i, s in enumerate(shards):
        here = z == i
        owner[here] = s.string[s.suffixes] + cuts[i]
        start[here] = s.inside[s.suffixes]
    ok = start < n[owner]
    total = np.bincount(block[ok], weights=w[owner[ok]], minlength=int(block[-1]) + 1 if len(block) else 1)
    hit = ok & (total[block] >= 2)
    first = np.cumsum(n) - n
    mark = np.zeros(int(n.sum()), dtype=bool)
    mark[first[owner[hit]] + start[hit]] = True
    return np.split(mark, np.cumsum(n)[:-1])


def _intervals(mark: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.diff(np.concatenate(([0], mark.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()


def _merge(classes: DataFrame) -> DataFrame:
    """(key, h1, h2, lo, hi): the repeated runs of starts of each different piece.  All pieces of a
    key come together, as many keys at once as fit ``MERGE_BYTES``."""
    def run(batches):
        rows: list[tuple] = []
        size = 0

        def flush():
            marks = repeated_starts([r[5] for r in rows], np.array([r[3] for r in rows]), np.array([r[4] for r in rows]))
            out = [(*r[:3], a, b) for r, m in zip(rows, marks) for a, b in zip(*_intervals(m))]
            cols = list(zip(*out)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.int32()] * 2)],
                                              names=["key", "h1", "h2", "lo", "hi"])
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= MERGE_BYTES and r[0] != rows[-1][0]:
                    yield flush()
                    rows, size = [], 0
                rows.append(r)
                size += len(r[5])
        if rows:
            yield flush()
    ordered = classes.select("key", "h1", "h2", "n", "w", "seg").repartition("key").sortWithinPartitions("key", "h1", "h2")
    return ordered.mapInArrow(run, "key long, h1 long, h2 long, lo int, hi int")


def repeated_runs(pieces: DataFrame) -> DataFrame:
    """(tid, tid2, lo, hi): runs of starts whose window occurs elsewhere too."""
    found = None
    for width in (*WIDTHS, None):
        classes = pieces.groupBy("key", "h1", "h2").agg(F.first("seg").alias("seg"), F.first("n").alias("n"),
                                                        F.sum("w").alias("w"), F.max("self").alias("self"))
        classes = written(classes, "classes")
        keys = written(classes.groupBy("key").agg(F.count("*").alias("different"), F.sum(F.length("seg")).alias("bytes"),
                                                  F.max("self").alias("twice"), F.max("w").alias("most")), "keys")
        alone = (F.col("different") == 1) & ~F.col("twice")
        large = ~alone & (F.col("bytes") > MERGE_BYTES)
        whole = keys.filter(alone & (F.col("most") > 1)).select("key")
        runs = _merge(classes.join(keys.filter(~alone & ~large).select("key"), "key"))
        own = pieces.select("tid", "tid2", "start", "n", "key", "h1", "h2")
        out = (own.join(written(runs, "runs"), ["key", "h1", "h2"])
                  .select("tid", "tid2", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))
                  .unionAll(own.join(whole, "key").select("tid", "tid2", F.col("start").alias("lo"),
                                                          (F.col("start") + F.col("n")).alias("hi"))))
        found = out if found is None else found.unionAll(out)
        rest = keys.filter(large).select("key")
        if width is None or rest.isEmpty():
            return found
        if "gram" not in pieces.columns:
            pieces = pieces.withColumn("gram", F.col("key"))
        fine = finer_pieces(pieces.join(rest, "key").select(*[c.split()[0] for c in _PIECE.split(", ")], "gram"), width)
        # a finer piece keeps the gram of the piece it comes from
        gram = pieces.join(rest, "key").select("tid", "tid2", F.col("start").alias("s0"), F.col("n").alias("n0"), "gram")
        fine = written(fine, "fine")
        pieces = written(fine.join(gram, ["tid", "tid2"]).filter("start >= s0 and start < s0 + n0").drop("s0", "n0"), "pieces")
    return found


def _without(texts: DataFrame) -> DataFrame:
    """(tid, tid2, n_removed, n_spans, kept_sha256, spans) of texts with their repeated runs."""
    def run(batches):
        for batch in batches:
            out = []
            for tid, tid2, text, lo, hi in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
                spans: list[list[int]] = []
                for a, b in sorted(zip(lo, hi)):
                    b += LENGTH - 1
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                digest, at = hashlib.sha256(), 0
                for a, b in spans:
                    digest.update(raw[at:a])
                    at = b
                digest.update(raw[at:])
                out.append((tid, tid2, sum(b - a for a, b in spans), len(spans), digest.hexdigest(),
                            [{"start": a, "stop": b} for a, b in spans]))
            cols = list(zip(*out)) or [[]] * 6
            span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            types = [pa.int64()] * 4 + [pa.string(), span]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             names=["tid", "tid2", "n_removed", "n_spans", "kept_sha256", "spans"])
    return texts.select("tid", "tid2", "text", "lo", "hi").mapInArrow(
        run, "tid long, tid2 long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte ranges removed).

    Null and empty texts, and texts under ``LENGTH`` bytes, lose nothing.  Repeated rows are
    separate documents: a text of ``LENGTH`` bytes or more that occurs twice is removed whole,
    under the same doc_id too.  An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    tid, tid2 = F.xxhash64("text").alias("tid"), F.xxhash64(F.lit(1), "text").alias("tid2")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"vigil_texts_{uuid.uuid4().hex}"
    try:
        # the files lie in the shared folder, wherever the warehouse is
        (own.filter(F.octet_length("text") >= LENGTH).select(tid, tid2, "text").repartition(parts, "tid")
            .groupBy("tid", "tid2").agg(F.first("text").alias("text"), F.count("*").alias("w"))
            .write.option("compression", "zstd").option("path", scratch_path(spark, name)).bucketBy(parts, "tid").saveAsTable(name))
        texts = spark.table(name)
        grams = written(selected_grams(texts), "grams")
        often = grams.groupBy("key").agg(F.sum("w").alias("m")).filter("m > 1").select("key")
        keys = grams.join(often, "key").groupBy("tid").agg(F.collect_set("key").alias("keys"))
        pieces = written(cut_pieces(texts.join(keys, "tid")), "pieces")
        runs = repeated_runs(pieces).groupBy("tid", "tid2").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
        lost = written(_without(texts.join(runs, ["tid", "tid2"])), "spans")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        forget(spark, name)
    rows = own.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"), tid, tid2)
    return rows.join(lost, ["tid", "tid2"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "spans")


def op1_repeats(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")
