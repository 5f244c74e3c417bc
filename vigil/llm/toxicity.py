"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

Both dictionaries share what zstandard learns from ordinary training windows, its entropy
tables and segments.  The toxic one ends with words whose stems toxic training texts use far more
often than ordinary ones; the ordinary one ends with the same words, their stems overwritten by
zero bytes, so that offsets agree and the compressed lengths of a window differ only by what
toxic stems save.  A stem is the
beginning of words, so that all inflections of a rare word count together.  Each text is
cut, whole, into windows at white space; the differences of its windows are pooled and a
logistic threshold, fitted on labelled rows kept apart from the dictionaries, gives the score.

Learning takes at most ``TRAIN_ROWS`` labelled documents of at most ``TRAIN_CHARS``
characters, the shared part at most ``SHARED_TEXTS`` ordinary ones of them and
``SHARED_WINDOWS`` windows, each time the first ones in a hash order.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import first_by_hash, prepare, table, text_or_empty
from vigil.llm.quality import remainder

TRAIN_ROWS = 8000
TRAIN_CHARS = 50_000
WINDOW = 256
DICTIONARY = 8192
LEVEL = 12
#: ordinary texts and windows of them that the shared part is learnt from
SHARED_TEXTS, SHARED_WINDOWS = 2000, 20_000
TAIL = 4096
#: bytes that zstandard's header of a trained dictionary (entropy tables) takes at most
HEADER = 256
#: bytes of a stem, and of a part of it that compression may find elsewhere
MATCH = 5
STEM = range(4, 13)
#: the part of a stem's words that have its whole length
KEEP = 0.9
#: a stem joins the toxic dictionary with a z value over MIN_Z and over SHARE of the largest
MIN_Z, SHARE = 4.0, 0.5
REJECT = 0.5
_WORD = re.compile(rb"[0-9a-z\x80-\xff]{3,}")


def windows(text: str, size: int = WINDOW) -> list[bytes]:
    """The lower-cased text as pieces of at most ``size`` bytes, cut before a blank if there is one."""
    raw, out, at = text.lower().encode("utf-8", "replace"), [], 0
    while at < len(raw):
        end = at + size
        if end < len(raw):
            blank = raw.rfind(b" ", at, end)
            end = blank if blank > at else end
        out.append(raw[at:end])
        at = end
    return out or [b""]


def _words(text: str) -> list[bytes]:
    return _WORD.findall(text.lower().encode("utf-8", "replace"))


def _stems(word: bytes) -> list[bytes]:
    return [word[:k] for k in STEM if k <= len(word)]


def _z(a: int, n: int, b: int, m: int) -> float:
    p = (a + b) / (n + m)
    return (a / n - b / m) / np.sqrt(p * (1 - p) * (1 / n + 1 / m) + 1e-12)


def toxic_stems(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """Stems typical of toxic texts, the most typical first, none the beginning of another.

    A stem counts as often as toxic texts have it, but at most once for each different word
    before it, so that copies of one text do not count.  Only stems that toxic texts have are
    counted in ordinary ones.
    """
    texts: Counter = Counter()
    for t in toxic:
        texts.update({s for w in set(_words(t)) for s in _stems(w)})
    known = {s for s, k in texts.items() if k > 2}
    before: dict[bytes, set[bytes]] = {s: set() for s in known}
    for t in toxic:
        last = b""
        for w in _words(t):
            for s in _stems(w):
                if s in known:
                    before[s].add(last)
            last = w
    often = {s: min(texts[s], len(before[s])) for s in known}
    del texts, before
    known = {s for s, k in often.items() if k > 2}
    common: Counter = Counter()
    for t in ordinary:
        common.update({s for w in set(_words(t)) for s in _stems(w)} & known)
    def z_values(stems) -> dict[bytes, float]:
        return {s: float(_z(often[s], len(toxic), common[s], len(ordinary))) for s in stems}
    z = z_values(known)
    least = max(MIN_Z, SHARE * max(z.values(), default=0.0))
    # compression also finds a part of a stem inside ordinary words: the part that they have most counts
    known = {s for s in known if z[s] >= least}
    raw = [t.lower().encode("utf-8", "replace") for t in ordinary]
    parts = {s: {s[i:i + MATCH] for i in range(max(1, len(s) - MATCH + 1))} for s in known}
    inside = {x: sum(x in t for t in raw) for x in set().union(*parts.values())}
    common.update({s: max(inside[x] for x in parts[s]) - common[s] for s in known})
    z = z_values(known)
    out: list[bytes] = []
    for s in sorted((s for s in known if z[s] >= least), key=lambda s: (-z[s], len(s), s)):
        if not any(s.startswith(o) or o.startswith(s) for o in out):
            out.append(s)
    return out


def toxic_words(toxic: list[str], ordinary: list[str], size: int) -> list[tuple[bytes, int]]:
    """Words of toxic texts that begin with a toxic stem, each with its stem's length, at most
    ``size`` bytes with a blank each: the most frequent one of each stem, then the next ones."""
    stems = toxic_stems(toxic, ordinary)
    counts: dict[bytes, Counter] = {s: Counter() for s in stems}
    sizes = sorted({len(s) for s in stems})
    for t in toxic:
        for w in _words(t):
            for k in sizes:
                if w[:k] in counts:
                    counts[w[:k]][w] += 1
    ranked = [[w for w, _ in sorted(counts[s].items(), key=lambda x: (-x[1], x[0]))] for s in stems]
    # a stem reaches as far as KEEP of its words agree
    reach = []
    for s in stems:
        k, n = len(s), sum(counts[s].values())
        while True:
            longer = Counter()
            for w, c in counts[s].items():
                longer[w[:k + 1]] += c
            best, c = longer.most_common(1)[0]
            if len(best) == k or c < KEEP * n:
                break
            k += 1
        reach.append(k)
    out, left = [], size
    for place in range(max(map(len, ranked), default=0)):
        for words, k in zip(ranked, reach):
            if place < len(words) and len(words[place]) < left:
                out.append((words[place], k))
                left -= len(words[place]) + 1
    return out


class Distance:
    """The two dictionaries; picklable, the compressors are made where they are used."""

    def __init__(self, toxic: list[str], ordinary: list[str]):
        samples = [w for t in ordinary[:SHARED_TEXTS] for w in windows(t, 256)][:SHARED_WINDOWS]
        tail = plain = b""
        for w, k in toxic_words(toxic, ordinary, TAIL) if toxic and ordinary else []:
            tail, plain = b" " + w + tail, b" " + bytes(min(k, len(w))) + w[k:] + plain
        try:
            base, self.kind = zs.train_dictionary(DICTIONARY, samples, k=50, d=8, level=LEVEL).as_bytes(), zs.DICT_TYPE_FULLDICT
            least = HEADER  # texts that are much alike give a dictionary shorter than the tail
        except zs.ZstdError:  # too few samples for entropy tables
            base, self.kind = b" ".join(samples)[-DICTIONARY:].rjust(TAIL + 8, b"\0"), zs.DICT_TYPE_RAWCONTENT
            least = 0
        head = base[:max(len(base) - len(tail), least)]
        self.toxic, self.ordinary = head + tail, head + plain

    def _compressor(self, data: bytes):
        d = zs.ZstdCompressionDict(data, dict_type=self.kind)
        p = zs.ZstdCompressionParameters.from_level(
            LEVEL, source_size=WINDOW, dict_size=len(data), format=zs.FORMAT_ZSTD1_MAGICLESS,
            write_content_size=0, write_checksum=0, write_dict_id=0)
        d.precompute_compress(compression_params=p)
        return zs.ZstdCompressor(dict_data=d, compression_params=p)

    def features(self, texts) -> np.ndarray:
        """[texts, 8]: pooled differences of the windows' lengths."""
        two = self._compressor(self.ordinary), self._compressor(self.toxic)
        out = []
        for t in texts:
            pieces = windows(t)
            diff = np.zeros(len(pieces), dtype=np.int32)
            for lo in range(0, len(pieces) if t else 0, 1024):  # zstandard refuses a call without bytes
                part = pieces[lo:lo + 1024]
                a, b = (c.multi_compress_to_buffer(part) for c in two)
                diff[lo:lo + len(part)] = [len(a[i]) - len(b[i]) for i in range(len(part))]
            top = np.sort(diff)[::-1]
            m = min(max(int(top[0]), 0), 6)
            out.append((m, m >= 2, m >= 3, m >= 4, min(np.maximum(top[:3], 0).sum(), 14),
                        min(np.maximum(top[:8] - 1, 0).sum(), 14), np.log1p(len(pieces)), 1))
        return np.array(out, dtype=np.float64).reshape(-1, 8)


class Toxicity:
    """Dictionaries and the calibrated threshold, learnt from (doc_id, text, label) rows in a hash order."""

    def __init__(self, rows):
        held = [zlib.crc32(b"calibrate|%d" % r[0]) % 3 == 0 for r in rows]
        side = [[r[1] for r, h in zip(rows, held) if not h and r[2] == k] for k in (1, 0)]
        self.distance = Distance(*side)
        own = [r for r, h in zip(rows, held) if h]
        y = np.array([r[2] for r in own], dtype=np.float64)
        self.flat = None
        if not all(side) or len(y) < 10 or y.min() == y.max():
            label = [r[2] for r in rows]
            self.flat = (sum(label) + 1) / (len(label) + 2)
            return
        x = self.distance.features(r[1] for r in own)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        self.mean[-1], self.scale[-1] = 0, 1
        x, self.w = (x - self.mean) / self.scale, np.zeros(8)
        for _ in range(100):
            p = 1 / (1 + np.exp(-x @ self.w))
            step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.eye(8), x.T @ (p - y) + self.w)
            self.w -= step
            if np.abs(step).max() < 1e-9:
                break

    def score(self, texts) -> np.ndarray:
        if self.flat is not None:
            return np.array([self.flat for _ in texts])
        return 1 / (1 + np.exp(-(self.distance.features(texts) - self.mean) / self.scale @ self.w))


def train(docs: DataFrame, labels: DataFrame, usable, train_rows: int = TRAIN_ROWS) -> Toxicity:
    known = labels.filter(F.col("toxic").isNotNull() & usable).select(
        F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_label"))
    usable_ids = docs.filter(F.length(text_or_empty()) <= TRAIN_CHARS).select(F.col("doc_id").cast("long").alias("_id")).distinct()
    ids = [tuple(r) for r in first_by_hash(known.join(usable_ids, "_id").select("_id", "_label"), "_id", train_rows, known.count()).collect()]
    wanted = docs.sparkSession.createDataFrame(ids, "_id long, _label int")
    own = docs.select(F.col("doc_id").cast("long").alias("_id"), text_or_empty().alias("_text"))
    rows = (own.filter(F.length("_text") <= TRAIN_CHARS).join(F.broadcast(wanted), "_id")  # at most train_rows ids
               .select("_id", "_text", "_label"))
    prepare(docs.sparkSession)

    def run(batches):  # in one task, so that the driver gets the model and never the texts
        own = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns))]
        model = Toxicity(sorted(own, key=lambda r: (zlib.crc32(b"%d" % r[0]), r)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])
    learned = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(learned[0].model) if learned else Toxicity([])


def scored(docs: DataFrame, model: Toxicity, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every document and its ``score``."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                score = pa.array(model.score(part.column(part.num_columns - 1).to_pylist()), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], score], names=[*part.schema.names[:-1], "score"])
    own = docs.select(*keep, text_or_empty().alias("_toxicity_text"))
    schema = own.select(*keep).schema.add("score", "double")
    return own.mapInArrow(run, schema)


def classify_toxicity(docs: DataFrame, labels: DataFrame, usable, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, score) of every document; ``usable`` marks the rows of ``labels`` to learn from.

    Null and empty texts are scored as a text without words.  Null labels, labels of unknown
    documents and (for learning only) texts over ``TRAIN_CHARS`` are not used; without labels
    of both kinds all documents get the base rate.  Repeated rows are scored alike; other
    columns have no influence; an empty table gives no rows.
    """
    ids = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    return scored(ids, train(docs, labels, usable, train_rows), ["doc_id"])


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents scored under ``REJECT``, columns as given."""
    name = "_toxicity_row"
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias(name), "text")
    model = train(docs, labels, F.lit(True))
    return scored(packed, model, [name]).filter(F.col("score") < REJECT).select(
        *[F.col(name)[c].alias(c) for c in docs.columns])


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    usable = remainder(F.col("doc_id"), 5) != 0
    out = classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), usable)
    return out.select("doc_id", F.coalesce(~usable, F.lit(False)).alias("held_out"), "score",
                      F.when(F.col("score") >= REJECT, 1).otherwise(0).alias("predicted"))
