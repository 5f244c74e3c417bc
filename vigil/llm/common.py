"""Shared pieces of the operators: byte and word arrays of Arrow text columns, 64-bit
mixers, scratch tables and reading of the given tables.

Everything here works on one Arrow batch (or one document) inside a task.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.session import scratch_dir, ship_package

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))
#: bytes handled at once by the array code; longer texts are cut at white space
BLOCK_BYTES = 1 << 21
_POW: dict[str, np.ndarray] = {}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: the separators of ``[^\x20\x09-\x0D]+``
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Make this package importable in Python workers."""
    ship_package(spark)


_SCOPES: list[list[str]] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_go(spark: SparkSession):
    """Shuffle files of what is executed inside go when it ends, not with the driver's next
    garbage collection."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder (cuts the lineage)."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    with _shuffles_go(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)  # with its schema given, reading it is no job


@contextmanager
def scratch(spark: SparkSession):
    """Tables that are ``written`` inside go at the end, also after a failure, but for the one that
    the caller's ``keep`` names last: everything else that the caller returns must come from it."""
    made: list[str] = []
    kept: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = written(df, name)
        kept.append(made[-1])
        return out
    _SCOPES.append(made)
    try:
        yield keep
    finally:
        _SCOPES.pop()
        for path in made:
            if path not in kept:
                delete_path(spark, path)
        if _SCOPES:
            _SCOPES[-1].extend(kept)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A place in the shared checkpoint folder."""
    return scratch_dir(spark, f"llm-{name}")


def forget(spark: SparkSession, name: str) -> None:
    """Delete what this run has written to ``scratch_path``."""
    delete_path(spark, scratch_path(spark, name))


def delete_path(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary array, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    off = off.astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of the 64-bit integers (new array)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(kind: str, n: int) -> np.ndarray:
    have = _POW.get(kind)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        have = np.full(size, _BASE if kind == "up" else _BASE_INV, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size > 4 * BLOCK_BYTES:
            return have
        _POW[kind] = have
    return have[:n]


def range_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every ``data[start:end]`` by one prefix sum of the block."""
    n = len(data)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + U64(1)) * _powers("up", n), out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * _powers("down", n + 1)[starts]
    return mix64(h ^ ((ends - starts).astype(np.uint64) << U64(40)))


def blocks(data: np.ndarray, off: np.ndarray, limit: int = BLOCK_BYTES):
    """Yield (byte start, byte end, first document, last document + 1) covering all bytes in
    pieces of about ``limit``; a document longer than that is cut after white space."""
    d, pos, n = 0, 0, len(off) - 1
    while d < n:
        last = int(np.searchsorted(off, pos + limit, side="right")) - 1
        if last > d:
            yield pos, int(off[last]), d, last
            d, pos = last, int(off[last])
            continue
        end = int(off[d + 1])
        while end - pos > limit:
            cut = pos + limit
            window = _SPACE[data[cut:end]]
            step = int(np.argmax(window)) if window.any() else end - cut
            cut += step
            if cut >= end:
                break
            yield pos, cut, d, d + 1
            pos = cut
        yield pos, end, d, d + 1
        d, pos = d + 1, end


def words(data: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words ``[^\\x20\\x09-\\x0D]+`` in order, and the number of each document's."""
    hashes, counts = [], np.zeros(len(off) - 1, dtype=np.int64)
    for a, b, d0, d1 in blocks(data, off):
        piece = data[a:b]
        if lower:
            piece = _LOWER[piece]
        starts, ends = word_spans(piece, np.clip(off[d0:d1 + 1] - a, 0, b - a))
        if len(starts):
            hashes.append(range_hash(piece, starts, ends))
            counts[d0:d1] += np.diff(np.searchsorted(starts, np.clip(off[d0:d1 + 1] - a, 0, b - a)))
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def word_spans(piece: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of the texts ``piece[off[i]:off[i+1]]``."""
    n = len(piece)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    body = ~_SPACE[piece]
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    first = body.copy()
    first[1:] &= ~body[:-1] | edge[1:n]
    last = body.copy()
    last[:-1] &= ~body[1:] | edge[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def first_by_hash(df: DataFrame, by: str, limit: int, total: int | None = None) -> DataFrame:
    """At most ``limit`` rows of ``df``, those of the smallest ``xxhash64(by)`` (equal ones in the
    order of all columns).  Where there are many more, a threshold on the hash, from the number of
    rows, leaves little more than the limit before anything is sorted, so that no partition sends rows
    that cannot be among the first.  ``total`` is the number of rows where it is known, or a bound
    of it (then fewer may be left)."""
    rows = df.withColumn("_order", F.xxhash64(by))
    total = df.count() if total is None else total
    enough = limit + 12 * int(limit ** 0.5) + 100  # the number left varies by its square root
    if total > enough:
        rows = rows.filter(F.col("_order") < int(-(1 << 63) + (1 << 64) * enough / total))
    return rows.orderBy("_order", *df.columns).limit(limit).drop("_order")


def seed_hash(*columns):
    """A stable hex order of rows for seeded choices (the same in any SQL engine)."""
    return F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns]))
