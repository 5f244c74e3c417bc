"""Approximate nearest neighbours by shifted space-filling curves.

``CURVES`` Hilbert orderings, each of another random projection of the vectors, shifted in its
grid, are range-partitioned in Spark and give every vector a rank on every curve.  A query's
candidates are the vectors within a radius of its ranks; the windows are cut into blocks of
neighbouring ranks, each task ranks its block by the exact distance, and the best of all
blocks and curves merge.

The radius is measured, not guessed: ``SAMPLE`` vectors (the first in a hash order) are
compared with all rows, and the radius is the rank distance that reaches ``RECALL`` of their
true neighbours on the curve nearest to each.  Every row is indexed and searched.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import prepare, table, written

CURVES, AXES, BITS = 16, 6, 8
K = 10
SAMPLE, RECALL = 64, 0.96
LEAST_RADIUS, MOST_BLOCK = 64, 65_536


def hilbert(grid: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert keys of [rows, axes] cells below 2**bits (axes * bits under 64)."""
    x = [grid[:, i].astype(np.int64).copy() for i in range(grid.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations from the highest bit down
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ turn) >> b) & 1)
    return key


def curve_keys(v: np.ndarray, curves: int, axes: int, bits: int, seed: int = 5) -> np.ndarray:
    """[rows, curves] keys; directions only depend on the number of dimensions."""
    rng = np.random.default_rng(seed)
    out = np.empty((len(v), curves), dtype=np.int64)
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    length = np.log(np.maximum(np.linalg.norm(v, axis=1), 1e-300))
    for c in range(curves):
        basis, _ = np.linalg.qr(rng.standard_normal((v.shape[1], min(axes, v.shape[1]))))
        p = unit @ basis * np.sqrt(v.shape[1])
        p[:, 0] += 0.01 * np.clip(length, -30, 30)  # vectors of one direction are told apart by length
        shift = rng.uniform(0, 1, p.shape[1])
        cells = np.clip((p / 8 + 0.25 + shift / 2) * (1 << bits), 0, (1 << bits) - 1)
        out[:, c] = hilbert(cells.astype(np.int64), bits)
    return out


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part; v as doubles."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0))


def _distances(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(v - q).sum(axis=1))


def _best(dist: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    near = np.argpartition(dist, k)[:k + 1] if len(dist) > k + 1 else np.arange(len(dist))
    near = np.flatnonzero(dist <= dist[near].max()) if len(near) else near
    return near[np.lexsort((ids[near], dist[near]))][:k]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def nearest(vectors: DataFrame, queries, k: int = K, curves: int = CURVES, axes: int = AXES, bits: int = BITS,
            sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest rows found for each query.

    ``queries`` is a condition on vec_id.  Null, zero and non-finite vectors and null ids take
    no part, nor do vectors of another length than most.  Equal vectors are one point of the
    curves that keeps its k + 1 smallest ids, which are the only ones that can be among the
    nearest; ties go to the smaller vec_id, and a repeated vec_id counts once for each vector.
    A table without valid vectors gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = valid_vectors(vectors).distinct()
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    ranked = written(rows.withColumn("n", F.row_number().over(by_vector))
                         .filter((F.col("n") <= k + 1) | queries(F.col("vec_id"))), "vectors")
    points = (ranked.filter(F.col("n") <= k + 1).groupBy("v")
                    .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.min("vec_id").alias("low")))
    points = points.withColumn("point", F.xxhash64("v"))
    size = points.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if size is None:
        return empty
    points = written(points.filter(F.size("v") == size.d), "points")
    count = points.count()

    def keys(batches):
        for batch in batches:
            key = curve_keys(_matrix(batch.column(1)), curves, axes, bits)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(0).to_numpy(), curves)),
                 pa.array(np.tile(np.arange(curves, dtype=np.int32), batch.num_rows)), pa.array(key.ravel())],
                names=["point", "curve", "key"])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = (points.select("point", "v").mapInArrow(keys, "point long, curve int, key long")
                   .repartitionByRange(parts, "curve", "key", "point").sortWithinPartitions("curve", "key", "point")
                   .withColumn("place", F.monotonically_increasing_id()))
    order = written(order, "curves").withColumn("part", F.shiftright("place", 33))
    starts = order.groupBy("curve", "part").agg(F.min("place").alias("first"), F.count("*").alias("m"))
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("offset", F.coalesce(F.sum("m").over(before), F.lit(0)))
    ranks = written(order.join(starts, ["curve", "part"]).select(
        "curve", "point", (F.col("place") - F.col("first") + F.col("offset")).alias("pos")), "ranks")

    radius = _radius(points, ranks, count, k, sample, recall)
    block = max(1, min(radius, MOST_BLOCK))
    asked = (ranked.filter(queries(F.col("vec_id"))).select(F.xxhash64("v").alias("point")).distinct()
                   .join(points.select("point", "v"), "point"))
    spread = (asked.join(ranks, "point")
                   .withColumn("block", F.explode(F.sequence(F.floor(F.greatest(F.lit(0), F.col("pos") - radius) / block),
                                                             F.floor((F.col("pos") + radius) / block))))
                   .select(F.col("curve").alias("qcurve"), F.col("block").alias("qblock"), F.col("point").alias("q"), F.col("v").alias("qv"), F.col("pos").alias("qpos")))
    placed = ranks.join(points.select("point", "low", "v"), "point").select(
        "curve", F.floor(F.col("pos") / block).alias("block"), "point", "low", "v", "pos")

    def rerank(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(c):
            v, pos, low = np.stack(c["v"].to_numpy()), c["pos"].to_numpy(), c["low"].to_numpy()
            names = c["point"].to_numpy()
            for query, qv, at in zip(q["q"], q["qv"], q["qpos"]):
                use = np.flatnonzero(np.abs(pos - at) <= radius)
                dist = _distances(np.asarray(qv), v[use])
                for i in _best(dist, low[use], k + 1):
                    out.append((query, names[use[i]], low[use[i]], dist[i]))
        return pd.DataFrame(out, columns=["q", "point", "low", "score"])
    found = spread.groupBy("qcurve", "qblock").cogroup(placed.groupBy("curve", "block")).applyInPandas(
        rerank, "q long, point long, low long, score double")
    best = Window.partitionBy("q").orderBy("score", "low", "point")
    found = (found.groupBy("q", "point", "low").agg(F.min("score").alias("score"))
                  .withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1))
    near = found.join(points.select("point", "ids"), "point").select("q", "score", F.explode("ids").alias("vec_id"))
    own = ranked.filter(queries(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("q"))
    pairs = own.join(near, "q").filter("query_id != vec_id")
    final = Window.partitionBy("query_id", "q").orderBy("score", "vec_id")
    return (pairs.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k)
                 .select("query_id", "rank", "vec_id", "score"))


def _radius(points: DataFrame, ranks: DataFrame, count: int, k: int, sample: int, recall: float) -> int:
    """The rank distance within which ``recall`` of the sample's true neighbours lie on some curve."""
    chosen = points.orderBy(F.xxhash64("point"), "point").limit(sample).select("point", "v").collect()
    q = np.array([r.v for r in chosen])
    names = [r.point for r in chosen]

    def true(batches):
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(q)
        for batch in batches:
            ids, v = batch.column(0).to_numpy(), _matrix(batch.column(1))
            for i in range(len(q)):
                d = np.concatenate((best[i][0], _distances(q[i], v)))
                p = np.concatenate((best[i][1], ids))
                near = _best(d, p, k + 1)
                best[i] = d[near], p[near]
        for name, (d, p) in zip(names, best):
            if len(d):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(d), pa.int64()), pa.array(p), pa.array(d)],
                                                 names=["q", "point", "score"])
    near = points.select("point", "v").mapInArrow(true, "q long, point long, score double")
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("score", "point")))
    near = near.filter((F.col("n") <= k + 1) & (F.col("q") != F.col("point"))).select("q", "point").collect()
    wanted = points.sparkSession.createDataFrame(sorted({(p,) for r in near for p in r}), "point long") if near else None
    if wanted is None:
        return LEAST_RADIUS
    at = {(r.point, r.curve): r.pos for r in ranks.join(F.broadcast(wanted), "point").collect()}  # sample * (k + 1) points
    curves = 1 + max(c for _, c in at)
    apart = np.array([min(abs(at[a, c] - at[b, c]) for c in range(curves)) for a, b in near])
    return int(min(count, max(LEAST_RADIUS, np.quantile(apart, recall, method="higher"))))


def op3_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)
