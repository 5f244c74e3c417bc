"""Near-duplicate documents by circulant MinHash.

Two fixed permutations of the 64-bit universe serve all signature coordinates: the first
shuffles a shingle's hash, coordinate ``k`` then takes the smallest value of the second
permutation after a circular shift by ``k`` steps.  Bands of coordinates propose pairs,
exact Jaccard on the full shingle sets confirms them.

Documents with equal sets form one class, which is compared once.  In each bucket all
classes are first compared with one leader (another one in each band), then with the most
central class; classes that are still in different components afterwards are compared with
each other where exact bounds leave a link possible, so that no link between components of a
bucket is lost while a large group of near copies costs about one comparison a member.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import U64, mix64, prepare, table, text_or_empty, utf8, words, written
from vigil.llm.components import components

#: a pair at the threshold meets in some band with probability 1 - 5e-6; one at 0.3 with 0.03
BANDS, ROWS = 40, 6
THRESHOLD = 80  # percent
#: 64-bit words of the parity sketch that bounds the difference of two sets (a power of two)
SKETCH_LONGS = 16
_STEP = U64(0x9FB21C651E98DF25)


def sigma(x: np.ndarray) -> np.ndarray:
    """The initial permutation."""
    return mix64(x + U64(0x2545F4914F6CDD1D))


def pi(x: np.ndarray) -> np.ndarray:
    """The permutation that is shifted for each coordinate (works in place on ``x``)."""
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xCA5A826395121157)
    return x


def shingle_hashes(h: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of consecutive documents, and their number in each
    document.  A document of fewer than n words has one shingle, its whole word sequence."""
    number = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    first = np.concatenate(([0], np.cumsum(counts)))
    if len(h) == 0:
        return np.zeros(0, np.uint64), number
    at = np.concatenate(([0], np.cumsum(number)))
    starts = np.arange(at[-1]) - np.repeat(at[:-1], number) + np.repeat(first[:-1], number)
    left = np.repeat(first[1:], number) - starts
    out = np.zeros(len(starts), dtype=np.uint64)
    for i in range(n):
        use = i < left
        out = np.where(use, out * U64(0x9E3779B97F4A7C15) + h[np.minimum(starts + i, len(h) - 1)], out)
    return mix64(out + np.minimum(left, n).astype(np.uint64)), number


def distinct_in_rows(values: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each consecutive row."""
    out, at = [], 0
    counts = np.zeros(len(number), dtype=np.int64)
    for i, m in enumerate(number):
        if m:
            u = np.unique(values[at:at + m])
            out.append(u)
            counts[i] = len(u)
            at += m
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), counts


def signatures(values: np.ndarray, counts: np.ndarray, k: int, block: int = 1 << 16) -> np.ndarray:
    """[rows, k] circulant signature of each row's distinct values; all ones for an empty row."""
    sig = np.full((len(counts), k), ~U64(0), dtype=np.uint64)
    full = np.flatnonzero(counts)
    begin = np.concatenate(([0], np.cumsum(counts)))
    row = 0
    while row < len(full):  # rows of about `block` values together; longer rows in pieces
        end = int(np.searchsorted(begin[full + 1], begin[full[row]] + block, side="right"))
        end = max(end, row + 1)  # a row over the block is alone: rows of a group share one piece
        rows = full[row:end]
        lo, hi = int(begin[rows[0]]), int(begin[rows[-1] + 1])
        for a in range(lo, hi, 4 * block):
            b = min(hi, a + 4 * block)
            base = sigma(values[a:b])
            cuts = np.clip(begin[rows] - a, 0, None)
            shift = U64(0)
            for j in range(k):
                low = np.minimum.reduceat(pi(base + shift), cuts) if len(rows) > 1 else pi(base + shift).min()
                sig[rows, j] = np.minimum(sig[rows, j], low)
                with np.errstate(over="ignore"):
                    shift = shift + _STEP
        row = end
    return sig


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(sig), bands), dtype=np.uint64)
    for r in range(rows):
        out = mix64(out * U64(0x9E3779B97F4A7C15) + sig[:, r::rows][:, :bands])
    return out


def _rows(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    off = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values.view(np.int64)))


def _sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    h, counts = words(*utf8(texts))
    return distinct_in_rows(*shingle_hashes(h, counts, n))


def _class_ids(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set: equal sets, equal sums."""
    prefix = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(values + U64(c))))) for c in (11, 29)]
    at = np.concatenate(([0], np.cumsum(counts)))
    one, two = (p[at[1:]] - p[at[:-1]] for p in prefix)
    return mix64(one + counts.astype(np.uint64)).view(np.int64), mix64(two).view(np.int64)


def row_key():
    """Names the pair of doc_id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), text_or_empty())


def describe(docs: DataFrame, n: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, row, n_shingles, class, class2, bands) of every document; row as in ``row_key``."""
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                values, counts = _sets(part.column(1), n)
                c1, c2 = _class_ids(values, counts)
                bh = band_hashes(signatures(values, counts, bands * rows), bands, rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(counts), pa.array(c1), pa.array(c2),
                     _rows(bh.reshape(-1), np.full(len(counts), bands))],
                    names=["doc_id", "row", "n_shingles", "class", "class2", "bands"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), row_key().alias("row")).mapInArrow(
        run, "doc_id long, row long, n_shingles long, class long, class2 long, bands array<long>")


def full_sets(docs: DataFrame, n: int) -> DataFrame:
    """(class, set) of every document given; ``class`` as in ``describe``."""
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                values, counts = _sets(batch.slice(lo, 512).column(0), n)
                c1, _ = _class_ids(values, counts)
                yield pa.RecordBatch.from_arrays([pa.array(c1), _rows(values, counts)], names=["class", "set"])
    return docs.select(text_or_empty().alias("text")).mapInArrow(run, "class long, set array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= threshold * union."""
    one = sets.select(F.col("class").alias("a"), F.col("set").alias("set_a"))
    two = sets.select(F.col("class").alias("b"), F.col("set").alias("set_b"))
    na, nb = F.size("set_a"), F.size("set_b")
    both = F.size(F.array_intersect("set_a", "set_b"))
    return (pairs.join(one, "a").join(two, "b")
                 .filter((F.least(na, nb) * 100 >= F.greatest(na, nb) * threshold))
                 .filter(both * 100 >= (na + nb - both) * threshold).select("a", "b"))


def linkable(sets: DataFrame, threshold: int) -> DataFrame:
    """(vertex, n, m, s0, s1, ...) of the classes that can have a link among ``sets``: size,
    number of shingles that occur in another set, and parity sketch.  Two sets share at most
    the smaller ``m``, and at least ``threshold`` percent of a linked set is shared (exact
    bounds).  Bit b of the sketch is the parity of the number of shingles that fall on b, so
    two sets differ in at least as many shingles as their sketches differ in bits."""
    each = sets.select(F.col("class").alias("vertex"), F.size("set").alias("n"), F.explode("set").alias("shingle"))
    shared = (each.groupBy("shingle").agg(F.count("*").alias("m")).filter("m > 1")
                  .select("shingle", F.lit(1).alias("again")))
    bit = "shiftleft(1L, cast(shiftright(shingle, 8) & 63 as int))"
    sketch = [F.expr(f"coalesce(bit_xor(case when (shingle & {SKETCH_LONGS - 1}) = {i} then {bit} end), 0L) as s{i}")
              for i in range(SKETCH_LONGS)]
    return (each.join(shared, "shingle", "left").groupBy("vertex", "n").agg(F.count("again").alias("m"), *sketch)
                .filter(F.col("m") * 100 >= F.col("n") * threshold))


def _possible(threshold: int):
    """Condition on rows x and y of ``linkable``: no exact bound rules the pair out."""
    n = F.col("x.n") + F.col("y.n")
    most = F.least("x.n", "y.n", "x.m", "y.m")
    differ = sum((F.bit_count(F.col(f"x.s{i}").bitwiseXOR(F.col(f"y.s{i}"))) for i in range(SKETCH_LONGS)), F.lit(0))
    return (most * 100 >= (n - most) * threshold) & (differ * (100 + threshold) <= n * (100 - threshold))


def with_leaders(buckets: DataFrame) -> DataFrame:
    """``buckets`` (band, bucket, vertex) of two vertices or more, each with a ``leader``; the
    order that chooses it differs from band to band."""
    order = F.struct(F.xxhash64("vertex", "band").alias("o"), F.col("vertex").alias("v"))
    leaders = (buckets.groupBy("band", "bucket").agg(F.count("*").alias("m"), F.min(order)["v"].alias("leader"))
                      .filter("m > 1").drop("m"))
    return buckets.join(leaders, ["band", "bucket"])


def _mixed(placed: DataFrame) -> DataFrame:
    """The rows of buckets that hold two components or more."""
    apart = (placed.groupBy("band", "bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
                   .filter("lo != hi").select("band", "bucket"))
    return placed.join(apart, ["band", "bucket"])


def bucket_links(members: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) that connect all vertices that are linked inside a bucket.

    members: band, bucket, vertex, leader, for buckets of two vertices or more; sets: class
    (the vertex), set.  First each member is compared with its leader; what is still in
    different components of a bucket is compared with the bucket's most central vertex (the
    one whose shingles occur most in others); and what is then still apart is compared with
    every vertex of the other components that an exact bound does not rule out.
    """
    pair = [F.least("vertex", "leader").alias("a"), F.greatest("vertex", "leader").alias("b")]
    links = written(confirmed(members.filter("vertex != leader").select(*pair).distinct(), sets, threshold), "links")
    found = components(links)
    placed = _mixed(members.join(found.withColumnRenamed("id", "vertex"), "vertex", "left")
                    .withColumn("component", F.coalesce("component", "vertex")).select("band", "bucket", "vertex", "component"))
    placed = written(placed, "placed")
    apart = sets.join(placed.select(F.col("vertex").alias("class")).distinct(), "class", "left_semi")
    bounds = written(linkable(apart, threshold), "bounds")

    # each vertex against the central vertex of its bucket
    order = F.struct((F.col("m") / F.col("n")).alias("shared"), "m", F.xxhash64("vertex", "band").alias("o"), "vertex", "component")
    central = (placed.join(bounds.select("vertex", "n", "m"), "vertex").groupBy("band", "bucket").agg(F.max(order).alias("c"))
                     .select("band", "bucket", F.col("c.vertex").alias("leader"), F.col("c.component").alias("to")))
    pairs = placed.join(central, ["band", "bucket"]).filter("component != to").select(F.col("vertex").alias("a"), F.col("leader").alias("b")).distinct()
    x, y = bounds.alias("x"), bounds.alias("y")
    pairs = (pairs.join(x, F.col("a") == F.col("x.vertex")).join(y, F.col("b") == F.col("y.vertex"))
                  .filter(_possible(threshold))
                  .select(F.least("x.vertex", "y.vertex").alias("a"), F.greatest("x.vertex", "y.vertex").alias("b")).distinct())
    links = written(links.unionAll(confirmed(pairs.join(links, ["a", "b"], "left_anti"), sets, threshold)), "links")
    found = components(links)
    placed = _mixed(placed.drop("component").join(found.withColumnRenamed("id", "vertex"), "vertex", "left")
                    .withColumn("component", F.coalesce("component", "vertex")))

    # the vertices outside a bucket's largest component against all others of the bucket
    sizes = placed.groupBy("band", "bucket", "component").agg(F.count("*").alias("k"))
    main = sizes.groupBy("band", "bucket").agg(F.max(F.struct("k", "component"))["component"].alias("main"))
    placed = written(placed.join(main, ["band", "bucket"]).join(bounds, "vertex"), "placed")
    x, y = placed.filter("component != main").alias("x"), placed.alias("y")
    once = (F.col("y.component") == F.col("y.main")) | (F.col("x.vertex") < F.col("y.vertex"))
    rest = (x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.bucket") == F.col("y.bucket"))
                   & (F.col("x.component") != F.col("y.component")) & once & _possible(threshold))
             .select(F.least("x.vertex", "y.vertex").alias("a"), F.greatest("x.vertex", "y.vertex").alias("b")).distinct()
             .join(links, ["a", "b"], "left_anti"))
    more = confirmed(rest, sets, threshold)
    return written(links.unionAll(more), "links")


def near_duplicates(docs: DataFrame, words_per_shingle: int = 5, threshold: int = THRESHOLD,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept, links (number of distinct
    other texts' classes it was confirmed with directly), row (``row_key``), component (a name of
    the group of linked texts, null without shingles).

    Null and empty texts have an empty set, n_shingles 0, and are linked with nothing (their
    component is their own doc_id).  A null doc_id has component null unless linked to an id
    and kept false.  Repeated rows share their class; with one doc_id on several texts, each
    text is its own vertex and component_id the smallest doc_id of the component.  An empty
    table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    d = written(describe(docs, words_per_shingle, bands, rows), "minhash")
    # class and class2 together name a set; the key of both is the vertex
    d = d.withColumn("vertex", F.xxhash64("class", "class2"))
    classes = (d.filter("n_shingles > 0").groupBy("vertex")
                .agg(F.min_by("bands", "doc_id").alias("b0"), F.first("bands").alias("b1"),
                     F.min("doc_id").alias("first_id"), F.min("row").alias("row"), F.max("n_shingles").alias("n"))
                .select("vertex", "first_id", "row", F.coalesce("b0", "b1").alias("bands")))
    members = written(with_leaders(classes.select("vertex", F.posexplode("bands").alias("band", "bucket"))), "buckets")
    texts = classes.join(members.select("vertex").distinct(), "vertex", "left_semi").select("row", "vertex")
    source = docs.select(row_key().alias("row"), text_or_empty().alias("text"))  # a null doc_id has a row key
    sets = full_sets(source.join(texts.select("row").distinct(), "row", "left_semi"), words_per_shingle)
    ids = d.select("class", "vertex").distinct()
    sets = written(sets.join(ids, "class").join(texts.select("vertex"), "vertex", "left_semi")
                       .select(F.col("vertex").alias("class"), "set").dropDuplicates(["class"]), "sets")

    links = bucket_links(members, sets, threshold)
    found = components(links)
    ends = links.select(F.col("a").alias("vertex")).unionAll(links.select(F.col("b").alias("vertex")))
    degree = ends.groupBy("vertex").agg(F.count("*").alias("links"))
    label = (classes.select("vertex", "first_id").join(found.withColumnRenamed("id", "vertex"), "vertex", "left")
                    .withColumn("component", F.coalesce("component", "vertex")))
    low = label.groupBy("component").agg(F.min("first_id").alias("component_id"))
    label = label.join(low, "component").join(degree, "vertex", "left").select("vertex", "component", "component_id", "links")
    out = d.select("doc_id", "row", "n_shingles", "vertex").join(label, "vertex", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"),
                      F.coalesce(F.col("doc_id") == own, F.lit(False)).alias("kept"),
                      F.coalesce("links", F.lit(0)).cast("long").alias("links"), "row", "component")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the smallest doc_id, a null
    one last, and of the smallest key of (doc_id, text) if the doc_id stands on several texts; of
    rows equal in both, the smallest.  Texts without words are in no group and stay.
    """
    found = near_duplicates(docs, **options).filter("n_shingles > 0").select("component", "doc_id", "row")
    rows = written(found.groupBy("component", "doc_id", "row").agg(F.count("*").alias("times")), "near-rows")
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")
    first = rows.groupBy("component").agg(F.min(place)["row"].alias("_first"))
    rows = rows.join(first, "component")
    gone = rows.filter("row != _first").select(F.col("row").alias("_gone"))
    twice = rows.filter("row = _first and times > 1").select(F.col("row").alias("_twice"))
    left = docs.withColumn("_row", row_key()).join(gone, F.col("_row") == F.col("_gone"), "left_anti")
    one = left.join(twice, F.col("_row") == F.col("_twice"), "left_semi").groupBy("_row").agg(
        F.min(F.struct(*[F.col(c) for c in docs.columns])).alias("_one")).select("_one.*")
    return left.join(twice, F.col("_row") == F.col("_twice"), "left_anti").drop("_row").unionByName(one)


def op6_minhash(spark, sf_dir: str) -> DataFrame:
    """Four-word shingles, as the query's contract fixes them."""
    return near_duplicates(table(spark, sf_dir, "documents"), words_per_shingle=4).drop("links", "row", "component")


ORACLE_SQL = """
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents),
s as (select distinct doc_id, g from (
  select doc_id, unnest(case when len(ws) >= 4
      then list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))
      when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as g from w)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select x.doc_id as a, y.doc_id as b, count(*) as c
      from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
e as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b
      where 100 * c >= 80 * (na.n + nb.n - c)),
u as (select a, b from e union all select b, a from e),
r as (select a as id, b as reach from u union select r.id, u.b from r join u on r.reach = u.a),
m as (select id, min(reach) as lo from r group by id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(m.lo, d.doc_id)) as component_id,
       least(d.doc_id, coalesce(m.lo, d.doc_id)) = d.doc_id as kept
from documents d left join n on n.doc_id = d.doc_id left join m on m.id = d.doc_id
"""
