"""Prefix trie of conversations by ROLLUP over positional turn-id columns.

A conversation is cut into blocks of ``WIDTH`` turns; a block is one row with a column (two
64-bit hashes) for each turn, keyed by the node in which the block before it ends.  One
``GROUP BY key, ROLLUP(turns)`` over the blocks of all lengths aggregates every prefix:
``grouping_id()`` tells how many turns a group holds.  A node's key is the XOR of the hashes of
(turn, position) along its path, so the key of each block is a running window value and blocks
need not wait for one another.

Sums over a subtree take a second ROLLUP.  Every node is counted with its smallest member, its
owner; a conversation owns the nodes from some depth on, so a node's subtree holds all that its
members own, less what its owner owns above the node.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import prepare, table, written

#: turns in a block
WIDTH = 8
#: conv_ids a piece of a list of ids spans, so a piece holds at most as many
PIECE = 4096
#: rules of the rebuilt conversations of ``op12_trie``
FAMILY, HEADS = 5, 9


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv, pos, i1, i2, bytes): turns numbered from 1 by ``turn``, null first.

    Null roles and texts are empty; equal turn numbers are ordered by the hashes of role and
    text, repeated rows are separate turns; rows without a conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    t = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.xxhash64(F.lit(1), role, text).alias("i1"),
        F.xxhash64(F.lit(2), text, role).alias("i2"), F.octet_length(text).cast("long").alias("bytes"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "i1", "i2")
    return t.select("conv", F.row_number().over(order).cast("long").alias("pos"), "i1", "i2", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that share heads, from ``turn_rows``: (turns, conversations (conv, len)).

    Conversation c gets the first h turns of conversation c - c % FAMILY (all if it has fewer,
    none if there is none) and then its own turns after the first h; h = crc32 of c's decimal
    digits modulo HEADS.  It may end up without turns.
    """
    turns = written(turns, "trie-turns")
    convs = turns.groupBy("conv").agg(F.max("pos").alias("n")).select(
        "conv", "n", (F.col("conv") - F.col("conv") % FAMILY).alias("base"),
        (F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS).alias("h"))
    bases = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    given = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = written(convs.join(bases, "base", "left").select(
        "conv", "base", "h", given.alias("given"), (given + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("len")), "trie-convs")
    heads = turns.filter(F.col("pos") < HEADS).withColumnRenamed("conv", "base").join(convs, "base").filter("pos <= h")
    tails = turns.join(convs, "conv").filter("pos > h").withColumn("pos", F.col("given") + F.col("pos") - F.col("h"))
    columns = ["conv", "pos", "i1", "i2", "bytes"]
    return heads.select(columns).unionAll(tails.select(columns)), convs.select("conv", "len")


def _places(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, len, pos, i1, i2, bytes, z1, z2, y1, y2) of the root (pos 0) and each turn: z is
    the key of the node there, y that of its parent (null above the root)."""
    root = convs.select("conv", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("long").alias("i1"),
                        F.lit(None).cast("long").alias("i2"), F.lit(0).cast("long").alias("bytes"))
    rows = turns.unionByName(root).join(convs, "conv")
    along = Window.partitionBy("conv").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for n in (1, 2):
        own = F.when(F.col("pos") > 0, F.xxhash64("i1", "i2", "pos", F.lit(n))).otherwise(F.lit(0).cast("long"))
        rows = rows.withColumn(f"o{n}", own).withColumn(f"z{n}", F.bit_xor(f"o{n}").over(along))
        rows = rows.withColumn(f"y{n}", F.when(F.col("pos") > 0, F.col(f"z{n}").bitwiseXOR(F.col(f"o{n}")))).drop(f"o{n}")
    return rows


def _blocks(places: DataFrame, width: int) -> DataFrame:
    """(conv, len, block, k1, k2, a1, b1, a2, b2, ...): a row for each block of a conversation,
    the first one also of a conversation without turns; k1, k2 name the node before the block."""
    at = F.greatest(F.col("pos") - 1, F.lit(0))
    slot = F.when(F.col("pos") > 0, at % width + 1)
    rows = places.withColumn("block", F.floor(at / width)).withColumn("slot", slot)
    pick = lambda column, i, name: F.max(F.when(F.col("slot") == i, F.col(column))).alias(name)
    return rows.groupBy("conv", "len", "block").agg(
        *[F.coalesce(F.max(F.when(F.col("slot") == 1, F.col(f"y{n}"))), F.lit(0).cast("long")).alias(f"k{n}") for n in (1, 2)],
        *[pick(source, i, f"{name}{i}") for i in range(1, width + 1) for source, name in (("i1", "a"), ("i2", "b"))])


def _rollup(blocks: DataFrame, width: int, **measures: str) -> DataFrame:
    """(owner, depth, measures) of every node: the groups of one ROLLUP over the turn columns.
    A group whose members end before its last column is no node; a block's empty prefix is the
    node that the block before it has given."""
    turns = ", ".join(f"(a{i}, b{i})" for i in range(1, width + 1))
    named = "".join(f", {sql} as {name}" for name, sql in measures.items())
    groups = blocks.sparkSession.sql(
        f"select block, {width} - bit_count(grouping_id()) div 2 as level, min(conv) as owner, min(len) as shortest{named} "
        f"from {{blocks}} group by block, k1, k2, rollup({turns})", blocks=blocks)
    return (groups.withColumn("depth", F.col("block") * width + F.col("level"))
                  .filter("shortest >= depth and (level > 0 or block = 0)").select("owner", "depth", *measures))


def prefix_trie(turns: DataFrame, convs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """The trie of the conversations: (nodes, ends).

    turns: conv, pos (from 1, without gaps), i1, i2, bytes; convs: conv, len, also of those
    without turns.  nodes: z1, z2, depth (together the node's name), conv_id (smallest member),
    parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens, i1, i2 (last
    turn, null for the root).  ends: z1, z2, depth, conv of the node in which each conversation
    ends.  No conversations, no nodes; without any turns there is the root alone.
    """
    places = written(_places(turns, convs), "trie-places")
    blocks = written(_blocks(places, width), "trie-blocks")
    found = _rollup(blocks, width, n_convs="count(*)", reach="max(len)")
    nodes = written(found.join(places, (F.col("owner") == F.col("conv")) & (F.col("depth") == F.col("pos")))
                    .select("owner", "depth", "n_convs", "reach", "z1", "z2", "y1", "y2", "i1", "i2",
                            ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")), "trie-nodes")
    owned = nodes.groupBy(F.col("owner").alias("conv")).agg(
        F.sum("saved").alias("all_saved"), F.max((F.col("reach") == F.col("depth")).cast("long")).alias("leaf"))
    below = _rollup(blocks.join(owned, "conv"), width, n_leaves="sum(leaf)", all_saved="sum(all_saved)")
    above = Window.partitionBy("owner").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    own = nodes.withColumn("above", F.coalesce(F.sum("saved").over(above), F.lit(0)))
    children = nodes.filter("depth > 0").groupBy(F.col("y1").alias("z1"), F.col("y2").alias("z2"), (F.col("depth") - 1).alias("depth")) \
                    .agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("z1").alias("y1"), F.col("z2").alias("y2"), F.col("owner").alias("parent_conv_id"),
                           (F.col("depth") + 1).alias("depth"))
    out = (own.join(below, ["owner", "depth"]).join(parents, ["y1", "y2", "depth"], "left")
              .join(children, ["z1", "z2", "depth"], "left"))
    nodes = out.select("z1", "z2", "depth", F.col("owner").alias("conv_id"), "parent_conv_id", "n_convs",
                       F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves",
                       (F.col("all_saved") - F.col("above")).alias("saved_tokens"), "i1", "i2")
    return nodes, places.filter("pos = len").select("z1", "z2", F.col("pos").alias("depth"), "conv")


def node_texts(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """``nodes`` with role and text of each node's last turn (null for the root)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = conversations.select(F.xxhash64(F.lit(1), role, text).alias("i1"), F.xxhash64(F.lit(2), text, role).alias("i2"),
                                role.alias("role"), text.alias("text")).groupBy("i1", "i2").agg(
        F.first("role").alias("role"), F.first("text").alias("text"))
    return nodes.join(said, ["i1", "i2"], "left")


def end_digests(ends: DataFrame) -> DataFrame:
    """(z1, z2, depth, sha256) over the decimal conv_ids that end in a node, ascending and joined
    by commas.  Ids are joined in pieces of bounded length in parallel; a node's pieces pass one
    hash in order, which holds no list."""
    prepare(ends.sparkSession)
    key = ["z1", "z2", "depth"]
    ids = F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string"))
    pieces = (ends.withColumn("piece", F.floor(F.col("conv") / PIECE)).groupBy(*key, "piece")
                  .agg(F.array_join(ids, ",").alias("ids")))

    def run(batches):
        last, state, out = None, None, []

        def close():
            if state is not None:
                out.append((*last, state.hexdigest()))

        for batch in batches:
            *columns, texts = (c.to_pylist() for c in batch.columns)
            for name, text in zip(zip(*columns[:3]), texts):
                if name != last:
                    close()
                    last, state = name, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.encode())
            yield _digests(out)
            out.clear()
        close()
        yield _digests(out)
    return (pieces.repartition(*key).sortWithinPartitions(*key, "piece")
                  .mapInArrow(run, "z1 long, z2 long, depth long, sha256 string"))


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    columns = zip(*rows) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["z1", "z2", "depth", "sha256"])


def op12_trie(spark, sf_dir: str) -> DataFrame:
    """The nodes of the rebuilt conversations, by smallest member and depth.

    Nulls, ties and repeated rows as in ``turn_rows``; very long conversations take more blocks;
    columns other than conv_id, turn, role and text are ignored; an empty table has no nodes.
    """
    nodes, ends = prefix_trie(*rebuilt(turn_rows(table(spark, sf_dir, "conversations"))))
    out = nodes.join(end_digests(ends), ["z1", "z2", "depth"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


# crc32 of the decimal digits: a list of bytes, each followed by eight steps (-1) of the shift register
_CRC = """xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(c::varchar, ''),
        lambda d: list_concat([ascii(d)::bigint], list_transform(range(8), lambda i: -1::bigint))))),
        lambda x, y: case when y >= 0 then xor(x, y) when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end), 4294967295)"""
ORACLE_SQL = f"""
with t as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first) as pos,
                  coalesce(role, '') as r, coalesce(text, '') as x from conversations where conv_id is not null),
v as (select c, c - c % {FAMILY} as base, {_CRC} % {HEADS} as h, list([r, x] order by pos) as own from t group by c),
p as (select v.c, list_concat(coalesce(b.own, [])[1:v.h], v.own[v.h + 1:]) as path from v left join v b on b.c = v.base),
m as (select c, unnest(range(len(path) + 1)) as d, path from p),
n as (select path[1:d] as node, d, min(c) as conv_id, count(*) as n_convs,
             string_agg(case when len(path) = d then c::varchar end, ',' order by c) as ends from m group by 1, 2),
k as (select node[1:d - 1] as node, count(*) as n from n where d > 0 group by 1),
w as (select n.*, coalesce(k.n, 0) as n_children, case when d = 0 then 0 else (n_convs - 1) * octet_length(encode(n.node[d][2])) end as saved
      from n left join k on k.node = n.node),
s as (select node[1:a] as node, sum(saved) as saved, count(*) filter (n_children = 0) as n_leaves
      from (select node, saved, n_children, unnest(range(d + 1)) as a from w) group by 1)
select w.conv_id, w.d as depth, u.conv_id as parent_conv_id, w.n_convs, w.n_children, s.n_leaves,
       s.saved::bigint as saved_tokens, sha256(coalesce(w.ends, '')) as ends_sha256
from w join s on s.node = w.node left join w u on w.d > 0 and u.node = w.node[1:w.d - 1]
"""
