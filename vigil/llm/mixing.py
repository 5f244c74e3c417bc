"""Mixing sources to target weights by capped water-filling (native).

Targets: sources share ``share`` times all words by weight; a source is clamped at
``max_epochs`` times its own words and the excess goes to the others by weight until no
target is above its clamp.  In closed form the water level is the largest of
``(T - caps before) / (weights from here)`` along the sources sorted by cap / weight.

``mix`` plans the words that each document gives, ``sample`` makes the rows.

Repetitions: a source with target ``f`` times its words takes every document
``floor(f)`` times and fills the rest, in a seeded order of its documents, up to the
target's nearest whole word; the one document on that border is taken in part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import seed_hash, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = 20240
#: the seeded order is cut into 16**HEX_DIGITS ranges a source, so that a source with a
#: third of all rows is still summed in many tasks
HEX_DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
                   max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sources`` (source, source_size) with ``target``.  One row a source: the list of
    sources is configuration-sized, and its windows run over that list only."""
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]),
                     ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
                      % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", w).withColumn("cap", F.col("source_size") * max_epochs)
    order = [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()]
    below = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    s = s.withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share))
                               - F.coalesce(F.sum("cap").over(below), F.lit(0))) / F.sum("weight").over(onward))
    return s.select("source", "source_size",
                    F.least(F.col("cap").cast("double"),
                            F.max("level").over(everything) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS,
        seed: int = SEED, carry: Sequence[str] = ()) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken, then ``carry`` columns.

    size counts words (null and empty texts: 0, never taken); a null source is a source of
    its own, last in order; repeated rows are separate documents; an empty table gives no
    rows; other columns of ``docs`` are ignored unless carried.
    """
    rows = docs.select(
        F.col("doc_id"), F.col("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        seed_hash(F.lit(seed), F.col("doc_id")).alias("_order"),
        F.struct(F.lit(0).alias("_none"), *[F.col(c) for c in carry]).alias("_carry"))
    rows = rows.withColumn("_range", F.substring("_order", 1, HEX_DIGITS))
    ranges = rows.groupBy("source", "_range").agg(F.sum("size").alias("range_size"))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")),
                             weights, share, max_epochs)
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_base", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
    t = targets.withColumnRenamed("source", "_s")
    ranges = ranges.join(t, F.col("source").eqNullSafe(F.col("_s"))).select(
        F.col("source").alias("_s"), F.col("_range").alias("_r"), "_base", "source_size", "target")
    within = Window.partitionBy("source", "_range").orderBy("_order", "doc_id", "size") \
        .rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_sum", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(ranges, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.round("target").cast("long") - F.col("_whole") * F.col("source_size") - F.col("_base") - F.col("_sum")
    return (rows.withColumn("_whole", whole)
                .withColumn("taken", F.col("_whole") * F.col("size")
                            + F.greatest(F.lit(0), F.least(F.col("size"), rest)))
                .select("doc_id", "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"),
                        *[F.col("_carry")[c].alias(c) for c in carry]))


#: columns that ``sample`` adds
ADDED = ("size", "source_size", "target", "copy", "taken")


def sample(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a row for each repetition of a document, with the columns of ``docs`` and
    ``ADDED``.  copy counts a document's repetitions from 1; taken is the number of words in the
    row's text.  Whole repetitions keep their text; of the one document of a source that is taken
    in part, the last repetition has its first words, joined by blanks.  Documents of which nothing
    is taken are not in the mix.  A column of ``docs`` named like an added one is replaced.
    """
    own = [c for c in docs.columns if c not in ADDED]
    packed = docs.select("doc_id", "source", "text", F.struct(*own).alias("_row"))
    rows = mix(packed, carry=("_row",), **options).drop("doc_id", "source")
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0))
    rest = F.col("taken") - whole * F.col("size")
    rows = rows.withColumn("_takes", F.concat(F.array_repeat(F.col("size"), whole.cast("int")),
                                              F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<long>"))))
    rows = rows.drop("taken").select("*", F.posexplode("_takes").alias("_n", "taken"))
    cut = F.col("taken") < F.col("size")
    text = F.col("_row.text")
    part = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), 0), F.lit(1), F.col("taken").cast("int")), " ")
    out = {"text": F.when(cut, part).otherwise(text)}
    if "n_chars" in own:
        out["n_chars"] = F.when(cut, F.length(part).cast("long")).otherwise(F.col("_row.n_chars"))
    return rows.select(*[out.get(c, F.col("_row")[c]).alias(c) for c in own], "size", "source_size", "target",
                       (F.col("_n") + 1).alias("copy"), "taken")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document with the words the mix takes of it."""
    return mix(table(spark, sf_dir, "documents")).drop("source")


ORACLE_SQL = f"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
         md5('{SEED}|' || coalesce(doc_id::varchar, 'null')) as o from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, (case (row_number() over (order by source asc nulls last) - 1) % 3
                 when 0 then 5 when 1 then 2 else 1 end) as weight, {MAX_EPOCHS} * source_size as cap from s),
l as (select *, ((sum(source_size) over ()) * {SHARE}::double
                 - coalesce(sum(cap) over (order by cap / weight, source nulls last
                                           rows between unbounded preceding and 1 preceding), 0))::double
                / (sum(weight) over (order by cap / weight, source nulls last
                                     rows between current row and unbounded following))::double as level from w),
t as (select source, source_size, least(cap::double, (max(level) over ()) * weight) as target from l),
c as (select d.*, t.source_size, t.target,
             case when t.source_size > 0 then floor(t.target / t.source_size)::bigint else 0 end as whole,
             coalesce(sum(size) over (partition by d.source order by o, doc_id, size
                                      rows between unbounded preceding and 1 preceding), 0)::bigint as before
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, round(target)::bigint - whole * source_size - before)))::bigint as taken
from c
"""
