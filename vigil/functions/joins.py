"""Broadcast only behind a size check."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Largest estimated size we hint as broadcast (configuration-sized tables).
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimized plan (no job runs)."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(size if isinstance(size, int) else size.toString())


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` reads, by Catalyst's estimates of its leaves (no job runs)."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [leaves.apply(i).stats().sizeInBytes() for i in range(leaves.size())]
    return sum(int(s if isinstance(s, int) else s.toString()) for s in sizes)


def small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """``broadcast(df)`` when its estimated size is within ``limit``; otherwise the
    frame unhinted, so the planner (and AQE at runtime) picks a shuffle join."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """Parameter rows as literals inside the plan: unlike a frame made from Python rows,
    whose size Catalyst takes for unbounded, it has a real size estimate."""
    types = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in types])
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, types)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


# Non-ASCII characters that match an ASCII letter when case is ignored, and those letters.
_CASE_PARTNERS = ("ſKİı", "skii")
#: lengths of a pattern's leading literal text by which it is looked up
PREFIXES = (4, 2, 1)
#: length of the literal text inside a pattern by which it is looked up
GRAM = 3
_LITERAL = r"((?:\x01[ -~]|[ -~&&[^%_\[]])+)"


def folded(name):
    """Lower case in which names and the literal text of patterns meet."""
    return F.lower(F.translate(name, *_CASE_PARTNERS))


def pattern_index(patterns: DataFrame) -> DataFrame:
    """``patterns`` with ``kind`` and ``literal``, a coarse class (``anti_like`` uses ``pattern_keys``).

    exact: the whole pattern is literal; prefix4, prefix2, prefix1: names begin with the literal;
    gram: names hold it somewhere; any: no literal text to look up.  A class of one character
    (``[_]``) is literal text; only ASCII text serves as a key, so that ignoring case means the
    same in a key as in the regex.
    """
    marked = F.regexp_replace("pattern", r"\[([^\]^])\]", "\x01$1")          # a literal character
    marked = F.regexp_replace(marked, r"(?<!\x01)\[[^\]]*\]", "%")           # any other class
    plain = lambda c: folded(F.replace(c, F.lit("\x01"), F.lit("")))
    head = plain(F.regexp_extract(marked, "^" + _LITERAL, 1))
    runs = F.transform(F.regexp_extract_all(marked, F.lit(_LITERAL), 1), plain)
    inside = F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("text"))))["text"]
    choices = [(F.length(head) >= n, f"prefix{n}", F.substring(head, 1, n)) for n in PREFIXES if n >= GRAM]
    choices.append((F.length(inside) >= GRAM, "gram", F.substring(inside, 1, GRAM)))
    choices += [(F.length(head) >= n, f"prefix{n}", F.substring(head, 1, n)) for n in PREFIXES if n < GRAM]
    found = F.coalesce(*[F.when(fits, F.struct(F.lit(kind).alias("kind"), text.alias("literal"))) for fits, kind, text in choices],
                       F.struct(F.lit("any").alias("kind"), F.lit("").alias("literal")))
    return patterns.withColumn("_found", found).select(*patterns.columns, "_found.kind", "_found.literal")


#: lengths to which the literal text inside a pattern is cut
INSIDE = (16, 12, 8, 6, 4, 3, 2, 1)
_WILD, _BREAK = "\x02", "\x03"


def pattern_keys(patterns: DataFrame) -> DataFrame:
    """The distinct ``patterns`` with what a name must hold to match, found without the regex.

    The text before the first ``%`` and after the last one stands at fixed places: ``runs`` are the
    places of its literal parts (from 1, or from -1 backwards), ``size`` is the length of the name
    where the pattern has no ``%``.  ``inside`` is the length of the longest literal text between,
    where that is longer than all of the fixed text.  ``key`` hashes the places or the length with
    the literal text; it is null for a pattern without any.  Text outside ASCII counts as wild.
    """
    marked = F.regexp_replace("pattern", "\x01", "\u00e9")                    # any one character, see below
    marked = F.regexp_replace(marked, r"\[([ -~&&[^\]^]])\]", "\x01$1")     # a literal character
    marked = F.regexp_replace(marked, r"(?<!\x01)(\[[^\]]*\]|[\n\r\x{85}\x{2028}\x{2029}])", "%")
    marked = F.regexp_replace(marked, r"(?<!\x01)_|[^ -~\x01]", _WILD)
    marked = F.regexp_replace(marked, r"(?<!\x01)%", _BREAK)
    parts = F.split(folded(F.replace(marked, F.lit("\x01"), F.lit(""))), _BREAK)
    literal = lambda c: F.regexp_extract_all(c, F.lit(f"([^{_WILD}]+)"), 0)

    def places(c, back):
        at = F.filter(F.transform(F.split(c, ""), lambda x, i: F.when((x != _WILD) & (x != ""), i + 1)), lambda i: i.isNotNull())
        at = F.filter(at, lambda i: (i == 1) | (F.substring(c, i - 1, F.lit(1)) == _WILD))
        first = (lambda i: i - F.length(c) - 1) if back else (lambda i: i)
        return F.zip_with(at, literal(c), lambda i, t: F.struct(first(i).cast("int").alias("at"), F.length(t).alias("n")))

    # an aggregate: the parts are found once a pattern, by all that use the index, and no filter moves below
    out = patterns.groupBy(*patterns.columns).agg(F.max(parts).alias("_parts"))
    out = out.withColumn("_head", F.col("_parts")[0]).withColumn("_tail", F.when(F.size("_parts") > 1, F.element_at("_parts", -1)).otherwise(""))
    between = F.slice("_parts", F.lit(2), F.greatest(F.size("_parts") - 2, F.lit(0)))
    longest = F.array_max(F.transform(F.flatten(F.transform(between, literal)), lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    out = out.withColumn("_texts", F.concat(literal(F.col("_head")), literal(F.col("_tail")))).withColumn("_longest", longest)
    fixed = F.length(F.array_join("_texts", ""))
    cut = F.coalesce(*[F.when(F.length("_longest") >= n, F.lit(n)) for n in INSIDE])
    out = out.withColumn("inside", F.when(cut > fixed, cut))
    at_all = F.col("inside").isNull() & (fixed > 0)
    out = out.withColumn("size", F.when(at_all & (F.size("_parts") == 1), F.length("_head")))
    out = out.withColumn("runs", F.when(at_all, F.concat(places(F.col("_head"), False), places(F.col("_tail"), True))))
    key = (F.when(at_all, F.xxhash64(F.xxhash64("size", "runs"), F.array_join("_texts", _WILD)))
            .when(F.col("inside").isNotNull(), F.xxhash64("inside", F.substring("_longest", F.lit(1), F.col("inside")))))
    return out.withColumn("key", key).drop("_parts", "_head", "_tail", "_texts", "_longest")


def name_keys(names: DataFrame, index: DataFrame) -> DataFrame:
    """(name, key): each distinct name of ``names`` (one column) with the keys under which
    patterns of ``index`` (see ``pattern_keys``) may match it.  The distinct places and lengths of
    the patterns, far fewer than patterns, reach each name as scalar arrays."""
    shape = F.when(F.col("runs").isNotNull(), F.struct(F.xxhash64("size", "runs").alias("id"), "size", "runs"))
    looked = index.select(F.struct(F.collect_set(shape).alias("shapes"), F.collect_set("inside").alias("lengths"))).scalar()
    name = names.columns[0]
    # without patterns nothing of the names is read
    held = names.filter(F.col(name).isNotNull() & (F.size(looked["shapes"]) + F.size(looked["lengths"]) > 0)).distinct()
    held = held.withColumn("_low", folded(F.col(name))).withColumn("_looked", looked)
    held = held.select(name, "_low", F.length("_low").alias("_n"), "_looked.shapes", "_looked.lengths").toDF(
        name, "_low", "_n", "_shapes", "_lengths")
    low, n = F.col("_low"), F.col("_n")
    fits = F.filter("_shapes", lambda s: s["size"].isNull() | (s["size"] == n))
    fixed = F.transform(fits, lambda s: F.xxhash64(s["id"], F.array_join(
        F.transform(s["runs"], lambda r: F.substring(low, r["at"], r["n"])), _WILD)))
    windows = F.transform(F.filter("_lengths", lambda k: k <= n), lambda k: F.transform(
        F.sequence(F.lit(1), n - k + 1), lambda i: F.xxhash64(k, F.substring(low, i, k))))
    return held.select(name, F.explode(F.array_distinct(F.concat(fixed, F.flatten(windows)))).alias("key"))


def anti_like(df: DataFrame, name_col: str, patterns: DataFrame, keys: list[str], scope=None,
              names: DataFrame | None = None) -> DataFrame:
    """Rows of ``df`` whose ``name_col`` matches none of the LIKE ``patterns`` that share
    ``keys`` (case-insensitive) -- the exclusion test.

    Plain names are a hash anti join on (keys, lower(name)): no regex at all.  A pattern is looked
    up by all of its literal text at fixed places, or by some inside (``pattern_keys``), in one
    join with the keys of the distinct names; only those candidates meet the regex, which is
    written once, on the patterns' side.  Patterns without literal text become one alternative
    for each value of ``keys``.  ``scope`` (a Column of ``df``) limits the rows that the exclusions
    apply to; ``names`` (one column) holds at least the names in scope, where they are cheaper to
    get than from ``df``.
    """
    from vigil.functions.text import has_like_wildcard, like_to_regex
    scope = F.lit(True) if scope is None else scope
    own = ["_x_" + k for k in keys]
    p = patterns.select(*[F.col(k).alias("_x_" + k) for k in keys], "pattern")
    exact = p.filter(~has_like_wildcard("pattern")).select(*own, F.lower("pattern").alias("_x_name")).distinct()
    wild = pattern_keys(p.filter(has_like_wildcard("pattern"))).withColumn("_x_rx", like_to_regex("pattern"))
    name, rx = F.col(name_col), F.col("_x_rx")

    def without(rows: DataFrame, side: DataFrame, *conditions) -> DataFrame:
        met = [F.col(k) == F.col("_x_" + k) for k in keys]
        return rows.join(small(side), reduce(and_, [*met, scope, *conditions]), "left_anti")

    out = without(df, exact, F.lower(name) == F.col("_x_name"))
    source = out.filter(scope).select(name.alias("_x_name")) if names is None else names.toDF("_x_name")
    side = wild.filter("key is not null").select(*own, F.col("key").alias("_x_key"), "_x_rx")
    found = name_keys(source, wild).join(small(side), (F.col("key") == F.col("_x_key")) & F.regexp_like("_x_name", rx))
    out = without(out, found.select(*own, "_x_name").distinct(), name == F.col("_x_name"))
    rest = wild.filter("key is null").groupBy(*own).agg(F.array_join(F.sort_array(F.collect_set("_x_rx")), "|").alias("_x_rx"))
    return without(out, rest, F.regexp_like(name, rx))
