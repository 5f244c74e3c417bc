"""Data-quality scans for the constraints the reference declares (Q1-Q3):
keys that must be unique, CHECK predicates, foreign keys with cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.joins import input_bytes

#: bytes of the read files for each task that groups keys: hundreds of thousands of rows
TASK_BYTES = 4 * 1024 * 1024


def duplicate_keys(df: DataFrame, keys: list[Column | str], label: str) -> DataFrame:
    """Q1: key values held by more than one row (hash aggregate on the key columns; the key is
    printed only for the offending groups).  Keys are dealt over a number of tasks that grows with
    the files read, as almost every row is a group of its own and the map of a task holds them all.
    The rows of one key meet in one task, as keys only, and are counted as they are read."""
    cols = [(F.col(k) if isinstance(k, str) else k).alias(f"_k{i}") for i, k in enumerate(keys)]
    parts = max(1, -(-input_bytes(df) // TASK_BYTES))
    grouped = df.select(*cols).repartition(parts, *[F.col(f"_k{i}") for i in range(len(keys))])
    grouped = grouped.groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)
    key_text = F.concat_ws("|", *[F.col(f"_k{i}").cast("string") for i in range(len(keys))])
    return grouped.select(F.lit(label).alias("constraint_name"), key_text.alias("key_value"), "n_rows")


def check_violations(df: DataFrame, predicate: Column, label: str) -> DataFrame:
    """Q2: rows whose CHECK predicate is FALSE (NULL passes, as in SQL)."""
    return df.filter(~F.coalesce(predicate, F.lit(True))).withColumn("constraint_name", F.lit(label))


def volume_bound_check(bounds: DataFrame) -> Column:
    """The volume-bound CHECK: both bounds within 1..100 and warning below error."""
    w, e = F.col("warning_pct"), F.col("error_pct")
    return w.between(1, 100) & e.between(1, 100) & (w < e)


def orphans(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Q3: child rows whose key has no parent row (left anti join)."""
    return child.join(parent.select(*keys), keys, "left_anti")


def cascade_keep(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Q3: what survives an ON DELETE CASCADE once parents are gone (left semi join)."""
    return child.join(parent.select(*keys), keys, "left_semi")
