"""Database selection by pattern (F1-F10): which databases of each server a
maintenance action or a policy visits.

Patterns: ``*system``, ``*user``, ``*``, ``list(a,b)``, ``list($usedefinition)``,
or one exact name.  Comparisons ignore case, as under the reference's collation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.joins import literal_rows, small

from vigil.functions.text import csv_items

# The system databases.
SYSTEM_DBS = ("master", "model", "msdb")                 # what "*system" expands to (no tempdb)
NOT_USER_DBS = ("master", "tempdb", "model", "msdb")     # what "*user" leaves out
LIST_FROM_CONFIG = "$usedefinition"
LIST_CONFIG_KEY = "base.database_list"

SELECTION_COLUMNS = ["server_id", "db_name", "db_state"]
_ALL_COLUMNS = [*SELECTION_COLUMNS, "is_read_only", "database_id"]


def expand(pattern: str, databases: DataFrame, servers: DataFrame, config: DataFrame | None = None) -> DataFrame:
    """Pattern -> (server_id, db_name, db_state) for every server; patterns ignore case."""
    return _selected(pattern, databases, servers, config).select(*SELECTION_COLUMNS)


def _selected(pattern: str, databases: DataFrame, servers: DataFrame, config: DataFrame | None) -> DataFrame:
    spark = databases.sparkSession
    dbs = databases.select("server_id", F.col("name").alias("db_name"), F.col("state").cast("int").alias("db_state"),
                           F.coalesce("is_read_only", F.lit(False)).alias("is_read_only"), "database_id")
    low = pattern.lower()
    if low == "*system":
        # a fixed three-name list per server, state taken as ONLINE
        named = servers.select("server_id", F.explode(F.array(*[F.lit(n) for n in SYSTEM_DBS])).alias("db_name"))
        own = dbs.filter(F.lower("db_name").isin(list(SYSTEM_DBS))).select(
            F.col("server_id").alias("_s"), F.lower("db_name").alias("_n"), "is_read_only", "database_id")
        return (named.join(own, (F.col("server_id") == F.col("_s")) & (F.col("db_name") == F.col("_n")), "left")
                     .select("server_id", "db_name", F.lit(0).alias("db_state"),
                             F.coalesce("is_read_only", F.lit(False)).alias("is_read_only"), "database_id"))
    if low == "*user":
        return dbs.filter(~F.lower("db_name").isin(list(NOT_USER_DBS)))
    if low == "*":
        return dbs
    if low.startswith("list(") and low.endswith(")"):
        body = pattern[5:-1]
        items = literal_rows(spark, [(body,)], "body string")
        if body.lower() == LIST_FROM_CONFIG and config is not None:
            cfg = config.filter(F.col("name") == LIST_CONFIG_KEY).select(F.max("value")).scalar()
            # unset -> the literal stays and matches nothing
            items = items.select(F.coalesce(cfg, F.col("body")).alias("body"))
        items = items.select(F.explode(csv_items("body")).alias("item")).select(F.lower("item").alias("k"))
        # the list is a parameter (bounded); duplicates in it duplicate rows
        return dbs.join(small(items), F.lower(F.col("db_name")) == F.col("k")).select(*_ALL_COLUMNS)
    return dbs.filter(F.lower("db_name") == low)


def skipped(pattern: str, databases: DataFrame, servers: DataFrame, config: DataFrame | None = None,
            skip_read_only: bool = False) -> DataFrame:
    """How many selected databases of each server are skipped, by reason; every server has a row."""
    sel = _selected(pattern, databases, servers, config)
    read_only = F.col("is_read_only") if skip_read_only else F.lit(False)
    counts = sel.groupBy("server_id").agg(F.count_if(F.col("db_state") != 0).alias("n_offline"),
                                          F.count_if((F.col("db_state") == 0) & read_only).alias("n_read_only"))
    return servers.select("server_id").join(counts, "server_id", "left").select(
        "server_id", F.coalesce("n_offline", F.lit(0)).alias("n_offline"),
        F.coalesce("n_read_only", F.lit(0)).alias("n_read_only"))


def for_each(pattern: str, databases: DataFrame, servers: DataFrame, config: DataFrame | None = None,
             skip_read_only: bool = False) -> DataFrame:
    """The databases an action visits -- ONLINE only, optionally writable only --
    with the server's numbers of skipped offline and read-only databases.  A server
    whose databases are all skipped has one row without a database name."""
    sel = _selected(pattern, databases, servers, config).filter(F.col("db_state") == 0)
    if skip_read_only:
        sel = sel.filter(~F.col("is_read_only"))
    counts = skipped(pattern, databases, servers, config, skip_read_only)
    return counts.join(sel.select("server_id", "db_name"), "server_id", "left").select(
        "server_id", "db_name", "n_offline", "n_read_only")


def affected_list(pattern: str, databases: DataFrame, servers: DataFrame, config: DataFrame | None = None,
                  skip_read_only: bool = False) -> DataFrame:
    """the printed list -- left(name, 40) and the database id, by name."""
    kept = _selected(pattern, databases, servers, config).filter(F.col("db_state") == 0)
    if skip_read_only:
        kept = kept.filter(~F.col("is_read_only"))
    return (kept.select("server_id", F.left("db_name", F.lit(40)).alias("name"), F.col("database_id").alias("id"))
                .orderBy("server_id", "name"))


def csv_rows(df: DataFrame, key: str, column: str) -> DataFrame:
    """a comma list column -> one row per item (trimmed, empty items kept,
    NULL -> no rows), with its position."""
    return df.select(key, F.posexplode(csv_items(column)).alias("pos", "item"))
