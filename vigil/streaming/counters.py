"""The collected counters (S11, ST7): 15 paths, matched by object and counter.

A path is ``\\Object(Instance)\\Counter``.  In a collected path ``(*)`` stands for any
instance, ``(X)`` for that one and no brackets for none.  Counters of a database instance have its name in the
object (``\\MSSQL$NAME:Object``, or ``\\SQLServer:Object`` for the default instance); a collected
path is written for one of them and stands for all.  Both sides are split once, so samples meet
the collected paths in a hash join on (set, object, counter).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.joins import literal_rows, small

# Fixed values: (collector, object, instance, counter); NULL: none, '*': any.
COUNTERS = (
    ("System", "Memory", None, "Pages/sec"),
    ("System", "System", None, "Processor Queue Length"),
    ("System", "Processor", "*", "% Processor Time"),
    ("System", "Memory", None, "Available MBytes"),
    ("System", "Network Interface", None, "Bytes Total/sec"),
    ("System", "PhysicalDisk", "_Total", "% Disk Time"),
    ("System", "PhysicalDisk", "_Total", "Avg. Disk Queue Length"),
    ("SQLServer", "Buffer Manager", None, "Buffer cache hit ratio"),
    ("SQLServer", "Buffer Manager", None, "Page life expectancy"),
    ("SQLServer", "Databases", "_Total", "Transactions/sec"),
    ("SQLServer", "General Statistics", None, "User Connections"),
    ("SQLServer", "Memory Manager", None, "Total Server Memory (KB)"),
    ("SQLServer", "SQL Statistics", None, "Batch Requests/sec"),
    ("SQLServer", "SQL Statistics", None, "SQL Compilations/sec"),
    ("SQLServer", "SQL Statistics", None, "SQL Re-Compilations/sec"),
)
COUNTER_PATH = r"^\\([^\\(]+)(?:\(([^)]*)\))?\\(.+)$"
SERVER_OBJECT = r"(?i)^(?:MSSQL\$([^:]+)|(SQLServer)):(.+)$"
SAMPLE_WINDOW = "60 seconds"


def split_path(df: DataFrame, column: str = "counter_path") -> DataFrame:
    """``df`` with object, instance (NULL: none), counter, collector and sql_instance (NULL: not
    a database counter); object without the instance's name."""
    p, own = F.col(column), F.regexp_extract(column, COUNTER_PATH, 1)
    named = F.regexp_extract(own, SERVER_OBJECT, 3)
    return (df.withColumn("object", F.when(named != "", named).otherwise(own))
              .withColumn("instance", F.nullif(F.regexp_extract(p, COUNTER_PATH, 2), F.lit("")))
              .withColumn("counter", F.regexp_extract(p, COUNTER_PATH, 3))
              .withColumn("collector", F.when(named != "", F.lit("SQLServer")).otherwise(F.lit("System")))
              .withColumn("sql_instance", F.when(named != "", F.coalesce(
                  F.nullif(F.regexp_extract(own, SERVER_OBJECT, 1), F.lit("")), F.lit("MSSQLSERVER")))))


def collected(samples: DataFrame, counters=COUNTERS) -> DataFrame:
    """The samples of the collected counters, split, with the counter's number (from 1).  Names
    are compared ignoring case, as the collector does."""
    spark: SparkSession = samples.sparkSession
    rows = [(i + 1, c, o.lower(), n, k.lower()) for i, (c, o, n, k) in enumerate(counters)]
    wanted = literal_rows(spark, rows, "counter_no int, _collector string, _object string, _instance string, _counter string")
    s = split_path(samples)
    met = ((F.col("collector") == F.col("_collector")) & (F.lower("object") == F.col("_object"))
           & (F.lower("counter") == F.col("_counter"))
           & F.when(F.col("_instance") == "*", F.col("instance").isNotNull())
              .otherwise(F.lower("instance").eqNullSafe(F.lower("_instance"))))
    return s.join(small(wanted), met).drop("_collector", "_object", "_instance", "_counter")


def counter_rollup(samples: DataFrame, watermark: str | None = None) -> DataFrame:
    """Collected counters per 60-second window, server, database instance, counter and instance."""
    df = collected(samples.withColumn("ts", F.col("ts").cast("timestamp")))
    if watermark:
        df = df.withWatermark("ts", watermark)
    # an exact sum, so that the mean does not depend on the order of the samples
    mean = F.sum(F.col("value").cast("decimal(28,6)")).cast("double") / F.count("value")
    return (df.groupBy("server_id", F.window("ts", SAMPLE_WINDOW).alias("w"), "counter_no", "collector", "sql_instance",
                       "object", "instance", "counter")
              .agg(F.count(F.lit(1)).alias("n_samples"), mean.alias("avg_value"),
                   F.min("value").alias("min_value"), F.max("value").alias("max_value"))
              .select("server_id", F.col("w.start").alias("window_start"), "counter_no", "collector", "sql_instance",
                      "object", "instance", "counter", "n_samples", "avg_value", "min_value", "max_value"))
