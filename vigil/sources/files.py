"""Directory listing ``ls(path, pattern)`` -- top folder only, no file content
read.  Spark's binaryFile source reads the content column only when it is selected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    listing = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
                    .option("recursiveFileLookup", "false").load(path))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return listing.select(
        name.alias("name"),
        F.regexp_extract(name, r"(\.[^.]*)$", 1).alias("extension"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("last_write_time"))
