"""The volume inventory as XML.

``read_volume_inventory`` reads the inventory tool's raw form: one RESULTS element a machine
(attribute NODE) with an INSTANCE for each volume and its values as nested PROPERTY elements,
named by an attribute.  The properties are pivoted to columns; only fixed disks stay.

``read_volumes_xml`` reads the flat layout (root ``VOLUMES``, one ``VOLUME`` element a volume).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIXED_DISK = 3  # fixed value: the drive type that is inventoried
# fixed values: property name -> (column, type)
PROPERTIES = {"Name": ("name", "string"), "Label": ("label", "string"), "Capacity": ("capacity", "bigint"),
              "FreeSpace": ("free_space", "bigint"), "DriveType": ("drive_type", "int")}
VOLUME_SCHEMA = T.StructType([
    T.StructField("server_id", T.LongType()),
    T.StructField("volume_no", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("capacity", T.LongType()),
    T.StructField("free_space", T.LongType()),
])
_PROPERTY = "struct<_NAME: string, _TYPE: string, VALUE: string>"
RESULTS_SCHEMA = f"_NODE string, CIM struct<INSTANCE: array<struct<_CLASSNAME: string, PROPERTY: array<{_PROPERTY}>>>>"


def write_volumes_xml(volumes: DataFrame, path: str) -> None:
    volumes.write.mode("overwrite").format("xml").option("rootTag", "VOLUMES").option("rowTag", "VOLUME").save(path)


def read_volumes_xml(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "VOLUME").schema(VOLUME_SCHEMA).load(path)


def write_volume_inventory(volumes: DataFrame, path: str) -> None:
    """``volumes`` (node and the columns of ``PROPERTIES``) in the raw form, one RESULTS element a
    node: a machine's volumes are a bounded group.  A NULL has no VALUE element."""
    texts = {"string", "bigint", "int"}
    kind = {"string": "string", "bigint": "uint64", "int": "uint32"}
    assert {t for _, t in PROPERTIES.values()} <= texts
    listed = F.array(*[F.struct(F.lit(name).alias("_NAME"), F.lit(kind[t]).alias("_TYPE"),
                                F.col(column).cast("string").alias("VALUE"))
                       for name, (column, t) in sorted(PROPERTIES.items())])
    instance = F.struct(F.lit("Win32_Volume").alias("_CLASSNAME"), listed.alias("PROPERTY"))
    rows = volumes.select("node", instance.alias("i")).groupBy(F.col("node").alias("_NODE")).agg(F.collect_list("i").alias("INSTANCE"))
    (rows.select("_NODE", F.struct("INSTANCE").alias("CIM")).write.mode("overwrite").format("xml")
         .option("rootTag", "COMMAND").option("rowTag", "RESULTS").save(path))


def read_volume_inventory(spark: SparkSession, path: str, drive_type: int | None = FIXED_DISK) -> DataFrame:
    """(node, name, label, capacity, free_space, drive_type) of the volumes of ``drive_type``
    (None: all).  A property that is missing or without a value is NULL, as is a bad number."""
    rows = spark.read.format("xml").option("rowTag", "RESULTS").schema(RESULTS_SCHEMA).load(path)
    one = rows.select(F.col("_NODE").alias("node"), F.explode("CIM.INSTANCE").alias("i"))
    value = lambda name: F.get(F.filter("i.PROPERTY", lambda p: p["_NAME"] == name), 0)["VALUE"]
    out = one.select(
        "node", *[value(name).try_cast(t).alias(column) for name, (column, t) in PROPERTIES.items()])
    return out if drive_type is None else out.filter(F.col("drive_type") == drive_type)
