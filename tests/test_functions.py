import datetime as dt

from pyspark.sql import functions as F

from vigil.functions.text import boundary_days, boundary_seconds, csv_items, like_to_regex, safe_os_name


def test_like_to_regex(spark):
    cases = [("m[as]%", "master", True), ("m[as]%", "model", False), ("DB_2_", "DB_2X", True),
             ("DB_2_", "DB_201", False), ("db_1%", "DB_100", True), ("[[]Unc%", "[Uncategorized", True),
             ("a.b", "axb", False), ("a.b", "A.B", True), ("[^m]%", "master", False), ("100%", "100 MB", True),
             ("a+b", "a+b", True), ("(x)", "(X)", True), ("master", "MASTER", True), ("master", "masterx", False)]
    df = spark.createDataFrame(cases, "p string, n string, want boolean")
    got = df.select("want", F.regexp_like("n", like_to_regex("p")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_csv_items_keeps_empty_and_drops_null(spark):
    df = spark.createDataFrame([(" a, b ,,c",), (None,), ("",)], "s string")
    rows = [r.x for r in df.select(F.explode(csv_items("s")).alias("x")).collect()]
    assert rows == ["a", "b", "", "c", ""]


def test_safe_os_name(spark):
    r = spark.createDataFrame([("a.b\\c/d:e*f?g<h>i|j",)], "s string").select(safe_os_name("s").alias("x")).first()
    assert r.x == "a_b_c_d_e_f_g_h_i_j"


def test_boundaries_count_midnights_and_seconds(spark):
    a, b = dt.datetime(2024, 1, 1, 23, 59, 59, 900000), dt.datetime(2024, 1, 2, 0, 0, 0, 100000)
    df = spark.createDataFrame([(a, b)], "a timestamp_ntz, b timestamp_ntz")
    r = df.select(boundary_days("a", F.col("b")).alias("d"), boundary_seconds("a", F.col("b")).alias("s")).first()
    assert (r.d, r.s) == (1, 1)
