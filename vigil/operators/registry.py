"""Policy registry, exclusions, policy filter, module versions, config lookups."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.joins import anti_like, literal_rows, small
from vigil.functions.text import csv_items

REGISTRY_SCHEMA = T.StructType([
    T.StructField("policy_no", T.IntegerType(), False),
    T.StructField("policy_name", T.StringType(), False),
    T.StructField("processing_order", T.IntegerType(), False),
    T.StructField("is_server_level", T.BooleanType(), False),
    T.StructField("online_only", T.BooleanType(), False),
    T.StructField("is_active", T.BooleanType(), False),
])
EXCLUSION_SCHEMA = T.StructType([
    T.StructField("policy_no", T.IntegerType(), False),
    T.StructField("pattern", T.StringType(), False),
])

# Name of the maintenance database itself; it is excluded like a system database.
MAINT_DB = "Fleet"


@dataclass(frozen=True)
class PolicySpec:
    number: int
    name: str
    server_level: bool
    online_only: bool
    exclusions: str | None = None
    active: bool = True


def _seed_lists(maint_db: str) -> tuple[str, str, str]:
    e1 = f"master,msdb,{maint_db},ReportServer,ReportServerTempDB"
    e2 = f"master,tempdb,model,msdb,{maint_db}"
    e3 = f"master,tempdb,model,msdb,{maint_db},ReportServer,ReportServerTempDB"
    return e1, e2, e3


def default_policies(maint_db: str = MAINT_DB) -> list[PolicySpec]:
    """The built-in policy set.

    Fixed values (must equal the reference): policy numbers, names, levels,
    online-only flags, exclusion seeds and the three inactive mirroring policies.
    """
    e1, e2, e3 = _seed_lists(maint_db)
    return [
        PolicySpec(1, "Autogrowth must be not in %", False, True, "master"),
        PolicySpec(2, "Autogrowth must be 100 MB", False, True, e1),
        PolicySpec(3, "DB collation must be = server collation", False, False, "ReportServer,ReportServerTempDB"),
        PolicySpec(4, "DB compat. level must be = server level", False, False),
        PolicySpec(5, "Last backup may not be too old", False, False, "tempdb"),
        PolicySpec(6, "AutoClose must be turned off", False, False),
        PolicySpec(7, "AutoShrink must be turned off", False, False),
        PolicySpec(8, "Recovery model may not be SIMPLE", False, False, "master,msdb,tempdb,ReportServerTempDB"),
        PolicySpec(9, "All databases should be ONLINE", False, False),
        PolicySpec(10, "Services startup", True, False),
        PolicySpec(11, "Services accounts", True, False),
        PolicySpec(12, "Priority boost", True, False),
        PolicySpec(13, "Instance name", True, False),
        PolicySpec(14, "User databases check job", True, False),
        PolicySpec(16, "max degree of parallelism", True, False),
        PolicySpec(17, "SA account", True, False),
        PolicySpec(18, "Number of Virtual Log Files", False, True, e2),
        PolicySpec(19, "Housekeeping: orphaned exclusions", True, False),
        PolicySpec(20, "Housekeeping: unneeded exclusions", True, False),
        PolicySpec(21, "Fatal errors", True, False),
        PolicySpec(22, "Job step log names", True, False),
        PolicySpec(23, "Job category", True, False),
        PolicySpec(24, "Job notification", True, False),
        PolicySpec(25, "Performance issues", True, False),
        PolicySpec(26, "Arithmetic Abort", False, False, e3),
        PolicySpec(27, "Mirroring: DB must be mirrored", False, False, e2, active=False),
        PolicySpec(28, "Mirroring: Must be up and running", False, False, active=False),
        PolicySpec(29, "Mirroring: Configuration", False, False, active=False),
    ]


def registry_frame(spark: SparkSession, specs: list[PolicySpec]) -> DataFrame:
    rows = [(s.number, s.name, s.number, s.server_level, s.online_only, s.active) for s in specs]
    return literal_rows(spark, rows, REGISTRY_SCHEMA)


def exclusion_requests(spark: SparkSession, specs: list[PolicySpec]) -> DataFrame:
    """(policy_no, csv) -- the exclusion lists as they are passed at registration."""
    rows = [(s.number, s.exclusions) for s in specs]
    return literal_rows(spark, rows, "policy_no int, csv string")


def explode_exclusions(requests: DataFrame) -> DataFrame:
    """csv lists -> one row per (policy, pattern); a NULL list gives no rows."""
    return (requests.select("policy_no", F.explode(csv_items("csv")).alias("pattern"))
                    .dropDuplicates(["policy_no", "pattern"]))


def default_exclusions(spark: SparkSession, maint_db: str = MAINT_DB) -> DataFrame:
    return explode_exclusions(exclusion_requests(spark, default_policies(maint_db)))


def register(registry: DataFrame, exclusions: DataFrame, new: DataFrame,
             new_exclusions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Insert policies whose number is absent, with their exclusions; present
    numbers are left untouched (registering twice changes nothing)."""
    added = new.join(registry.select("policy_no"), "policy_no", "left_anti")
    reg = registry.unionByName(added.select(registry.columns))
    exc = exclusions.unionByName(
        explode_exclusions(new_exclusions.join(added.select("policy_no"), "policy_no", "left_semi"))
        .select(exclusions.columns))
    return reg, exc


def filter_numbers(spark: SparkSession, policy_filter: str | None) -> DataFrame:
    """The csv filter parameter as a frame of numbers ('' or junk -> NULL, dropped by the set ops)."""
    return (literal_rows(spark, [(policy_filter,)], "f string")
                 .select(F.explode(csv_items("f")).alias("v"))
                 .select(F.col("v").try_cast("int").alias("policy_no")))


def policy_filter(registry: DataFrame, policy_filter: str | None, invert: bool = False) -> DataFrame:
    """NULL -> all numbers; list -> intersect; inverted -> except; NULL + inverted -> none."""
    numbers = registry.select("policy_no")
    if policy_filter is None:
        return numbers.limit(0) if invert else numbers.distinct()
    wanted = filter_numbers(registry.sparkSession, policy_filter)
    return numbers.subtract(wanted) if invert else numbers.intersect(wanted)


def filter_text(selected: DataFrame) -> DataFrame:
    """The effective filter as comma-joined text, 'NULL' when empty (ordered by number)."""
    return selected.agg(F.expr("coalesce(listagg(cast(policy_no as string), ',') within group (order by policy_no), "
                               "'NULL')").alias("effective_filter"))


def active_policies(registry: DataFrame, selected: DataFrame) -> DataFrame:
    """P5: active policies in the filter, in processing order."""
    return (registry.join(selected, "policy_no", "inner")
                    .filter(F.col("is_active"))
                    .orderBy("processing_order", "policy_no"))


def upsert(target: DataFrame, updates: DataFrame, key: str | list[str]) -> DataFrame:
    """MERGE (insert new keys, update existing) as a full outer join; ``retention.merge_rows``
    writes the touched parts of a table and switches to them.  Key columns are not NULL."""
    keys = [key] if isinstance(key, str) else list(key)
    t, u = target.alias("t"), updates.withColumn("_new", F.lit(True)).alias("u")
    same = reduce(and_, [F.col(f"t.{k}") == F.col(f"u.{k}") for k in keys])
    pick = lambda c: F.when(F.col("u._new"), F.col(f"u.{c}")).otherwise(F.col(f"t.{c}")).alias(c)
    return t.join(u, same, "full_outer").select(*[pick(c) for c in target.columns])


def config_value(config: DataFrame, name: str) -> Column:
    """Scalar config lookup (``udf_get_config_value``): an uncorrelated scalar subquery,
    evaluated once per query and inlined as a literal."""
    return config.filter(F.col("name") == name).select(F.max("value")).scalar()


def config_int(config: DataFrame, name: str) -> Column:
    return config_value(config, name).try_cast("int")


def config_field(name: str) -> str:
    return name.replace(".", "__")


def config_struct(config: DataFrame, names) -> Column:
    """All ``names`` as one struct (NULL field = setting absent), as a scalar subquery."""
    return config.select(F.struct(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(config_field(n))
                                    for n in names])).scalar()


def server_settings(settings: DataFrame, names) -> DataFrame:
    """(server_id, _own): each server's own values of ``names`` as one struct.  One row a server;
    only servers with a setting of their own have one."""
    held = settings.filter(F.col("name").isin(list(names)))
    return held.groupBy("server_id").agg(F.struct(*[
        F.max(F.when(F.col("name") == n, F.col("value"))).alias(config_field(n)) for n in names]).alias("_own"))


def with_settings(df: DataFrame, config: DataFrame, names, server_config: DataFrame | None = None,
                  column: str = "_cfg") -> DataFrame:
    """``df`` with ``names`` as one struct: the server's own value if it has one, else the fleet's.
    A setting is chosen as it stands: an own value that is no number is not replaced by the fleet's."""
    if server_config is None:
        return df.withColumn(column, config_struct(config, names))
    own = server_settings(server_config, names).withColumnRenamed("server_id", "_own_id")
    df = df.join(small(own), F.col("server_id") == F.col("_own_id"), "left").withColumn("_fleet", config_struct(config, names))
    chosen = F.struct(*[F.coalesce(F.col("_own")[f], F.col("_fleet")[f]).alias(f) for f in map(config_field, names)])
    return df.withColumn(column, chosen).drop("_own", "_own_id", "_fleet")


def effective_settings(servers: DataFrame, config: DataFrame, server_config: DataFrame, names) -> DataFrame:
    """(server_id, name, value, is_own) of every server and setting that has a value there."""
    held = with_settings(servers.select("server_id"), config, names, server_config)
    each = F.array(*[F.struct(F.lit(n).alias("name"), F.col("_cfg")[config_field(n)].alias("value")) for n in names])
    rows = held.select("server_id", F.inline(each)).filter(F.col("value").isNotNull())
    own = server_config.select("server_id", "name", F.lit(True).alias("is_own")).distinct()
    return rows.join(own, ["server_id", "name"], "left").withColumn("is_own", F.coalesce("is_own", F.lit(False)))


def operator_lookup(config: DataFrame, operators: DataFrame) -> DataFrame:
    """For every ``*.notify_operator`` setting, the operator's mail address
    (NULL when the operator is missing)."""
    c = config.filter(F.col("name").endswith(".notify_operator")).select(
        F.col("name").alias("config_name"), F.col("value").alias("operator_name"))
    o = operators.select(F.col("name").alias("operator_name"), "email_address")
    return c.join(o, "operator_name", "left").select("config_name", "operator_name", "email_address")


def eligible_databases(databases: DataFrame, registry: DataFrame, exclusions: DataFrame) -> DataFrame:
    """(policy, database) pairs a database-level policy visits: not excluded by a
    LIKE pattern of that policy (case-insensitive), online when the policy asks for it.

    The registry's database-level rows are a bounded list; they reach each database
    row as one scalar array (no join); the exclusion test is ``joins.anti_like``.
    """
    pols = (registry.filter(~F.col("is_server_level") & F.col("is_active"))
                    .select(F.sort_array(F.collect_list(F.struct("policy_no", "online_only")))).scalar())
    pairs = (databases.select("server_id", F.col("name").alias("db_name"), F.col("state").alias("db_state"),
                              F.inline(pols))
                      .filter(~F.col("online_only") | (F.col("db_state") == 0)))
    return anti_like(pairs, "db_name", exclusions, ["policy_no"], names=databases.select("name")).select(
        "server_id", "policy_no", "db_name")
