"""The violation report (P7-P9, S12, S13) and per-policy results.

Plan shape: one union of policy scans -> broadcast join with the registry (a
bounded table) -> broadcast hash anti join with the exclusion patterns (policy
number as hash key, regex as residual) -> per-server numbering that splits hot
servers (``operators.numbering``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.joins import anti_like

from vigil.operators import registry as reg
from vigil.operators.numbering import number_within
from vigil.plans.context import CheckContext
from vigil.plans.policies import ALL_POLICIES, raw_violations

#: leading characters of a database name in a numbering bucket
BUCKET_PREFIX = 6
REPORT_COLUMNS = ["server_id", "seq", "policy_no", "policy_name", "db_name", "message"]
POLICY_COLUMNS = ["server_id", "policy_no", "db_name", "stmt_no", "message"]


def plan_numbers(ctx: CheckContext, policy_filter: str | None, invert: bool) -> list[int]:
    """Policies whose scans enter the plan.  The filter is a job parameter, so it
    prunes plan branches up front; the registry frame still decides activity."""
    known = set(ALL_POLICIES) | set(ctx.extra)
    if policy_filter is None:
        return [] if invert else sorted(known)
    listed = set()
    for item in policy_filter.split(","):
        item = item.strip()
        if item.lstrip("-").isdigit():
            listed.add(int(item))
    return sorted(known - listed) if invert else sorted(known & listed)


def apply_eligibility(ctx: CheckContext, v: DataFrame, selected: DataFrame | None = None,
                      require_active: bool = True) -> DataFrame:
    registry = ctx.registry
    if selected is not None:
        registry = registry.join(selected, "policy_no", "left_semi")
    if require_active:
        registry = registry.filter(F.col("is_active"))
    v = v.join(registry.select("policy_no", "policy_name", "processing_order", "online_only"), "policy_no")
    v = v.filter(~F.col("db_level") | ~F.col("online_only") | (F.col("db_state") == 0))
    # a database-level policy speaks of databases of the catalog
    return anti_like(v, "db_name", ctx.exclusions, ["policy_no"], scope=F.col("db_level"),
                     names=ctx.frame("databases").select("name"))


def report_order():
    """Numbering order: processing order; database-level policies run database by
    database (name, case-insensitive) then statement; server-level policies run
    statement by statement; log lines by generation (older first) then time."""
    db_key = F.when(F.col("db_level"), F.lower(F.col("db_name")))
    db_key2 = F.when(F.col("db_level"), F.col("db_name"))
    return [F.col("processing_order").asc(), F.col("policy_no").asc(), db_key.asc_nulls_first(), db_key2.asc_nulls_first(),
            F.col("stmt_no").asc(), F.col("log_order").desc_nulls_last(), F.col("log_date").asc_nulls_first(),
            F.col("db_name").asc_nulls_first(), F.col("message").asc()]


def eligible_violations(ctx: CheckContext, policy_filter: str | None = None, invert: bool = False) -> DataFrame:
    """The report's rows without their numbers."""
    numbers = plan_numbers(ctx, policy_filter, invert)
    # no filter: every registered policy, nothing to intersect
    selected = None if (policy_filter is None and not invert) else reg.policy_filter(ctx.registry, policy_filter, invert)
    return apply_eligibility(ctx, raw_violations(ctx, numbers), selected)


def report_bucket():
    """A prefix of ``report_order``: rows of one bucket are neighbours in the report, and buckets
    compare as the report does (the later generation of a log comes first, hence the minus)."""
    db_key = F.when(F.col("db_level"), F.lower(F.col("db_name")))
    return F.struct(F.col("processing_order").alias("a"), F.col("policy_no").alias("b"),
                    F.substring(db_key, 1, BUCKET_PREFIX).alias("c"),
                    F.when(db_key.isNull(), F.col("stmt_no")).alias("d"),
                    F.when(db_key.isNull(), F.coalesce(-F.col("log_order").cast("long"), F.lit(1 << 40))).alias("e"),
                    F.when(db_key.isNull(), F.date_trunc("hour", "log_date")).alias("f"))


def policy_report(ctx: CheckContext, policy_filter: str | None = None, invert: bool = False) -> DataFrame:
    # columns that the numbered rows do not keep would part the two readers of the exchange (see ``numbering``)
    v = eligible_violations(ctx, policy_filter, invert).drop("db_state", "online_only")
    return number_within(v, "server_id", report_bucket(), report_order(), "seq").select(*REPORT_COLUMNS)


def policy_result(ctx: CheckContext, number: int) -> DataFrame:
    """One policy's eligible violations, whatever its active flag."""
    v = apply_eligibility(ctx, raw_violations(ctx, [number]), require_active=False)
    return v.select(*POLICY_COLUMNS)


def policy_counts(report: DataFrame) -> DataFrame:
    """Messages per server (partial aggregation map-side, then a small shuffle)."""
    return report.groupBy("server_id").agg(F.count(F.lit(1)).alias("n_messages"))


def _escape_html(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


HTML_PAGE_ROWS = 1000


def report_html(report: DataFrame, page_rows: int = HTML_PAGE_ROWS) -> DataFrame:
    """The report as HTML tables, rows in report order, one table per page of
    ``page_rows`` messages of a server -- a server with millions of messages still
    gives bounded groups (``listagg ... within group (order by seq)`` per page)."""
    cell = lambda c: F.concat(F.lit("<td>"), F.coalesce(_escape_html(F.col(c).cast("string")), F.lit("")),
                              F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), cell("seq"), cell("policy_name"), cell("db_name"), cell("message"), F.lit("</tr>"))
    head = ("<table><tr><th>Order</th><th>Policy Name</th><th>Affected DB</th><th>Message</th></tr>")
    page = ((F.col("seq") - 1) / F.lit(page_rows)).cast("bigint") + 1
    return (report.withColumn("_row", row).withColumn("page", page).groupBy("server_id", "page")
                  .agg(F.count(F.lit(1)).alias("n_messages"),
                       F.expr("listagg(_row, '') within group (order by seq)").alias("rows"))
                  .select("server_id", "page", "n_messages",
                          F.concat(F.lit(head), F.col("rows"), F.lit("</table>")).alias("html")))


def write_report(report: DataFrame, path: str, run_date: str) -> None:
    """The ordered report as parquet, one folder per run date; rewriting a run
    date replaces only that partition.  Range partitioning on (server, seq) keeps
    files balanced even when one server holds most messages, and every file holds
    a contiguous, ordered slice."""
    (report.repartitionByRange("server_id", "seq").sortWithinPartitions("server_id", "seq")
           .write.mode("overwrite").parquet(date_folder(path, run_date)))


def date_folder(path: str, run_date: str) -> str:
    """The run date's own folder: overwriting it also clears a date that has no rows any more."""
    return f"{path.rstrip('/')}/run_date={run_date}"


def read_report(spark: SparkSession, path: str, run_date: str) -> DataFrame:
    """One date of a written report; the schema is given, so a date without rows reads as none."""
    schema = "server_id long, seq long, policy_no int, policy_name string, db_name string, message string"
    return spark.read.schema(schema).parquet(date_folder(path, run_date))
