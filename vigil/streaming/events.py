"""Event streams (ST1-ST8): every function takes a batch OR a streaming DataFrame
with the same columns; batch calls are the twins the tests compare against.  Response
suppression (ST5) is in ``throttle``, the event files (S15) in ``event_files``, the collected
counters (S11) in ``counters``.

Event time is cast to ``timestamp`` (session zone UTC) because watermarks reject
``timestamp_ntz``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.streaming.counters import COUNTER_PATH, SAMPLE_WINDOW, split_path
from vigil.streaming.event_files import EventFiles

# Fixed values (must equal the reference's).
WAIT_MIN_DURATION = 15000
WAIT_MIN_SESSION = 50
WAIT_TYPES_IGNORED = ("BROKER_EVENTHANDLER", "BROKER_RECEIVE_WAITFOR", "DBMIRRORING_CMD",
                      "BROKER_TRANSMITTER", "CXPACKET", "DBMIRROR_EVENTS_QUEUE")
# the 2012 event session keys the same six waits by number
WAIT_KEYS_IGNORED_2012 = (178, 121, 122, 173, 191, 144)
PASS_THROUGH_EVENTS = ("blocked_process_report", "xml_deadlock_report")
# what the session adds to a wait event, and to no other
WAIT_ACTIONS = ("client_app_name", "client_hostname", "database_name", "sql_text", "username")
DISPATCH_LATENCY = "30 seconds"
# (name suffix, message id, severity); 0 = not used
ALERT_RULES = (("Filegroup Overflow", 1105, 0), ("TX Log Full", 9002, 0),
               ("No Catalog Entry Found", 608, 0), ("Severity 21 Errors", 0, 21))
ACTIVITY_UPLOAD_WINDOW = "15 minutes"


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    return df.withColumn(column, F.col(column).cast("timestamp"))


def _long_waits(ignored, key: str) -> "Column":
    return ((F.col("event_name") == "wait_info") & (F.col("duration_ms") > WAIT_MIN_DURATION)
            & (F.col("session_id") > WAIT_MIN_SESSION) & ~F.col(key).isin(list(ignored)))


def wait_filter(events: DataFrame, ignored=WAIT_TYPES_IGNORED, key: str = "wait_type") -> DataFrame:
    """ST1: long waits of user sessions, minus the benign wait types.  The list is a
    parameter: by name (default) or, for the older session form, by numeric key
    (``ignored=WAIT_KEYS_IGNORED_2012, key="wait_key"``)."""
    return events.filter(_long_waits(ignored, key))


def session_filter(events: DataFrame, ignored=WAIT_TYPES_IGNORED, key: str = "wait_type") -> DataFrame:
    """ST1 + ST2: what the event session keeps -- filtered waits plus every blocked
    process and deadlock report.  One filter, evaluated before any shuffle.  Only waits carry
    the session's actions (client, database, statement, login)."""
    kept = events.filter(_long_waits(ignored, key) | F.col("event_name").isin(list(PASS_THROUGH_EVENTS)))
    return kept.withColumns({c: F.when(F.col("event_name") == "wait_info", F.col(c)) for c in WAIT_ACTIONS if c in kept.columns})


def alert_rules(maint_db: str) -> list[tuple[str, int, int]]:
    """(alert name, message id, severity) of each rule."""
    return [(f"{maint_db} {n}", m, s) for n, m, s in ALERT_RULES]


def alert_match(events: DataFrame, rules: list[tuple[str, int, int]]) -> DataFrame:
    """ST4: events that raise an alert -- by message id, or by severity when the rule has no
    message id.  One scan: each row lists the rules it meets (the rules are configuration)."""
    met = F.array_compact(F.array(*[
        F.when(F.col("message_id") == m if m else F.col("severity") == s, F.lit(name)) for name, m, s in rules]))
    return (events.withColumn("alert_name", F.explode(met))
                  .select("event_id", "server_id", "ts", "alert_name", "message_id", "severity"))


def activity_rollup(snapshots: DataFrame, ts_col: str = "snap_time_stamp", watermark: str | None = None) -> DataFrame:
    """ST6: snapshots (taken every 300 s) rolled up per 15-minute upload window."""
    df = event_time(snapshots, ts_col)
    if watermark:
        df = df.withWatermark(ts_col, watermark)
    return (df.groupBy("server_id", F.window(ts_col, ACTIVITY_UPLOAD_WINDOW).alias("w"))
              .agg(F.count(F.lit(1)).alias("n_requests"), F.sum("duration_sec").alias("sum_duration_sec"),
                   F.max("duration_sec").alias("max_duration_sec"))
              .select("server_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                      "n_requests", "sum_duration_sec", "max_duration_sec"))


def perf_rollup(samples: DataFrame, watermark: str | None = None) -> DataFrame:
    """ST7: all counter samples per 60-second window, per server and counter, objects as they are
    named (``counters.counter_rollup`` keeps the collected set)."""
    df = split_path(event_time(samples)).withColumn("object", F.regexp_extract("counter_path", COUNTER_PATH, 1))
    if watermark:
        df = df.withWatermark("ts", watermark)
    return (df.groupBy("server_id", F.window("ts", SAMPLE_WINDOW).alias("w"), "object", "instance", "counter")
              .agg(F.count(F.lit(1)).alias("n_samples"), F.avg("value").alias("avg_value"),
                   F.min("value").alias("min_value"), F.max("value").alias("max_value"))
              .select("server_id", F.col("w.start").alias("window_start"), "object", "instance", "counter",
                      "n_samples", "avg_value", "min_value", "max_value"))


#: how long a rotation of the log may take to be seen
ROTATION_DELAY = "2 days"
LOG_LINE = ["server_id", "log_date", "process_info", "text"]


def log_lines(log: DataFrame, delay: str = ROTATION_DELAY) -> DataFrame:
    """ST8: each line of the error log once, though it is read as generation 0 and, after the
    log was cycled, again as generation 1.  A streamed log forgets lines ``delay`` behind the
    newest one; a table keeps the newest generation of a line.  Equal lines of one moment are one."""
    if log.isStreaming:
        return event_time(log, "log_date").withWatermark("log_date", delay).dropDuplicatesWithinWatermark(LOG_LINE)
    return log.groupBy(*LOG_LINE).agg(F.min("log_order").alias("log_order")).select(*log.columns)


def run_available_now(df: DataFrame, out_path: str, checkpoint: str, output_mode: str = "append") -> None:
    """Drain a streaming frame to parquet."""
    q = (df.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint)
           .outputMode(output_mode).trigger(availableNow=True).start())
    q.awaitTermination()


def stream_fixture(spark: SparkSession, data_dir: str, view: str, max_files_per_trigger: int = 1) -> DataFrame:
    """A fixture view over a streaming read of the driver's ``events`` table: the
    same SQL as the batch view, so stream and batch results are comparable."""
    import os

    from vigil.sources.fixtures import FIXTURE_SQL, references
    events_path = os.path.join(data_dir, "events.parquet")
    schema = spark.read.parquet(events_path).schema
    if os.path.isdir(events_path):
        reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
        stream = reader.parquet(events_path)
    else:  # a single file: stream its folder, filtered to that file name
        reader = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
                       .option("pathGlobFilter", "events.parquet"))
        stream = reader.parquet(data_dir)
    name = view if view.startswith("fx_") else "fx_" + view
    assert references(name) == ["events"], name
    return spark.sql(FIXTURE_SQL[name], events=stream)


def event_session(events: DataFrame, out_path: str, checkpoint: str, sink: EventFiles | None = None, **trigger):
    """ST1/ST2 + S15 as a running query: the session filter over an event stream, dispatched every
    30 seconds to event files that roll at 5 MB.  Returns the started ``StreamingQuery``."""
    sink = sink or EventFiles(events.sparkSession, out_path)
    return sink.start(session_filter(events), checkpoint, **(trigger or {"processingTime": DISPATCH_LATENCY}))
