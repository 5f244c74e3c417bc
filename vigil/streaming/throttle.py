"""Alert response suppression (ST5): an alert answers an event only if its last response is at
least the delay old.

**Table.**  Which events get a response looks sequential, but an event that follows its
predecessor by the delay or more always gets one.  Time is cut into cells of one delay; cells
whose first event is that far from the last of the cell before begin a *segment*, and segments
do not depend on one another.  A long segment (an alert that never rests) is cut further into
pieces.  What enters a piece is one time, so a piece is a function from the event that first
responds in it to its last response; those functions are computed for all pieces at once, joined
along the segment on that small table, and then all pieces run apart.

**Stream.**  Events are buffered and released in time order once the watermark (largest event
time less the lateness) has passed them; the released ones go through the table form with the
alerts' last responses ahead of them.  An event behind the watermark goes to an output of its own.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.sources.versions import Folder

DELAY_SECONDS = 3600  # fixed value
_DELAY = DELAY_SECONDS * 1_000_000
#: cells in a piece of a segment
PIECE_CELLS = 48
KEY = ["server_id", "alert_name"]
_PIECE = [*KEY, "segment", "piece"]
EVENT = "event_id long, server_id long, alert_name string, ts timestamp"


def _responses(us: np.ndarray, first: int) -> list[int]:
    """Places of the responses among sorted times, from the one at ``first`` on."""
    out, i = [], first
    while i < len(us):
        out.append(i)
        i = int(np.searchsorted(us, us[i] + _DELAY))
    return out


def _last_responses(pdf: pd.DataFrame) -> pd.DataFrame:
    """One piece: for each event that may be its first response, its last one."""
    us = np.sort(pdf["us"].to_numpy())
    # the first response is in the first cell, or else the first event after it
    may = int(np.searchsorted(us // _DELAY, us[0] // _DELAY, side="right")) + 1
    at = np.arange(min(may, len(us)))
    while True:
        after = np.searchsorted(us, us[at] + _DELAY)
        if (after >= len(us)).all():
            break
        at = np.where(after < len(us), after, at)
    row = {k: pdf[k].iloc[0] for k in _PIECE}
    return pd.DataFrame({**row, "first_us": us[:len(at)], "last_us": us[at]})


def _along(frames):
    """Pieces of each segment in order: the time from which a piece may respond."""
    segment = piece = allowed = None
    for pdf in frames:
        out = []
        for row in pdf.itertuples(index=False):
            key = (row.server_id, row.alert_name, row.segment)
            if key != segment:
                segment, piece, allowed = key, None, None
            if row.piece != piece and (allowed is None or row.first_us >= allowed):
                piece, allowed = row.piece, row.last_us + _DELAY
                out.append((*key, row.piece + 1, allowed))
        yield pd.DataFrame(out, columns=[*_PIECE, "allowed_us"])


def _run(frames):
    """The responses of pieces that follow one another in time order."""
    key = last = None
    for pdf in frames:
        keep = np.zeros(len(pdf), dtype=bool)
        us, allowed = pdf["us"].to_numpy(), pdf["allowed_us"].to_numpy()
        own = list(zip(*[pdf[k] for k in _PIECE]))
        edges = [0, *[i for i in range(1, len(own)) if own[i] != own[i - 1]], len(own)]
        for a, b in zip(edges[:-1], edges[1:]):
            if a == b:
                continue
            if own[a] != key:
                key, last = own[a], allowed[a] - _DELAY
            found = _responses(us[a:b], int(np.searchsorted(us[a:b], last + _DELAY)))
            if found:
                keep[[a + i for i in found]], last = True, us[a + found[-1]]
        yield pdf.loc[keep, ["event_id", "server_id", "alert_name", "ts"]]


def throttled(matches: DataFrame, piece_cells: int = PIECE_CELLS) -> DataFrame:
    """The events that get a response (event_id, server_id, alert_name, ts), whatever the order of
    files.  Of events at the same time the smallest id answers; rows without a time never do."""
    e = (matches.filter(F.col("ts").isNotNull()).groupBy(*KEY, F.col("ts").cast("timestamp").alias("ts"))
                .agg(F.min("event_id").alias("event_id")).withColumn("us", F.unix_micros("ts"))
                .withColumn("cell", F.floor(F.col("us") / F.lit(_DELAY))))
    along = Window.partitionBy(*KEY).orderBy("cell")
    rest = F.col("lo") - F.lag("hi").over(along)
    cells = e.groupBy(*KEY, "cell").agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    cells = cells.withColumn("begins", F.when(rest.isNull() | (rest >= _DELAY), F.col("cell")))
    cells = cells.withColumn("segment", F.max("begins").over(along))
    cells = cells.select(*KEY, "cell", "segment", F.floor((F.col("cell") - F.col("segment")) / piece_cells).alias("piece"))
    e = e.join(cells, [*KEY, "cell"])

    # pieces that another one of their segment follows
    pieces = cells.select(*_PIECE).distinct()
    followed = pieces.filter("piece > 0").withColumn("piece", F.col("piece") - 1)
    ends = (e.join(followed, _PIECE, "left_semi").select(*_PIECE, "us").groupBy(*_PIECE)
             .applyInPandas(_last_responses, "server_id long, alert_name string, segment long, piece long, first_us long, last_us long"))
    allowed = (ends.repartition(*KEY, "segment").sortWithinPartitions(*KEY, "segment", "piece", "first_us")
                   .mapInPandas(_along, "server_id long, alert_name string, segment long, piece long, allowed_us long"))
    e = e.join(allowed, _PIECE, "left").withColumn("allowed_us", F.coalesce("allowed_us", F.lit(-(1 << 62))))
    return (e.select(*_PIECE, "event_id", "ts", "us", "allowed_us").repartition(*_PIECE)
             .sortWithinPartitions(*_PIECE, "us").mapInPandas(_run, EVENT))


class AlertThrottle:
    """ST5 as a running query: ``foreachBatch`` state in versions under ``base``.

    ``base``/responses and ``base``/late hold a folder for each micro-batch, so a batch that is
    run again writes the same place.  State of batch n (events not yet released, last responses
    within their delay) lies in ``base``/state/n and counts once n.json stands beside it.
    """

    def __init__(self, spark: SparkSession, base: str, lateness_seconds: int = 600):
        self.spark, self.base, self.lateness = spark, base.rstrip("/"), lateness_seconds * 1_000_000
        self.folder = Folder(spark, self.base)

    def start(self, matches: DataFrame, **trigger):
        columns = matches.select("event_id", "server_id", "alert_name", F.col("ts").cast("timestamp").alias("ts"))
        return (columns.writeStream.foreachBatch(lambda df, n: self.batch(df, n))
                       .option("checkpointLocation", f"{self.base}/checkpoint").trigger(**trigger).start())

    def _state(self, before: int) -> tuple[int | None, DataFrame, DataFrame]:
        """(watermark, buffer, last responses) after the batches before ``before``."""
        done = [int(n[:-5]) for n in self.folder.names("state") if n.endswith(".json") and int(n[:-5]) < before]
        if not done:
            none = self.spark.createDataFrame([], EVENT)
            return None, none, none
        n = max(done)
        read = lambda kind: self.spark.read.schema(EVENT).parquet(f"{self.base}/state/{n}/{kind}")
        return json.loads(self.folder.text(f"state/{n}.json"))["watermark"], read("buffer"), read("last")

    def batch(self, df: DataFrame, n: int, close: bool = False) -> None:
        if f"{n}.json" in self.folder.names("state"):
            return  # its outputs and its state are there
        watermark, buffer, last = self._state(n)
        us = F.unix_micros("ts")
        late = F.lit(False) if watermark is None else us < watermark
        df = df.persist()
        try:
            top = df.agg(F.max(us)).first()[0]
            moved = max((x for x in (watermark, None if top is None else top - self.lateness) if x is not None), default=None)
            moved = (1 << 62) if close else moved
            self._write(df.filter(late), f"late/batch={n}")
            pending = buffer.unionByName(df.filter(~late))
            free = F.lit(False) if moved is None else us < moved
            # a last response leads its alert's events and so is the first to answer; it has no event
            led = pending.filter(free).unionByName(last.withColumn("event_id", F.lit(None).cast("long")))
            self._write(throttled(led).filter("event_id is not null"), f"responses/batch={n}")
            answered = self.spark.read.schema(EVENT).parquet(f"{self.base}/responses/batch={n}")
            newest = last.unionByName(answered).groupBy(*KEY).agg(F.max_by("event_id", "ts").alias("event_id"), F.max("ts").alias("ts"))
            # whatever comes after the watermark is answered anyway once the delay is over
            self._write(newest.filter(F.lit(True) if moved is None else us + _DELAY > moved), f"state/{n}/last")
            self._write(pending.filter(~free), f"state/{n}/buffer")
        finally:
            df.unpersist()
        self.folder.put_once(f"state/{n}.json", json.dumps({"watermark": moved}))

    def close(self) -> None:
        """Release what is still buffered (at the end of a bounded stream)."""
        done = [int(n[:-5]) for n in self.folder.names("state") if n.endswith(".json")]
        self.batch(self.spark.createDataFrame([], EVENT), max(done, default=-1) + 1, close=True)

    def _write(self, df: DataFrame, name: str) -> None:
        df.select("event_id", "server_id", "alert_name", "ts").write.mode("overwrite").parquet(f"{self.base}/{name}")

    def _read(self, name: str) -> DataFrame:
        paths = [f"{self.base}/{name}/{n}" for n in self.folder.names(name) if n.startswith("batch=")]
        return self.spark.read.schema(EVENT).parquet(*paths) if paths else self.spark.createDataFrame([], EVENT)

    def responses(self) -> DataFrame:
        return self._read("responses")

    def late(self) -> DataFrame:
        return self._read("late")
