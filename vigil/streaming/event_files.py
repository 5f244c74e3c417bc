"""Event files that roll by written bytes.

The size of a parquet file is known when it is written, not from its rows.  So each lane (a hash
of the server) writes with the bytes a row that its last files have shown, the files are
measured, a file over the limit is split again by its own figure, and the lane's unfilled last
files are read back and go on with the next batch.  What is closed is never touched again.  Each
micro-batch is one version of the table, so a reader sees whole batches and a batch that is run
again changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.sources.versions import VersionedTable

MAX_FILE_BYTES = 5 * 1024 * 1024  # fixed value: 5 MB
#: a file is full from this share of the limit on
FULL = 0.85
#: attempts to split a file whose rows are larger than those before
SPLITS = 6


class EventFiles:
    """A ``foreachBatch`` sink over a ``VersionedTable``."""

    def __init__(self, spark: SparkSession, path: str, limit: int = MAX_FILE_BYTES, lanes: int = 1, by: str = "server_id"):
        self.spark, self.limit, self.lanes, self.by = spark, limit, lanes, by
        self.table = VersionedTable(spark, path)

    def start(self, events: DataFrame, checkpoint: str, **trigger):
        return (events.writeStream.foreachBatch(lambda df, n: self.batch(df, n))
                      .option("checkpointLocation", checkpoint).trigger(**trigger).start())

    def _write(self, df: DataFrame, rows_a_file: int) -> dict[str, tuple[int, int]]:
        """Write the rows, each lane by one task; bytes and rows of each file."""
        name = f"data/{uuid.uuid4().hex}"
        lane = F.pmod(F.xxhash64(self.by), F.lit(self.lanes))
        (df.repartition(self.lanes, lane).write.option("maxRecordsPerFile", max(1, rows_a_file))
           .parquet(f"{self.table.root}/{name}"))
        return self._measured(self.table.folder.files(name))

    def _measured(self, files: dict[str, int]) -> dict[str, tuple[int, int]]:
        if not files:
            return {}
        path = F.col("_metadata.file_path")
        counted = self.spark.read.parquet(*files).groupBy(path.alias("p")).agg(F.count(F.lit(1)).alias("n"))
        rows = {r.p.rsplit("/", 1)[1]: r.n for r in counted.collect()}  # one row a file
        return {p: (size, rows[p.rsplit("/", 1)[1]]) for p, size in files.items() if p.rsplit("/", 1)[1] in rows}

    def batch(self, df: DataFrame, n: int) -> None:
        base = self.table.current()
        if base.facts.get("batch", -1) >= n:
            return
        unfilled = [p for p in base.facts.get("open", []) if p in base.parts]
        if unfilled:
            df = self.table.read(base, unfilled).unionByName(df)
        a_row = base.facts.get("bytes_a_row")
        files = self._write(df, int(self.limit / a_row) if a_row else 1 << 40)
        for _ in range(SPLITS):
            over = {p: v for p, v in files.items() if v[0] > self.limit and v[1] > 1}
            if not over:
                break
            for p, (size, rows) in over.items():
                del files[p]
                again = self.spark.read.schema(df.schema).parquet(p)
                files |= self._write(again, int(rows * self.limit * (1 + FULL) / 2 / size))
        # of the files of a batch those that are not full stay open
        opened = [p for p, (size, _) in files.items() if size < FULL * self.limit]
        # small files carry more overhead a row; take the figure of the fullest one, and aim between FULL and the limit
        best = max(files.values(), default=None)
        rate = best[0] / best[1] / ((1 + FULL) / 2) if best and best[1] else a_row
        changed: dict[str, str | None] = dict.fromkeys(unfilled) | {p: p for p in files}
        self.table.publish(base, changed, df.schema, batch=n, open=opened, bytes_a_row=rate)

    def files(self) -> dict[str, int]:
        """Bytes of each file of the current version."""
        have = self.table.folder.files("data")
        return {p: have[p] for p in self.table.current().parts}

    def read(self) -> DataFrame:
        return self.table.read()
