"""Input catalog: driver tables and the fixture views built on them.

``FleetInputs`` hands out DataFrames only; nothing is read until an action runs and
nothing is cached, so Catalyst prunes columns and pushes filters into each parquet scan.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from vigil.sources.fixtures import FIXTURE_SQL, references


class FleetInputs:
    def __init__(self, spark: SparkSession, data_dir: str):
        self.spark = spark
        self.data_dir = data_dir
        self._frames: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """A driver table (``<data_dir>/<name>.parquet``)."""
        key = "t:" + name
        if key not in self._frames:
            self._frames[key] = self.spark.read.parquet(os.path.join(self.data_dir, f"{name}.parquet"))
        return self._frames[key]

    def fx(self, name: str) -> DataFrame:
        """A fixture view (see FIXTURES.md) as a DataFrame."""
        if not name.startswith("fx_"):
            name = "fx_" + name
        if name not in self._frames:
            args = {r: (self.fx(r) if r in FIXTURE_SQL else self.table(r)) for r in references(name)}
            self._frames[name] = self.spark.sql(FIXTURE_SQL[name], **args)
        return self._frames[name]

    def __getattr__(self, item: str) -> DataFrame:
        if item.startswith("_"):
            raise AttributeError(item)
        if "fx_" + item in FIXTURE_SQL:
            return self.fx(item)
        raise AttributeError(item)


class SnapshotInputs:
    """Production form: one parquet table per catalog (``<root>/<name>``, e.g.
    ``databases``, ``files``, ``error_log``), columns as in FIXTURES.md, each
    partitioned by snapshot date.  Same interface as ``FleetInputs``."""

    def __init__(self, spark: SparkSession, root: str, snapshot_date: str | None = None):
        self.spark = spark
        self.root = root
        self.snapshot_date = snapshot_date
        self._frames: dict[str, DataFrame] = {}

    def fx(self, name: str) -> DataFrame:
        name = name[3:] if name.startswith("fx_") else name
        if name not in self._frames:
            df = self.spark.read.parquet(os.path.join(self.root, name))
            if self.snapshot_date and "snapshot_date" in df.columns:
                # partition pruning: only the requested snapshot folder is listed and read
                df = df.filter(df.snapshot_date == self.snapshot_date).drop("snapshot_date")
            self._frames[name] = df
        return self._frames[name]
