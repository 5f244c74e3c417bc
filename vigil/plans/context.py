"""What a check run needs: input frames, registry, exclusions, config, the clock."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.operators import registry as reg


# Settings the built-in policies read.
CONFIG_KEYS = ("pol.allow_sharepoint", "pol.allowed_max_vlf", "pol.required_maxdop", "pol.mirr_safety_level",
               "pol.mirr_conn_timeout", "pol.mirr_partner_name")


_DEFAULTS: dict = {}


def _defaults(spark, maint_db: str):
    """The built-in registry and exclusion frames, built once per session."""
    key = (id(spark), spark.sparkContext.applicationId, maint_db)
    if key not in _DEFAULTS:
        _DEFAULTS[key] = (reg.registry_frame(spark, reg.default_policies(maint_db)),
                          reg.default_exclusions(spark, maint_db))
    return _DEFAULTS[key]


@dataclass
class CheckContext:
    inputs: object                      # anything with .fx(name) -> DataFrame
    as_of: str = "1998-08-02 00:00:00"  # stands for getdate(); explicit, so runs repeat
    maint_db: str = reg.MAINT_DB
    instance_separator: str = "\\"      # between machine and instance of a server name
    registry: DataFrame | None = None
    exclusions: DataFrame | None = None
    config: DataFrame | None = None
    server_config: DataFrame | None = None      # settings of single servers, ahead of ``config``
    extra: dict = field(default_factory=dict)   # user policies: number -> builder

    def __post_init__(self):
        spark = self.frame("servers").sparkSession
        self.spark = spark
        if self.registry is None or self.exclusions is None:
            default_registry, default_exclusions = _defaults(spark, self.maint_db)
            self.registry = default_registry if self.registry is None else self.registry
            self.exclusions = default_exclusions if self.exclusions is None else self.exclusions
        if self.config is None:
            self.config = self.frame("config")

    def frame(self, name: str) -> DataFrame:
        return self.inputs.fx(name)

    def with_cfg(self, df: DataFrame) -> DataFrame:
        """Attach every known setting as one struct column ``_cfg``: a single scalar
        subquery (one small job per query) and, if servers have settings of their own, a join
        on ``server_id``; referenced by ``cfg`` / ``cfg_int``."""
        return reg.with_settings(df, self.config, CONFIG_KEYS, self.server_config)

    def cfg(self, name: str) -> Column:
        return F.col("_cfg").getField(reg.config_field(name))

    def cfg_int(self, name: str) -> Column:
        return self.cfg(name).try_cast("int")

    def as_of_col(self) -> Column:
        return F.lit(self.as_of).cast("timestamp_ntz")
