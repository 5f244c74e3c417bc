"""vigil — fleet-wide configuration and health checks for database servers, on Spark.

Every input is a snapshot table keyed by ``server_id``; every check is a set-based
DataFrame over the whole fleet.  See README.md for the module map.
"""

__all__ = ["session", "sources", "functions", "operators", "plans", "streaming"]
