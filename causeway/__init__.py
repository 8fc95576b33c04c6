"""Causal analytics over execution traces, as Spark DataFrame operators.

Every operator takes and returns DataFrames keyed by ``run_id`` (or
``graph_id``); many runs are handled in one job.
"""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
