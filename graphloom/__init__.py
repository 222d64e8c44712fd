"""graphloom: property-graph, search and agent-memory analytics as lazy Spark DataFrames."""

from graphloom.plans.engine import Engine

__all__ = ["Engine"]
