"""Demand-panel analytics on Spark: sources, features, exploration, models, hierarchies and business queries."""

__version__ = "0.1.0"
