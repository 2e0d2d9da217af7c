"""Narrative and coordination analytics as plain PySpark DataFrame operators.

Sub-packages
------------
functions   column expressions and fixed lookup values
sources     readers, payload normalisers, ingest steps, exports
operators   DataFrame -> DataFrame analytics
plans       views over the benchmark tables and the query catalogue
streaming   Structured Streaming counterparts
"""

__all__ = ["functions", "sources", "operators", "plans", "streaming"]
