"""Bulk Spark operators over agent telemetry, retrieval indexes and device measurements."""
