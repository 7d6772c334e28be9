"""Spark-first analytics for listing catalogues that change over time."""
