"""Ridgeline: terrain analytics, landscape models and corpus preparation as Spark jobs."""
