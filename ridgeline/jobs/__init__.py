"""Ridgeline jobs."""
