"""Ridgeline functions."""
