"""Streams of results."""
