"""Fixture views, log readers and sinks."""
