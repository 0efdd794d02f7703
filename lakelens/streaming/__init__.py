"""Streams: the run log."""
