"""Streams of deltas."""
