"""Observations as streams."""
